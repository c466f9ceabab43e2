"""Media columns: MPEG transport streams.

``mux`` stores a payload losslessly as a transport stream: program tables (PAT,
PMT), then packetised elementary stream (PES) packets with a presentation time
stamp each; every ``KEY_EVERY``-th access unit is a random-access point with a
clock reference, preceded by fresh program tables. ``demux`` parses any such
stream: it follows PAT to PMT to elementary PIDs, verifies section checksums,
checks continuity counters, reassembles PES packets and indexes time stamps, each
PID by itself. Sections may span packets; null packets have no counter; a packet
may come twice, and a counter may jump where its packet says so.

Defined results: a null or empty payload gives one access unit of no bytes (the
query pads, so it always has at least 64); a damaged stream is parsed as far as
it goes, with the damage counted (``sync_errors``, ``cc_errors``,
``psi_errors``). A very long text is one stream, held once at a time; an empty table
gives an empty one. Repeated rows give equal values, a null doc_id stays null. Input
columns other than the two named are ignored, so they may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

PACKET, BODY = 188, 184
PMT_PID, ES_PID, NULL_PID, PROGRAM = 0x1000, 0x0100, 0x1FFF, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in PES, private stream 1
UNIT, KEY_EVERY = 8192, 4  # bytes in an access unit; units from one random-access point to the next
TICKS = 3600  # of 90 kHz between access units: 25 a second


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


_PAT = b"\x00" + _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = b"\x00" + _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def _unstamp(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def _clock(base: int) -> bytes:
    """A program clock reference: 33 bits at 90 kHz, 6 reserved ones, 9 bits of 27 MHz."""
    return (base << 15 | 0x7E00).to_bytes(6, "big")


_HEAD = {(start, has_field, cc): bytes([0x47, start << 6 | ES_PID >> 8, ES_PID & 0xFF, (0x30 if has_field else 0x10) | cc]) for start in (0, 1) for has_field in (0, 1) for cc in range(16)}


def mux(payload: bytes, unit: int = UNIT, key_every: int = KEY_EVERY) -> bytes:
    out: list[bytes] = []
    cc = tables = 0
    for n, at in enumerate(range(0, max(1, len(payload)), unit)):
        key = n % key_every == 0
        if key:
            for pid, section in ((0, _PAT), (PMT_PID, _PMT)):
                out.append(bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10 | tables & 15]) + section.ljust(BODY, b"\xff"))
            tables += 1
        pts = (n + 1) * TICKS & 0x1FFFFFFFF
        part = payload[at : at + unit]
        data = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + part
        extra = b"\x50" + _clock(pts - TICKS) if key else b""  # flags: random access, clock reference
        i, end, first = 0, len(data), 1
        while i < end:
            room = BODY - (1 + len(extra) if extra else 0)
            take = min(room, end - i)
            if take == BODY:
                out += (_HEAD[first, 0, cc], data[i : i + BODY])
            else:
                size = BODY - take - 1  # of the adaptation field after its length byte
                out += (_HEAD[first, 1, cc], bytes([size]), (extra or b"\x00" * (size > 0)).ljust(size, b"\xff"), data[i : i + take])
            i, first, extra, cc = i + take, 0, b"", cc + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds. payloads: of each elementary PID its data;
    units: (PID, PTS, byte offset of the packet it starts in, offset of its data in
    the PID's payload, random access), in the order in which they end."""

    payloads: dict[int, bytes] = field(default_factory=dict)
    packets: int = 0
    sync_errors: int = 0
    cc_errors: int = 0
    psi_errors: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    units: list[tuple[int, int | None, int, int, bool]] = field(default_factory=list)
    clocks: list[int] = field(default_factory=list)

    @property
    def payload(self) -> bytes:
        """The data of all elementary PIDs, by PID."""
        return b"".join(x for _, x in sorted(self.payloads.items()))


@dataclass
class _Pid:
    """One PID's state: its counter, the packet last taken, and what is not yet whole."""

    counter: int = -1
    body: bytes = b""
    repeated: bool = False
    pes: list[bytes] = field(default_factory=list)
    pes_at: int = 0
    pes_key: bool = False
    done: list[bytes] = field(default_factory=list)
    total: int = 0
    section: bytearray | None = None

    def end_pes(self, s: Stream, pid: int) -> None:
        if not self.pes:
            return
        whole = b"".join(self.pes)
        self.pes = []
        if whole[:3] != b"\x00\x00\x01" or len(whole) < 9 or len(whole) < 9 + whole[8] or whole[7] & 0x80 and whole[8] < 5:
            s.sync_errors += 1  # no start code, or cut off within its header
            return
        size, head = int.from_bytes(whole[4:6], "big"), 9 + whole[8]
        data = whole[head : 6 + size] if size else whole[head:]
        s.units.append((pid, _unstamp(whole[9:14]) if whole[7] & 0x80 else None, self.pes_at, self.total, self.pes_key))
        self.done.append(data)
        self.total += len(data)

    def sections(self, s: Stream, body: bytes, start: bool) -> list[bytes]:
        """The sections that this packet completes; they may span packets."""
        if start:
            at = 1 + body[0]
            out = self.whole(s, body[1:at])
            if self.section:
                s.psi_errors += 1  # it never ended
            self.section = bytearray()
            return out + self.whole(s, body[at:])
        return self.whole(s, body)

    def whole(self, s: Stream, data: bytes) -> list[bytes]:
        out: list[bytes] = []
        if self.section is None:
            return out
        self.section += data
        while len(self.section) >= 3 and self.section[0] != 0xFF:
            size = 3 + (int.from_bytes(self.section[1:3], "big") & 0x0FFF)
            if len(self.section) < size:
                return out
            one = bytes(self.section[:size])
            del self.section[:size]
            if size < 12 or crc32_mpeg(one):
                s.psi_errors += 1
            else:
                out.append(one)
        if self.section[:1] == b"\xff":  # stuffing up to the end of the packet
            self.section = None
        return out


def _learn(s: Stream, section: bytes) -> None:
    """Program tables: of a PAT the program's PMT PIDs, of a PMT its elementary PIDs."""
    x = section[8:-4]
    if section[0] == 0:
        s.programs |= {p: int.from_bytes(x[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(x) - 3, 4) if (p := int.from_bytes(x[i : i + 2], "big"))}
    elif section[0] == 2:
        i = 4 + (int.from_bytes(x[2:4], "big") & 0x0FFF)
        while i + 5 <= len(x):
            s.streams[int.from_bytes(x[i + 1 : i + 3], "big") & 0x1FFF] = x[i]
            i += 5 + (int.from_bytes(x[i + 3 : i + 5], "big") & 0x0FFF)


def demux(media: bytes) -> Stream:
    s = Stream()
    pids: dict[int, _Pid] = {}
    tables = {0}
    for at in range(0, len(media) - PACKET + 1, PACKET):
        b1, flags = media[at + 1], media[at + 3]
        if media[at] != 0x47 or b1 & 0x80:
            s.sync_errors += 1
            continue
        s.packets += 1
        pid, body = (b1 & 0x1F) << 8 | media[at + 2], at + 4
        if pid == NULL_PID:
            continue
        key = jump = False
        if flags & 0x20:
            size = media[body]
            if size:
                told = media[body + 1]
                jump, key = bool(told & 0x80), bool(told & 0x40)
                if told & 0x10:
                    s.clocks.append(int.from_bytes(media[body + 2 : body + 8], "big") >> 15)
            body += 1 + size
        if not flags & 0x10:
            continue
        p = pids.get(pid) or pids.setdefault(pid, _Pid())
        data, counter = media[body : at + PACKET], flags & 15
        if p.counter >= 0 and not jump and counter != p.counter + 1 & 15:
            if counter == p.counter and data == p.body and not p.repeated:
                p.repeated = True  # a packet may come twice
                continue
            s.cc_errors += 1
        p.counter, p.body, p.repeated = counter, data, False
        if pid in s.streams:
            if b1 & 0x40:
                p.end_pes(s, pid)
                p.pes_at, p.pes_key = at, key
            if b1 & 0x40 or p.pes:
                p.pes.append(data)
        elif pid in tables and data:
            for section in p.sections(s, data, bool(b1 & 0x40)):
                _learn(s, section)
            tables = {0, *s.programs.values()}
    for pid, p in pids.items():
        p.end_pes(s, pid)
        s.psi_errors += bool(p.section)
        if pid in s.streams:
            s.payloads[pid] = b"".join(p.done)
    return s


def feature(s: Stream) -> str:
    """The program map, counters and time index on one line."""
    stamps = [u[1] for u in s.units if u[1] is not None]
    return ";".join(
        [
            "programs=" + ",".join(f"{k}@{v:#06x}" for k, v in sorted(s.programs.items())),
            "streams=" + ",".join(f"{v:#04x}@{k:#06x}" for k, v in sorted(s.streams.items())),
            f"packets={s.packets}",
            f"errors={s.sync_errors}/{s.cc_errors}/{s.psi_errors}",
            f"units={len(s.units)}",
            f"keys={sum(u[4] for u in s.units)}",
            f"pts={min(stamps, default=0)}-{max(stamps, default=0)}",
            f"clocks={len(s.clocks)}",
        ]
    )


def pad(data: bytes, to: int = 64) -> bytes:
    """Appends bytes 0 up to a positive multiple of ``to``."""
    return data + bytes(-len(data) % to or (0 if data else to))


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text, padded, as a transport stream. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, texts), pa.int64()), pa.array([mux(pad(t)) for t in texts], pa.binary())],
                names=[id_col, "n_bytes", "media"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


UNITS = "array<struct<pid: int, pts: long, packet_at: long, payload_at: long, random_access: boolean>>"


def read_streams(media: DataFrame, id_col: str = "doc_id", with_payload: bool = True) -> DataFrame:
    """Parses a column ``media``: payload, digests, feature string and the index
    of access units, by which a reader can seek to a random-access point. A null
    medium counts as a stream of no packets. Without ``with_payload`` a payload is let go
    as soon as its digests are taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pa.list_(pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("packet_at", pa.int64()), ("payload_at", pa.int64()), ("random_access", pa.bool_())]))
        names = ("pid", "pts", "packet_at", "payload_at", "random_access")
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), index, pa.binary()]
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                blob = b.column(2)[k].as_py() or b""
                s = demux(blob)
                payload = s.payload
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(s), [dict(zip(names, u)) for u in s.units])
                rows.append((*row, payload) if with_payload else row)
            columns = list(zip(*rows)) or [()] * (7 + with_payload)
            out = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "units", "payload"]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=[id_col, "n_bytes", *out[: len(columns)]])

    kind = media.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, units {UNITS}"
    return media.select(id_col, "n_bytes", "media").mapInArrow(run, schema + ", payload binary" * with_payload)


def media_digests(docs: DataFrame) -> DataFrame:
    """The digest columns of every document's stream, plus its time index."""
    return read_streams(encode_texts(docs), with_payload=False)
