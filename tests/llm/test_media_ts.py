import hashlib
import random
import zlib

from edge import EDGE_TEXTS, edge_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import media_ts as M


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40_000), st.integers(1, 9000), st.integers(1, 5))
def test_round_trip(data, unit, every):
    media = M.mux(data, unit, every)
    assert len(media) % M.PACKET == 0 and set(media[:: M.PACKET]) == {0x47}
    s = M.demux(media)
    assert s.payload == data
    assert (s.sync_errors, s.cc_errors, s.psi_errors) == (0, 0, 0)
    assert s.programs == {1: M.PMT_PID} and s.streams == {M.ES_PID: M.STREAM_TYPE}
    n = max(1, -(-len(data) // unit))
    assert [u[1] for u in s.units] == [(i + 1) * M.TICKS for i in range(n)]
    assert [u[4] for u in s.units] == [i % every == 0 for i in range(n)]
    assert [u[3] for u in s.units] == [i * unit for i in range(n)]


def test_stamps_and_checksum():
    for pts in (0, 1, 2**33 - 1, 0x155555555):
        assert M._unstamp(M._stamp(pts)) == pts
    assert M.crc32_mpeg(b"123456789") == 0x0376E6E7  # published check value


def test_damage_is_counted():
    data = random.Random(1).randbytes(30_000)
    media = bytearray(M.mux(data))
    lost = media[: 40 * 188] + media[41 * 188 :]
    assert M.demux(bytes(lost)).cc_errors == 1
    media[10] ^= 1
    assert M.demux(bytes(media)).psi_errors == 1
    media[5 * 188] = 0
    assert M.demux(bytes(media)).sync_errors >= 1
    assert M.demux(b"") .packets == 0


def packets(media):
    return [media[i : i + M.PACKET] for i in range(0, len(media), M.PACKET)]


def pid_of(p):
    return (p[1] & 0x1F) << 8 | p[2]


def program_map(pids, filler=0):
    """A PMT section of several streams, with a descriptor of ``filler`` bytes for each."""
    body = (0xE000 | pids[0]).to_bytes(2, "big") + b"\xf0\x00"
    for p in pids:
        body += bytes([M.STREAM_TYPE]) + (0xE000 | p).to_bytes(2, "big") + (0xF000 | filler).to_bytes(2, "big") + b"\x05" * filler
    return M._section(2, M.PROGRAM, body)


def section_packets(pid, section):
    data, out = b"\x00" + section, []
    for k, at in enumerate(range(0, len(data), M.BODY)):
        out.append(bytes([0x47, (0x40 if k == 0 else 0) | pid >> 8, pid & 0xFF, 0x10 | k & 15]) + data[at : at + M.BODY].ljust(M.BODY, b"\xff"))
    return out


def interleaved(parts, filler=0, seed=1):
    """Several elementary streams in one, their packets mixed at random."""
    pids = [M.ES_PID + 7 * k for k in range(len(parts))]
    out = [p for p in packets(M.mux(b"")) if pid_of(p) == 0] + section_packets(M.PMT_PID, program_map(pids, filler))
    queues = []
    for pid, data in zip(pids, parts):
        own = [p for p in packets(M.mux(data)) if pid_of(p) == M.ES_PID]
        queues.append([p[:1] + bytes([p[1] & 0xE0 | pid >> 8, pid & 0xFF]) + p[3:] for p in own])
    rng = random.Random(seed)
    while any(queues):
        out.append(rng.choice([q for q in queues if q]).pop(0))
    return out, pids


def test_interleaved_streams_keep_apart():
    rng = random.Random(2)
    parts = [rng.randbytes(20_000), rng.randbytes(20_000), rng.randbytes(33)]
    for filler in (0, 200):  # sections longer than a packet
        mixed, pids = interleaved(parts, filler)
        s = M.demux(b"".join(mixed))
        assert s.payloads == dict(zip(pids, parts)) and s.payload == b"".join(parts)
        assert (s.sync_errors, s.cc_errors, s.psi_errors) == (0, 0, 0)
        assert s.streams == {p: M.STREAM_TYPE for p in pids}
        for pid, data in zip(pids, parts):
            assert [u[3] for u in s.units if u[0] == pid] == list(range(0, len(data), M.UNIT))


def test_null_and_repeated_packets_are_no_damage():
    data = random.Random(3).randbytes(20_000)
    plain = packets(M.mux(data))
    null = bytes([0x47, 0x1F, 0xFF, 0x10]) + bytes(M.BODY)
    out = []
    for k, p in enumerate(plain):
        out += [p, null] if k % 3 == 0 else [p, p] if k % 3 == 1 else [p]
    s = M.demux(b"".join(out))
    assert s.payload == data and (s.sync_errors, s.cc_errors, s.psi_errors) == (0, 0, 0)
    thrice = [q for p in plain for q in ([p, p, p] if p is plain[9] else [p])]
    assert M.demux(b"".join(thrice)).cc_errors >= 1


def test_a_jump_that_is_told_is_no_damage():
    plain = packets(M.mux(random.Random(4).randbytes(40_000)))
    k = next(i for i, p in enumerate(plain) if i > 60 and p[1] & 0x40 and pid_of(p) == M.ES_PID and p[3] & 0x20)
    told = plain[k][:5] + bytes([plain[k][5] | 0x80]) + plain[k][6:]
    before = plain[: k - 3] + plain[k - 2 :]  # a lost packet
    assert M.demux(b"".join(before)).cc_errors == 1
    assert M.demux(b"".join([*plain[: k - 1], told, *plain[k + 1 :]])).cc_errors == 0


def test_a_section_that_never_ends_is_counted():
    part = section_packets(M.PMT_PID, program_map([M.ES_PID], 400))[:1]
    pat = [p for p in packets(M.mux(b"")) if pid_of(p) == 0]
    assert M.demux(b"".join(pat + part)).psi_errors == 1


def test_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (3, None)], "doc_id long, text string")
    rows = M.media_digests(docs).collect()
    assert sorted((r.doc_id is None, r.n_bytes) for r in rows) == [(False, 0), (True, 1), (True, 1)]


def test_digests_of_awkward_texts(spark):
    rows = {r.doc_id: r for r in M.media_digests(edge_docs(spark)).collect()}
    for i, t in enumerate(EDGE_TEXTS):
        raw = (t or "").encode()
        want = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    assert rows[6].feature == rows[7].feature and rows[6].media_sha256 == rows[7].media_sha256
    assert M.media_digests(edge_docs(spark, [])).count() == 0


def test_pes_header_that_is_cut_off():
    for head in (b"\x00\x00\x01\xe0\x00\x00\x80\x80\x05\x21", b"\x00\x00\x01\xe0\x00\x00\x80\x80\x01\x21", b"\x00\x00\x01\xe0\x00\x00\x80\x00\x09", b"\x00\x00\x01"):
        s, pid = M.Stream(), M._Pid()
        pid.pes = [head]
        pid.end_pes(s, 256)
        assert s.sync_errors == 1 and not s.units
