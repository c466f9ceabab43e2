"""Best-fit packing by large-item matching.

Documents become token pieces of at most ``capacity``. Lengths are whole numbers
up to ``capacity``, so the histogram of lengths, whose size depends on
``capacity`` alone, says all that packing needs: the driver plans with counts,
not with documents. Pieces above a third of the capacity share a sequence with
at most one other of their kind; a greedy matching pairs each, longest first,
with the longest partner that fits. The smaller pieces then go, longest first,
to the tightest gap that holds them. The plan is a short table of index ranges
per length; each piece gets its place from its number among the pieces of equal
length, counted in two steps so that a length holding a third of all rows is
never one task's work.

Defined results: a null text is empty; an empty text is one piece, of the end
token only; only documents longer than the capacity are cut, and their first
piece takes the remainder; pieces of equal length are numbered in the order of
their other columns; an empty table gives no rows; repeated rows are packed as often
as they occur; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 2048
END = 0
CHUNK = 50_000  # rows at most, about, in a numbered group
#: Below U+0250 both libraries split texts alike (tests go through all of them).
_OTHER = re.compile("[^\x00-\u024f]")


@lru_cache(maxsize=4)
def tokenizer(name: str):
    """A function from a text to the ids that the ``tokenizers`` library gives.
    The same vocabulary as ranks, read by ``tiktoken``, is several times faster; it
    takes the texts on which both are known to agree, and the library the rest."""
    import public_tokenizers as vocabularies
    import tiktoken

    whole = None
    with open(vocabularies.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def known(text: str) -> bool:
        if "<|" in text:  # may start a special token
            return False
        try:
            return text.isascii() or bool(text.encode("latin-1"))
        except UnicodeEncodeError:
            return not _OTHER.search(text)

    def encode(text: str) -> list[int]:
        nonlocal whole
        if known(text):
            return fast.encode_ordinary(text)
        if whole is None:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(vocabularies.path(f"{name}.json"))
        return whole.encode(text, add_special_tokens=False).ids

    return encode


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of n tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, name: str = "byte_bpe_50k", capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): every document's token pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(name)
        for b in batches:
            rows: list[tuple] = []
            at: list[int] = []
            for k, text in enumerate(b.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END], "<u4")
                for i, (s, n) in enumerate(cuts(len(ids), capacity)):
                    part = ids[s : s + n]
                    at.append(k)
                    rows.append((i, s, n, zlib.crc32(part.tobytes()), part if with_ids else None))
            columns = list(zip(*rows)) or [()] * 5
            arrays = [b.column(0).take(pa.array(at, pa.int32())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:4])]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array([p.astype(np.int64) for p in columns[4]], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(rows (length, from, per, sequence, offset), number of sequences): the pieces
    numbered from ``from`` among those of ``length`` go ``per`` to a sequence, to
    sequences from ``sequence`` on, at ``offset``; a row holds up to the next one."""
    left = {n: c for n, c in histogram.items() if c}
    used: dict[int, int] = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, count)
    total = 0

    def put(n: int, items: int, per: int, sequence: int, offset: int) -> None:
        rows.append((n, used[n], per, sequence, offset))
        used[n] += items
        left[n] -= items

    third = capacity // 3
    large = sorted((n for n in left if n > third), reverse=True)
    for i, a in enumerate(large):
        for b in large[i:]:
            if not left[a]:
                break
            m = left[a] // 2 if a == b else min(left[a], left[b])
            if a + b > capacity or not m:
                continue
            put(a, m, 1, total, 0)
            put(b, m, 1, total, a)
            gaps[capacity - a - b].append((total, m))
            total += m
        if m := left[a]:
            put(a, m, 1, total, 0)
            gaps[capacity - a].append((total, m))
            total += m
    for n in sorted((n for n in left if n <= third), reverse=True):
        for room in range(n, capacity + 1):
            per = room // n
            while gaps[room] and left[n]:
                first, count = gaps[room].pop()
                full = min(count, left[n] // per)
                if full:
                    put(n, full * per, per, first, capacity - room)
                    gaps[room - per * n].append((first, full))
                if full < count and (rest := min(left[n], per)) and left[n] < per:
                    put(n, rest, rest, first + full, capacity - room)
                    gaps[room - rest * n].append((first + full, 1))
                    full += 1
                if full < count:
                    gaps[room].append((first + full, count - full))
            if not left[n]:
                break
        if left[n]:
            per = capacity // n
            full, rest = divmod(left[n], per)
            if full:
                put(n, full * per, per, total, 0)
                gaps[capacity - per * n].append((total, full))
            if rest:
                put(n, rest, rest, total + full, 0)
                gaps[capacity - rest * n].append((total + full, 1))
            total += full + bool(rest)
    return np.array(sorted(rows), np.int64).reshape(-1, 5), total


def number_within(items: DataFrame, key: str, order: list[str], into: str, chunk: int = CHUNK) -> DataFrame:
    """Numbers the rows of each key from 0, in groups of about ``chunk`` rows at
    most: by a hash first, then groups are counted and the counts summed up."""
    groups = max(1, -(-items.count() // chunk))
    dealt = items.withColumn("_group", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int"))
    counts = dealt.groupBy(key, "_group").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(key, "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy(key, "_group").orderBy(*order)) - 1
    return dealt.withColumn("_in", inside).join(firsts, [key, "_group"]).withColumn(into, F.col("_first") + F.col("_in")).drop("_group", "_in", "_first")


def place(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` from 1 to ``capacity``.
    ``items`` is read twice, so it should be a written table."""
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    table, _ = plan(histogram, capacity)
    keys = table[:, 0] << 40 | table[:, 1]
    order = [c for c in items.columns if c not in ("length", "ids")]
    numbered = number_within(items, "length", order, "_i")
    columns = items.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, i = (b.column(c).to_numpy() for c in ("length", "_i"))
            row = table[np.searchsorted(keys, n << 40 | i, "right") - 1]
            at = i - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in columns), pa.array(row[:, 3] + at // row[:, 2]), pa.array(row[:, 4] + at % row[:, 2] * n)],
                names=[*columns, "sequence_id", "offset"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return numbered.select(*columns, "_i").mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, name: str = "byte_bpe_50k", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place in a sequence. Texts are
    tokenized once: the pieces are written before they are counted and placed."""
    return place(materialize(pieces(docs, name, capacity, with_ids=with_ids), "pieces"), capacity)
