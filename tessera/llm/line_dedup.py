"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

A run of consecutive lines with ``MIN_WORDS`` words or more that occurs earlier
as well (by doc_id, then place) is deleted; the first occurrence stays.

Lines that occur once end every run, so a document falls into segments of lines
that occur again somewhere. Equal segments are found at once: all but the first
are later copies, and only the first goes on.

Every step sorts all suffixes of the segments by their first 2s lines: by the
rank of their first s lines and the rank of the s lines after those (the first
step by the 128-bit line IDs themselves). So the sorted table is the suffix array
to that depth, and the place of the first suffix with the same 2s lines is the
next rank. In it the suffixes with a common prefix of m lines are neighbours. One
sweep over the array compares each suffix with the one before: s < m <= 2s lines
are common if the first s and the last s of them have equal ranks. Where a common
prefix ends, an interval of the array ends; its least position is the copy to
keep, all others begin a later copy of m lines.

The lengths m that matter at a line are those of the shortest runs with enough
words from it on, and of those up to some line that begin there: the union of
such runs with an earlier copy is the union of all maximal repeated runs with
enough words, since each line of a maximal run lies in one of them. A segment
leaves the doubling when no longer run is to be looked up.

The sort is by range and by position within equal keys, so that a line or a
passage in a third of all documents is dealt over many tasks; there is a range for
every ``RANGE`` suffixes, so a task's memory does not grow with the table. Intervals
that cross from one task to the next are joined by a summary of each task, which is
one row (its first and last keys and their intervals); those rows are all that
the driver sees. A line with more than a ``HOT``-th of all repeated lines, such as the
empty one, is known by a list of fewer than ``HOT``, and its rows are dealt by place.

Defined results: a null or empty text is unchanged; an empty table gives an empty
one; a very long text is handled whole, its arrays growing with its lines; rows that
repeat doc_id and text are one document; a null doc_id comes first; among copies
with one doc_id the text with the least hash comes first; a document of which every
line goes has the text ""; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import BROADCAST
from .common import WORD, materialize, packed, rows_of, unpacked

MIN_WORDS = 50
_FIRST = -(1 << 63)
_END = -(1 << 63)  # stands after a segment's last line
BATCH = 50_000  # lines in a batch that leaves a Python worker
RANGE = 500_000  # suffixes that a task sweeps
HOT = 1_000

_KEYS = ["a1", "a2", "b1", "b2"]
_NEED = pa.list_(pa.struct([("m", pa.int32()), ("t1", pa.int64()), ("t2", pa.int64())]))
SEGMENT = "_d long, _t long, start int, n int, segment binary, longest int, a1 array<long>, a2 array<long>, more array<array<int>>"
SUFFIX = "_d long, _t long, start int, at int, a1 long, a2 long, b1 long, b2 long, need array<struct<m: int, t1: long, t2: long>>, more array<int>"
SWEPT = "_d long, _t long, start int, at int, part int, place long, first boolean, found int, open array<struct<side: int, m: int>>, more array<int>, summary string"


def shortest_runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lines) by start of the shortest runs with enough words from each line
    on, and up to each line."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(n)
    ends = np.searchsorted(total, total[:-1] + least, "left")
    begins = np.searchsorted(total, total[1:] - least, "right") - 1
    forward, back = ends <= n, begins >= 0
    both = np.concatenate([at[forward] * (n + 1) + (ends - at)[forward], begins[back] * (n + 1) + (at + 1 - begins)[back]])
    both = np.unique(both)
    return both // (n + 1), both % (n + 1)


def _lists(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _segments(lines: DataFrame, min_words: int) -> DataFrame:
    """lines: _d, _t, and ``own``, the document's repeated lines as (pos, h1, h2, words) by pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                own = b.column(2)[k].values
                pos, h1, h2, words = (own.field(i).to_numpy() for i in range(4))
                cut = np.flatnonzero(np.diff(pos) != 1) + 1
                for p, a1, a2, w in zip(np.split(pos, cut), np.split(h1, cut), np.split(h2, cut), np.split(words, cut)):
                    if w.sum() >= min_words:
                        starts, sizes = shortest_runs(w, min_words)
                        more = np.split(sizes, np.searchsorted(starts, np.arange(1, len(w))))
                        name = xxhash.xxh3_128_digest(np.ascontiguousarray(np.stack([a1, a2])).tobytes())
                        rows.append((b.column(0)[k].as_py(), b.column(1)[k].as_py(), int(p[0]), len(p), name, int(sizes.max()), a1, a2, more))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in SEGMENT.split(", ")])

    return lines.mapInArrow(run, SEGMENT)


def suffixes(level: DataFrame, size: int) -> DataFrame:
    """A row for each suffix of each segment: its sort keys, the lengths to look up
    at twice ``size`` lines with the rank of the last ``size`` of them, and the longer ones."""

    def rows(d: int, t: int, start: int, a1: np.ndarray, a2: np.ndarray, counts: np.ndarray, m: np.ndarray) -> tuple:
        n = len(a1)
        ahead = np.minimum(np.arange(size, n + size), n)
        at = np.repeat(np.arange(n), counts)
        now = m <= 2 * size
        last = at + m - size  # line at which the last ``size`` of m lines begin
        tails = [np.where(m > size, np.append(a, _END)[np.minimum(last, n)], 0)[now] for a in (a1, a2)]
        each = lambda keep: np.bincount(at[keep], minlength=n)
        fixed = [np.full(n, d), np.full(n, t), np.full(n, start, np.int32), np.arange(n, dtype=np.int32)]
        return [*fixed, a1, a2, np.append(a1, _END)[ahead], np.append(a2, _END)[ahead]], (each(now), m[now].astype(np.int32), *tails), (each(~now), m[~now].astype(np.int32))

    def batch(done: list[tuple]) -> pa.RecordBatch:
        plain = [pa.array(np.concatenate(c)) for c in zip(*(x[0] for x in done))]
        sizes, m, t1, t2 = (np.concatenate(c) for c in zip(*(x[1] for x in done)))
        need = _lists(pa.StructArray.from_arrays([pa.array(m), pa.array(t1), pa.array(t2)], ["m", "t1", "t2"]), _offsets(sizes))
        sizes, m = (np.concatenate(c) for c in zip(*(x[2] for x in done)))
        return pa.RecordBatch.from_arrays([*plain, need, _lists(pa.array(m), _offsets(sizes))], names=[c.split()[0] for c in SUFFIX.split(", ") if c.split()[0] not in ("t1:", "t2:")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held = [], 0
        for b in batches:
            for k in range(b.num_rows):
                d, t, start = (b.column(i)[k].as_py() for i in range(3))
                a1 = b.column(3)[k].values.to_numpy(zero_copy_only=False)
                a2 = b.column(4)[k].values.to_numpy(zero_copy_only=False) if size == 1 else np.zeros(len(a1), np.int64)
                more = b.column(5)[k].values
                m = more.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                done.append(rows(d, t, start, a1, a2, np.diff(more.offsets.to_numpy()), m))
                if (held := held + len(a1)) >= BATCH:
                    yield batch(done)
                    done, held = [], 0
        if done:
            yield batch(done)

    second = "a2" if size == 1 else F.lit(None).cast("array<long>").alias("a2")
    return level.select("_d", "_t", "start", "a1", second, "more").mapInArrow(run, SUFFIX)


def _sweep(rows: pa.Table, part: int) -> pa.RecordBatch:
    """One task's stretch of the suffix array: each suffix's place, and the length of
    the longest later copy that begins there; what depends on the neighbouring tasks
    stays open."""
    rows = rows.combine_chunks()
    keys = [rows[c].to_numpy() for c in _KEYS]
    order = np.lexsort(keys[::-1])
    rows, keys = rows.take(pa.array(order)).combine_chunks(), [k[order] for k in keys]
    n = rows.num_rows
    d, t, start, at = (rows[c].to_numpy() for c in ("_d", "_t", "start", "at"))
    line = start.astype(np.int64) + at
    new = np.ones(n, bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    place = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    same_head = np.zeros(n, bool)
    same_head[1:] = (keys[0][1:] == keys[0][:-1]) & (keys[1][1:] == keys[1][:-1])

    need = rows["need"].chunk(0) if n else pa.array([], _NEED)
    sizes = np.diff(need.offsets.to_numpy())
    row = np.repeat(np.arange(n), sizes)
    m, t1, t2 = (c.to_numpy(zero_copy_only=False) for c in need.flatten().flatten())
    by = np.argsort(m, kind="stable")
    row, m, t1, t2 = row[by], m[by], t1[by], t2[by]
    new = np.ones(len(m), bool)  # an interval begins where the prefix common with the neighbour is shorter than m
    new[1:] = ~((m[1:] == m[:-1]) & (row[1:] == row[:-1] + 1) & same_head[row[1:]] & (t1[1:] == t1[:-1]) & (t2[1:] == t2[:-1]))
    begins = np.flatnonzero(new)
    ends = np.append(begins, len(m))[1:]
    which = np.cumsum(new) - 1
    ordinal = np.empty(n, np.int64)
    by_place = np.lexsort((line, t, d))
    ordinal[by_place] = np.arange(n)
    least = by_place[np.minimum.reduceat(ordinal[row], begins)] if len(m) else np.empty(0, np.int64)
    left, right = row[begins] == 0, row[ends - 1] == n - 1

    found = np.zeros(n, np.int32)
    later = (least[which] != row) & ~(left | right)[which]
    np.maximum.at(found, row[later], m[later])
    edge = np.flatnonzero((left | right)[which])
    edge = edge[np.argsort(row[edge], kind="stable")]
    side = np.where(left[which[edge]], 0, 1)
    opened = _lists(pa.StructArray.from_arrays([pa.array(side, pa.int32()), pa.array(m[edge], pa.int32())], ["side", "m"]), _offsets(np.bincount(row[edge], minlength=n)))

    def told(k: int) -> list:
        e, first = begins[k], int(least[k])
        return [int(m[e]), int(t1[e]), int(t2[e]), [int(d[first]), int(t[first]), int(line[first])], bool(left[k] and right[k])]

    summary = {
        "n": n,
        "first": [int(k[0]) for k in keys],
        "last": [int(k[-1]) for k in keys],
        "last_place": int(place[-1]),
        "left": [told(k) for k in np.flatnonzero(left)],
        "right": [told(k) for k in np.flatnonzero(right)],
    }
    notes = pa.array([json.dumps(summary), *[None] * (n - 1)], pa.string())
    columns = [rows["_d"], rows["_t"], rows["start"], rows["at"], pa.array(np.full(n, part, np.int32)), pa.array(place), pa.array(place == 0), pa.array(found), opened, rows["more"], notes]
    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.RecordBatch.from_arrays(columns, names=["_d", "_t", "start", "at", "part", "place", "first", "found", "open", "more", "summary"])


def swept(rows: DataFrame, n: int) -> DataFrame:
    """The suffix array of ``n`` suffixes, range by range; see ``_sweep``. Suffixes with
    equal keys are dealt by position, so that no key fills a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held):
            rows = pa.Table.from_batches(held)
            done = _sweep(rows.drop_columns(["_part"]), rows["_part"][0].as_py())
            for k in range(0, done.num_rows, BATCH):
                yield done.slice(k, BATCH)

    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE))
    dealt = rows.repartitionByRange(ranges, *_KEYS, "_d", "_t", "start", "at").withColumn("_part", F.spark_partition_id())
    return dealt.mapInArrow(run, SWEPT)


def stitch(notes: list[tuple[int, dict]]) -> list[tuple]:
    """(part, offset, rank of the first key, least positions of the open intervals as
    (side, m, position)) from the tasks' summaries in order."""
    out, before, last, last_rank = [], 0, None, 0
    least: dict[int, list] = {}  # of each open interval
    names: dict[tuple[int, int, int], int] = {}
    carried: dict[tuple, int] = {}  # intervals that reach the end of the last task
    for part, x in notes:
        first_rank = last_rank if x["first"] == last else before
        last_rank = first_rank if x["last_place"] == 0 else before + x["last_place"]
        last, reaching = x["last"], {}
        for m, t1, t2, at, through in x["left"]:
            key = (m, t1, t2, *x["first"][:2])
            k = carried.get(key, len(least))
            least[k] = min(least.get(k, at), at)
            names[part, 0, m] = k
            if through:
                reaching[key] = k
        for m, t1, t2, at, through in x["right"]:
            if not through:
                k = names[part, 1, m] = len(least)
                least[k] = at
                reaching[m, t1, t2, *x["last"][:2]] = k
        carried = reaching
        out.append((part, before, first_rank))
        before += x["n"]
    mins: dict[int, list] = {p: [] for p, _ in notes}
    for (part, side, m), k in names.items():
        mins[part].append((side, m, tuple(least[k])))
    return [(part, offset, rank, mins[part]) for part, offset, rank in out]


def ranked(rows: DataFrame) -> DataFrame:
    """(_d, _t, start, at, rank, found, more) of a written sweep: ranks over all
    tasks, and open intervals settled."""
    spark = rows.sparkSession
    notes = sorted((r["part"], json.loads(r["summary"])) for r in rows.where("summary is not null").select("part", "summary").collect())
    fixes = spark.createDataFrame(stitch(notes), "part int, _offset long, _first long, _mins array<struct<side: int, m: int, at: struct<d: long, t: long, line: long>>>")
    own = F.struct(F.col("_d").alias("d"), F.col("_t").alias("t"), (F.col("start") + F.col("at")).cast("long").alias("line"))
    beaten = F.filter("open", lambda o: F.exists("_mins", lambda x: (x["side"] == o["side"]) & (x["m"] == o["m"]) & (x["at"] != own)))
    open_found = F.when(F.size("open") > 0, F.coalesce(F.array_max(F.transform(beaten, lambda o: o["m"])), F.lit(0))).otherwise(0)
    rank = F.when(F.col("first"), F.col("_first")).otherwise(F.col("_offset") + F.col("place"))
    fixes = F.broadcast(fixes) if len(notes) <= BROADCAST else fixes
    return rows.join(fixes, "part").select("_d", "_t", "start", "at", rank.alias("rank"), F.greatest("found", open_found).alias("found"), "more")


def only_again(lines: DataFrame, again: DataFrame) -> DataFrame:
    """The lines that are in ``again``, a written table of (h1, h2, c). Fewer than ``HOT``
    lines have more than a ``HOT``-th of the sum of c; these are told without a shuffle,
    and in the join with the others their rows go by place."""
    hot = again.join(again.agg(F.sum("c").alias("_all")), F.col("c") * HOT > F.col("_all")).select("h1", "h2", F.lit(True).alias("_hot"))
    told = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    by = F.when(F.col("_hot"), F.xxhash64("_d", "_t", "pos")).otherwise(F.col("h1"))
    known = again.select(F.col("h1").alias("_k1"), F.col("h2").alias("_k2"), F.lit(True).alias("_known"))
    both = told.withColumn("_by", by).join(known, (F.col("_by") == F.col("_k1")) & (F.col("h2") == F.col("_k2")), "left")
    return both.where("_hot or _known").select(*lines.columns)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_d, _t, from, to) of later copies, in lines, ``to`` exclusive. docs: _d, _t, text."""
    split = docs.select("_d", "_t", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = split.select("_d", "_t", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.regexp_count("line", F.lit(WORD)).alias("words"))
    again = materialize(lines.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1"), "lines")
    own = F.sort_array(F.collect_list(F.struct("pos", "h1", "h2", "words"))).alias("own")
    kept = only_again(lines, again).groupBy("_d", "_t").agg(own)
    segments = materialize(_segments(kept, min_words), "segments")

    place = ["_d", "_t", "start"]
    first = segments.groupBy("segment").agg(F.min(F.struct(*place)).alias("p")).select("p.*", F.lit(True).alias("_head"))
    headed = materialize(segments.join(first, place, "left"), "heads")
    level = headed.where("_head")
    found = [headed.where("_head is null").select("_d", "_t", F.col("start").alias("from"), (F.col("start") + F.col("n")).alias("to"))]
    total, longest = level.agg(F.sum("n"), F.max("longest")).first()
    size, done = 1, 0
    while done < (longest or 0):
        step = ranked(materialize(swept(suffixes(level, size), total), "sweep"))
        begin = F.col("start") + F.col("at")
        found.append(step.where("found > 0").select("_d", "_t", begin.alias("from"), (begin + F.col("found")).alias("to")))
        done = 2 * size
        if done < longest:
            whole = step.groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("at", "rank", "more"))).alias("s"))
            longer = whole.where(F.exists("s", lambda x: F.size(x["more"]) > 0))
            level = materialize(longer.select(*place, F.col("s.rank").alias("a1"), F.col("s.more").alias("more")), "level")
            total = level.agg(F.sum(F.size("a1"))).first()[0] or 0
        size *= 2
    return reduce(DataFrame.union, found)


def merged(runs: DataFrame) -> DataFrame:
    """(_d, _t, from, to): a document's runs as ranges that neither touch nor overlap."""
    row = ["_d", "_t"]
    by = Window.partitionBy(*row).orderBy("from", "to")
    reach = F.max("to").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.withColumn("_new", F.when(F.col("from") <= reach, 0).otherwise(1)).withColumn("_i", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*row, "_i").agg(F.min("from").alias("from"), F.max("to").alias("to")).drop("_i")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` rid of later copies, and n_lines, n_removed and
    removed, the deleted lines as merged ranges (from, to); columns of ``docs`` with
    these names are replaced."""
    docs = docs.drop("n_lines", "n_removed", "removed")
    d, t = F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)), F.xxhash64(F.col(text_col))
    plain = docs.where(F.col(text_col).isNotNull()).select(d.alias("_d"), t.alias("_t"), F.col(text_col).alias("text")).dropDuplicates(["_d", "_t"])
    ranges = materialize(merged(repeated_runs(plain, min_words)), "removed")
    runs = ranges.groupBy(F.col("_d").alias("_rd"), F.col("_t").alias("_rt")).agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("removed"))
    runs = F.broadcast(runs) if rows_of(ranges) <= BROADCAST else runs
    both = docs.join(runs, (d == F.col("_rd")) & (t == F.col("_rt")), "left").drop("_rd", "_rt")
    lines = F.split(text_col, "\n")
    n = F.size("removed")
    begin = lambda k: F.when(k == 0, 0).otherwise(F.get("removed", k - 1)["to"])
    end = lambda k: F.when(k == n, F.size(lines)).otherwise(F.get("removed", k)["from"])
    rest = F.transform(F.array(lines), lambda x: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(x, begin(k) + 1, end(k) - begin(k)))), "\n"))[0]
    gone = F.aggregate("removed", F.lit(0), lambda a, r: a + r["to"] - r["from"])
    columns = [F.when(F.col("removed").isNull(), F.col(c)).otherwise(rest).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return both.select(*columns, F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(gone, F.lit(0)).alias("n_removed"), "removed")


def line_report(docs: DataFrame) -> DataFrame:
    """Per document its lines, the lines deleted, their ranges, and the text left."""
    ranges = F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["from"].cast("string"), r["to"].cast("string"))), ",")
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.coalesce(ranges, F.lit("")).alias("removed"), "text")


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents' columns with later copies deleted and n_chars renewed; documents
    left without a word by that go. Null and empty texts stay; an empty table stays empty."""
    done = dedup_lines(packed(docs, "doc_id", "text"))
    left = done.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    length = {"n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("_rest.n_chars"))} if "n_chars" in docs.columns else {}
    return unpacked(left, docs, ("doc_id", "text"), **length)
