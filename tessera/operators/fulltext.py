"""A full-text index that is kept up to date: stemmed postings with places, in
immutable segments.

A segment has the postings of the documents that one change added, laid out by a hash
of a word's first two letters (into up to ``BUCKETS``, by its size) and sorted by word,
so that a search reads one bucket of each segment a word. A change also names the documents that it took away; a posting
counts if its segment is not older than the last removal of its document. Totals are
kept by what each change adds to them and takes from them. Segments of about equal
size are merged, newest first, so a document is rewritten a number of times that grows
with the logarithm of the index.

A search is a list of words, any of which a document may have. A word is itself cut
into words and stemmed: ``get_item`` asks for ``get`` and then a word that begins with
``item``. BM25 counts such runs; see ``search`` for its constants. Columns are one
text with a gap between them, so no run goes over it.

Words are counted first, and those that come most often are stemmed once each, in a
broadcast table of at most ``COMMON`` words; a rarer word is stemmed where it stands.
Documents are dealt over tasks of about ``DOCS_A_TASK``, and a bucket of a large segment
over several, each a sorted file.

Defined results: a null text has no words; a search without words finds nothing; equal
scores go by id; an id that is added again must be removed by the same change."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import stem, words
from ..plans.storage import cut, rows as rows_of
from .search import B, FLOOR, K1

BUCKETS, DOCS_A_BUCKET, MERGE, RATIO = 64, 2000, 4, 2
COMMON, DOCS_A_TASK = 200_000, 4000
POSTINGS = "token string, id long, positions array<int>, doc_len int"


def occurrences(docs: DataFrame, columns: list[str], n: int = 0) -> DataFrame:
    """(id, doc_len, pos, word), a row a word that is not yet stemmed, a document's rows in one task. n: how many documents there are."""
    gap = F.array(F.lit(None).cast("string"))
    parts = [x for c in columns for x in (F.coalesce(words(F.col(c), stems=False), F.array().cast("array<string>")), gap)]
    tasks = max(-(-n // DOCS_A_TASK), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = (tasks, "id") if n > DOCS_A_TASK else ("id",)
    dealt = docs.select("id", *columns).repartition(*by)  # a table may be one file of few row groups
    rows = dealt.select("id", F.concat(*parts[:-1]).alias("_t")).select("id", "_t", F.size(F.filter("_t", lambda t: t.isNotNull())).alias("doc_len"))
    # outer: else Spark filters by the array's size first, and so makes the array twice
    return rows.select("id", "doc_len", F.posexplode_outer("_t").alias("pos", "word")).where("word is not null")


def count_words(docs: DataFrame, columns: list[str], n: int = 0) -> DataFrame:
    """(word, n), a written table."""
    return cut(occurrences(docs, columns, n).groupBy("word").agg(F.count("*").alias("n")), "words")


def common_words(counted: DataFrame, most: int) -> DataFrame:
    """(word) of at most ``most`` words: those that come 2^k times or more, for the least such k."""
    power = F.floor(F.log2(F.col("n"))).cast("int")
    left, least = most, 64
    for r in counted.groupBy(power.alias("k")).agg(F.count("*").alias("c")).orderBy(F.desc("k")).collect():  # at most 64 rows
        if r["c"] > left:
            break
        left, least = left - r["c"], r["k"]
    return counted.where(power >= least).select("word")


def postings(docs: DataFrame, columns: list[str], counted: DataFrame, n: int = 0, most: int = COMMON) -> DataFrame:
    """(token, id, positions, doc_len). docs: id and text columns; counted: what ``count_words`` gave for them; n: how many there are."""
    all_ = rows_of(counted) <= most
    stems = (counted if all_ else common_words(counted, most)).select("word", stem(F.col("word")).alias("stem"))
    each = occurrences(docs, columns, n).join(F.broadcast(stems), "word", "inner" if all_ else "left")
    each = each.withColumn("token", F.col("stem") if all_ else F.coalesce("stem", stem(F.col("word"))))
    return each.groupBy("token", "id", "doc_len").agg(F.sort_array(F.collect_list("pos")).alias("positions")).select("token", "id", "positions", "doc_len")


def lengths(docs: DataFrame, columns: list[str]) -> tuple[int, int]:
    """(documents, words): what they add to the totals."""
    n = sum((F.coalesce(F.size(words(F.col(c), stems=False)), F.lit(0)) for c in columns), F.lit(0))
    row = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(n), F.lit(0)).alias("w")).first()
    return row["n"], row["w"]


def buckets_for(docs: int) -> int:
    return max(1, min(BUCKETS, docs // DOCS_A_BUCKET))


def write_segment(rows: DataFrame, path: str, buckets: int, docs: int = 0) -> None:
    """Beyond the size that ``BUCKETS`` are for, a bucket is more tasks and files, not larger ones."""
    files = max(1, -(-docs // (DOCS_A_BUCKET * BUCKETS)))
    laid = rows.withColumn("bucket", F.pmod(F.hash(F.substring("token", 1, 2)), F.lit(buckets)))
    dealt = laid.repartition(buckets * files, "bucket", F.pmod(F.xxhash64("id"), F.lit(files)))
    dealt.sortWithinPartitions("bucket", "token", "id").write.partitionBy("bucket").parquet(path)


@dataclass
class Segment:
    postings: str  # path, empty if it has none
    gone: str  # path of the ids that its change took away, empty if none
    at: int  # number of its change
    rows: int
    buckets: int = 1


def read(spark: SparkSession, segments: list[Segment], starts: list[int] | None = None) -> DataFrame:
    """Live postings of all segments, or of the buckets in which words with these starts are (see ``hashed_starts``)."""
    none = spark.createDataFrame([], POSTINGS + ", at long")
    parts = []
    for s in segments:
        if s.postings:
            rows = spark.read.schema(POSTINGS + ", bucket int").parquet(s.postings)
            rows = rows.where(F.col("bucket").isin(sorted({h % s.buckets for h in starts}))) if starts is not None else rows
            parts.append(rows.drop("bucket").withColumn("at", F.lit(s.at).cast("long")))
    live = reduce(DataFrame.union, parts) if parts else none
    later = [s for s in segments if s.gone and any(t.at < s.at and t.postings for t in segments)]
    if later:
        each = [spark.read.schema("id long").parquet(s.gone).select("id", F.lit(s.at).cast("long").alias("_at")) for s in later]
        last = reduce(DataFrame.union, each).groupBy("id").agg(F.max("_at").alias("_at"))
        live = live.join(last, "id", "left").where(F.col("_at").isNull() | (F.col("_at") <= F.col("at"))).select(*live.columns)
    return live


def to_merge(segments: list[Segment], new_rows: int) -> int:
    """How many of the last segments a new one of that many rows is merged with."""
    size, n = max(1, new_rows), 0
    for s in reversed(segments):
        if s.rows > RATIO * size:
            break
        size, n = size + s.rows, n + 1
    return n if n >= MERGE - 1 else 0


@dataclass
class Phrase:
    words: list[str]


def phrases(spark: SparkSession, query: str) -> list[Phrase]:
    """The words of a query as stemmed words each; quotes, stars and brackets are dropped."""
    pieces = re.sub(r"['\"*()]", " ", query).split()
    if not pieces:
        return []
    rows = spark.createDataFrame(list(enumerate(pieces)), "k int, piece string").select("k", words(F.col("piece")).alias("w")).collect()  # a row a word
    return [Phrase(list(r["w"])) for r in sorted(rows) if r["w"]]


def hashed_starts(spark: SparkSession, asked: list[Phrase]) -> list[int] | None:
    """Hashes of the first two letters of each word, or None where a beginning of one
    letter may be anywhere."""
    if any(len(p.words[-1]) < 2 for p in asked):
        return None
    starts = spark.createDataFrame([(s,) for s in sorted({w[:2] for p in asked for w in p.words})], "s string")
    return [r["h"] for r in starts.select(F.hash("s").alias("h")).collect()]


def frequencies(rows: DataFrame, asked: list[Phrase]) -> DataFrame:
    """(phrase, id, doc_len, tf): how often each phrase is in each document that has it."""
    parts = [(k, j, len(p.words), w, j == len(p.words) - 1) for k, p in enumerate(asked) for j, w in enumerate(p.words)]
    lits = F.array(*[F.struct(F.lit(k).alias("phrase"), F.lit(j).alias("j"), F.lit(n).alias("n"), F.lit(w).alias("w"), F.lit(end).alias("end")) for k, j, n, w, end in parts])
    fits = lambda m: (m["w"] == F.col("token")) | (m["end"] & F.col("token").startswith(m["w"]))
    some = reduce(lambda a, b: a | b, [F.col("token").startswith(w) if end else F.col("token") == w for _, _, _, w, end in parts])
    hits = rows.where(some).select("id", "doc_len", "positions", F.explode(F.filter(lits, fits)).alias("m")).select("id", "doc_len", "positions", "m.phrase", "m.j", "m.n")
    one = hits.where("n = 1").groupBy("phrase", "id", "doc_len").agg(F.sum(F.size("positions")).alias("tf"))
    if all(n == 1 for _, _, n, _, _ in parts):
        return one
    places = hits.where("n > 1").select("phrase", "id", "doc_len", "n", F.explode(F.transform("positions", lambda p: p - F.col("j"))).alias("start"))
    runs = places.groupBy("phrase", "id", "doc_len", "n", "start").agg(F.count("*").alias("c")).where("c = n")
    return one.union(runs.groupBy("phrase", "id", "doc_len").agg(F.count("*").alias("tf")))


def scores(rows: DataFrame, docs: int, tokens: int, asked: list[Phrase]) -> DataFrame:
    """(id, score) by BM25 with k1 = 1.2 and b = 0.75; docs and tokens are of the whole index."""
    per = frequencies(rows, asked)
    df = per.groupBy("phrase").agg(F.count("*").alias("df"))  # a row a word of the query
    idf = F.greatest(F.lit(FLOOR), F.ln((F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.lit(tokens / max(1, docs))))
    return per.join(F.broadcast(df), "phrase").groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))


def search(spark: SparkSession, segments: list[Segment], docs: int, tokens: int, query: str, limit: int | None = 20, among: DataFrame | None = None) -> DataFrame:
    """(id, score) of the best documents, of those in ``among`` (a column id) if it is
    given; it does not change the totals or how often a word is found."""
    asked = phrases(spark, query)
    if not asked:
        return spark.createDataFrame([], "id long, score double")
    found = scores(read(spark, segments, hashed_starts(spark, asked)), docs, tokens, asked)
    if among is not None:
        found = found.join(among.select("id"), "id", "left_semi")
    return found.orderBy(F.desc("score"), "id").limit(limit) if limit else found


class Index:
    """An index of its own below ``root``, for one writer. Its state is what ``segments``,
    ``docs`` and ``tokens`` say; a store keeps these in its versions instead."""

    def __init__(self, spark: SparkSession, root: str, columns: list[str], state: dict | None = None) -> None:
        state = state or {}
        self.spark, self.root, self.columns = spark, root.rstrip("/"), columns
        self.segments = [Segment(**s) for s in state.get("segments", [])]
        self.docs, self.tokens, self.last = state.get("docs", 0), state.get("tokens", 0), state.get("last", 0)

    def state(self) -> dict:
        return {"segments": [s.__dict__ for s in self.segments], "docs": self.docs, "tokens": self.tokens, "last": self.last}

    def _full(self, path: str) -> str:
        return f"{self.root}/{path}" if path else ""

    def _found(self, segments: list[Segment] | None = None) -> list[Segment]:
        return [Segment(self._full(s.postings), self._full(s.gone), s.at, s.rows, s.buckets) for s in segments or self.segments]

    def change(self, added: DataFrame, removed: DataFrame, folder: str) -> None:
        """Adds documents (id and the text columns) and takes away others (as they were).
        Writes one segment, below ``folder``; merges it with others where that is due."""
        self.last += 1
        n, w, counted = added.count(), 0, None
        if n:
            counted = count_words(added, self.columns, n)
            w = counted.agg(F.sum("n")).first()[0] or 0
        gone_n, gone_w = lengths(removed, self.columns)
        self.docs, self.tokens = self.docs + n - gone_n, self.tokens + w - gone_w
        gone = ""
        if gone_n and self.segments:
            gone = f"{folder}/gone"
            removed.select("id").distinct().write.parquet(self._full(gone))
        if not n and not gone:
            return
        k = to_merge(self.segments, n)
        kept, merged = (self.segments[:-k], self.segments[-k:]) if k else (self.segments, [])
        rows = postings(added, self.columns, counted, n) if n else self.spark.createDataFrame([], POSTINGS)
        if merged:
            old = read(self.spark, [*self._found(merged), Segment("", self._full(gone), self.last, 0)]).drop("at")
            rows = rows.unionByName(old)
            if kept:  # older segments still need to know what the merged ones took away
                paths = [self._full(s.gone) for s in merged if s.gone] + ([self._full(gone)] if gone else [])
                if paths:
                    gone = f"{folder}/gone-merged"
                    self.spark.read.schema("id long").parquet(*paths).distinct().write.parquet(self._full(gone))
            else:
                gone = ""
        path, size = "", n + sum(s.rows for s in merged)
        if n or merged:
            path = f"{folder}/postings"
            write_segment(rows, self._full(path), buckets_for(size), size)
        self.segments = [*kept, Segment(path, gone, self.last, size, buckets_for(size))]

    def search(self, query: str, limit: int | None = 20, among: DataFrame | None = None) -> DataFrame:
        return search(self.spark, self._found(), self.docs, self.tokens, query, limit, among)
