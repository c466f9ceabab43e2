"""Full-text, vector and fused search, and line search.

Tokens are lower-case runs of letters and digits. BM25 has k1 = 1.2 and b = 0.75;
a query word stands for every token that it begins; its inverse document
frequency is ln((N - n + 0.5) / (n + 0.5)), 1e-6 at least. Scores are rounded to six
places before they are ranked, and ties go to the smaller id."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, FLOOR, RRF_K = 1.2, 0.75, 1e-6, 60
SEPARATORS = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda t: t != "")


def query_words(query: str) -> list[str]:
    """Quotes, stars and brackets are dropped; each word is a prefix."""
    return [w.lower() for w in re.sub(r"['\"*()]", " ", query).split()]


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: (token, id, tf, doc_len)."""
    t = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("_t"))
    rows = t.select("id", F.size("_t").alias("doc_len"), F.explode("_t").alias("token"))
    return rows.groupBy("token", "id", "doc_len").agg(F.count("*").alias("tf"))


def write_index(docs: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings by a hash of the first two letters, sorted by token, so that a search
    reads one bucket a word and skips row groups within it; and the corpus totals."""
    p = postings(docs).withColumn("bucket", bucket(F.substring("token", 1, 2), buckets))
    p.repartition(F.col("bucket")).sortWithinPartitions("bucket", "token", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
    totals(docs).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/totals")


def bucket(start: Column, buckets: int) -> Column:
    return F.pmod(F.hash(start), F.lit(buckets))


def search_index(spark, path: str, query: str, limit: int = 20) -> DataFrame:
    t = spark.read.parquet(f"{path}/totals")
    p = spark.read.parquet(f"{path}/postings")
    words = query_words(query)
    buckets = t.first()["buckets"]
    if all(len(w) >= 2 for w in words):
        starts = spark.createDataFrame([(w[:2],) for w in words], "s string")
        wanted = [r["b"] for r in starts.select(bucket(F.col("s"), buckets).alias("b")).distinct().collect()]  # one a word
        p = p.where(F.col("bucket").isin(wanted))
    return _ranked(_scored(p, t, words), limit)


def totals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n documents, avg length."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.size(tokens(F.col(text_col))), F.lit(0))).alias("avg_len"))


def _scored(p: DataFrame, t: DataFrame, words: list[str]) -> DataFrame:
    """(id, score) by BM25; p: token, id, tf, doc_len; t: totals."""
    matches = F.filter(F.array(*map(F.lit, words)), lambda w: F.col("token").startswith(w)) if words else F.array().cast("array<string>")
    hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.col("token").startswith(w)) if words else F.lit(False)
    per = p.where(hit).select("id", "doc_len", "tf", F.explode(matches).alias("word")).groupBy("word", "id", "doc_len").agg(F.sum("tf").alias("tf"))
    df = per.groupBy("word").agg(F.count("*").alias("df"))  # a row per query word
    rows = per.join(F.broadcast(df), "word").join(F.broadcast(t.select("n", "avg_len")))
    idf = F.greatest(F.lit(FLOOR), F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    return rows.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))


def _ranked(scores: DataFrame, limit: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "id").limit(limit)


def bm25(docs: DataFrame, query: str, limit: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) without an index: tokens that no query word begins are dropped before anything is shuffled."""
    words = query_words(query)
    t = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("_t"))
    keep = lambda x: F.exists(F.array(*map(F.lit, words)), lambda w: x.startswith(w)) if words else F.lit(False)
    rows = t.select("id", F.size("_t").alias("doc_len"), F.explode(F.filter("_t", keep)).alias("token"), F.lit(1).alias("tf"))
    return _ranked(_scored(rows, totals(docs, text_col), words), limit)


def _with_rank(rows: DataFrame, order: list) -> DataFrame:
    """rows are a top list, so one task ranks them."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def fuse(lists: list[DataFrame], limit: int) -> DataFrame:
    """Reciprocal rank fusion of (id, score) lists: the sum of 1 / (60 + rank + 1)."""
    union = None
    for one in lists:
        r = _with_rank(one, [F.desc("score"), "id"]).select("id", (1 / (F.lit(RRF_K) + F.col("rank") + 1)).alias("s"))
        union = r if union is None else union.union(r)
    return _ranked(union.groupBy("id").agg(F.round(F.sum("s"), 9).alias("score")), limit)


def multi_query(docs: DataFrame, queries: str, limit: int = 20) -> DataFrame:
    """Queries parted by ``;``, each searched twice as deep, fused."""
    parts = [q.strip() for q in queries.split(";") if q.strip()]
    return bm25(docs, parts[0], limit) if len(parts) == 1 else fuse([bm25(docs, q, 2 * limit) for q in parts], limit)


def dot(a: Column, b: Column) -> Column:
    wide = lambda v: v.cast("array<double>")
    return F.aggregate(F.zip_with(wide(a), wide(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vector_topk(vectors: DataFrame, query: list[float], limit: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score): exact inner products with unit vectors; each partition keeps its best."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return _ranked(vectors.select(F.col(id_col).alias("id"), F.round(dot(F.col(vector_col), q), 6).alias("score")), limit)


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, vector: list[float] | None, limit: int = 20) -> DataFrame:
    """Words and vectors, each three times as deep, fused; words alone without a vector."""
    words = bm25(docs, query, 3 * limit)
    return fuse([words, vector_topk(vectors, vector, 3 * limit)], limit) if vector else _ranked(words, limit)


def _line_test(pattern: str) -> Column:
    """``/expression/`` is a regular expression in either case, all else a substring in
    either case; so is an expression that does not compile."""
    if len(pattern) > 2 and pattern[0] == pattern[-1] == "/":
        try:
            re.compile(pattern[1:-1])
            return F.col("line").rlike("(?i)" + pattern[1:-1])
        except re.error:
            pass
    return F.lower("line").contains(pattern.lower())


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).select("id", (F.col("pos") + 1).alias("line_no"), "line")


def grep(docs: DataFrame, pattern: str, limit: int = 30) -> DataFrame:
    """(id, line_no, line), by document and line."""
    return lines(docs).where(_line_test(pattern)).orderBy("id", "line_no").limit(limit)


def grep_snippets(docs: DataFrame, pattern: str, limit: int = 30, most: int = 300) -> DataFrame:
    """The same with the lines before and after. They come from the document's own
    array of lines, so nothing is sorted or shuffled for them."""
    d = docs.select(F.col("doc_id").alias("id"), F.split("text", "\n").alias("_l"))
    rows = d.select("id", "_l", F.posexplode("_l").alias("pos", "line")).where(_line_test(pattern))
    first = F.greatest(F.col("pos"), F.lit(1))
    near = F.array_join(F.slice("_l", first, F.col("pos") + 3 - first), "\n")
    return rows.select("id", (F.col("pos") + 1).alias("line_no"), F.substring(near, 1, most).alias("snippet")).orderBy("id", "line_no").limit(limit)


def embedding_text(symbols: DataFrame) -> DataFrame:
    """(id, text): kind and name, signature and the body's first 512 characters, without empty parts."""
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    body = F.substring("body", 1, 512)
    text = F.concat_ws("\n", part(F.concat_ws(" ", "kind", "name")), part(F.col("signature")), part(body))
    return symbols.select("id", text.alias("text")).where(F.trim("text") != "")


def backlog(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ids without a vector. items: id; vectors: id."""
    return items.select("id").join(vectors.select("id"), "id", "left_anti")


def name_fallback(symbols_v: DataFrame, query: str, limit: int = 20, kinds: list[str] | None = None) -> DataFrame:
    """Symbols whose name or qualified name contains the query, in any case: for
    queries without a word that the index knows."""
    q = query.lower()
    rows = symbols_v.where(F.lower("name").contains(q) | F.lower("qualified_name").contains(q))
    if kinds:
        rows = rows.where(F.col("kind").isin(kinds))
    return rows.select("id", "name", "kind", "relative_path").orderBy("id").limit(limit)
