"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row: its terms are positions, its weights whole numbers other
than 0. Candidates are dealt into blocks of about ``CANDIDATES`` rows and queries into
blocks of about ``QUERIES``; Spark brings each block of queries to each block of
candidates. There, candidates are inverted into a list of (row, weight) for each term,
and each query term scatters its weight times the list into an array that has a score
for each row; a list that covers most of its block is kept as a dense column. The best
k of the block are chosen by partition selection, and the blocks' choices are merged
by rank, of which Spark keeps k a query in each task before the shuffle. All pairs of
a query and a candidate are scored: nothing is pruned or approximated.

A task holds two blocks and a tile of scores at a time, whatever the tables' sizes;
blocks are dealt by row number, so equal ids or vectors do not meet in one.

Defined results: a vector that is null, or has a null or non-finite component, takes
no part; of vectors of different lengths the shared positions count; an empty vector
scores 0; ties go to the smaller id, a null id last; a query's candidates are all rows
with another id; repeated candidate rows are ranked each, and a repeated query row is
answered again; with fewer candidates than k all are returned; an empty table gives no
rows; other columns are ignored. Scores are exact; one that does not fit a long, or a
component whose weight does not, is an error.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, rows_of

K, CANDIDATES, QUERIES, TILE = 5, 1024, 1024, 64
DENSE = 0.25  # a list that covers more of its block than this is kept as a column
QUERY_SHARE = 50  # rows whose id is divisible by it are queries
FOUND = "_qrow long, query_id long, vec_id long, score long"


def integer_weights(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    unfit = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~unfit, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _sparse(rows: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of all weights other than 0."""
    lists = rows.combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    offsets = np.asarray(lists.offsets)
    values = np.asarray(lists.values)[offsets[0] : offsets[-1]].astype(np.int64)
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    some = values != 0
    return row[some], term[some], values[some]


def _by_term(row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The list of rows and weights of each term."""
    if not len(term):
        return {}
    order = np.argsort(term, kind="stable")
    row, term, weight = row[order], term[order], weight[order]
    cuts = np.flatnonzero(np.diff(term)) + 1
    return {int(t[0]): (r, w) for t, r, w in zip(np.split(term, cuts), np.split(row, cuts), np.split(weight, cuts), strict=True)}


def block_scores(queries: dict, postings: dict, n_queries: int, n_rows: int, kind: type) -> np.ndarray:
    """Scores of a tile of queries with every row of a block, term at a time."""
    scores = np.zeros((n_queries, n_rows), kind)
    for term, (q, weight) in queries.items():
        if term in postings:
            rows, weights = postings[term]
            by_query = weight.astype(kind)[:, None]
            if rows is None:
                part = by_query * weights
                if len(q) == n_queries:
                    scores += part
                else:
                    scores[q] += part
            else:
                scores[np.ix_(q, rows)] += by_query * weights
    return scores


def best_of_block(key: tuple, queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of the block for each query of the block."""
    schema = pa.schema([("_qrow", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    if not len(rows) or not len(queries):
        return schema.empty_table()
    rows = rows.sort_by("vec_id")  # places follow the order of ties; a null id is last
    ids, qids = rows["vec_id"].combine_chunks(), queries["vec_id"].to_pylist()
    places: dict[int, list[int]] = {}
    for i, x in enumerate(ids.to_pylist()):
        places.setdefault(x, []).append(i)
    n = len(rows)
    row, term, weight = _sparse(rows["weights"])
    q_row, q_term, q_weight = _sparse(queries["weights"])
    most = lambda w: int(np.abs(w.astype(object)).max()) if len(w) else 0
    terms = min(len(np.unique(term)), len(np.unique(q_term)))
    bound = most(weight) * most(q_weight) * terms
    kind = np.int32 if bound < 1 << 31 else np.int64 if bound < (1 << 62) // (n + 1) else object
    postings = _by_term(row, term, weight.astype(kind))
    for t, (r, w) in postings.items():
        if len(r) > DENSE * n:
            column = np.zeros(n, kind)
            column[r] = w
            postings[t] = (None, column)
    wide = object if kind is object else np.int64
    tie = np.arange(n - 1, -1, -1).astype(wide)
    out: list[tuple] = []
    for first in range(0, len(qids), TILE):
        inside = (q_row >= first) & (q_row < first + TILE)
        tile = _by_term(q_row[inside] - first, q_term[inside], q_weight[inside])
        here = qids[first : first + TILE]
        ranked = block_scores(tile, postings, len(here), n, kind).astype(wide) * n + tie  # distinct: score, then place
        own = [(i, p) for i, x in enumerate(here) for p in places.get(x, ())]
        lowest = ranked.min() - 1 if len(own) else None
        for i, p in own:
            ranked[i, p] = lowest
        if n > k and wide is np.int64:
            best = np.argpartition(ranked, n - k, axis=1)[:, n - k :]
        else:
            best = np.argsort(ranked, axis=1, kind="stable")[:, -k:]
        chosen = np.take_along_axis(ranked, best, axis=1)
        i, j = np.nonzero(chosen != lowest) if len(own) else np.indices(best.shape).reshape(2, -1)
        out.append((i + first, best[i, j], chosen[i, j] // n))
    i, place, score = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table([queries["_row"].take(pa.array(i)), queries["vec_id"].take(pa.array(i)), ids.take(pa.array(place)), pa.array([int(s) for s in score], pa.int64())], schema=schema)


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, candidates: int = CANDIDATES, most_queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score). rows, queries: vec_id long, weights array<long>."""
    numbered = lambda df, tag: materialize(df.where("weights is not null").select("vec_id", "weights").withColumn("_row", F.monotonically_increasing_id()), tag)
    rows, queries = numbered(rows, "vectors"), numbered(queries, "queries")
    blocks, query_blocks = (max(1, -(-rows_of(df) // most)) for df, most in ((rows, candidates), (queries, most_queries)))
    dealt = lambda n: F.pmod(F.xxhash64("_row"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.withColumn("_queries", dealt(query_blocks)).withColumn("_block", each(blocks)).groupBy("_queries", "_block")
    right = rows.withColumn("_block", dealt(blocks)).withColumn("_queries", each(query_blocks)).groupBy("_queries", "_block")
    found = left.cogroup(right).applyInArrow(partial(best_of_block, k=k), FOUND)
    merged = Window.partitionBy("_qrow", "query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_report(embeddings: DataFrame, k: int = K) -> DataFrame:
    """Every row whose vec_id is divisible by ``QUERY_SHARE`` against all rows."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), integer_weights(F.col("embedding")).alias("weights"))
    return top_k(rows, rows.where(F.col("vec_id") % QUERY_SHARE == 0), k)


SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id ASC NULLS LAST) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
