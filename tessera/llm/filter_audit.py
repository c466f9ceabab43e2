"""Filter interaction audit by lattice edges. DataFrame operations only.

Filters that a document passes or fails on its own do not depend on their order, but
what each one removes does. The order in which filters are applied is a path through
the lattice of sets of filters: a step is an edge from the set S of those already
applied to S with the next filter f. Five filters have 80 edges, which their 120
orders share in 600 steps. So every document, as a set of failed filters, contributes
to each of the 80 edges once (kept, removed or redundant there), edges are added up by
part, and the sums are joined to the steps of all orders. Documents of one part with
the same failures and labels contribute alike, so they are counted before they are
spread over the edges: a part is at most 2^5 * 4 rows by then, however many documents
it has, and is counted in each task before the shuffle.

Identity with the text of a smaller doc_id is decided over the whole table: the least
doc_id is found for each text (by SHA-256, combined in each task), and a document
passes if (text, doc_id) is among these. Both columns are the key of that join, so
that thousands of copies of one text spread over tasks.

Defined results: a null text is empty, and identical to empty ones; a null lang is the
part '' (as is an empty one); a null doc_id is never smaller nor greater than another,
so its text passes E, and it has no labels; rows that repeat a doc_id with the same
text fail or pass E together and count each; a document with several rows in labels
has a label if any of them says so; an empty table gives no rows, as there is no part;
texts of any length are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

# The five failure conditions of the audit.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 100, 80, 10, r"[#$%&*|]"
TEXT_FILTERS = "ABCD"
COPIES = "E"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of A to D, for a text that is not null."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), "")
    distinct = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    return {
        "A": distinct["n"] < MIN_WORDS,
        "B": 100 * distinct["d"] < MIN_DISTINCT * distinct["n"],
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITALS * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text_key, mask) a row: bit i of mask is set if filter i of ABCD fails."""
    text = text_or_empty("text")
    one = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("_text"))
    parts = text_failures(F.col("_text"))
    mask = sum((F.when(parts[name], F.lit(1 << i)).otherwise(0) for i, name in enumerate(TEXT_FILTERS)), F.lit(0))
    return one.select("doc_id", "part", F.unhex(F.sha2("_text", 256)).alias("text_key"), mask.alias("mask"))


def with_copies(failed: DataFrame, bit: int) -> DataFrame:
    """``mask`` with ``bit`` set where a smaller doc_id has the same text."""
    firsts = failed.groupBy("text_key").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("_first", F.lit(True))
    known, unknown = failed.where("doc_id is not null"), failed.where("doc_id is null")
    marked = known.join(firsts, ["text_key", "doc_id"], "left")
    return marked.select("doc_id", "part", F.when(F.col("_first"), F.col("mask")).otherwise(F.col("mask") + (1 << bit)).alias("mask")).union(unknown.select("doc_id", "part", "mask"))


def with_labels(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic, 0 or 1."""
    has = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(has("quality").alias("good"), has("toxic").alias("toxic"))
    known, unknown = failed.where("doc_id is not null"), failed.where("doc_id is null")
    joined = known.join(told, "doc_id", "left").select("part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    return joined.union(unknown.select("part", "mask", F.lit(0), F.lit(0)))


def edges(classes: DataFrame, n: int) -> DataFrame:
    """(part, applied, filter, counts ..., weight): a row for each part and edge. classes:
    part, mask, rows, good, toxic. weight: in how many orders the edge is a step."""
    every = [(s, f) for f in range(n) for s in range(1 << n) if not s >> f & 1]
    edge = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter"), F.lit(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())).alias("weight")) for s, f in every]))
    at = classes.withColumn("_e", edge).select("*", "_e.applied", "_e.filter", "_e.weight")
    fails = F.expr("(mask >> filter) & 1") == 1
    reached = F.col("mask").bitwiseAND(F.col("applied")) == 0
    removed = fails & reached
    total = lambda when, of="rows": F.sum(F.when(when, F.col(of)).otherwise(0))
    counts = [total(reached & ~fails), total(removed), total(fails & ~reached), total(F.col("mask") == F.expr("1 << filter")), total(removed, "good"), total(removed, "toxic")]
    return at.groupBy("part", "applied", "filter", "weight").agg(*[c.alias(name) for c, name in zip(counts, COUNTS, strict=True)])


def steps(spark, names: str) -> DataFrame:
    """(filter_order, step, applied, filter): the path of each order through the lattice."""
    rows = [("".join(names[f] for f in order), k + 1, sum(1 << f for f in order[:k]), order[k]) for order in permutations(range(len(names))) for k in range(len(names))]
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, filter int")


def interactions(marked: DataFrame, names: str) -> DataFrame:
    """The audit of ``marked`` (part, mask, good, toxic; a row a document) over all orders of the filters."""
    classes = marked.groupBy("part", "mask").agg(F.count("*").alias("rows"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    by_edge = materialize(edges(classes, len(names)), "edges")  # parts times 80 rows
    values = by_edge.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("weight")).alias("shapley"))
    whole = by_edge.drop("weight").join(values, ["part", "filter"])
    path = steps(marked.sparkSession, names)
    return whole.join(path, ["applied", "filter"]).select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in (*COUNTS, "shapley")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Filters A to E over all documents: a row for each part, order and step."""
    failed = materialize(failures(docs), "failures")
    return interactions(with_labels(with_copies(failed, len(TEXT_FILTERS)), labels), TEXT_FILTERS + COPIES)


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words FROM d
), firsts AS (
  SELECT t, min(doc_id) AS least FROM d GROUP BY t
), m AS (
  SELECT w.part, w.doc_id,
    [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * len(regexp_extract_all(w.t, '[A-Z]')) > 10 * length(w.t),
     regexp_matches(w.t, '[#$%&*|]'), coalesce(w.doc_id > firsts.least, false)] AS fails
  FROM w JOIN firsts ON w.t = firsts.t
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), classes AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, fails
), f AS (SELECT unnest(range(1, 6)) AS i
), orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), paths AS (
  SELECT o, k.i AS step, o[k.i] AS own, o[1:k.i - 1] AS before FROM orders, f k
), sums AS (
  SELECT part, o, step, own,
    sum(CASE WHEN NOT fails[own] AND NOT early THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails[own] AND NOT early THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails[own] AND early THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails[own] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails[own] AND NOT early THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails[own] AND NOT early THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, len(list_filter(before, lambda j: fails[j])) > 0 AS early FROM classes, paths)
  GROUP BY part, o, step, own
)
SELECT part, array_to_string(list_transform(o, lambda j: substr('ABCDE', CAST(j AS INTEGER), 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
  CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM sums
"""
