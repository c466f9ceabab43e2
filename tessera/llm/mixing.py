"""Mixing sources to target weights. DataFrame operations only.

Each source's words, in a hashed order of its documents, are a stream cut into
blocks of ``BLOCK`` words. Targets share all words by weight; a target stops at
``REPEAT`` times its source's words, and the excess is shared by weight among the
rest. The mix is a row of slots, one block each, in output shards of ``SHARD``
slots. In every shard the counts of the sources are a multinomial draw by target
(one independent draw a slot). A source's slots are numbered over all shards;
those past its quota, which is its target in blocks, go to the sources that the
draw left short, so every target is met to within a block. Slot number c of a
source takes block ``perm(c mod blocks)``, ``perm`` a pseudorandom permutation of
the source's block numbers for each turn through them (swap-or-not, Hoang,
Morris, Rogaway 2012). Slots and blocks are joined by number.

Running sums over documents, shards and slots go in two steps, by group and
over groups, so that a source with a third of all rows is never one task's
work. The source table has a row per source.

Defined results: a null text has no words; a null source is a source of its own,
sorted last; documents without words take nothing; with no words at all every
target is 0, and an empty table gives no rows; repeated rows are separate documents,
and equal places in the hashed order go by row; a very long text is counted whole and
taken block by block; the same rows give the same mix; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, packed, text_or_empty, unpacked

WEIGHTS = (5, 2, 1)
REPEAT, BLOCK, SHARD, GROUP, SEED, ROUNDS = 3, 64, 1024, 4096, 17, 24


def running(df: DataFrame, keys: list[str], group: str, order: list[str], value: Column, into: str) -> DataFrame:
    """Sum of ``value`` over the rows of ``keys`` that come before by (group, order)."""
    df = df.withColumn("_v", value)
    sums = df.groupBy(*keys, group).agg(F.sum("_v").alias("_g"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.withColumn("_first", F.coalesce(F.sum("_g").over(before(Window.partitionBy(*keys).orderBy(group))), F.lit(0))).drop("_g")
    inside = F.coalesce(F.sum("_v").over(before(Window.partitionBy(*keys, group).orderBy(*order))), F.lit(0))
    return df.withColumn("_in", inside).join(firsts, [*keys, group]).withColumn(into, F.col("_first") + F.col("_in")).drop("_v", "_in", "_first")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """(source, sid, source_size, target). sizes: source, size. A source per row, so
    one task may rank them. The share per weight is fixed by the sources that stop:
    by rising limit per weight, a source stops while what is left over exceeds its limit."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = own.withColumn("sid", F.row_number().over(by_name) - 1).withColumn("w", F.array(*map(F.lit, weights))[F.col("sid") % len(weights)])
    limit = ranked.withColumn("r", repeat * F.col("source_size") / F.col("w"))
    rising = Window.orderBy("r", "sid")
    upto, every = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - repeat * F.coalesce(F.sum("source_size").over(upto), F.lit(0))
    share = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0)))
    shared = limit.withColumn("share", share)
    level = F.min(F.when(F.col("share") <= F.col("r"), F.struct("r", "sid", "share"))).over(every)["share"]
    return shared.withColumn("level", level).select("source", "sid", "source_size", F.least(F.col("level") * F.col("w"), F.lit(float(repeat)) * F.col("source_size")).alias("target"))


def permuted(x: Column, n: Column, *seed: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0 .. n - 1 for each seed, at x."""
    step = lambda v, r: (F.pmod(F.xxhash64(*seed, r), n) - v + n) % n
    turn = lambda v, r: F.transform(F.array(step(v, r)), lambda w: F.when(F.xxhash64(*seed, r, F.greatest(v, w), F.lit(1)).bitwiseAND(F.lit(1)) == 1, w).otherwise(v))[0]
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, turn)


def _between(points: DataFrame, point: str, ranges: DataFrame, n: int, cells: int) -> DataFrame:
    """Joins each point in 0 .. n - 1 with the range [lo, hi) it lies in, by equal cells."""
    width = max(1, -(-n // cells))
    spread = ranges.where("hi > lo").withColumn("_cell", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    return points.withColumn("_cell", F.expr(f"{point} div {width}")).join(spread, "_cell").where((F.col(point) >= F.col("lo")) & (F.col(point) < F.col("hi"))).drop("_cell")


def layout(docs: DataFrame, row: list[str], block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(documents with sid, source_size, target and ``at``, their first word's place
    in the source's stream; sources with their blocks and quota of slots). docs: the
    columns ``row``, source and size; the last of ``row`` only tells equal rows apart."""
    sources = targets(docs)
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    quota = F.when(F.col("source_size") > 0, F.round(blocks * F.col("target") / F.col("source_size")).cast("long")).otherwise(0)
    sources = materialize(sources.withColumn("blocks", blocks).withColumn("quota", quota), "sources")
    groups = max(1, -(-docs.count() // GROUP))
    joined = docs.join(sources, docs["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    dealt = joined.withColumn("_h", F.xxhash64(F.lit(SEED), *row[:-1])).withColumn("_group", F.pmod("_h", F.lit(groups)))
    placed = running(dealt, ["sid"], "_group", ["_h", *row], F.col("size"), "at").drop("_h", "_group", "quota", "blocks")
    return materialize(placed, "layout"), sources


def slots(sources: DataFrame) -> DataFrame:
    """(slot, shard, sid, block): the mix, a block a slot."""
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("n"), F.count("*").alias("s")).first()
    n, cells = total["n"], 4 * max(1, total["s"])
    spark = sources.sparkSession
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    shares = sources.withColumn("lo", F.coalesce(F.sum("quota").over(upto), F.lit(0))).withColumn("hi", F.col("lo") + F.col("quota"))
    drawn = spark.range(n).select(F.col("id").alias("slot"), F.expr(f"id div {SHARD}").alias("shard"), F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(max(1, n))).alias("v"))
    drawn = _between(drawn, "v", shares.select("sid", "lo", "hi", "quota", "blocks"), n, cells).drop("v", "lo", "hi")
    counts = drawn.groupBy("shard", "sid").agg(F.count("*").alias("draws"))
    firsts = running(counts.withColumn("_group", F.expr(f"shard div {GROUP}")), ["sid"], "_group", ["shard"], F.col("draws"), "first")
    inside = F.row_number().over(Window.partitionBy("shard", "sid").orderBy("slot")) - 1
    numbered = materialize(drawn.withColumn("_in", inside).join(firsts.select("shard", "sid", "first"), ["shard", "sid"]).withColumn("c", F.col("first") + F.col("_in")).drop("first", "_in"), "draws")

    got = numbered.groupBy("sid").agg(F.count("*").alias("got"))
    state = sources.select("sid", "quota", "blocks").join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    over, short = F.greatest(F.col("got") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("got"), F.lit(0))
    base = state.withColumn("over_lo", F.coalesce(F.sum(over).over(upto), F.lit(0))).withColumn("lo", F.coalesce(F.sum(short).over(upto), F.lit(0))).withColumn("hi", F.col("lo") + short)
    base = materialize(base, "quotas")
    extra = numbered.where("c >= quota").join(base.select("sid", "over_lo"), "sid").select("slot", "shard", (F.col("over_lo") + F.col("c") - F.col("quota")).alias("e"))
    moved = _between(extra, "e", base.select("sid", "lo", "hi", "got", "blocks"), n, cells).select("slot", "shard", "sid", "blocks", (F.col("got") + F.col("e") - F.col("lo")).alias("c"))
    kept = numbered.where("c < quota").select("slot", "shard", "sid", "blocks", "c")
    block = permuted(F.col("c") % F.col("blocks"), F.col("blocks"), F.lit(SEED), F.col("sid"), F.expr("c div blocks"))
    return kept.union(moved).select("slot", "shard", "sid", block.alias("block"))


def block_uses(placed: DataFrame, mix: DataFrame, row: list[str], block: int = BLOCK) -> DataFrame:
    """(row, uses array<struct<block, words, uses>> by block): what the mix takes of each document with words."""
    uses = mix.groupBy("sid", "block").agg(F.count("*").alias("uses"))
    last = F.expr(f"(at + size - 1) div {block}")
    spans = placed.where("size > 0").select(*row, "sid", "at", "size", F.explode(F.sequence(F.expr(f"at div {block}"), last)).alias("block"))
    words = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("at"), F.col("block") * block)
    parts = spans.select(*row, "at", "sid", "block", words.alias("words")).join(uses, ["sid", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    return parts.groupBy(*row, "sid", "at").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"), F.sort_array(F.collect_list(F.struct("block", "words", "uses"))).alias("uses"))


def _rows(docs: DataFrame, *more: str) -> DataFrame:
    """A written table with a number for each row, so that equal rows stay apart."""
    size = F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("long").alias("size")
    return materialize(docs.select("doc_id", "source", *more, F.xxhash64("text").alias("_t"), size).withColumn("_row", F.monotonically_increasing_id()), "rows")


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document what the mix takes of it."""
    row = ["doc_id", "_t", "_row"]
    rows = _rows(docs)
    placed, sources = layout(rows, row)
    taken = block_uses(placed, slots(sources), row).select(F.col("_row"), "taken")
    return placed.join(taken, "_row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as rows with the columns of ``docs``: of each document the words of
    the blocks taken at least once, then those taken at least twice, and so on, a
    row each; where that is the whole document, its text is unchanged. The longest
    document part in a row is the document itself."""
    row = ["doc_id", "_t", "_row"]
    rows = _rows(packed(docs, "doc_id", "source", "text"), "text", "_rest")
    placed, sources = layout(rows.select(*row, "source", "size"), row, block)
    used = block_uses(placed, slots(sources), row, block).select("_row", "at", "uses")
    turns = F.explode(F.sequence(F.lit(1), F.array_max(F.col("uses.uses"))))
    part = rows.join(used.where(F.array_max(F.col("uses.uses")) > 0), "_row").withColumn("_turn", turns)
    whole = F.array_min(F.col("uses.uses")) >= F.col("_turn")
    first = F.expr(f"at div {block}")
    uses = F.col("uses.uses")
    words = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    taken = F.transform(F.array(uses), lambda u: F.array_join(F.filter(words, lambda _, i: F.get(u, F.floor((F.col("at") + i) / block).cast("int") - first.cast("int")) >= F.col("_turn")), ""))[0]
    text = F.when(whole, F.col("text")).otherwise(F.ltrim(taken))
    made = part.select("doc_id", "source", text.alias("text"), "_rest")
    return unpacked(made, docs, ("doc_id", "source", "text"), **({"n_chars": F.length("text")} if "n_chars" in docs.columns else {}))
