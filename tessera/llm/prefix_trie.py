"""Prefix trie of conversations, by first owned depths.

A prefix of d turns is a sum over its turns of 160 bits that depend on the turn's
place and SHA-256, so prefixes come from running sums and a conversation is never in
one piece. Its minimum is the smallest conversation that has it; that one owns the
prefix's node. Minima can only rise along a conversation, so what it owns is a chain
from its first owned depth to its end. That depth is found for all conversations at
once by binary search: each round joins a probe a conversation with the minima.

The chains are the tree: a chain hangs from the owner of the prefix before its first
node. Sums over subtrees go bottom-up over chains, the deepest level first: running
sums along each chain, whose first node's total then goes, added up for each node, to
the level above. A round reads its own level only. Levels are found by doubling.

Skew: a node that many conversations share is counted in each task before the shuffle;
probes are keyed by conversation and depth; the ids that end at a node are joined to
text in ranges of ``RANGE`` ids, and its digest streams over them in order, as SHA-256
must. The joins that remain on a shared node (its owner for the chains that hang from
it) are of rows of a few numbers and split by AQE.

Defined results: a null role or text is empty; turns go by turn, null first, equal ones
by role, then text; repeated rows are turns of their own; rows without conv_id take no
part; a conversation that the rebuilding leaves without turns is a member of the root
and ends there; an empty table gives no rows, as nothing starts with the root; texts
are read whole; a conversation may have 2^23 turns (the sums then leave a long); other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, rows_of

FAMILY, HEADS = 100, 6  # conversation c starts with crc32(c) % HEADS turns of c - c % FAMILY
SPAN, RANGE = 256, 4096
LANES = ("l0", "l1", "l2", "l3")
NODE = ["depth", *LANES]


def running(rows: DataFrame, key: str, at: str, sums: dict[str, Column], order: list[str] | None = None) -> DataFrame:
    """Adds sums over the rows of ``key`` up to each row, by ``at`` (within it by
    ``order``). In two steps, within spans of ``at`` and over spans."""
    names = list(sums)
    rows = rows.withColumn("_span", F.coalesce(F.expr(f"{at} div {SPAN}"), F.lit(-(1 << 62)))).withColumns({f"_v_{c}": v for c, v in sums.items()})
    whole = rows.groupBy(key, "_span").agg(*[F.sum(f"_v_{c}").alias(f"_s_{c}") for c in names])
    earlier = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select(key, "_span", *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in names])
    inside = Window.partitionBy(key, "_span").orderBy(*(order or [at])).rowsBetween(Window.unboundedPreceding, 0)
    added = rows.withColumns({f"_w_{c}": F.sum(f"_v_{c}").over(inside) for c in names}).join(before, [key, "_span"])
    return added.select(*[c for c in rows.columns if c != "_span" and not c.startswith("_v_")], *[(F.col(f"_w_{c}") + F.col(f"_b_{c}")).alias(c) for c in names])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, key, chars)."""
    full = lambda c: F.coalesce(c, F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), full("role").alias("role"), full("text").alias("text"))
    placed = running(rows, "conv_id", "turn", {"pos": F.lit(1)}, ["turn", "role", "text"])
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return placed.select("conv_id", "pos", key.alias("key"), F.length("text").cast("long").alias("chars"))


def rebuilt(original: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, depth, key, chars; conversations: conv_id, length): each starts
    with the first turns of its family's first conversation."""
    sizes = original.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = sizes.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = materialize(convs.select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    firsts = original.where(F.col("pos") < heads).withColumnRenamed("conv_id", "base")
    head = convs.where("head > 0").select("conv_id", "base", "head").join(firsts, "base").where("pos <= head").select("conv_id", F.col("pos").alias("depth"), "key", "chars")
    tail = original.join(convs.select("conv_id", "h", "head"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("depth"), "key", "chars")
    return head.union(tail), convs.select("conv_id", "length")


def prefixes(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, lanes, chars): a row a conversation and depth, the root's 0 included."""
    bits = {lane: F.xxhash64(F.lit(k), "depth", "key").bitwiseAND(F.lit((1 << 40) - 1)) for k, lane in enumerate(LANES)}
    summed = running(placed, "conv_id", "depth", bits).select("conv_id", *NODE, "chars")
    zero = F.lit(0).cast("long")
    return summed.union(convs.select("conv_id", zero, *[zero] * len(LANES), zero))


def first_owned(minima: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, length, first): the least depth whose prefix has no smaller conversation,
    length + 1 if there is none. By binary search, a probe a conversation and round."""
    most = convs.agg(F.max("length")).first()[0]
    search = convs.select("conv_id", "length", F.lit(0).cast("long").alias("lo"), (F.col("length") + 1).alias("hi"))
    owners = minima.select("conv_id", "depth", F.lit(True).alias("own"))
    for _ in range(ceil(log2(most + 2))):
        probes = search.withColumn("depth", F.expr("(lo + hi) div 2"))
        open_ = F.col("lo") < F.col("hi")
        found = probes.join(owners, ["conv_id", "depth"], "left")
        search = materialize(
            found.select(
                "conv_id",
                "length",
                F.when(open_ & F.col("own").isNull(), F.col("depth") + 1).otherwise(F.col("lo")).alias("lo"),
                F.when(open_ & F.col("own"), F.col("depth")).otherwise(F.col("hi")).alias("hi"),
            ),
            "search",
        )
    return search.select("conv_id", "length", F.col("lo").alias("first"))


def chains(firsts: DataFrame, ways: DataFrame, minima: DataFrame) -> DataFrame:
    """(conv_id, length, first, parent, level) of conversations that own something.
    parent owns the node at depth first - 1; it is null for the root's chain, level 0."""
    owning = firsts.where("first <= length")
    root = F.broadcast(minima.where("depth = 0").select(F.col("conv_id").alias("root")))  # one row
    from_root = owning.where("first <= 1").join(root).select("conv_id", "length", "first", F.when(F.col("first") == 1, F.col("root")).alias("parent"))
    tops = owning.where("first > 1").withColumn("depth", F.col("first") - 1).join(ways.select("conv_id", *NODE), ["conv_id", "depth"])
    deeper = tops.join(minima.select(*NODE, F.col("conv_id").alias("parent")), NODE).select("conv_id", "length", "first", "parent")
    linked = materialize(from_root.union(deeper), "chains")
    above_root = F.when(F.col("parent") == F.col("root"), None).otherwise(F.col("parent"))
    up = materialize(linked.join(root).select("conv_id", above_root.alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("level")), "levels")
    while rows_of(waiting := materialize(up.where("up is not null"), "levels-open")):
        next_ = up.select(F.col("conv_id").alias("up"), F.col("up").alias("_up"), F.col("level").alias("_level"))
        moved = waiting.join(next_, "up").select("conv_id", F.col("_up").alias("up"), (F.col("level") + F.col("_level")).alias("level"))
        up = materialize(up.where("up is null").union(moved), "levels")
    return linked.join(up.select("conv_id", "level"), "conv_id")


def subtree_sums(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Result tables, a level each. nodes: conv_id, depth, first, length, parent, level,
    n_convs, chars; laid out by level."""
    out, inbox = [], None
    for level in range(levels, -1, -1):
        own = nodes.where(F.col("level") == level).drop("level")
        if inbox is None:
            own = own.withColumns({c: F.lit(0).cast("long") for c in ("hung", "leaves_in", "saved_in")})
        else:
            own = own.join(inbox, ["conv_id", "depth"], "left").fillna(0, ["hung", "leaves_in", "saved_in"])
        own = own.withColumn("n_children", F.col("hung") + (F.col("depth") < F.col("length")).cast("long")).withColumn("_up", -F.col("depth"))
        leaf = (F.col("n_children") == 0).cast("long")
        sums = {"n_leaves": leaf + F.col("leaves_in"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars") + F.col("saved_in")}
        done = running(own, "conv_id", "_up", sums)
        above = F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent"))
        done = materialize(done.select("conv_id", "depth", "first", above.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens"), "subtrees")
        tops = done.where("depth = first and depth > 0").select(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), "n_leaves", "saved_tokens")
        inbox = tops.groupBy("conv_id", "depth").agg(F.count("*").alias("hung"), F.sum("n_leaves").alias("leaves_in"), F.sum("saved_tokens").alias("saved_in"))
        out.append(done.drop("first"))
    return out


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a node are adjacent and in order; a digest is carried over batches."""
    node, digest = None, None
    for batch in batches:
        done = []
        for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
            if (conv, depth) != node:
                if node:
                    done.append((*node, digest.hexdigest()))
                node, digest = (conv, depth), hashlib.sha256()
                digest.update(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield _digest_rows(done)
    if node:
        yield _digest_rows([(*node, digest.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["conv_id", "depth", "ends_sha256"])


def ends(ways: DataFrame, convs: DataFrame, minima: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes at which a conversation ends."""
    last = convs.select("conv_id", F.col("length").alias("depth")).join(ways.select("conv_id", *NODE), ["conv_id", "depth"])
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    ranges = last.groupBy(*NODE, F.expr(f"conv_id div {RANGE}").alias("range")).agg(ids.alias("ids"))
    owned = ranges.join(minima.select(*NODE, "conv_id"), NODE).select("conv_id", "depth", "range", "ids")
    return owned.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "range").mapInArrow(_stream_digests, "conv_id long, depth long, ends_sha256 string")


def trie(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of conversations. placed: conv_id, depth from 1 without gaps, key
    (binary, equal for equal turns), chars; convs: conv_id, length, a row each."""
    convs = materialize(convs, "lengths")
    ways = materialize(prefixes(placed, convs), "prefixes")
    minima = materialize(ways.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars")), "minima")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    if not rows_of(convs):
        return convs.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in columns[1:]], F.lit("").alias("ends_sha256"))
    firsts = first_owned(minima, convs)
    linked = chains(firsts, ways, minima)
    nodes = materialize(minima.select("conv_id", "depth", "n_convs", "chars").join(linked, "conv_id"), "nodes", by="level")
    levels = nodes.agg(F.max("level")).first()[0]
    parts = subtree_sums(nodes, levels)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.select(*columns).join(ends(ways, convs, minima), ["conv_id", "depth"], "left").select(*columns, F.coalesce("ends_sha256", none).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations: a row a node, the root included."""
    original = materialize(turns(conversations), "turns")
    return trie(*rebuilt(original))


SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS turns,
         list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(3988292384 AS BIGINT) FOR _ IN range(8)]),
             lambda v, p: xor(v >> 1, p * (v & 1))), CAST(4294967295 AS BIGINT)) AS raw
  FROM t GROUP BY conv_id
), h AS (
  SELECT conv_id, turns, xor(raw, 4294967295) % 6 AS h FROM own
), r AS (
  SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns
  FROM h LEFT JOIN h b ON b.conv_id = h.conv_id - h.conv_id % 100
), p AS (
  SELECT conv_id, len(turns) AS length, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r
), q AS (
  SELECT conv_id, length, depth, turns[1:depth] AS prefix FROM p
), nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE length = depth), '')) AS ends_sha256,
         CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(prefix[depth].text) END AS saved
  FROM q GROUP BY prefix, depth
), kids AS (
  SELECT n.*, up.conv_id AS parent_conv_id, up.prefix AS up FROM nodes n LEFT JOIN nodes up ON n.depth > 0 AND up.depth = n.depth - 1 AND up.prefix = n.prefix[1:n.depth - 1]
), counts AS (
  SELECT up, depth - 1 AS depth, count(*) AS n_children FROM kids WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
  SELECT k.*, coalesce(c.n_children, 0) AS n_children FROM kids k LEFT JOIN counts c ON k.prefix = c.up AND k.depth = c.depth
), above AS (
  SELECT prefix, depth, n_children, saved, unnest(range(0, depth + 1)) AS d FROM full_nodes
), sums AS (
  SELECT prefix[1:d] AS prefix, d AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM above GROUP BY ALL
)
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON n.prefix = s.prefix AND n.depth = s.depth
"""
