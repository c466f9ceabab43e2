"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's set of word shingles gives a signature of ``COORDS`` minima. Equal
sets are one node, so that copies cost nothing further. A node is posted under its
coordinate values; the nodes of one value are a list. A pair with a similarity of
0.75 collides in ``MATCHES`` coordinates but for a chance of 4.6e-6 (binomial).

Prefix: whoever collides in ``MATCHES`` of ``COORDS`` collides in one of any
``PREFIX`` = ``COORDS - MATCHES + 1`` of them. So nodes without a partner in the
first ``PREFIX`` coordinates go at once, and the others are posted under their
``PREFIX`` rarest values only. Skip merging: the long lists are not merged; for a
pair that the short ones give, the collisions are counted over all coordinates in
the two nodes' own signatures, and pairs below ``MATCHES`` go.

A family of documents that share a passage, with similarities between ``MATCHES`` /
``COORDS`` and the threshold, collides in enough coordinates though none of it is
linked. So of the nodes that have more than ``BUSY`` pairs across components a shingle the
private shingles are counted, those that no other component of such nodes holds. Sets
of n and m shingles, p and q of them private, have at most (n + m - p - q) / 2 in
common, so linked ones have p + q <= (n + m) (DEN - NUM) / (DEN + NUM), and one of the
two is light: its own share of private shingles is no more than that. Pairs without a
light node are never formed. Nodes that are not busy count as light and cost at most
``BUSY`` pairs a shingle. What can still grow faster than the texts are lists of light
nodes that are not linked: documents put together from passages of which each is held
by others as well.

Pairs come from the lists in two rounds, so that a group of thousands of near
copies costs pairs in proportion to its size. First each list gives the pairs of
its nodes with one of them, the one whose values are held by the most nodes in all:
in a family of copies that is the original. Linked nodes are a component. Then the
lists that still hold several components give the pairs across components; a value
that no other component holds cannot collide, so it only takes up a place in the
prefix. In both rounds a pair must first pass a length filter and an odd sketch of
the sets, a bound that no linked pair fails. Texts are read only of busy nodes and of
pairs with enough collisions; whether those are linked is decided by their full sets alone.

Defined results: a null text, or one without words, has an empty set and is
linked with nothing; fewer than ``SHINGLE`` words are one shingle; a very long text
is taken whole; an empty table gives an empty one; rows that share
a doc_id are one node; a row without doc_id is linked with nothing, has no component
and is kept; among equal nodes the least id comes first; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import materialize, rows_of, small_batches, small_enough

SHINGLE, COORDS, MATCHES, ODD = 5, 64, 32, 512
PREFIX = COORDS - MATCHES + 1
NUM, DEN = 75, 100  # links: DEN * intersection >= NUM * union
LEAVES = 4096  # of one node in one task, about, when texts are compared
BLOCK = 4096  # nodes of one list in one task, about
BUSY = 16  # a node with more pairs across components for each shingle has its private shingles counted first

_rng = np.random.default_rng(20_240_607)
_MUL = _rng.integers(1, 1 << 63, COORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDS, np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted, distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out += h[i : i + n] * _PLACE[i]
        out ^= out >> np.uint64(29)
    out *= _PLACE[-1]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """A value a coordinate, with the coordinate in its last bits: a posting's key is both."""
    out = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1 << 12):
        np.minimum(out, (s[None, at : at + (1 << 12)] * _MUL[:, None] + _ADD[:, None]).min(axis=1), out=out)
    return out & ~np.uint64(COORDS - 1) | np.arange(COORDS, dtype=np.uint64)


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """``ODD`` bits, each the parity of the shingles that hash to it (Mitzenmacher, Pagh,
    Pham, 2014). Two sketches differ in no more bits than their sets differ in shingles."""
    return np.packbits(np.bincount((s >> np.uint64(7) & np.uint64(ODD - 1)).astype(np.int64), minlength=ODD) & 1).view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, set_key, odd, sig); an empty set has no key and no signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, odds, sigs = [], [], [], []
            for t in b.column(1):
                s = shingles(t.as_py())
                n.append(len(s))
                if len(s):
                    sig = signature(s)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    odds.append(odd_sketch(s))
                    sigs.append(sig.view(np.int64))
                else:
                    keys.append(None), odds.append(None), sigs.append(None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(odds, longs), pa.array(sigs, longs)],
                names=[id_col, "n_shingles", "set_key", "odd", "sig"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_shingles long, set_key binary, odd array<long>, sig array<long>")


def with_partners(nodes: DataFrame) -> DataFrame:
    """The nodes that share a value of their first ``PREFIX`` coordinates. nodes: node, sig, ..."""
    posts = nodes.select("node", F.explode(F.slice("sig", 1, PREFIX)).alias("value"))
    shared = materialize(posts.groupBy("value").agg(F.count("*").alias("_c")).where("_c > 1").select("value"), "values")
    some = materialize(posts.join(shared, "value", "left_semi").select("node").distinct(), "partners")
    return nodes.join(small_enough(some), "node", "left_semi")


def _fits(a: str, b: str) -> Column:
    """Lengths allow the similarity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return DEN * F.least(n, m) >= NUM * F.greatest(n, m)


def _near(a: str, b: str) -> Column:
    """Sets that are similar enough differ in (n + m) (DEN - NUM) / (DEN + NUM) shingles at most."""
    apart = sum((F.bit_count(F.get(f"{a}.odd", F.lit(i)).bitwiseXOR(F.get(f"{b}.odd", F.lit(i)))) for i in range(ODD // 64)), F.lit(0))
    return (DEN + NUM) * apart <= (DEN - NUM) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def star_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): each node with the hub of each list of its prefix. nodes: node, n, odd, sig."""
    posts = nodes.select("node", F.explode("sig").alias("value"))
    held = posts.groupBy("value").agg(F.count("*").alias("c")).where("c > 1")
    most = posts.join(held, "value").groupBy("node").agg(F.sum("c").alias("_all"), F.array_sort(F.collect_list(F.struct("c", "value"))).alias("_own"))
    # values that no other node holds come first; they only take up places
    prefix = F.slice("_own", F.lit(1), F.greatest(F.lit(0), PREFIX - COORDS + F.size("_own")))
    short = materialize(nodes.join(most.where(F.size("_own") >= MATCHES), "node").select("node", "n", "odd", "_all", F.transform(prefix, lambda x: x["value"]).alias("values")), "prefixes")
    lists = short.select(F.explode("values").alias("value"), "node", "n", "odd", "_all")
    hubs = lists.groupBy("value").agg(F.max(F.struct("_all", "node", "n", "odd")).alias("hub"), F.count("*").alias("c")).where("c > 1").select("value", "hub")
    both = lists.select("value", F.struct("node", "n", "odd").alias("x")).join(materialize(hubs, "hubs"), "value")
    return both.where((F.col("x.node") != F.col("hub.node")) & _fits("x", "hub") & _near("x", "hub")).select(F.col("hub.node").alias("a"), F.col("x.node").alias("b")).distinct()


def private_shingles(busy: DataFrame, texts: DataFrame) -> DataFrame:
    """(set, private): how many of a set's shingles no other component of ``busy`` holds.
    Those that three or more sets of one component share are left out, which lowers the
    number. busy: node, comp, distinct; texts: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            held = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), held], names=["comp", "set_key", "held"])

    of = texts.join(small_enough(busy), "node").select("comp", "text")
    held = of.mapInArrow(run, f"comp {busy.schema['comp'].dataType.simpleString()}, set_key binary, held array<long>")
    posts = held.select("comp", F.xxhash64("set_key").alias("set"), F.explode("held").alias("shingle"))
    ends = posts.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("set").alias("a"), F.max("set").alias("b"))
    own = ends.where("lo = hi").select(F.explode(F.array_distinct(F.array("a", "b"))).alias("set"))
    return own.groupBy("set").agg(F.count("*").alias("private"))


def cross_lists(nodes: DataFrame, comps: DataFrame, texts: DataFrame) -> DataFrame:
    """(value, c, main, node, comp, n, odd, light): the prefixes' lists that hold several
    components. c: a list's length; main: of the component with most nodes in the list;
    two nodes that are not light cannot be linked. comps: node, component; a node without is
    its own."""
    told = nodes.join(small_enough(comps), "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    posts = told.select("node", "comp", F.explode("sig").alias("value"))
    mixed = posts.groupBy("value").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("value", "c")
    own = posts.join(mixed, "value").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "value"))).alias("_own")).where(F.size("_own") >= MATCHES)
    prefix = F.transform(F.slice("_own", F.lit(1), PREFIX - COORDS + F.size("_own")), lambda x: x["value"])
    lists = materialize(told.join(own, "node").select(F.explode(prefix).alias("value"), "node", "comp", "n", "odd", "set"), "mixed")
    groups = materialize(lists.groupBy("value", "comp").agg(F.count("*").alias("k")), "groups")
    wholes = groups.groupBy("value").agg(F.sum("k").alias("c"), F.count("*").alias("m"), F.max(F.struct("k", "comp")).alias("top")).where("m > 1")
    sized = groups.join(wholes, "value").select("value", "comp", "c", (F.col("c") - F.col("k")).alias("others"), (F.col("comp") == F.col("top.comp")).alias("main"))
    lists = materialize(lists.join(sized, ["value", "comp"]), "placed")
    busy = materialize(lists.groupBy("node", "set", "comp", "n").agg(F.sum("others").alias("looks")).where(F.col("looks") > BUSY * F.col("n")), "busy")
    if rows_of(busy):
        private = private_shingles(materialize(busy.select("node", "comp").distinct(), "busy_nodes"), texts)
        heavy = busy.join(private, "set").where((DEN + NUM) * F.col("private") > (DEN - NUM) * F.col("n")).select("set", F.lit(True).alias("heavy"))
        lists = lists.join(small_enough(materialize(heavy, "heavy")), "set", "left").withColumn("light", F.col("heavy").isNull())
    else:
        lists = lists.withColumn("light", F.lit(True))
    return lists.select("value", "c", "main", "node", "comp", "n", "odd", "light")


def cross_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): nodes of different components that share a list, one of them light at least.
    The nodes outside a list's main component meet all its nodes; no component is larger
    than the main one, so at most every other pair formed is within a component. They are
    dealt over tasks, about ``BLOCK`` to each."""
    blocks = F.floor(F.col("c") / BLOCK)
    meets = F.explode(F.when(F.col("light"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))))
    x = lists.where("not main").withColumn("block", F.pmod(F.xxhash64("node"), 1 + blocks)).withColumn("side", meets).alias("x")
    y = lists.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks))).withColumn("side", F.col("light")).alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("value", "block", "side")]
    once = (F.col("x.comp") < F.col("y.comp")) | F.col("y.main") & (F.col("x.comp") != F.col("y.comp"))
    on = same[0] & same[1] & same[2] & once & _fits("x", "y") & _near("x", "y")
    return x.join(y, on).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def colliding(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that collide in ``MATCHES`` coordinates or more."""
    sig = lambda x: nodes.select(F.col("node").alias(x), F.col("sig").alias(f"_{x}"))
    both = pairs.join(sig("b"), "b").join(sig("a"), "a")
    count = F.size(F.filter(F.zip_with("_a", "_b", lambda x, y: x == y), lambda same: same))
    return both.where(count >= MATCHES).select("a", "b").distinct()


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v) of the pairs (a, b) whose full sets are similar enough. texts: node, text.
    The leaves of a node ``a`` are dealt over tasks, about ``LEAVES`` to each, and its
    text goes to each of them once."""
    pairs = materialize(pairs, "pairs")
    used = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "used")
    texts = texts.join(small_enough(used), "node", "left_semi")
    deal = F.pmod(F.xxhash64("b"), F.lit(1 + rows_of(pairs) // LEAVES)).alias("_deal")
    dealt = pairs.select("a", "b", deal)
    leaves = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "_deal", F.lit(1).alias("_leaf"), "b", "text")
    hubs = dealt.select("a", "_deal").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "_deal", F.lit(0).alias("_leaf"), F.col("a").alias("b"), "text")
    rows = hubs.union(leaves).repartition("a", "_deal").sortWithinPartitions("a", "_deal", "_leaf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, own = None, []
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if key != of:
                    of, own = key, []
                s = shingles(batch.column(4)[i].as_py())
                if batch.column(2)[i].as_py() == 0:
                    own.append(s)
                    keep.append(False)
                else:
                    same = [(len(np.intersect1d(x, s, assume_unique=True)), len(x)) for x in own]
                    keep.append(any(DEN * k >= NUM * (m + len(s) - k) for k, m in same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"u {kind}, v {kind}"), "links")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component): the component is the least id reachable by links."""
    with small_batches(docs.sparkSession):
        return _link(docs, id_col, text_col)


def _link(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = materialize(signatures(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text"), "signatures")
    keyed = rows.where("set_key is not null and _id is not null")
    copied = materialize(keyed.groupBy("set_key").agg(F.min("_id").alias("node"), F.count("*").alias("c")).where("c > 1").drop("c"), "classes")
    members = materialize(keyed.select("_id", "set_key").join(small_enough(copied), "set_key").where("_id <> node").distinct(), "members")
    leave = small_enough(members).select(F.col("_id").alias("_m"), F.col("set_key").alias("_k"))
    own = keyed.join(leave, (F.col("_id") == F.col("_m")) & (F.col("set_key") == F.col("_k")), "left_anti")
    nodes = own.select(F.col("_id").alias("node"), F.col("n_shingles").alias("n"), F.xxhash64("set_key").alias("set"), "odd", "sig")
    nodes = materialize(with_partners(nodes.dropDuplicates(["node", "set"])), "nodes")
    texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))

    comps = materialize(components(confirm(colliding(star_pairs(nodes), nodes), texts)), "components")
    across = confirm(colliding(cross_pairs(cross_lists(nodes, comps, texts)), nodes), texts)
    if rows_of(across):
        end = lambda x: small_enough(comps).select(F.col("node").alias(x), F.col("component").alias(f"_{x}"))
        of = across.join(end("u"), "u", "left").join(end("v"), "v", "left")
        joined = materialize(components(of.select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))), "joined")
        later = small_enough(joined).select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        known = comps.join(later, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_c", "component").alias("component"))
        comps = materialize(known.union(joined.join(comps, "node", "left_anti")), "components")

    told = rows.select("_id", "n_shingles", "set_key").join(small_enough(members).select("_id", "set_key", F.col("node").alias("_node")), ["_id", "set_key"], "left")
    of = told.select("_id", "n_shingles", F.coalesce("_node", "_id").alias("node"))
    return of.join(small_enough(comps), "node", "left").select(F.col("_id").alias(id_col), "n_shingles", F.when(F.col("_id").isNotNull(), F.coalesce("component", "node")).alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document its set size, its component and whether it is the one kept."""
    return link(docs).select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near copies of a document with a smaller id; of rows
    that repeat an id, all stay. Null and empty texts stay; an empty table stays empty."""
    gone = materialize(link(docs).where("component <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(small_enough(gone), "doc_id", "left_anti")
