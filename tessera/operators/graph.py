"""Traversal of call and import graphs. edges: columns src and dst.

Walks go level by level. A level's nodes are held on the driver only while they
number ``NARROW`` at most, which a limit on what is collected ensures; a wider
walk goes on with tables, joined and written level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import cut
from .components import components

NARROW = 1000
MOST_DEPTH, MOST_CHILDREN = 8, 10


def callers(calls: DataFrame, symbols: DataFrame, node: int) -> DataFrame:
    """A row per call site, so a caller may come more than once."""
    return calls.where(F.col("dst") == node).join(symbols, F.col("src") == symbols.id).select("id", "name", "kind").orderBy("id")


def callees(calls: DataFrame, symbols: DataFrame, node: int) -> DataFrame:
    return calls.where(F.col("src") == node).join(symbols, F.col("dst") == symbols.id).select("id", "name", "kind").orderBy("id")


def neighbourhood(calls: DataFrame, symbols: DataFrame, node: int, radius: int = 1) -> DataFrame:
    """The symbols of the node's file and, with a radius, its callers and callees; itself left out."""
    own = symbols.where(F.col("id") == node).select("file_id")
    ids = symbols.join(own, "file_id", "left_semi").select("id")
    if radius > 0:
        ids = ids.union(calls.where(F.col("dst") == node).select("src")).union(calls.where(F.col("src") == node).select("dst"))
    return symbols.join(ids.where(F.col("id") != node), "id", "left_semi").select("id", "name", "kind", "file_id")


def _turned(edges: DataFrame, direction: str) -> DataFrame:
    down = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    up = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"down": down, "up": up, "both": down.union(up)}[direction]


def reach(edges: DataFrame, starts: DataFrame, depth: int | None = None, direction: str = "down", narrow: int = NARROW) -> DataFrame:
    """(node, depth) of what can be reached from ``starts`` (a column node), the starts
    left out, each with its least depth."""
    steps = cut(_turned(edges, direction).distinct(), "steps")
    first = [r["node"] for r in starts.select("node").distinct().limit(narrow + 1).collect()]
    kind = steps.schema["b"].dataType.simpleString()
    spark = edges.sparkSession
    rows: list[tuple[int, int]] = []
    level, frontier, seen = 0, first, set(first)
    while len(seen) <= narrow and frontier and (depth is None or level < depth):
        level += 1
        found = [r["b"] for r in steps.where(F.col("a").isin(frontier) & ~F.col("b").isin(list(seen))).select("b").distinct().limit(narrow + 1).collect()]
        if len(seen) + len(found) > narrow:
            level -= 1
            break
        rows += [(b, level) for b in found]
        seen |= set(found)
        frontier = found
    else:
        if len(seen) <= narrow:
            return spark.createDataFrame(rows, f"node {kind}, depth int")
    begun = starts.select("node").distinct() if level == 0 else spark.createDataFrame([(n,) for n in frontier], f"node {kind}")
    known = cut((starts.select("node").distinct() if level == 0 else spark.createDataFrame([(n,) for n in seen], f"node {kind}")), "seen")
    out = [spark.createDataFrame(rows, f"node {kind}, depth int")]
    wide = begun
    while depth is None or level < depth:
        level += 1
        wide = cut(steps.join(wide, steps.a == wide.node).select(F.col("b").alias("node")).distinct().join(known, "node", "left_anti"), "level")
        if wide.isEmpty():
            break
        out.append(wide.select("node", F.lit(level).alias("depth")))
        known = cut(known.union(wide), "seen")
    return reduce(DataFrame.union, out)


def one(spark, node: int) -> DataFrame:
    return spark.createDataFrame([(node,)], "node long")


def impact(calls: DataFrame, symbols: DataFrame, node: int, depth: int = 5, direction: str = "up") -> DataFrame:
    """Symbols that a change of the node may reach, with depth, file and name."""
    found = reach(calls, one(calls.sparkSession, node), depth, direction)
    return found.join(symbols, found.node == symbols.id).select("id", "name", "file_id", "depth")


READ_BACK = 16  # steps of a path that one job reads back
KNOWN_PARTS = 8  # levels that are held as they are before they become one table
LOPSIDED = 8  # a side that is so many times wider than the other waits


def _fronts(steps: DataFrame, start: int, goal: int) -> tuple[list[DataFrame], list[DataFrame]] | None:
    """Levels from the start and back from the goal until they meet, as (node, prev); None
    if they do not. Each round goes a step on both sides in one job, or on one side while
    the other is ``LOPSIDED`` times wider."""
    spark = steps.sparkSession
    ends = {"f": start, "b": goal}
    frontier = spark.createDataFrame(list(ends.items()), "side string, node long")
    known, sizes = [frontier], {"f": 1, "b": 1}
    levels = {side: [one(spark, node)] for side, node in ends.items()}
    both = steps.select(F.lit("f").alias("side"), "a", "b").union(steps.select(F.lit("b").alias("side"), F.col("b").alias("a"), F.col("a").alias("b")))
    while True:
        go = [side for side, other in ("fb", "bf") if sizes[side] <= LOPSIDED * sizes[other]]
        here = frontier.where(F.col("side").isin(go))
        found = both.join(here, (both.side == here.side) & (both.a == here.node)).groupBy(both.side, F.col("b").alias("node")).agg(F.min("a").alias("prev"))
        level = cut(found.join(reduce(DataFrame.union, known), ["side", "node"], "left_anti"), "level")
        last = {side: levels[side][-1].select("node", F.lit(True).alias(f"last_{side}")) for side in ends}
        at = level.groupBy("node").agg(*[F.max(F.col("side") == side).alias(side) for side in ends])
        seen = at.join(last["f"], "node", "left").join(last["b"], "node", "left").agg(F.count_if("f").alias("f"), F.count_if("b").alias("b"), F.count_if(F.col("f") & F.col("last_b")).alias("forward"), F.count_if(F.col("b") & F.col("last_f")).alias("backward"), F.count_if(F.col("f") & F.col("b")).alias("between")).first()
        for side in go:
            sizes[side] = seen[side]
            levels[side].append(level.where(F.col("side") == side).select("node", "prev"))
        if seen["forward"]:
            return levels["f"], levels["b"][: len(levels["b"]) - ("b" in go)]
        if seen["backward"] or seen["between"]:
            return levels["f"][: len(levels["f"]) - ("f" in go and not seen["between"])], levels["b"]
        if not all(sizes.values()):
            return None
        level = level.select("side", "node")
        known.append(level)
        if len(known) > KNOWN_PARTS:
            known = [cut(reduce(DataFrame.union, known), "seen")]
        frontier = level if len(go) == 2 else frontier.where(~F.col("side").isin(go)).union(level)


def _path_of_few(steps: DataFrame, start: int, goal: int, narrow: int) -> list[int] | None:
    """The path, [] if there is none, while a round looks at ``narrow`` edges at most and
    the driver can hold them; None beyond that."""
    ahead: dict[int, int | None] = {start: None}
    back: dict[int, set[int]] = {goal: set()}
    front, rear = {start}, {goal}
    while front and rear:
        rows = steps.where(F.col("a").isin(list(front)) | F.col("b").isin(list(rear))).limit(narrow + 1).collect()
        if len(rows) > narrow or len(ahead) + len(back) > 2 * narrow:
            return None
        new_front: dict[int, int] = {}
        new_rear: dict[int, set[int]] = {}
        for a, b in rows:
            if a in front and b not in ahead:
                new_front[b] = min(new_front.get(b, a), a)
            if b in rear and a not in back:
                new_rear.setdefault(a, set()).add(b)
        ahead |= new_front
        middle = new_front.keys() & rear
        if not middle:
            back |= new_rear
            middle = new_front.keys() & new_rear.keys()
        if middle:
            before, level = {}, set(middle)
            while goal not in level:
                far: dict[int, int] = {}
                for x in level:
                    for y in back[x]:
                        far[y] = min(far.get(y, x), x)
                before |= far
                level = set(far)
            path = [goal]
            while path[-1] != start:
                path.append(before[path[-1]] if path[-1] in before else ahead[path[-1]])
            return path[::-1]
        front, rear = set(new_front), set(new_rear)
    return []


def shortest_path(edges: DataFrame, start: int, goal: int, narrow: int = NARROW) -> DataFrame:
    """(step, node) of a shortest directed path; of several, the one with the least
    predecessor at every step, seen from the goal. Empty if there is none. The search
    goes from both ends; predecessors of the far half are found from the middle on."""
    spark = edges.sparkSession
    if start == goal:
        return spark.createDataFrame([(0, start)], "step int, node long")
    steps = cut(_turned(edges, "down").distinct(), "steps")
    few = _path_of_few(steps, start, goal, narrow)
    if few is not None:
        return spark.createDataFrame(list(enumerate(few)), "step int, node long")
    fronts = _fronts(steps, start, goal)
    if fronts is None:
        return spark.createDataFrame([], "step int, node long")
    forward, back = fronts
    on_path = cut(forward[-1].join(back[-1].select("node"), "node", "left_semi").select("node"), "middle")
    levels = forward[1:]
    for behind in reversed(back[:-1]):
        ahead = steps.join(on_path, steps.a == on_path.node).groupBy(F.col("b").alias("node")).agg(F.min("a").alias("prev"))
        levels.append(cut(ahead.join(behind.select("node"), "node", "left_semi"), "far"))
        on_path = levels[-1].select("node")
    path = [goal]
    while levels:
        chunk, levels = levels[-READ_BACK:], levels[:-READ_BACK]
        row = chunk[-1].where(F.col("node") == path[-1]).select(F.col("prev").alias("p0"))
        for k, level in enumerate(reversed(chunk[:-1])):
            row = row.join(level.select(F.col("node").alias(f"p{k}"), F.col("prev").alias(f"p{k + 1}")), f"p{k}")
        found = row.first()
        path += [found[f"p{k}"] for k in range(len(chunk))]
    return spark.createDataFrame(list(enumerate(reversed(path))), "step int, node long")


def execution_flow(calls: DataFrame, start: int, depth: int = 5, most: int = MOST_CHILDREN) -> DataFrame:
    """The calls below ``start`` as paths: (path, node, depth, cyclic, more). A node
    shows its first ``most`` distinct callees by id; where there are more, a row with
    node -1 says how many. A callee already on the path is marked and not followed."""
    depth = min(depth, MOST_DEPTH)
    own = Window.partitionBy("src")
    ranked = calls.select("src", "dst").distinct().withColumn("_r", F.row_number().over(own.orderBy("dst"))).withColumn("_n", F.count("*").over(own))
    shown = cut(ranked.where(F.col("_r") <= most).select("src", "dst"), "shown")
    rest = cut(ranked.where(F.col("_r") == most + 1).select("src", (F.col("_n") - most).alias("more")), "rest")
    level = calls.sparkSession.createDataFrame([([start], start)], "path array<long>, node long")
    out = []
    for d in range(depth):
        nxt = level.join(shown, level.node == shown.src).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node"), F.lit(d).alias("depth"), F.array_contains("path", F.col("dst")).alias("cyclic"), F.lit(0).cast("long").alias("more"))
        more = level.join(rest, level.node == rest.src).select(F.concat("path", F.array(F.lit(-1).cast("long"))).alias("path"), F.lit(-1).cast("long").alias("node"), F.lit(d).alias("depth"), F.lit(False).alias("cyclic"), "more")
        nxt = cut(nxt, "flow")
        out += [nxt, more]
        level = nxt.where(~F.col("cyclic")).select("path", "node")
    return reduce(DataFrame.union, out)


def trace_chain(calls: DataFrame, start: int, depth: int = 5, direction: str = "down", narrow: int = 100_000) -> DataFrame:
    """(ordinal, node, depth, path): depth-first discovery with one visited set, so a
    node's depth need not be its least. The order is that of a single walk, which
    runs on the driver over what lies within ``depth``; more than ``narrow`` edges there
    are refused."""
    spark = calls.sparkSession
    steps = _turned(calls, direction).distinct()
    near = reach(calls, one(spark, start), depth, direction).select("node").union(one(spark, start))
    rows = steps.join(near, steps.a == near.node).select("a", "b").limit(narrow + 1).collect()
    if len(rows) > narrow:
        raise ValueError(f"more than {narrow} calls within depth {depth}; use reach()")
    children: dict[int, list[int]] = {}
    for r in rows:
        children.setdefault(r["a"], []).append(r["b"])
    out: list[tuple] = []
    visited: set[int] = set()

    stack: list[tuple[int, int, list[int]]] = [(start, 0, [start])]
    while stack:
        node, d, path = stack.pop()
        if node in visited or d > depth:
            continue
        visited.add(node)
        out.append((len(out), node, d, path))
        stack += [(c, d + 1, [*path, c]) for c in sorted(children.get(node, []), reverse=True)]
    return spark.createDataFrame(out, "ordinal int, node long, depth int, path array<long>")


def degrees(calls: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of every symbol with a call, by call sites."""
    o = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
    i = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
    return o.join(i, "id", "full").select("id", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))


def fan(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) of every file: distinct other files that import it, and that it imports."""
    pairs = imports.where("src <> dst").distinct()
    i = pairs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
    o = pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
    return files.join(i, "id", "left").join(o, "id", "left").select("id", F.coalesce("i", F.lit(0)).alias("fan_in"), F.coalesce("o", F.lit(0)).alias("fan_out"))


def top_connected_files(imports: DataFrame, files: DataFrame, limit: int = 20) -> DataFrame:
    """Files by import edges in and out; each side is counted before it is joined."""
    i = imports.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
    o = imports.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
    both = files.join(i, "id", "left").join(o, "id", "left")
    return both.select("id", "relative_path", (F.coalesce("i", F.lit(0)) + F.coalesce("o", F.lit(0))).alias("degree")).orderBy(F.desc("degree"), "id").limit(limit)


def mutual_imports(imports: DataFrame, files: DataFrame, limit: int | None = 20) -> DataFrame:
    """Pairs of files that import each other, once each."""
    e = imports.where("src <> dst").distinct()
    low, high = e.where("src < dst"), e.where("src > dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    pairs = low.join(high, ["src", "dst"])
    f = files.select(F.col("id").alias("k"), "relative_path")
    named = pairs.join(f, pairs.src == f.k).select("dst", F.col("relative_path").alias("p")).join(f, F.col("dst") == f.k)
    rows = named.select(F.least("p", "relative_path").alias("file1"), F.greatest("p", "relative_path").alias("file2")).orderBy("file1", "file2")
    return rows.limit(limit) if limit else rows


def communities(calls: DataFrame, symbols: DataFrame, least: int = 2) -> DataFrame:
    """(id, component, size): symbols joined by calls in any direction; the component
    is named by its least symbol. Components below ``least`` are left out."""
    found = components(calls.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    all_ = symbols.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))
    sizes = all_.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return all_.join(sizes, "component").select("id", "component", "size")


def visual_edges(imports: DataFrame) -> DataFrame:
    return imports.where("src <> dst").distinct()


def language_chips(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(language, files, connections): what a view's legend counts."""
    edges = visual_edges(imports)
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("d"))
    both = files.select("id", F.coalesce("language", F.lit("unknown")).alias("language")).join(ends, "id", "left")
    return both.groupBy("language").agg(F.count("*").alias("files"), F.sum(F.coalesce("d", F.lit(0))).alias("connections"))
