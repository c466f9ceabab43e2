"""Operators on small frames: quirks, boundaries and differential checks."""

import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tessera.functions import code
from tessera.operators import governance as gov
from tessera.operators import graph, incremental, metrics, relational, search


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def bfs(pairs, starts, depth=None, direction="down"):
    turned = {"down": [(a, b) for a, b in pairs], "up": [(b, a) for a, b in pairs], "both": [p for a, b in pairs for p in ((a, b), (b, a))]}[direction]
    seen, queue = dict.fromkeys(starts, 0), deque(starts)
    while queue:
        x = queue.popleft()
        for a, b in turned:
            if a == x and b not in seen and (depth is None or seen[x] < depth):
                seen[b] = seen[x] + 1
                queue.append(b)
    return {k: v for k, v in seen.items() if v}


@pytest.mark.parametrize("narrow", [0, 3, 1000])
def test_reach_is_breadth_first(spark, narrow):
    rng = random.Random(narrow)
    pairs = [(rng.randrange(25), rng.randrange(25)) for _ in range(35)]
    for direction, depth in (("down", 3), ("up", None), ("both", 2)):
        found = graph.reach(edges(spark, pairs), graph.one(spark, 1), depth, direction, narrow)
        assert {r.node: r.depth for r in found.collect()} == bfs(pairs, [1], depth, direction)


def test_shortest_path(spark):
    e = edges(spark, [(1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (5, 1)])
    walk = lambda a, b: [r.node for r in graph.shortest_path(e, a, b).orderBy("step").collect()]
    assert walk(1, 5) == [1, 2, 3, 5] and walk(3, 3) == [3] and walk(5, 4) == [5, 1, 4]
    assert walk(1, 99) == []


def test_flow_marks_cycles_and_caps_children(spark):
    e = edges(spark, [(1, i) for i in range(2, 15)] + [(2, 1), (1, 2), (2, 20)])
    rows = graph.execution_flow(e, 1, 2).collect()
    top = [r for r in rows if r.depth == 0]
    assert sorted(r.node for r in top) == [-1, *range(2, 12)]
    assert [r.more for r in top if r.node == -1] == [3]
    assert {(r.node, r.cyclic) for r in rows if r.depth == 1} == {(1, True), (20, False)}


def test_trace_is_depth_first(spark):
    pairs = [(1, 2), (1, 3), (2, 4), (4, 3), (3, 5), (5, 6)]
    rows = graph.trace_chain(edges(spark, pairs), 1, 3).orderBy("ordinal").collect()
    # 3 is met below 4 first, at depth 3, so what lies below it is cut off
    assert [(r.node, r.depth) for r in rows] == [(1, 0), (2, 1), (4, 2), (3, 3)]
    with pytest.raises(ValueError):
        graph.trace_chain(edges(spark, pairs), 1, 3, narrow=2)


def test_communities_and_neighbourhood(spark):
    symbols = spark.createDataFrame([(i, f"n{i}", "function", i // 3) for i in range(9)], "id long, name string, kind string, file_id long")
    calls = edges(spark, [(0, 4), (4, 8), (2, 2), (0, 4)])
    assert {(r.id, r.component, r["size"]) for r in graph.communities(calls, symbols).collect()} == {(0, 0, 3), (4, 0, 3), (8, 0, 3)}
    assert {r.id for r in graph.neighbourhood(calls, symbols, 4).collect()} == {0, 3, 5, 8}
    assert {r.id for r in graph.neighbourhood(calls, symbols, 4, 0).collect()} == {3, 5}
    assert [r.id for r in graph.callers(calls, symbols, 4).collect()] == [0, 0]


def test_top_connected_counts_unresolved_imports(spark):
    files = spark.createDataFrame([(1, "a"), (2, "b")], "id long, relative_path string")
    e = edges(spark, [(1, 2), (1, None), (1, 2)])
    assert [(r.id, r.degree) for r in graph.top_connected_files(e, files).collect()] == [(1, 3), (2, 2)]


def brute_cognitive(body, lang):
    import re

    total = nest = 0
    for line in body.split("\n"):
        t = line.strip()
        if not t or t.startswith(("//", "#")):
            continue
        if any(re.search(rf"\b{w}\b", t) for w in code.NESTING[lang].split()):
            total += 1 + nest
            nest += 1
        down = code.UNNESTING.get(lang, "").split()
        if down and (any(re.search(rf"\b{w}\b", t) for w in down) or t in ("}", "end")):
            nest = max(0, nest - 1)
        total += t.count("&&") + t.count("||")
    return min(total, 100)


def test_complexity(spark):
    rng = random.Random(1)
    words = ["if", "else", "elif", "end", "}", "for x", "a && b", "a||b", "# if", "// for", "x", "", "while", "except", "  try", "finally"]
    bodies = ["\n".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(40)] + ["", "  \n", "if\n" * 300]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    for lang in ("python", "ruby", "generic", "java"):
        got = {r.i: r.c for r in df.select("i", code.cognitive(F.col("b"), lang).alias("c")).collect()}
        assert got == {i: brute_cognitive(b, lang) for i, b in enumerate(bodies)}, lang
    cc = lambda text, lang="typescript": df.limit(1).select(code.cyclomatic(F.lit(text), lang).alias("c")).first().c
    assert cc("a && b") == 1 and cc("a&&b") == 2 and cc("") == 1 and cc("if " * 500) == 100 and cc("ifs") == 1
    mi = lambda c, s, e: df.limit(1).select(code.maintainability(F.lit(c), F.lit(s), F.lit(e)).alias("m")).first().m
    assert mi(5, 10, 3) == 100.0 and mi(1, 1, 1) == 100.0
    assert math.isclose(mi(10, 1, 50), 171 - 21.4 * math.log(50) - 2.3)


def test_role_order(spark):
    rows = [("x", "function", 0, 5, False), ("x", "class", 0, 0, False), ("x", "function", 4, 1, True), ("main", "class", 0, 0, False), ("x", "function", 9, 1, False), ("x", "function", 1, 0, False), ("x", "function", 1, 9, False), ("getX", "function", 1, 1, False), ("x", "function", 1, 1, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, k string, a int, o int, e boolean")
    got = [r.r for r in df.orderBy("i").select(code.role(F.col("n"), F.col("k"), F.col("a"), F.col("o"), F.lit(1.5), F.lit(1.5), F.col("e")).alias("r")).collect()]
    assert got == ["dead", "unknown", "entry", "entry", "core", "leaf", "adapter", "utility", "unknown"]


def test_modules_and_bands(spark):
    paths = {
        "frontend/src/features/cart/x.ts": "fe·cart",
        "fe/store/x.ts": "fe·store",
        "fe/x.ts": "fe·x.ts",
        "frontend/app/features": "fe·app",
        "backend/a/service/dto/x.java": "be·service",
        "be/other/x.java": "be·other",
        "be": "be·root",
        "src/a/b.ts": "src/a",
        "x.ts": "x.ts",
        "a\\b\\c.ts": "a/b",
    }
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.m for r in df.select("p", code.module_key(F.col("p")).alias("m")).collect()} == paths
    n = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 6, 7, 12, 13, 25, 26, 49, 50)], "n int")
    assert "".join(r.b for r in n.orderBy("n").select(code.band(F.col("n")).alias("b")).collect()) == "MMKKGGFFAABBO"


def test_god_files_boundary(spark):
    files = spark.createDataFrame([(1, "a"), (2, "b")], "id long, relative_path string")
    symbols = spark.createDataFrame([(i, 1 if i < 20 else 2) for i in range(41)], "id long, file_id long")
    assert [(r.id, r.symbols) for r in relational.god_files(symbols, files).collect()] == [(2, 21)]


def test_entry_points(spark):
    rows = [(1, "if", "function", "a/index.ts", 1, None), (2, "xHandler", "function", "b.ts", 9, None), (3, "x", "function", "z/main.ts", 3, None), (4, "y", "method", "c.ts", 2, "app.get('/')"), (5, "z", "variable", "z/main.ts", 1, None), (6, "r", "type", "q.ts", 7, None), (7, "x", "function", "index.ts", 1, None)]
    v = spark.createDataFrame(rows, "id long, name string, kind string, relative_path string, start_line int, body string")
    roles = spark.createDataFrame([(r[0], "entry" if r[0] == 6 else "unknown") for r in rows], "id long, role string")
    assert [(r.id, r.tier) for r in metrics.entry_points(v, roles).collect()] == [(6, 1), (2, 2), (3, 3), (4, 4)]


def test_search_against_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["alpha", "alpine", "Beta", "gamma", "x-ray", "été"]) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    import re

    toks = {i: [t for t in re.split(r"[^\w]+", s.lower()) if t] for i, s in docs}
    avg = sum(map(len, toks.values())) / len(docs)
    want = {}
    for w in ("alp", "bet"):
        tf = {i: sum(t.startswith(w) for t in ts) for i, ts in toks.items()}
        n = sum(v > 0 for v in tf.values())
        idf = max(1e-6, math.log((len(docs) - n + 0.5) / (n + 0.5)))
        for i, f in tf.items():
            if f:
                want[i] = want.get(i, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(toks[i]) / avg))
    top = sorted(((round(s, 6), -i) for i, s in want.items()), reverse=True)[:20]
    got = [(r.score, -r.id) for r in search.bm25(df, 'ALP* "bet"').collect()]
    assert [g[1] for g in got] == [t[1] for t in top] and all(abs(a[0] - b[0]) < 2e-6 for a, b in zip(got, top))
    assert search.bm25(df, "").count() == 0


def test_written_index(spark, tmp_path):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpine"), (3, "")], "doc_id long, text string")
    search.write_index(df, f"file://{tmp_path}/ix")
    for q in ("alp", "a", "beta alp"):
        assert search.search_index(spark, f"file://{tmp_path}/ix", q).collect() == search.bm25(df, q).collect()


def test_fusion_and_lines(spark):
    a = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0)], "id long, score double")
    b = spark.createDataFrame([(3, 9.0)], "id long, score double")
    assert [r.id for r in search.fuse([a, b], 9).collect()] == [3, 1, 2]
    docs = spark.createDataFrame([(1, "one\nTwo\nthree\ntwo"), (2, None)], "doc_id long, text string")
    assert [(r.line_no, r.line) for r in search.grep(docs, "TWO").collect()] == [(2, "Two"), (4, "two")]
    assert [r.line_no for r in search.grep(docs, "/t(wo|h)/").collect()] == [2, 3, 4]
    assert search.grep(docs, "/(/").count() == 0
    assert [r.snippet for r in search.grep_snippets(docs, "o").collect()] == ["one\nTwo", "one\nTwo\nthree", "three\ntwo"]


def test_rules(spark):
    rules = spark.createDataFrame([("a", "m", 1.0, None), ("b", "m", 1.0, 5.0), ("c", "m", None, None), ("d", "zz", 1.0, 1.0), ("e", "m", 9.0, None)], "rule_name string, metric string, warn_threshold double, fail_threshold double")
    values = spark.createDataFrame([("m", 5.0)], "metric string, value double")
    done = gov.manifesto_check(rules, values)
    assert {r.rule_name: r.status for r in done.collect()} == {"a": "WARN", "b": "FAIL", "c": "PASS", "d": "SKIP", "e": "PASS"}
    assert gov.overall(done).first().status == "FAIL" and gov.overall(done.limit(0)).first().status == "PASS"


def test_hunks_and_overlap(spark):
    diff = "@@ -1,2 +5 @@ f\n+x\n@@ -9 +10,0 @@\n@@ -20,3 +30,4 @@"
    df = spark.createDataFrame([("p", diff)], "relative_path string, diff string")
    assert [(r.start, r["count"]) for r in gov.parse_hunks(df).collect()] == [(5, 1), (30, 4)]
    symbols = spark.createDataFrame([(1, "a", "f", 1, 1, 4), (2, "b", "f", 1, 5, 5), (3, "c", "f", 1, 33, 40), (4, "d", "f", 1, 34, 40), (5, "e", "f", 2, 5, 5)], "id long, name string, kind string, file_id long, start_line int, end_line int")
    hunks = spark.createDataFrame([(1, 5, 1), (1, 30, 4), (2, 5, 0)], "file_id long, start int, count long")
    assert {r.id for r in gov.diff_symbols(symbols, hunks).collect()} == {2, 3}


def test_import_candidates(spark):
    got = lambda p, t: spark.range(1).select(gov.import_candidates(F.lit(p), F.lit(t)).alias("c")).first().c
    c = got("a/b/x.ts", "../y")
    assert c[0] == "a/y.ts" and c[7] == "a/y/index.ts" and len(c) == 14
    assert got("a/b/x.ts", "./z.js")[-1] == "a/b/z.ts" and got("a/x.ts", "react") == [] and got("x.ts", "./y")[0] == "y.ts"


def test_changes(spark):
    old = spark.createDataFrame([(1, 5), (2, 6), (3, None), (4, None)], "k long, v int")
    new = spark.createDataFrame([(2, 6), (3, 1), (4, None), (5, 9)], "k long, v int")
    d = incremental.detect_changes(old, new, "k", ["v"])
    assert {r.k: r.status for r in d.collect()} == {1: "deleted", 2: "unchanged", 3: "modified", 4: "unchanged", 5: "added"}
    assert sorted(map(tuple, incremental.apply_changes(old, new, d, "k").collect())) == sorted(map(tuple, new.collect()))
    e = spark.createDataFrame([(1, 2), (2, 3), (None, 1)], "from_symbol_id long, to_symbol_id long")
    gone = spark.createDataFrame([(2,)], "id long")
    assert set(map(tuple, incremental.detach(e, gone).collect())) == {(1, None), (None, 3), (None, 1)}
    assert set(map(tuple, incremental.upsert(old, new, ["k"]).collect())) == {(1, 5), (2, 6), (3, 1), (4, None), (5, 9)}


def test_cochange_and_adrs(spark):
    commits = spark.createDataFrame([("c1", 1), ("c1", 2), ("c1", 1), ("c2", 2), ("c2", 1), ("c2", 3)], "commit string, file long")
    assert [tuple(r) for r in gov.cochange(commits).collect()] == [(1, 2, 2), (1, 3, 1), (2, 3, 1)]
    none = spark.createDataFrame([], "number int, title string, status string, context_text string, decision string, consequences string")
    assert gov.adr_next(none).first().number == 1
    one = gov.adr_create(none, "T")
    assert [(r.number, r.title, r.status) for r in one.collect()] == [(1, "T", "proposed")]


def test_long_path_takes_half_the_rounds(spark, monkeypatch):
    chain = [(i, i + 1) for i in range(16)] + [(0, 100), (100, 2), (5, 200), (14, 300)]
    e = spark.createDataFrame(chain, "src long, dst long")
    written = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, tag: (written.append(tag), real(df, tag))[1])
    assert [r.node for r in graph.shortest_path(e, 0, 16, narrow=0).orderBy("step").collect()] == list(range(17))
    assert written.count("level") == 8
    assert graph.shortest_path(e, 300, 0, narrow=0).count() == graph.shortest_path(e, 300, 0).count() == 0


def test_paths_as_by_single_search(spark):
    import random

    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(110)] + [(1, 70 + k) for k in range(30)]
    cut_edges = spark.createDataFrame(edges, "src long, dst long")
    before = {}
    for a, b in edges:
        before.setdefault(b, set()).add(a)

    def plain(start, goal):
        level, at = {start}, {start: 0}
        while level and goal not in at:
            level = {b for a, b in edges if a in level and b not in at}
            at |= {b: max(at.values()) + 1 for b in level}
        if goal not in at:
            return []
        path = [goal]
        while path[-1] != start:
            path.append(min(a for a in before[path[-1]] if at.get(a, -1) == at[path[-1]] - 1))
        return path[::-1]

    for start, goal in [(1, 17), (3, 44), (9, 71), (12, 12), (20, 5)]:
        for narrow in (1000, 12):
            assert [r.node for r in graph.shortest_path(cut_edges, start, goal, narrow).orderBy("step").collect()] == plain(start, goal), (start, goal)


def test_ordinals(spark):
    from tessera.operators.ordinals import ordinals

    keys = [None, 5, 5, -3, 900, 12, 7, 7, 41, 42, 43]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    want = {k: i for i, k in enumerate(sorted({k for k in keys if k is not None}, key=int), 1)} | {None: 0}
    for ranges in (1, 4):
        assert {r.k: r.n for r in ordinals(df, "k", "n", ranges).collect()} == want
    assert ordinals(df.limit(0), "k", "n").count() == 0


def test_intervals_as_all_pairs(spark):
    import random

    from tessera.operators import intervals

    rng = random.Random(1)
    ranges = [(i, rng.randrange(3), a, a + rng.choice([0, 1, 7, 300, -1])) for i, a in enumerate(rng.randrange(2000) for _ in range(300))] + [(900, 0, 0, 2**31 - 1)]
    others = [(rng.randrange(4), a, a + rng.choice([0, 2, 90])) for a in (rng.randrange(2500) for _ in range(60))]
    r = spark.createDataFrame(ranges, "id long, g int, s int, e int")
    o = spark.createDataFrame(others, "g int, first int, last int")
    got = sorted(x.id for x in intervals.overlapping(r, o, "g", ("id", "s", "e")).collect())
    assert got == sorted(i for i, g, s, e in ranges if s <= e and any(g == h and a <= e and b >= s for h, a, b in others))


def test_intervals_look_at_rows_not_pairs(spark):
    """One file of many nested symbols: rows that the joins see grow with the symbols."""
    from pyspark.sql import functions as F

    from tessera.operators import intervals

    n = 20_000
    r = spark.range(n).select("id", F.lit(1).alias("g"), F.col("id").cast("int").alias("s"), (2 * n - F.col("id")).cast("int").alias("e"))
    sizes = r.select(F.size(intervals.cover(F.col("s"), F.col("e"))).alias("c")).agg(F.max("c")).first()[0]
    assert sizes <= 2 * intervals.LEVELS
    o = r.where("id % 2 = 0").select("g", F.col("s").alias("first"), F.col("e").alias("last"))
    assert intervals.overlapping(r, o, "g", ("id", "s", "e")).count() == n


def test_cochange_in_blocks(spark):
    import random
    from collections import Counter
    from itertools import combinations

    from pyspark.sql import functions as F

    rng = random.Random(6)
    commits = [(c, f) for c in range(6) for f in rng.sample(range(40), rng.randint(1, 30))] + [(9, f) for f in range(300)]
    df = spark.createDataFrame(commits + commits[:20], "commit long, file long")
    want = Counter(p for c in {c for c, _ in commits} for p in combinations(sorted({f for d, f in commits if d == c}), 2))
    assert {(r.file1, r.file2): r.n for r in gov.cochange(df, None, most=8).collect()} == want
    left, right = gov.commit_blocks(spark.range(5000).select(F.lit(1).alias("commit"), F.col("id").alias("file")), most=100)
    sizes = left.union(right).groupBy("commit", "i", "j").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 300 and sizes[1] == 50 * 51 // 2


def test_crowded_nodes(spark, monkeypatch):
    from tessera.operators import components as c

    monkeypatch.setattr(c, "CROWDED", 20)
    edges = [(0, k) for k in range(1, 90)] + [(200, k) for k in range(201, 230)] + [(300, 301), (89, 500)]
    got = {r.node: r.component for r in c.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in [*range(90), 500]} | {k: 200 for k in range(200, 230)} | {300: 300, 301: 300}


def test_community_list(spark):
    from tessera.operators import metrics

    members = spark.createDataFrame([(1, "a/x")] * 3 + [(0, "b · y")] * 2 + [(2, "a/z"), (3, "plain")], "community long, name string")
    rows = lambda **a: [tuple(r) for r in metrics.community_list(members, **a).collect()]
    assert rows() == [("b ", 0, "b · y", 2), ("a", 1, "a/x", 3), ("a", 2, "a/z", 1), ("_", 3, "plain", 1)]
    assert [r[1] for r in rows(sort="count-desc")] == [1, 0, 2, 3] and [r[1] for r in rows(sort="count-asc")] == [2, 3, 0, 1]
    assert rows(least=2, contains="X", sort="name") == [("a", 1, "a/x", 3)]


def test_cochange_tasks_follow_pairs(spark, monkeypatch):
    from collections import Counter
    from itertools import combinations

    monkeypatch.setattr(gov, "A_TASK", 50)
    commits = [(c, (c * f) % 31) for c in range(1, 9) for f in range(12)] + [(9, f) for f in range(40)] + [(9, None), (None, 1), (None, 2)]
    df = spark.createDataFrame(commits, "commit long, file long")
    want = Counter(p for c in range(1, 10) for p in combinations(sorted({f for d, f in commits if d == c and f is not None}), 2))
    found = gov.cochange(df, None, most=8)
    assert {(r.file1, r.file2): r.n for r in found.collect()} == want  # a null file is in no pair, also of a commit in blocks
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file1#" in plan and int(plan.split("hashpartitioning(file1#")[1].split("),")[0].split(", ")[2].rstrip(")")) == -(-sum(want.values()) // 50)


def test_cochange_of_known_files(spark):
    commits = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (2, 3)], "commit long, file long")
    files = spark.createDataFrame([(1, "a", "go"), (2, "b", "py")], "id long, relative_path string, language string")
    known = gov.of_known_files(commits, files)
    assert [tuple(r) for r in gov.cochange_files(gov.cochange(known, 1), files).collect()] == [("a", "go", "b", "py", 1)]
    all_ = files.union(spark.createDataFrame([(3, "c", "js")], files.schema))
    assert gov.of_known_files(commits, all_) is commits
