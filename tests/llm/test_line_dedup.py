import random

import numpy as np
from edge import EDGE_TEXTS, edge_docs
from pyspark.sql import functions as F

from tessera.llm import line_dedup as L


def brute(docs, least):
    """{id: set of deleted lines}: every run with enough words, at every place but its first."""
    seen, out = {}, {i: set() for i, _ in docs}
    for i, t in docs:
        lines = t.split("\n")
        for s in range(len(lines)):
            n = 0
            for e in range(s + 1, len(lines) + 1):
                n += len([w for w in lines[e - 1].replace("\t", " ").split(" ") if w])
                run = tuple(lines[s:e])
                if n >= least and seen.setdefault(run, (i, s)) != (i, s):
                    out[i] |= set(range(s, e))
    return out


def sample(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 4))) for _ in range(9)]
    passages = [[rng.choice(pool) for _ in range(rng.randint(1, 12))] for _ in range(4)]
    docs = []
    for i in range(rng.randint(1, 30)):
        lines = []
        for _ in range(rng.randint(1, 6)):
            lines += rng.choice([passages[rng.randrange(4)], [f"own {i} {rng.random()}"], [rng.choice(pool)]])
        docs.append((i * 2, "\n".join(rng.choice(docs)[1].split("\n")[:-1]) if docs and rng.random() < 0.2 else "\n".join(lines)))
    return docs


def test_equals_brute_force(spark):
    for seed, least in ((1, 6), (2, 3), (3, 9), (4, 14)):
        docs = sample(seed)
        want = brute(docs, least)
        rows = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), least).collect()
        texts = dict(docs)
        assert len(rows) == len(docs)
        for r in rows:
            gone = {x for a in r.removed or [] for x in range(a["from"], a["to"])}
            assert gone == want[r.doc_id], (seed, r)
            assert r.n_removed == len(gone)
            assert r.text == "\n".join(x for k, x in enumerate(texts[r.doc_id].split("\n")) if k not in gone)


def arrays(spark, seqs, size=1):
    """Segments as the doubling takes them; every line asks for runs of 1 to 9 lines."""
    rows = [(i, 0, 0, s, [0] * len(s), [[m for m in range(1, 10) if k + m <= len(s)] for k in range(len(s))]) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "_d long, _t long, start int, a1 array<long>, a2 array<long>, more array<array<int>>")


def test_ranks_are_those_of_a_suffix_array(spark):
    rng = random.Random(4)
    seqs = [[rng.randrange(3) for _ in range(rng.randint(1, 9))] for _ in range(6)]
    level, size = arrays(spark, seqs), 1
    suffixes = [tuple(s[i:]) for s in seqs for i in range(len(s))]
    for _ in range(3):
        rows = L.ranked(L.materialize(L.swept(L.suffixes(level, size), len(suffixes)), "test")).collect()
        got = {(r._d, r["at"]): (r["rank"], r.found) for r in rows}
        for i, s in enumerate(seqs):
            for k in range(len(s)):
                own = s[k:]
                assert got[i, k][0] == sum(x[: 2 * size] < tuple(own[: 2 * size]) for x in suffixes)
                earlier = [x[j:] for h, x in enumerate(seqs[: i + 1]) for j in range(len(x)) if (h, j) < (i, k)]
                same = [m for m in range(1, len(own) + 1) if any(x[:m] == own[:m] for x in earlier) and (m <= 2 * size) and (size == 1 or m > size)]
                assert got[i, k][1] == max(same, default=0)
        by = {}
        for r in rows:
            by.setdefault(r._d, []).append((r["at"], r["rank"], r.more))
        level = spark.createDataFrame([(d, 0, 0, [x[1] for x in sorted(v)], [x[2] for x in sorted(v)]) for d, v in by.items()], "_d long, _t long, start int, a1 array<long>, more array<array<int>>")
        size *= 2


def test_the_order_of_ranks_decides(spark, monkeypatch):
    """With hashes for ranks equal prefixes are not neighbours, and copies are missed."""
    pool = [f"line {k} of eight words in all here" for k in range(12)]
    rng = random.Random(11)
    common = [pool[k] for k in range(7)]
    docs = [(i, "\n".join([f"own {i}", *common, *[rng.choice(pool) for _ in range(12)]])) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 50)
    deleted = lambda: {r.doc_id: {x for a in r.removed or [] for x in range(a["from"], a["to"])} for r in L.dedup_lines(frame, 50).collect()}
    assert deleted() == want
    ranked = L.ranked
    monkeypatch.setattr(L, "ranked", lambda rows: ranked(rows).withColumn("rank", F.xxhash64("rank")))
    assert deleted() != want


def test_intervals_across_many_tasks(spark):
    """One passage in all documents: its intervals fill whole tasks."""
    rng = random.Random(3)
    passage = [f"line {k} of a passage that all of them share" for k in range(9)]
    docs = [(i, "\n".join([f"own {i} {rng.random()}", *passage[rng.randrange(3) :], f"end {i}"])) for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set(adaptive, "false")
        rows = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), 20).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset(adaptive)
    want = brute(docs, 20)
    assert {r.doc_id: {x for a in r.removed or [] for x in range(a["from"], a["to"])} for r in rows} == want


def test_ranges_grow_with_the_suffixes(spark, monkeypatch):
    monkeypatch.setattr(L, "RANGE", 10)
    rows = L.swept(L.suffixes(arrays(spark, [[k % 7 for k in range(60)]] * 5), 1), 300)
    parts = [r["count"] for r in rows.groupBy("part").count().collect()]
    assert sum(parts) == 300 and 25 <= len(parts) <= 30 and max(parts) <= 30


def test_a_frequent_line_is_dealt_by_place(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT", 10)
    rows = [(d, 0, p, 1 if p % 2 else 100 + p, 1 if p % 2 else d % 9, 1) for d in range(90) for p in range(40)]
    lines = spark.createDataFrame(rows, "_d long, _t long, pos int, h1 long, h2 long, words int")
    again = L.materialize(lines.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1 and (h1 = 1 or h2 < 5)"), "test")
    adaptive = "spark.sql.adaptive.enabled"
    wide = "spark.sql.autoBroadcastJoinThreshold"
    try:
        spark.conf.set(adaptive, "false")
        spark.conf.set(wide, "-1")
        got = L.only_again(lines, again)
        tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        got = sorted((r._d, r.pos) for r in got.collect())
    finally:
        spark.conf.unset(adaptive)
        spark.conf.unset(wide)
    assert got == [(r[0], r[2]) for r in rows if r[3] == 1 or r[4] < 5]
    assert len(tasks) == 4 and max(tasks) < 0.4 * len(got)  # the line is 1800 of 2800 rows


def test_shortest_runs():
    rng = random.Random(9)
    for _ in range(200):
        w, least = [rng.randrange(5) for _ in range(rng.randint(1, 10))], rng.randint(1, 12)
        n = len(w)
        want = set()
        for s in range(n):
            want |= {(s, e - s) for e in range(s + 1, n + 1) if sum(w[s:e]) >= least > sum(w[s : e - 1])}
        for e in range(1, n + 1):
            want |= {(s, e - s) for s in range(e) if sum(w[s:e]) >= least > sum(w[s + 1 : e])}
        starts, lines = L.shortest_runs(np.array(w), least)
        assert list(zip(starts.tolist(), lines.tolist())) == sorted(want)


def test_awkward_texts(spark):
    passage = "\n".join(f"line {i} of a shared passage of many words indeed" for i in range(8))
    texts = EDGE_TEXTS + [passage, "own first\n" + passage + "\nown last", passage, "tail\n" + passage.replace("line 3", "line x")]
    docs = edge_docs(spark, texts)
    rows = {r.doc_id: r for r in L.line_report(docs).collect()}
    assert len(rows) == len(texts)
    n = len(EDGE_TEXTS)
    assert rows[n].n_removed == 0 and rows[n].text == passage
    assert rows[n + 1].text == "own first\nown last" and rows[n + 1].removed == "1-9"
    assert rows[n + 2].text == "" and rows[n + 2].n_removed == 8
    assert rows[n + 3].n_removed == 0  # 30 and 40 words at most in a run
    for i, t in enumerate(EDGE_TEXTS):
        assert rows[i].text == t
    kept = L.without_copies(docs)
    assert kept.columns == docs.columns
    by = {r.doc_id: r for r in kept.collect()}
    assert set(by) == set(range(len(texts))) - {n + 2}
    assert by[n + 1].n_chars == len("own first\nown last")
    assert L.line_report(edge_docs(spark, [])).count() == 0
    again = docs.union(docs.where(F.col("doc_id") == n)).union(docs.where(F.col("doc_id") == n).withColumn("doc_id", F.lit(None).cast("long")))
    got = [(r.doc_id, r.n_removed) for r in L.line_report(again).collect() if r.doc_id in (n, None)]
    assert sorted(got, key=str) == sorted([(n, 8), (n, 8), (None, 0)], key=str)
