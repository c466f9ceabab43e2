import random
from collections import defaultdict

from edge import EDGE_TEXTS, edge_docs
from pyspark.sql import functions as F

from tessera.llm import mixing as X


def water(sizes, weights=X.WEIGHTS):
    """sizes by source, in order; shares again until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while True:
        share = left / sum(w[i] for i in open_) if open_ else 0
        above = {i for i in open_ if share * w[i] > 3 * sizes[i]}
        if not above:
            for i in open_:
                out[i] = share * w[i]
            return out
        for i in above:
            out[i] = 3.0 * sizes[i]
            left -= out[i]
        open_ -= above


def test_targets(spark):
    rng = random.Random(1)
    for _ in range(3):
        sizes = [rng.choice([0, 1, 5, 40, 1000, 20000]) for _ in range(rng.randint(1, 9))]
        names = sorted(f"s{i}é" if i % 2 else f"S{i}" for i in range(len(sizes) - 1)) + [None]
        rows = [(n, s) for n, s in zip(names, sizes)]
        got = X.targets(spark.createDataFrame(rows, "source string, size long")).orderBy("sid").collect()
        assert [r.source for r in got] == names
        for r, t in zip(got, water(sizes)):
            assert abs(r.target - t) <= 1e-6 * max(1, t), (sizes, r, t)


def test_permutations(spark):
    for n in (1, 2, 7, 100, 1000):
        got = [r.p for r in spark.range(n).select(X.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(1)).alias("p")).collect()]
        assert sorted(got) == list(range(n))
        if n == 1000:
            assert sum(a == i for i, a in enumerate(got)) < 10
            assert abs(sum(b > a for a, b in zip(got, got[1:])) - 500) < 60


def texts(seed, n=400):
    rng = random.Random(seed)
    return [" ".join("w" for _ in range(rng.choice([0, 3, 50, 200, 900]))) for _ in range(n)]


def test_mix(spark):
    all_ = texts(2)
    docs = spark.createDataFrame([(i, t, f"s{i % 5 if i % 3 else 0}") for i, t in enumerate(all_)], "doc_id long, text string, source string")
    rows = X.mix_report(docs).collect()
    assert len(rows) == len(all_)
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert r["size"] == len(all_[r.doc_id].split()) and 0 <= r.taken <= 3 * r["size"]
        s = by[f"s{r.doc_id % 5 if r.doc_id % 3 else 0}"]
        s[0] += r["size"]
        s[1] += r.taken
        assert s[2] in (0.0, r.target)
        s[2] = r.target
    names = sorted(by)
    for n, t in zip(names, water([by[n][0] for n in names])):
        assert abs(by[n][2] - t) < 1e-6 * t
        assert abs(by[n][1] - t) <= 3 * X.BLOCK
    assert sorted(map(tuple, X.mix_report(docs.repartition(7)).collect())) == sorted(map(tuple, rows))


def test_slots_are_whole_turns(spark):
    sources = spark.createDataFrame([(0, 40, 60), (1, 100, 300), (2, 7, 3), (3, 0, 0), (4, 900, 2300)], "sid int, blocks long, quota long")
    rows = X.slots(sources).collect()
    assert sorted(r.slot for r in rows) == list(range(2663))
    for sid, blocks, quota in ((0, 40, 60), (1, 100, 300), (2, 7, 3), (4, 900, 2300)):
        own = [r.block for r in rows if r.sid == sid]
        uses = [own.count(b) for b in range(blocks)]
        assert len(own) == quota and set(own) <= set(range(blocks)) and max(uses) - min(uses) <= 1
    shard = [r.sid for r in rows if r.shard == 0]
    assert len(shard) == X.SHARD and abs(shard.count(4) - 2300 / 2663 * X.SHARD) < 60


def test_mixed_documents_have_the_words_taken(spark):
    rng = random.Random(3)
    all_ = ["\n ".join(f"d{i}w{k}" for k in range(rng.choice([1, 30, 150]))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, None, f"s{i % 4}", len(t)) for i, t in enumerate(all_)], "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r.doc_id: r.taken for r in X.mix_report(docs).collect()}
    mixed = X.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = defaultdict(int)
    for r in mixed.collect():
        words = r.text.split()
        assert words and r.n_chars == len(r.text)
        whole = all_[r.doc_id].split()
        assert [w for w in whole if w in set(words)] == words
        if len(words) == len(whole):
            assert r.text == all_[r.doc_id]
        got[r.doc_id] += len(words)
    assert dict(got) == {k: v for k, v in taken.items() if v}


def test_awkward_texts(spark):
    docs = edge_docs(spark)
    rows = {r.doc_id: r for r in X.mix_report(docs).collect()}
    assert len(rows) == len(EDGE_TEXTS)
    assert rows[0]["size"] == rows[1]["size"] == rows[2]["size"] == 0 and rows[9]["size"] == 30_000
    assert all(r.taken <= 3 * r["size"] for r in rows.values())
    assert X.mixed_documents(docs).columns == docs.columns
    assert X.mixed_documents(docs).count() > 0
    assert X.mix_report(edge_docs(spark, [])).count() == 0
    assert X.mixed_documents(edge_docs(spark, [])).count() == 0
    blank = X.mix_report(edge_docs(spark, [None, "", " "])).collect()
    assert [(r.target, r.taken) for r in blank] == [(0.0, 0)] * 3
    twice = docs.union(docs)
    assert X.mix_report(twice).count() == 2 * len(EDGE_TEXTS)
