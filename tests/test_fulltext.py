import math
import random
import re
from collections import Counter

from test_words import plain_stem

from tessera.operators import fulltext as T

WORDS = ["running", "runs", "ran", "getItem", "get_item", "Café", "cafes", "relational", "relate", "x", "xy", "node", "nodes", "path_to", "42"]


def cut(text):
    plain = (text or "").lower().replace("é", "e")
    return [plain_stem(w) for w in re.findall(r"[^\W_]+", plain)]


def brute(docs, query):
    """docs: {id: [texts]}. Scores of every document, by its words one after the other."""
    asked = [w for w in (cut(p) for p in re.sub(r"['\"*()]", " ", query).split()) if w]
    texts = {i: [x for t in ts for x in [*cut(t), None]] for i, ts in docs.items()}
    size = {i: sum(x is not None for x in t) for i, t in texts.items()}
    tf = {}
    for k, p in enumerate(asked):
        for i, t in texts.items():
            fits = sum(all(t[a + j] is not None and (t[a + j] == w or j == len(p) - 1 and t[a + j].startswith(w)) for j, w in enumerate(p)) for a in range(len(t) - len(p) + 1))
            if fits:
                tf[k, i] = fits
    df = Counter(k for k, _ in tf)
    mean = sum(size.values()) / max(1, len(size))
    out = Counter()
    for (k, i), n in tf.items():
        idf = max(1e-6, math.log((len(docs) - df[k] + 0.5) / (df[k] + 0.5)))
        out[i] += idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size[i] / mean))
    return {i: round(s, 5) for i, s in out.items()}


def frame(spark, docs):
    return spark.createDataFrame([(i, *ts) for i, ts in docs.items()], "id long, a string, b string")


def got(df):
    return {r.id: round(r.score, 5) for r in df.collect()}


def text(rng):
    return None if rng.random() < 0.1 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))


QUERIES = ["run", "get_item", "item* (node)", '"cafe" relat', "x", "path_to nope", "", "--"]


def test_changes_give_the_scores_of_an_index_built_anew(spark, tmp_path):
    rng = random.Random(4)
    docs = {i: [text(rng), text(rng)] for i in range(60)}
    index = T.Index(spark, f"file://{tmp_path}/ix", ["a", "b"])
    index.change(frame(spark, docs), frame(spark, {}), "c0")
    most = 0
    for step in range(1, 6):
        gone = rng.sample(sorted(docs), 5)
        new = {i: [text(rng), text(rng)] for i in [*gone[:3], 100 + step]}
        old = {i: docs.pop(i) for i in gone}
        docs |= new
        before = {s.postings for s in index.segments}
        index.change(frame(spark, new), frame(spark, old), f"c{step}")
        assert len({s.postings for s in index.segments} - before) == 1  # one segment a change
        most = max(most, len(index.segments))
        if step in (2, 5):
            again = T.Index(spark, f"file://{tmp_path}/ix", ["a", "b"], index.state())
            assert (again.docs, again.tokens) == (len(docs), sum(len(cut(t)) for ts in docs.values() for t in ts))
            for q in QUERIES if step == 5 else QUERIES[:1]:
                assert got(again.search(q, None)) == brute(docs, q), (step, q)
    assert 2 < most < 6
    best = index.search("run node", 3)
    assert [round(r.score, 5) for r in best.collect()] == sorted(brute(docs, "run node").values(), reverse=True)[:3]
    some = frame(spark, {i: docs[i] for i in sorted(docs)[::2]})
    assert got(index.search("run", None, some)) == {i: s for i, s in brute(docs, "run").items() if i in sorted(docs)[::2]}


def test_a_search_reads_one_bucket_a_word(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "buckets_for", lambda docs: 16)
    index = T.Index(spark, f"file://{tmp_path}/ix", ["a", "b"])
    index.change(frame(spark, {1: ["running nodes", "relational cafe x42"], 2: ["path", None]}), frame(spark, {}), "c0")
    assert len(list((tmp_path / "ix/c0/postings").glob("bucket=*"))) > 2
    starts = T.hashed_starts(spark, T.phrases(spark, "running relate"))
    wanted = {h % 16 for h in starts}
    plan = T.read(spark, index._found(), starts)._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("]")[0]
    assert len(wanted) <= 2 and "bucket" in filters and all(str(b) in filters for b in wanted)
    assert got(index.search("running relate")).keys() == {1}
    assert T.hashed_starts(spark, T.phrases(spark, "r")) is None


def test_common_words_are_stemmed_once(spark, tmp_path):
    rng = random.Random(9)
    docs = frame(spark, {i: [text(rng), "running " * i] for i in range(30)})
    counted = T.count_words(docs, ["a", "b"])
    got_ = {m: sorted(map(tuple, T.postings(docs, ["a", "b"], counted, 30, m).collect())) for m in (100, 3, 0)}
    assert got_[100] == got_[3] == got_[0] and {"run", "relat"} <= {r[0] for r in got_[0]}
    common = [r.word for r in T.common_words(counted, 3).collect()]
    assert "running" in common and len(common) <= 3
    plan = T.postings(docs, ["a", "b"], counted, 30)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[0-9]") == 1  # the stems, of the counted words only
    assert plan.count("split(") == 2  # each column once


def test_large_buckets_are_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "DOCS_A_BUCKET", 1)
    monkeypatch.setattr(T, "BUCKETS", 2)
    index = T.Index(spark, f"file://{tmp_path}/ix", ["a", "b"])
    docs = {i: ["node", "path"] for i in range(40)}
    index.change(frame(spark, docs), frame(spark, {}), "c0")
    assert min(len(list(p.glob("*.parquet"))) for p in (tmp_path / "ix/c0/postings").glob("bucket=*")) > 2
    assert got(index.search("node", None)) == brute(docs, "node")


def test_empty_index(spark, tmp_path):
    index = T.Index(spark, f"file://{tmp_path}/ix", ["a", "b"])
    assert index.search("run").count() == 0
    index.change(frame(spark, {}), frame(spark, {}), "c0")
    assert index.segments == [] and index.search("run").count() == 0
    index.change(frame(spark, {1: ["run", None]}), frame(spark, {}), "c1")
    index.change(frame(spark, {}), frame(spark, {1: ["run", None]}), "c2")
    assert index.search("run").count() == 0 and (index.docs, index.tokens) == (0, 0)
