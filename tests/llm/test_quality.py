import random
from collections import Counter

from edge import EDGE_TEXTS, edge_docs
from pyspark.sql import functions as F

from tessera.llm import quality as Q


def split(t):
    for c in "\t\n\x0b\f\r":
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def brute(t):
    t = t or ""
    w = split(t)
    lines = [x for x in t.split("\n") if split(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(5)}
    n, symbols, dup, rep = len(w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)
    failed = n < 10 or 100 * rep > 20 * n
    chars = sum(map(len, w))
    stutter = sum(a == b for a, b in zip(w, w[1:]))
    kept = not (failed or 100 * symbols > 10 * n or 100 * dup > 40 * len(lines) or 100 * stutter > 30 * n or chars > 20 * n)
    return n, chars, symbols, dup, rep, failed, kept


def sample(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(150):
        pool = [rng.choice(["a", "b", "é", "c#", "|", "dd", "longword" * 4]) for _ in range(rng.randint(1, 5))] if rng.random() < 0.5 else [f"w{i}" for i in range(300)]
        out.append("".join(rng.choice(pool) + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(rng.randint(0, 60))))
    return out


def test_equals_brute_force(spark):
    texts = sample(1) + EDGE_TEXTS
    rows = {r.doc_id: tuple(r)[1:] for r in Q.quality_report(edge_docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert rows[i] == brute(t), (t or "")[:200]
    assert Q.quality_report(edge_docs(spark, [])).count() == 0


def test_order_and_verdicts(spark):
    texts = sample(2) + EDGE_TEXTS
    docs = edge_docs(spark, texts)
    found = Q.estimate(docs)
    assert sorted(e.rule.name for e in found) == sorted(r.name for r in Q.RULES)
    assert all(a.rate >= b.rate for a, b in zip(found, found[1:]))
    judged = Q.judge(docs)
    assert judged.columns == [*docs.columns, "rejected_by"]
    kept = {r.doc_id for r in judged.where("rejected_by is null").collect()}
    assert kept == {i for i, t in enumerate(texts) if brute(t)[-1]}
    back = docs.select(Q.cascade(list(reversed(Q.RULES)), Q.measured(Q.text_or_empty("text"))).isNull().alias("k"), "doc_id")
    assert {r.doc_id for r in back.where("k").collect()} == kept


def test_later_rules_are_not_evaluated(spark):
    fails = Q.Rule("fails", lambda m: F.raise_error(F.concat(F.lit("evaluated "), m("n_words").cast("string"))).isNull())
    every = Q.Rule("every", lambda m: m("n_words") >= 0)
    docs = edge_docs(spark)
    assert docs.select(Q.cascade([every, fails], Q.measured(Q.text_or_empty("text"))).alias("r")).where("r = 'every'").count() == len(EDGE_TEXTS)
