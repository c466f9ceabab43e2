import math
import random

import pytest

from tessera.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, label int, weights string, rank int, _row long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "w", 2, 3) for i, v in rows], SCHEMA)


def brute(rows, k=5):
    fit = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if fit(v)]
    out = []
    for q, a in whole:
        if q is not None and q % 50 == 0:
            scored = [(-sum(x * y for x, y in zip(a, b)), i is None, i or 0, i) for i, b in whole if i != q]
            out += [(q, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()), key=str)


def vectors(seed, n, zeros, terms=12):
    rng = random.Random(seed)
    return [(i, [0.0 if rng.random() < zeros else rng.randint(-4, 4) / 256 + rng.choice([0, 1 / 1024]) for _ in range(terms)]) for i in range(n)]


@pytest.mark.parametrize("seed,zeros", [(1, 0.0), (2, 0.5), (3, 0.9)])
def test_as_brute_force_in_many_blocks(spark, seed, zeros):
    rows = vectors(seed, 420, zeros)  # small weights, so ties are many
    df = table(spark, rows)
    ready = df.select("vec_id", T.integer_weights(df.embedding).alias("weights"))
    small = T.top_k(ready, ready.where("vec_id % 50 = 0"), candidates=37, most_queries=4)
    assert got(small) == brute(rows) == got(T.search_report(df))


def test_awkward_vectors(spark):
    same = [0.5] * 4
    rows = [(0, same), (50, []), (100, None), (150, [float("nan"), 1.0]), (200, [None, 1.0]), (250, [float("inf")]), (7, [float("-inf")]), (None, same), (3, same), (3, same), (4, [0.5] * 2), (300, same), (300, same), (-50, [-0.5] * 9)]
    assert got(T.search_report(table(spark, rows))) == brute(rows)


def test_few_and_none(spark):
    assert got(T.search_report(table(spark, []))) == []
    assert got(T.search_report(table(spark, [(0, [1.0])]))) == []
    assert got(T.search_report(table(spark, [(0, [1.0]), (1, [1.0])]))) == [(0, 1, 1, 65536)]


def test_copies_of_one_vector(spark):
    rows = [(i, [0.25, -0.5]) for i in range(3000)]
    assert got(T.search_report(table(spark, rows))) == brute(rows)


def test_large_weights_are_exact_or_an_error(spark):
    rows = [(0, [2.0**20, 1.0, 1.0]), (1, [2.0**22, 3.0, 0.0]), (2, [2.0**22, 3.0, 1 / 256]), (3, [-(2.0**22), 0.0, 0.0])]
    assert got(T.search_report(table(spark, rows))) == brute(rows)
    with pytest.raises(Exception, match="(?i)overflow|too large|long"):
        T.search_report(table(spark, [(0, [2.0**40]), (1, [2.0**40])])).collect()
