import random

import numpy as np
from edge import EDGE_TEXTS, edge_docs
from pyspark.sql import functions as F

from tessera.llm import minhash as M


def word_sets(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    """docs: [(id, text)]; {id: (size, component)}"""
    sets = [(i, word_sets(t)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets}


def sample(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(n):
        p = rng.random()
        if texts and p < 0.5:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = word()
            texts.append(rng.choice([" ", " "]).join(w) if rng.random() < 0.8 else " ".join(w).upper())
        elif p < 0.7:
            texts.append(" ".join([word() for _ in range(rng.randint(5, 60))] + passage))
        else:
            texts.append(" ".join(word() for _ in range(rng.randint(1, 150))))
    return texts


def test_equals_brute_force(spark, monkeypatch):
    for seed, leaves in ((1, 4096), (2, 3)):
        monkeypatch.setattr(M, "LEAVES", leaves)
        texts = sample(seed)
        docs = [(i * 3 + 5, t) for i, t in enumerate(texts)]
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got == brute(docs)


def test_a_large_group_of_near_copies(spark):
    """Each differs from the base a little, and from the others more."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    docs = []
    for i in range(160):
        w = list(base)
        w[rng.randrange(80)] = f"x{i}"
        w[rng.randrange(80)] = f"y{i}"
        docs.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_awkward_texts(spark):
    docs = edge_docs(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(docs).collect()}
    assert {k: v[:2] for k, v in got.items()} == brute(list(enumerate(EDGE_TEXTS)))
    assert all(kept == (i == c) for i, (_, c, kept) in got.items())
    kept = M.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, v in got.items() if v[2]}
    assert M.near_duplicates(edge_docs(spark, [])).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.component_id, r.kept) for r in M.near_duplicates(odd).collect()), key=str)
    assert rows == sorted([(None, None, True)] * 2 + [(4, 4, True)] * 2 + [(9, 4, False)], key=str)
    assert M.keep_one(odd).count() == 4


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 4000, np.uint64)
    rates = []
    for _ in range(40):
        p = rng.permutation(pool)
        a, b = np.sort(p[:1750]), np.sort(p[250:2000])  # similarity 0.75
        rates.append((M.signature(a) == M.signature(b)).mean())
    assert abs(np.mean(rates) - 0.75) < 0.04


def test_odd_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for n in (3, 50, 400, 3000):
        a = rng.integers(0, 1 << 63, n, np.uint64)
        b = np.concatenate([a[: n - n // 6], rng.integers(0, 1 << 63, n // 6, np.uint64)])
        x = M.odd_sketch(a) ^ M.odd_sketch(b)
        apart = sum(bin(int(v) & (1 << 64) - 1).count("1") for v in x)
        assert apart <= 2 * (n // 6) and (n != 400 or apart > n // 6)


def test_full_sets_alone_confirm(spark):
    """Similar pairs with fewer than ``MATCHES`` equal coordinates."""
    texts, pairs = [], []
    for at in (48211, 311551):
        a, b = (" ".join(f"w{j}" for j in range(at, at + n)) for n in (8, 7))
        assert (M.signature(M.shingles(a)) == M.signature(M.shingles(b))).sum() == M.MATCHES - 1
        pairs.append((at, at + 1))
        texts += [(at, a), (at + 1, b), (at + 2, " ".join(a.split()[:6]))]
    given = spark.createDataFrame(pairs + [(a, a + 2) for a, _ in pairs], "a long, b long")
    got = M.confirm(given, spark.createDataFrame(texts, "node long, text string")).collect()
    assert sorted((r.u, r.v) for r in got) == pairs


def family(n, own, shared=70):
    """Documents of ``shared`` words that all have and ``own`` words that one has."""
    return [(i, " ".join([f"s{j}" for j in range(shared)] + [f"o{i}x{j}" for j in range(own)])) for i in range(n)]


def looked_at(spark, docs, monkeypatch):
    """Pairs that the second round forms, before any filter; and the result."""
    seen, lists_of = [], M.cross_lists

    def spy(*given):
        lists = lists_of(*given)
        number = lambda where: F.sum(F.expr(f"cast({where} as long)"))
        rows = lists.groupBy("value").agg(F.count("*").alias("c"), number("light").alias("l"), number("not main and light").alias("x"), number("not main and not light").alias("h"))
        seen.append(rows.agg(F.coalesce(F.sum(F.expr("x * c + h * l")), F.lit(0)).alias("n")).first().n)
        return lists

    with monkeypatch.context() as m:
        m.setattr(M, "cross_lists", spy)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    return seen[0], got


def test_a_family_of_unlinked_documents_costs_no_pairs(spark, monkeypatch):
    """Similarities of 0.54 to 0.74: its nodes collide, but all have private shingles."""
    docs = family(400, 28)
    pairs, got = looked_at(spark, docs, monkeypatch)
    assert pairs <= M.BUSY * sum(n for n, _ in got.values())
    assert got == {i: (94, i) for i, _ in docs}
    monkeypatch.setattr(M, "BUSY", 0)
    for own in (20, 13):
        docs = family(150, own)
        pairs, got = looked_at(spark, docs, monkeypatch)
        assert pairs == 0
        assert got == {i: (66 + own, i) for i, _ in docs}
    # one that all others nearly contain is light: a pair for each document and shared value
    docs = family(150, 13) + [(999, " ".join([f"s{j}" for j in range(70)] + ["t1", "t2"]))]
    pairs, got = looked_at(spark, docs, monkeypatch)
    assert pairs <= 2 * M.PREFIX * len(docs)
    assert {c for _, c in got.values()} == {0}


def test_a_large_component_is_not_paired_with_itself(spark, monkeypatch):
    """Near copies of one text, and two texts that share half of it."""
    base = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(80)]
    docs += [(900 + k, " ".join(base[:60] + [f"y{k}_{j}" for j in range(20)])) for k in range(2)]
    pairs, got = looked_at(spark, docs, monkeypatch)
    assert pairs <= 2 * 2 * M.PREFIX * len(docs)
    assert got == brute(docs)


def test_private_shingles_change_no_link(spark, monkeypatch):
    """All nodes busy, lists in small blocks; groups of near copies within the family."""
    monkeypatch.setattr(M, "BUSY", 0)
    for seed, block in ((3, 4096), (4, 3)):
        monkeypatch.setattr(M, "BLOCK", block)
        rng = random.Random(seed)
        texts = sample(seed, 60) + [t for _, t in family(20, 28)] + [t for _, t in family(20, 10)]
        for t in rng.sample(texts, 40):
            w = t.split(" ")
            w[rng.randrange(len(w))] = "other"
            texts.append(" ".join(w))
        docs = list(enumerate(texts))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got == brute(docs)
    # an id with two texts, one of which is a copy of another document
    base = [f"w{i}" for i in range(40)]
    near = base[:-1] + ["z"]
    odd = [(4, " ".join(base)), (4, "a b c d e f g"), (2, "a b c d e f g"), (9, " ".join(near)), (7, " ".join(near[1:]))]
    rows = {(r.doc_id, r.component_id) for r in M.near_duplicates(spark.createDataFrame(odd, "doc_id long, text string")).collect()}
    assert rows == {(4, 4), (4, 2), (2, 2), (9, 4), (7, 4)}
