import math

import numpy as np
from edge import EDGE_TEXTS, edge_docs
from pyspark.sql import functions as F

from tessera.llm import langid as L


def total(word, p):
    """Sum over all segmentations, each listed."""
    if not word:
        return 1.0
    out = sum(p[word[:n]] * total(word[n:], p) for n in range(1, len(word) + 1) if word[:n] in p)
    return out + (0 if word[0] in p else L.UNKNOWN * total(word[1:], p))


NAMES = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "bab", "c"]


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    p = rng.random((len(NAMES), 3)) / 9
    words = ["a", "ab", "abab", "babab", "zab", "abz", "cabbabacabz", "b" * 40]
    got = L.log_probabilities(words, L.Pieces.of(NAMES), p)
    for i, w in enumerate(words[:-1]):
        for k in range(3):
            assert math.isclose(got[i, k], math.log(total("▁" + w, dict(zip(NAMES, p[:, k])))), rel_tol=1e-9)
    assert np.isfinite(L.log_probabilities(["ab" * 3000], L.Pieces.of(NAMES), p)).all()


def segmentations(word, p):
    if not word:
        yield [], 1.0
    for n in range(1, len(word) + 1):
        if word[:n] in p:
            for rest, q in segmentations(word[n:], p):
                yield [word[:n], *rest], q * p[word[:n]]


def test_expected_counts():
    p = np.linspace(0.02, 0.2, len(NAMES))
    words, counts = ["abab", "bab", "aba"], np.array([2.0, 1.0, 5.0])
    got = L.expected_counts(words, counts, L.Pieces.of(NAMES), p)
    want = dict.fromkeys(NAMES, 0.0)
    for w, c in zip(words, counts):
        ways = list(segmentations("▁" + w, dict(zip(NAMES, p))))
        whole = sum(q for _, q in ways)
        for parts, q in ways:
            for x in parts:
                want[x] += c * q / whole
    assert np.allclose(got, [want[n] for n in NAMES])


def test_long_words_teach():
    p, pieces = np.linspace(0.02, 0.2, len(NAMES)), L.Pieces.of(NAMES)
    letters = np.array(list(map(len, NAMES)))
    for word, known in (("ab" * 29, 59), ("ab" * 30, 61), ("abbac" * 400, 2001), ("z" * 58 + "a", 2), ("z" * 500 + "ab" * 40, 81)):
        got = L.expected_counts([word, word], np.array([2.0, 1.0]), pieces, p)
        assert math.isclose(got @ letters, 3 * known, rel_tol=1e-9), word
    one = L.expected_counts(["b" * 59 + "cab"], np.ones(1), pieces, p)
    cut = L.expected_counts(["b" * 59], np.ones(1), pieces, p)
    assert np.isclose(one[NAMES.index("c")] - cut[NAMES.index("c")], 1)
    # a language whose words are all long is told from another by them
    model = L.fit({"x": (["ab" * 50], np.ones(1), 1), "y": (["cb" * 50], np.ones(1), 1)}, NAMES)
    assert [model.langs[k] for k in model.score(["abab", "cbcb"]).argmax(axis=1)] == ["x", "y"]


def test_words():
    assert L.words_of("Été 12 x_y ²½ L'an") == ["été", "x", "y", "²½", "l", "an"]
    assert L.words_of("²½ 123 !") == [] and L.words_of(None) == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.identify(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").toPandas()
    out = rows[rows.held_out & (rows.n_chars > 40)]
    assert len(out) > 150
    assert (out.lang_pred == out.lang).mean() > 0.97
    assert rows.score.between(0, 1).all()


def test_awkward_texts(spark):
    texts = EDGE_TEXTS + ["the cat and the dog", "123 !?", "²"]
    docs = edge_docs(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 3 == 1, "en").when(F.col("doc_id") % 3 == 2, "xx"))
    rows = {r.doc_id: r for r in L.identify(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert (rows[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
        assert rows[i].held_out == (__import__("zlib").crc32(str(i).encode()) % 4 == 2)
    kept = L.in_a_language(docs)
    assert kept.columns == docs.columns
    assert {r.lang_pred for r in L.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert L.identify(edge_docs(spark, [])).count() == 0


def test_short_texts_in_many_languages_stay(spark):
    rows = [(i, "the cat", f"l{i % 8}") for i in range(80)] + [(80, "12 !?", "l0"), (81, "qzxv " * 50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert max(r.score for r in L.identify(docs).where("doc_id < 80").collect()) < 0.4
    assert {r.doc_id for r in L.in_a_language(docs).collect()} == set(range(82)) - {80}
