from collections import Counter

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as C
from edge import edge_docs
from pyspark.sql import functions as F
from test_line_dedup import brute as brute_lines
from test_minhash import brute as brute_links

from tessera.llm import langid
from tessera.llm.packing import CAPACITY, tokenizer


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    stages = [f for _, f in C.STAGES]
    assert [n.split("_")[0] for n, _ in C.STAGES] == ["language", "line", "minhash", "source", "best"]

    a = stages[0](spark, docs, "").cache()
    told = rows(langid.identify(docs))
    assert set(rows(a)) == {i for i, r in told.items() if r.lang_pred != "und" and r.score >= langid.LEAST_SCORE}

    b = stages[1](spark, a, "").cache()
    before = rows(a)
    gone = brute_lines([(i, before[i].text) for i in sorted(before)], 50)
    after = rows(b)
    for i, r in before.items():
        text = "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone[i])
        if gone[i] and not text.split():
            assert i not in after
        else:
            assert after[i].text == text and after[i].n_chars == (len(text) if gone[i] else r.n_chars)

    c = stages[2](spark, b, "").cache()
    links = brute_links([(i, r.text) for i, r in sorted(after.items())])
    assert set(rows(c)) == {i for i, (_, k) in links.items() if i == k}

    d = stages[3](spark, c, "").cache()
    assert a.columns == b.columns == c.columns == d.columns == columns
    kept = rows(c)
    words = Counter()
    for r in d.collect():
        words[r.doc_id] += len(r.text.split())
    assert all(n <= 3 * len(kept[i].text.split()) for i, n in words.items())
    total = sum(len(r.text.split()) for r in kept.values())
    assert abs(sum(words.values()) - total) < 0.02 * total

    e = stages[4](spark, d, "").collect()
    encode = tokenizer("byte_bpe_50k")
    assert sum(r.length for r in e) == sum(len(encode(r.text)) + 1 for r in d.collect())
    size = Counter()
    for r in e:
        size[r.sequence_id] += r.length
    assert max(size.values()) <= CAPACITY


CLASHING = "size at uses component node score lang_pred removed n_removed n_lines _doc _row _t _turn _text _d taken sid target source_size block words shard held_out _rest".split()


def test_clashing_columns(spark):
    docs = edge_docs(spark).drop("piece", "_n", "media")
    for c in CLASHING:
        docs = docs.withColumn(c, F.col("doc_id") * 2)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == 2 * r.doc_id for r in rows for c in CLASHING), name
    assert C.STAGES[-1][1](spark, docs, "").count() >= docs.count()


def test_run(spark, tmp_path):
    edge_docs(spark).union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30).selectExpr("doc_id + 100", "text", "lang", "source", "n_chars", "'p'", "null", "'m'")).drop("piece", "_n", "media").write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() > 20
