import random
import tempfile
from collections import defaultdict

from edge import EDGE_TEXTS, edge_docs

from tessera.llm import token_rollup as R

CHANGES = "op string, doc_id long, source string, lang string, tokenizer string, tokens long, seq int"


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_equals_recounting(spark):
    rng = random.Random(1)
    rollup = R.Rollup(spark, "file://" + tempfile.mkdtemp())
    assert totals(rollup) == {}
    state, batches = {}, []
    for b in range(5):
        rows = [(rng.choice(["insert", "revise", "delete"]), rng.choice([None, *range(12)]), rng.choice([None, "a", "b"]), rng.choice(["x", None]), rng.choice([None, "v1", "v2"]), rng.choice([None, 0, 5, 9]), i) for i in range(rng.choice([0, 3, 20]))]
        batches.append(spark.createDataFrame(rows, CHANGES))
        for op, doc, source, lang, version, n, _ in rows:
            if doc is not None and version is not None:
                state.pop((doc, version), None)
                if op != "delete":
                    state[doc, version] = (source, lang, n or 0)
        assert rollup.commit(f"b{b}", batches[-1])
        want = defaultdict(lambda: (0, 0))
        for (_, version), (source, lang, n) in state.items():
            d, t = want[source, lang, version]
            want[source, lang, version] = (d + 1, t + n)
        assert totals(rollup) == want
    for b in (0, 3, 4):
        assert not rollup.commit(f"b{b}", batches[b])
    assert totals(rollup) == want
    assert {(r.doc_id, r.tokenizer): (r.source, r.lang, r.tokens) for r in rollup.state().collect()} == state


def test_a_failed_attempt_leaves_no_trace(spark, monkeypatch):
    rollup = R.Rollup(spark, "file://" + tempfile.mkdtemp())
    one = spark.createDataFrame([("insert", 1, "a", "x", "v1", 7, 0)], CHANGES)

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(rollup, "_publish", fails)
        try:
            rollup.commit("b", one)
        except RuntimeError:
            pass
    assert totals(rollup) == {}
    assert rollup.commit("b", one) and totals(rollup) == {("a", "x", "v1"): (1, 7)}
    assert not rollup._publish(1, {}) and totals(rollup) == {("a", "x", "v1"): (1, 7)}


def test_two_batches_at_once(spark, monkeypatch):
    """Another writer commits while a batch is being applied: both count."""
    root = "file://" + tempfile.mkdtemp()
    one, other = R.Rollup(spark, root), R.Rollup(spark, root)
    assert one.commit("load", spark.createDataFrame([("insert", 1, "a", "x", "v1", 7, 0), ("insert", 2, "a", "x", "v1", 5, 0)], CHANGES))
    applied, runs = one._applied, []

    def late(version, last):
        runs.append(1)
        out = applied(version, last)
        if len(runs) == 1:
            assert other.commit("second", spark.createDataFrame([("revise", 1, "b", "x", "v1", 9, 0)], CHANGES))
        return out

    monkeypatch.setattr(one, "_applied", late)
    assert one.commit("third", spark.createDataFrame([("delete", 1, None, None, "v1", None, 0)], CHANGES))
    assert len(runs) == 2 and totals(one) == {("a", "x", "v1"): (1, 5)}


def inserts(spark, first, end):
    return spark.range(first, end).selectExpr("'insert' op", "id doc_id", "'a' source", "'x' lang", "'v1' tokenizer", "1L tokens")


def test_a_commit_touches_only_its_buckets(spark):
    rollup = R.Rollup(spark, "file://" + tempfile.mkdtemp(), bucket_rows=25)
    rollup.commit("load", inserts(spark, 0, 200))
    before = rollup._current()[1]["state"]
    rollup.commit("one", spark.createDataFrame([("delete", 3, None, None, "v1", None, 0)], CHANGES))
    after = rollup._current()[1]["state"]
    assert len(before) == 8 and sum(before[k] != after[k] for k in before) == 1
    assert totals(rollup) == {("a", "x", "v1"): (199, 199)}


def test_buckets_grow_with_the_state(spark):
    rollup = R.Rollup(spark, "file://" + tempfile.mkdtemp(), bucket_rows=25)
    rollup.commit("nothing", inserts(spark, 0, 0))
    sizes = []
    for end in (50, 100, 1000):
        assert rollup.commit(f"up to {end}", inserts(spark, 0, end))
        sizes.append(rollup._current()[1]["buckets"])
        assert totals(rollup) == {("a", "x", "v1"): (end, end)} and rollup.state().count() == end
    assert sizes == [1, 6, 44]  # two are not more than twice one; then by 50 held and 100 given, 100 and 1000


def test_a_version_names_its_batch_only(spark, monkeypatch):
    """The mark of a batch whose writer ended early is left by the next one."""
    rollup = R.Rollup(spark, "file://" + tempfile.mkdtemp())
    publish = R.publish
    with monkeypatch.context() as m:
        m.setattr(R, "publish", lambda s, path, text: "/batches/" not in path and publish(s, path, text))
        assert rollup.commit("a/b c", inserts(spark, 0, 3))
    assert not R.published(spark, f"{rollup.root}/batches") and not rollup.commit("a/b c", inserts(spark, 0, 9))
    for b in range(3):
        assert rollup.commit(f"b{b}", inserts(spark, b, b + 1))
    assert rollup._current()[1]["batch"] == "b2" and len(R.published(spark, f"{rollup.root}/batches")) == 4
    assert not any(rollup.commit(b, inserts(spark, 0, 9)) for b in ("a/b c", "b0", "b1", "b2"))
    assert totals(rollup) == {("a", "x", "v1"): (3, 3)}


def test_clean(spark):
    rollup = R.Rollup(spark, "file://" + tempfile.mkdtemp(), bucket_rows=25)
    rollup.commit("load", inserts(spark, 0, 200))
    rollup.commit("one", inserts(spark, 3, 4))
    assert rollup.clean() == 0  # all of it is young
    assert rollup.clean(keep=2, age_ms=-60_000) == 0
    assert rollup.clean(age_ms=-60_000) == 2  # the first totals and the bucket written anew
    assert totals(rollup) == {("a", "x", "v1"): (200, 200)} and rollup.state().count() == 200
    rollup._applied(rollup._current()[1], R.materialize(inserts(spark, 5, 6).groupBy("doc_id", "tokenizer").agg(R.F.max(R.F.struct(R.F.lit(0).alias("seq"), "op", "tokens", "source", "lang")).alias("n")), "test"))
    assert rollup.clean(age_ms=-60_000) == 1 and rollup.state().count() == 200  # an attempt that no version names


def test_awkward_texts(spark):
    docs = edge_docs(spark)
    rows = R.pattern_report(docs).where("tokenizer = 'words-1'").collect()
    want = defaultdict(lambda: [0, 0])
    seen = set()
    for r in docs.collect():
        if r.text is not None and r.text in seen:
            continue
        seen.add(r.text)
        want[r.source, r.lang][0] += 1
        lines = dict.fromkeys((r.text or "").split("\n"))
        want[r.source, r.lang][1] += sum(len([w for w in x.split(" ") if w.strip()]) for x in lines)
    assert {(r.source, r.lang): [r.docs, r.tokens] for r in rows} == want
    assert R.rollup_report(edge_docs(spark, [])).count() == 0


def test_report_by_vocabulary(spark):
    """Against counting every text by itself."""
    from tessera.llm.packing import tokenizer

    encode = tokenizer("byte_bpe_50k")
    docs = edge_docs(spark, [*EDGE_TEXTS, "a line\na line\nanother", "a line\na line\nanother"])
    want, seen = defaultdict(lambda: [0, 0, 0, 0]), set()
    for r in docs.collect():
        w = want[r.source, r.lang]
        w[2], w[3] = w[2] + 1, w[3] + len(encode(r.text or ""))
        if r.text is None or r.text not in seen:
            w[0], w[1] = w[0] + 1, w[1] + len(encode("\n".join(dict.fromkeys((r.text or "").split("\n")))))
        seen.add(r.text)
    rows = R.rollup_report(docs).collect()
    assert {(r.source, r.lang): [r.docs, r.tokens, r.loaded_docs, r.loaded_tokens] for r in rows if r.tokenizer == "byte_bpe_50k"} == want
    patterns = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in R.pattern_report(docs).collect()}
    assert {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rows if r.tokenizer in R.PATTERNS} == patterns
    assert R.rollup_report(edge_docs(spark, [])).count() == 0


def test_vocabulary_counts(spark):
    from tessera.llm.packing import tokenizer

    encode = tokenizer("byte_bpe_50k")
    assert {r.doc_id: r.tokens for r in R.vocabulary_counts(edge_docs(spark)).collect()} == {i: len(encode(t or "")) for i, t in enumerate(EDGE_TEXTS)}
