import random
import re
from collections import Counter
from itertools import permutations

from edge import edge_docs

from tessera.llm import filter_audit as A

LABELS = "doc_id long, quality int, toxic int, part string, mask string"


def brute(docs, labels):
    """docs: [(doc_id, text, lang)]; labels: [(doc_id, quality, toxic)]. Applies every order, document by document."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    rows = [(i, t or "", lang or "") for i, t, lang in docs]
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    fails = []
    for i, t, lang in rows:
        w = words(t)
        own = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        own["E"] = i is not None and any(u == t and j is not None and j < i for j, u, _ in rows)
        fails.append((i, lang, {f for f in own if own[f]}))
    out, removed_by = {}, Counter()
    for part in {p for _, p, _ in fails}:
        for order in permutations("ABCDE"):
            left = [(i, x) for i, p, x in fails if p == part]
            for k, f in enumerate(order, 1):
                gone = [i for i, x in left if f in x]
                redundant = sum(f in x for i, p, x in fails if p == part) - len(gone)
                left = [(i, x) for i, x in left if f not in x]
                unique = sum(x == {f} for i, p, x in fails if p == part)
                out[part, "".join(order), k] = [len(left), len(gone), redundant, unique, sum(i in good for i in gone), sum(i in toxic for i in gone)]
                removed_by[part, f] += len(gone)
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): (*[r[c] for c in A.COUNTS], r.shapley) for r in df.collect()}


def labels_of(spark, labels):
    return spark.createDataFrame([(*x, "p", "m") for x in labels], LABELS)


def test_as_every_order_applied(spark):
    rng = random.Random(5)
    pieces = ["word%d " % i for i in range(130)]
    texts = [("".join(rng.sample(pieces, rng.choice([60, 110, 130]))) + rng.choice(["", "", "# | ", "ABC " * 40, "same " * 60])) for _ in range(40)]
    docs = [(i, rng.choice(texts + [None, ""]), rng.choice(["en", "de", None, ""])) for i in range(160)]
    docs += [(3, docs[3][1], "en"), (None, docs[5][1], "de"), (None, docs[5][1], "de"), (-7, docs[9][1], "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 160, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    df = spark.createDataFrame([(i, t, lang, "s", 0, None) for i, t, lang in docs], "doc_id long, text string, lang string, part string, mask int, good string")
    result = got(A.audit(df, labels_of(spark, labels)))
    assert len(result) == 3 * 600
    assert result == brute(docs, labels)


def test_awkward_texts(spark):
    df = edge_docs(spark)
    docs = [(r.doc_id, r.text, r.lang) for r in df.collect()]
    assert got(A.audit(df, labels_of(spark, [(0, 1, 0)]))) == brute(docs, [(0, 1, 0)])


def test_empty_tables(spark):
    df = edge_docs(spark)
    assert A.audit(df.limit(0), labels_of(spark, [])).count() == 0
    assert A.audit(df, labels_of(spark, [])).count() == 600 * 2


def test_lattice_has_80_edges_and_600_steps(spark):
    classes = spark.createDataFrame([("p", 3, 5, 1, 0)], "part string, mask int, rows long, good long, toxic long")
    assert A.edges(classes, 5).count() == 80
    path = A.steps(spark, "ABCDE")
    assert path.count() == 600 and path.select("applied", "filter").distinct().count() == 80
    assert A.edges(classes, 5).selectExpr("sum(weight)").first()[0] == 600
