import hashlib
import random
import zlib

import pytest

from tessera.llm import prefix_trie as P

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth int, length string, parent int"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        whole[c] = own.get(base, [])[:h] + v[h:]
    members = {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []

    def below(p):
        return [p, *(x for k in kids.get(p, []) for x in below(k))]

    for p, cs in members.items():
        under = below(p)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x)
        done = ",".join(map(str, sorted(c for c in cs if len(whole[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), sum(x not in kids for x in under), saved, hashlib.sha256(done.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def sample(seed, n, words, most=7):
    rng = random.Random(seed)
    return [(c, t if rng.random() < 0.95 else None, rng.choice(["user", None]), rng.choice(words)) for c in rng.sample(range(-40, 40 * n), n) for t in range(rng.randint(1, most))]


@pytest.mark.parametrize("seed,words", [(1, ["a", "bb", "", None]), (2, ["same"]), (3, ["é🎈", "漢" * 30])])
def test_as_brute_force(spark, seed, words):
    rows = sample(seed, 90, words)
    assert got(P.conversation_trie(table(spark, rows))) == brute(rows)


def test_long_conversations_over_spans(spark, monkeypatch):
    monkeypatch.setattr(P, "SPAN", 3)
    monkeypatch.setattr(P, "RANGE", 4)
    rows = sample(7, 25, ["a", "b"], most=22)
    rows += [(c, t, "user", "a" if t < 15 + c % 3 else f"own {c}") for c in range(5000, 5012) for t in range(18)]
    assert got(P.conversation_trie(table(spark, rows))) == brute(rows)


def test_awkward_rows(spark):
    rows = [(None, 1, "user", "x"), (100, None, None, None), (100, 0, "user", "long " * 20_000), (100, 0, "user", "long " * 20_000), (101, 5, "a", "bc"), (101, 5, "ab", "c"), (-101, -3, "u", "v"), (-101, 3, "u", "w"), (-100, 1, "u", "v")]
    assert got(P.conversation_trie(table(spark, rows))) == brute(rows)


def test_empty_and_turnless(spark):
    assert got(P.conversation_trie(table(spark, []))) == []
    short = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(short, 0, "user", "gone")]
    assert got(P.conversation_trie(table(spark, rows))) == brute(rows) == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]


def test_search_finds_first_owned_depth(spark):
    minima = spark.createDataFrame([(1, d) for d in range(5)] + [(2, 3), (2, 4)], "conv_id long, depth long")
    convs = spark.createDataFrame([(1, 4), (2, 4), (3, 2)], "conv_id long, length long")
    assert {(r.conv_id, r.first) for r in P.first_owned(minima, convs).collect()} == {(1, 0), (2, 3), (3, 3)}
