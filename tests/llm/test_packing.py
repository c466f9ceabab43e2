import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from edge import EDGE_TEXTS, edge_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing as P


def best_fit_decreasing(lengths, capacity):
    """By item: large ones matched, then best fit; the number of bins."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=200), st.integers(60, 90))
def test_plan_places_every_item_once(lengths, capacity):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    table, total = P.plan(histogram, capacity)
    bins = defaultdict(list)
    for n, c in histogram.items():
        own = [r for r in table if r[0] == n]
        assert own[0][1] == 0
        for r, nxt in zip(own, [*own[1:], None]):
            for i in range(r[1], nxt[1] if nxt is not None else c):
                bins[r[3] + (i - r[1]) // r[2]].append((r[4] + (i - r[1]) % r[2] * n, n))
    assert set(bins) == set(range(total))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
        assert sum(n > capacity // 3 for _, n in items) <= 2
    assert total <= best_fit_decreasing(lengths, capacity) + 1
    assert total >= -(-sum(lengths) // capacity)


def test_matching_of_large_items_is_maximum():
    rng = random.Random(3)
    for _ in range(200):
        lengths = [rng.randint(34, 100) for _ in range(rng.randint(1, 7))]

        def most(rest):
            if len(rest) < 2:
                return 0
            a, tail = rest[0], rest[1:]
            return max([most(tail)] + [1 + most(tail[:i] + tail[i + 1 :]) for i, b in enumerate(tail) if a + b <= 100])

        _, total = P.plan({n: lengths.count(n) for n in set(lengths)}, 100)
        assert total == len(lengths) - most(lengths)


def test_fast_ids_equal_the_librarys():
    encode, whole = P.tokenizer("byte_bpe_50k"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain = lambda t: whole.encode(t, add_special_tokens=False).ids
    for c in range(0x250):
        for t in (chr(c), f"a{chr(c)}b", f" {chr(c)} {chr(c)}1", f"\n{chr(c)}\n\n x  {chr(c)}'s"):
            assert encode(t) == plain(t), (c, t)
    for t in EDGE_TEXTS:
        assert encode(t or "") == plain(t or "")
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), 32, 10])) for _ in range(rng.randrange(80)))
        assert encode(t) == plain(t)


def check(rows, texts, capacity):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(by) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert len(own) == -(-len(ids) // capacity)
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
            assert r.length == capacity or r.piece == 0
        assert at == len(ids)
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity


def test_awkward_texts(spark):
    check(P.pack(edge_docs(spark)).collect(), EDGE_TEXTS, P.CAPACITY)
    assert P.pack(edge_docs(spark, [])).count() == 0


def test_with_ids_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(P.number_within, "__defaults__", (7,))
    texts = ["a b c d e " * (i % 9) for i in range(150)]
    rows = P.pack(edge_docs(spark, texts), capacity=32, with_ids=True).collect()
    check(rows, texts, 32)
    assert all(len(r.ids) == r.length for r in rows)


