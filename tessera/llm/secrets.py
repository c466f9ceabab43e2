"""Secret scans by a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived (an AND
of the trigrams of its mandatory literals, an OR over alternatives), as in code
search. Texts are indexed in segments: for every segment, postings from trigram
to the sorted numbers of the texts that hold it. A query intersects and unites
postings; only the candidates left are verified with the expression. A rule
whose expression has no mandatory trigram scans every text. Segments are
independent, so the scan needs no shuffle and bounded memory, and only trigrams
that some query names are kept.

Defined results: a null or empty text has no spans; offsets count code points,
ends are exclusive; a very long text is scanned whole; spans of
several kinds at one place are all kept, by start and then kind; an empty table gives no
rows; repeated rows give equal values; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as _c
import re._parser as _p
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A query is None (anything may match) or ("tri", code), ("and", [..]), ("or", [..]).
Query = tuple | None


@dataclass(frozen=True)
class Rule:
    """kind: the name in span lists. Of a match, ``group`` must have ``least``
    characters at least; shorter matches are dropped, but still consume text."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 1
    base: bool = False


#: The three base kinds first, in their order in span lists.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 20, True),
    Rule("hex", r"[0-9a-f]+", re.ASCII, 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_login", r"://[A-Za-z0-9._-]+:[^\x20\x09-\x0D/@]+@"),
)

MAX_SET = 8  # a string set larger than this stops being exact


def _all(parts: list[Query]) -> Query:
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any(parts: list[Query]) -> Query:
    return None if any(p is None for p in parts) or not parts else parts[0] if len(parts) == 1 else ("or", parts)


def _code(tri: bytes) -> int:
    return tri[0] << 16 | tri[1] << 8 | tri[2]


def _of_string(s: str) -> Query:
    b = s.encode()
    return _all([("tri", c) for c in dict.fromkeys(_code(b[i : i + 3]) for i in range(len(b) - 2))])


def _of_strings(strings: set[str]) -> Query:
    return _any([_of_string(s) for s in sorted(strings)])


def trigram_query(pattern: str, flags: int = re.ASCII) -> Query:
    """What a text must hold for ``pattern`` to match in it, over ASCII-lower-cased
    trigrams. Walks the parsed expression with the set of strings that the current
    stretch can be; a stretch ends, and gives its trigrams, where the set gets large."""

    def walk(parsed) -> tuple[set[str] | None, Query]:
        """(all the strings it matches, or None if unknown; what it needs besides)"""
        runs: set[str] = {""}
        needs: list[Query] = []
        exact = True

        def cut() -> None:
            nonlocal runs, exact
            needs.append(_of_strings(runs))
            runs, exact = {""}, False

        for op, arg in parsed:
            if op is _c.LITERAL:
                got: set[str] | None = {chr(arg).lower() if arg < 128 else chr(arg)}
                if arg >= 128:
                    got = None
            elif op is _c.IN and len(arg) <= MAX_SET and all(o is _c.LITERAL and a < 128 for o, a in arg):
                got = {chr(a).lower() for _, a in arg}
            elif op is _c.SUBPATTERN:
                got, need = walk(arg[-1])
                needs.append(need)
            elif op is _c.BRANCH:
                both = [walk(x) for x in arg[1]]
                if all(g is not None for g, _ in both):
                    got = set().union(*(g for g, _ in both))
                    needs.append(_any([n for _, n in both]))
                else:
                    got = None
                    needs.append(_any([_all([_of_strings(g) if g is not None else None, n]) for g, n in both]))
            elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
                low, high, body = arg
                one, need = walk(body)
                if low:
                    needs.append(need)
                got = {""} | one if one is not None and (low, high) == (0, 1) else one if (low, high) == (1, 1) else None
                if got is None and one is not None and low:
                    needs.append(_of_strings(one))
            elif op is _c.AT:
                continue
            else:
                got = None
            if got is None:
                cut()
            elif len(runs) * len(got) > 4 * MAX_SET:
                cut()
                runs = got if len(got) <= 4 * MAX_SET else {""}
            else:
                runs = {a + b for a in runs for b in got}
        if exact:
            return runs, _all(needs)
        needs.append(_of_strings(runs))
        return None, _all(needs)

    strings, need = walk(_p.parse(pattern, flags))
    return _all([_of_strings(strings) if strings is not None else None, need])


def trigrams(query: Query) -> set[int]:
    if query is None:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams, query[1]))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def index_segment(texts: list[bytes], wanted: set[int]) -> dict[int, np.ndarray]:
    """Postings of the wanted trigrams: sorted, distinct numbers of texts."""
    if not wanted or not texts:
        return {}
    marks = np.zeros(1 << 24, bool)
    marks[list(wanted)] = True
    ends = np.cumsum([len(t) + 2 for t in texts])  # two bytes between texts, so that no trigram spans two
    found: list[np.ndarray] = []
    at, step = 0, 1 << 22
    whole = np.frombuffer(b"\x00\x00".join(texts) + b"\x00\x00", np.uint8)
    while at < len(whole) - 2:
        b = _LOWER[whole[at : at + step + 2]].astype(np.int32)
        codes = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        hits = np.flatnonzero(marks[codes])
        found.append(codes[hits].astype(np.int64) << 32 | np.searchsorted(ends, hits + at, "right"))
        at += step
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    codes, numbers = pairs >> 32, pairs & 0xFFFFFFFF
    cuts = np.flatnonzero(np.diff(codes)) + 1
    return {int(c[0]): n for c, n in zip(np.split(codes, cuts), np.split(numbers, cuts)) if len(c)}


def candidates(query: Query, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
    if query is None:
        return np.arange(n)
    if query[0] == "tri":
        return postings.get(query[1], np.empty(0, np.int64))
    parts = sorted((candidates(q, postings, n) for q in query[1]), key=len)
    out = parts[0]
    for p in parts[1:]:
        if query[0] == "and" and not len(out):
            break
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


class Scanner:
    """Rules with their queries; ``scan`` gives each text's spans."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        self.wanted = set().union(*map(trigrams, self.queries))
        self.compiled = [re.compile(self._long(r), r.flags) for r in rules]

    @staticmethod
    def _long(r: Rule) -> str:
        """A lone repeated class needs no look at runs that are too short: the
        leftmost longest runs of enough characters are the same."""
        parsed = _p.parse(r.pattern, r.flags)
        lone = len(parsed) == 1 and parsed[0][0] is _c.MAX_REPEAT and r.group == 0 and r.pattern.endswith("]+") and r.pattern.startswith("[")
        return f"{r.pattern[:-1]}{{{r.least},}}" if lone else r.pattern

    def verify(self, k: int, text: str) -> list[tuple[int, int, int]]:
        r = self.rules[k]
        return [(m.start(), k, m.end()) for m in self.compiled[k].finditer(text) if m.end(r.group) - m.start(r.group) >= r.least]

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Of each text (start, rule's place, end), sorted."""
        postings = index_segment([t.encode() for t in texts], self.wanted)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, q in enumerate(self.queries):
            for i in candidates(q, postings, len(texts)):
                spans[i] += self.verify(k, texts[i])
        for s in spans:
            s.sort()
        return spans


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>): every span of every rule, by start, then rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans = scanner.scan([t or "" for t in b.column(1).to_pylist()])
            rows = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=[id_col, "spans"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, spans array<struct<kind: string, start: long, end: long>>")


def secret_digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as a string."""
    from pyspark.sql import functions as F

    base = [r.kind for r in rules if r.base]
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scan_secrets(docs, rules).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
