"""Quality rules as a short-circuit cascade. DataFrame operations only.

Each rule is a Boolean expression over measures of a text that rejects it. On a
sample bounded by ``SAMPLE`` documents (chosen by hash) each rule's cost is timed,
the least of ``READINGS`` times less that of reading the sample, and its share of
rejections counted. Rules then run by
falling rejections per cost as one CASE, whose later branches are not evaluated
for a text that an earlier one rejects. The order changes time, not verdicts.

Counts over word windows need no rows besides the text's: windows are 64-bit
hashes in an array, sorted with their places only where some value repeats.

Defined results: a null or empty text has no words and fails the base rules; a
very long text is counted whole; of rules with equal rates the first given runs
first; repeated rows give equal values, a null doc_id stays null; other columns are
ignored; an empty table gives no rows (the rules then keep their given order).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, text_or_empty

SAMPLE, READINGS, WINDOW = 4000, 3, 5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, inside lambdas too."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def n_dup_lines(text: Column) -> Column:
    return let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def n_stutters(text: Column) -> Column:
    """Words equal to the word before."""
    return let(words(text), lambda w: F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long"))


def _covered(windows: Column, size: int) -> Column:
    """Words that lie in windows whose value occurs twice or more."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    places = let(pairs, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1)), lambda x: x["i"])))
    return let(places, lambda p: F.aggregate(F.transform(p, lambda i, k: F.least(F.coalesce(F.get(p, k + 1) - i, F.lit(size)), F.lit(size))), F.lit(0), lambda a, n: a + n))


def n_repeats(words: Column, size: int = WINDOW) -> Column:
    """Of an array of words, those in windows that occur twice or more."""
    shifted = lambda h: [h, *[F.slice(h, F.lit(k + 1), F.size(h) - k) for k in range(1, size)]]
    windows = lambda h: F.transform(F.slice(F.arrays_zip(*shifted(h)), F.lit(1), F.size(h) - (size - 1)), lambda x: F.xxhash64(x))
    count = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w, size)).otherwise(0)
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > size, let(hashes, lambda h: let(windows(h), count))).otherwise(0).cast("long")


def n_repeat_words(text: Column, size: int = WINDOW) -> Column:
    return n_repeats(words(text), size)


MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_lines": n_lines,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
    "n_stutters": n_stutters,
}
Measure = Callable[[str], Column]


def measured(text: Column, known: tuple[str, ...] = ()) -> Measure:
    """A measure of ``text`` by name; those ``known`` are columns already."""
    return lambda name: F.col(name) if name in known else MEASURES[name](text)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measure], Column]


#: Thresholds are shares in hundredths. The first two are the base rules.
RULES = (
    Rule("few_words", lambda m: m("n_words") < 10),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
    Rule("symbols", lambda m: 100 * m("n_symbols") > 10 * m("n_words")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > 40 * m("n_lines")),
    Rule("stutter", lambda m: 100 * m("n_stutters") > 30 * m("n_words")),
    Rule("long_words", lambda m: m("word_chars") > 20 * m("n_words")),
)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: int

    @property
    def rate(self) -> float:
        return self.rejected / self.seconds


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, text_col: str = "text", known: tuple[str, ...] = ()) -> list[Estimate]:
    """The rules by falling rejections per second on a sample: the least of
    ``READINGS`` times, less that of reading the sample and the columns ``known``."""
    text = text_or_empty(text_col)
    part = max(1, docs.count() // sample)
    few = docs.where(F.pmod(F.xxhash64(text_col), F.lit(part)) == 0).select(text.alias("t")).limit(sample)
    few = materialize(few.select("t", *[MEASURES[k](F.col("t")).alias(k) for k in known]), "sample")

    def run(what: Column) -> tuple[float, int]:
        began = time.perf_counter()
        n = few.agg(F.coalesce(F.sum(what.cast("long")), F.lit(0)).alias("n")).first()["n"]
        return time.perf_counter() - began, n

    def least(what: Column) -> tuple[float, int]:
        run(what)  # compiles
        return min(run(what) for _ in range(READINGS))

    bare = least((F.length("t") < 0) | F.greatest(F.lit(0), *[F.col(k) for k in known], F.lit(0)).isNull())[0]
    out = []
    for r in rules:
        seconds, rejected = least(r.rejects(measured(F.col("t"), known)))
        out.append(Estimate(r, max(1e-4, seconds - bare), rejected))
    return sorted(out, key=lambda e: -e.rate)


def cascade(rules: list[Rule], measure: Measure) -> Column:
    """The name of the first rule that rejects, or null."""
    out = None
    for r in rules:
        out = F.when(r.rejects(measure), r.name) if out is None else out.when(r.rejects(measure), r.name)
    return out if out is not None else F.lit(None).cast("string")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with rejected_by: the rule that rejects the text, or null where it is
    kept. A column of ``docs`` with that name is replaced."""
    order = [e.rule for e in estimate(docs, rules, text_col=text_col)]
    return docs.withColumn("rejected_by", cascade(order, measured(text_or_empty(text_col))))


def quality_report(docs: DataFrame) -> DataFrame:
    """The base counts, the base verdict, and the cascade's over all rules. Counts that
    the report has anyway are taken from its columns; the cascade counts the others,
    of the texts that come so far."""
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    order = [e.rule for e in estimate(docs, known=base)]
    text = text_or_empty("text")
    split = docs.select("doc_id", text.alias("_text"), words(text).alias("_words"))
    counted = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": n_symbols(F.col("_text")),
        "n_dup_lines": n_dup_lines(F.col("_text")),
        "n_repeat_words": n_repeats(F.col("_words")),
    }
    counts = split.select("doc_id", *[counted[k].alias(k) for k in base], "_text")
    failed = counts.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return failed.withColumn("kept", cascade(order, measured(F.col("_text"), base)).isNull()).drop("_text")


#: The same over the documents table in DuckDB.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rn, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT rn, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g FROM (SELECT rn, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
dup AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rn, sum(n) AS n FROM (SELECT rn, least(5, coalesce(lead(i) OVER (PARTITION BY rn ORDER BY i) - i, 5)) AS n FROM dup) GROUP BY rn),
b AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters
  FROM w LEFT JOIN cov USING (rn))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 40 * n_lines
    OR 100 * n_stutters > 30 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""
