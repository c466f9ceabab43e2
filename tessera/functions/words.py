"""Words of a full-text index as column expressions: runs of letters and digits in
lower case without accents, and their stems by Porter's algorithm (1980, with the
author's later ``bli`` and ``logi``)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARKS = range(0x300, 0x370)
_ACCENTED = (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))
_NOT_A_WORD = r"[^\p{L}\p{N}\p{Co}\p{Mn}]+"
SHORTEST, LONGEST = 3, 64  # of words that have stems


def _folding() -> tuple[str, str]:
    """Letters with accents and their plain ones; combining marks come last and have none."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in _ACCENTED]
    plain = [(a, d[0]) for a, d in pairs if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(a for a, _ in plain) + "".join(map(chr, _MARKS)), "".join(b for _, b in plain)


def folded(text: Column) -> Column:
    """Lower case without accents, of letters that are one or that have marks after them."""
    lower = F.lower(text)
    return F.when(lower.rlike(r"[^\x00-\x7F]"), F.translate(lower, *_folding())).otherwise(lower)


def words(text: Column, stems: bool = True) -> Column:
    """The array of words, in order."""
    plain = F.filter(F.split(folded(text), _NOT_A_WORD), lambda w: w != "")
    return F.transform(plain, stem) if stems else plain


# The suffixes of Porter's steps 2, 3 and 4.
STEP_2 = "ational ate,tional tion,enci ence,anci ance,izer ize,logi log,bli ble,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble"
STEP_3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
STEP_4 = "al,ance,ence,er,ic,able,ible,ant,ement,ment,ent,ou,ism,ate,iti,ous,ive,ize"

# What a stem must be like. A consonant is no vowel, and y one only after a vowel or in front.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
VOWEL = f"^({_C}[aeiouy]|[aeiou])"
SOME = f"{VOWEL}[aeiou]*{_C}"  # a measure over 0
ONE = f"{SOME}({_V})?$"  # a measure of 1
MANY = f"{SOME}{_V}{_C}"  # a measure over 1
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"  # consonant, vowel, consonant
DOUBLE = r"([^aeiou])\1$"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _cut(word: Column, n: int) -> Column:
    return F.left(word, F.length(word) - n)


def _rewrite(word: Column, pairs: list[tuple[str, str]], condition: str) -> Column:
    """The longest suffix that the word has decides; it is replaced if what is left fits."""
    out = word
    for old, new in sorted(pairs, key=lambda p: len(p[0])):
        rest = _cut(word, len(old))
        out = F.when(word.endswith(old), F.when(rest.rlike(condition), F.concat(rest, F.lit(new))).otherwise(word)).otherwise(out)
    return out


def _pairs(text: str) -> list[tuple[str, str]]:
    return [tuple(p.split(" ")) if " " in p else (p, "") for p in text.split(",")]


def _plural(w: Column) -> Column:
    return F.when(w.endswith("sses") | w.endswith("ies"), _cut(w, 2)).when(w.endswith("ss") | ~w.endswith("s"), w).otherwise(_cut(w, 1))


def _past(w: Column) -> Column:
    def mended(s: Column) -> Column:
        return F.when(s.rlike("(at|bl|iz)$"), F.concat(s, F.lit("e"))).when(s.rlike(DOUBLE) & ~s.rlike("[lsz]$"), _cut(s, 1)).when(s.rlike(SHORT), F.concat(s, F.lit("e"))).otherwise(s)

    ended = lambda n: F.when(_cut(w, n).rlike(VOWEL), bound(_cut(w, n), mended)).otherwise(w)
    return F.when(w.endswith("eed"), F.when(_cut(w, 3).rlike(SOME), _cut(w, 1)).otherwise(w)).when(w.endswith("ed"), ended(2)).when(w.endswith("ing"), ended(3)).otherwise(w)


def _final_y(w: Column) -> Column:
    return F.when(w.endswith("y") & _cut(w, 1).rlike(VOWEL), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _last_suffix(w: Column) -> Column:
    ion = F.when(w.endswith("ion"), F.when(_cut(w, 3).rlike("[st]$") & _cut(w, 3).rlike(MANY), _cut(w, 3)).otherwise(w))
    return ion.otherwise(_rewrite(w, _pairs(STEP_4), MANY))


def _final_e(w: Column) -> Column:
    rest = _cut(w, 1)
    return F.when(w.endswith("e") & (rest.rlike(MANY) | rest.rlike(ONE) & ~rest.rlike(SHORT)), rest).otherwise(w)


def _double_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(MANY), _cut(w, 1)).otherwise(w)


def stem(word: Column) -> Column:
    """The stem of a word of 3 to 64 letters; others stay."""
    steps = [_plural, _past, _final_y, lambda w: _rewrite(w, _pairs(STEP_2), SOME), lambda w: _rewrite(w, _pairs(STEP_3), SOME), _last_suffix, _final_e, _double_l]
    out = word
    for step in steps:
        out = bound(out, step)
    return F.when(F.length(word).between(SHORTEST, LONGEST) & ~word.rlike("[0-9]"), out).otherwise(word)
