"""Language identification by segmentation-marginalised unigrams.

Over the pieces of a fixed public vocabulary each language has a probability
per piece. A word's probability in a language is the sum over all its
segmentations into pieces of the product of their probabilities, which a forward
recursion gives; a text's is the product over its words (runs of letters, lower
case, each begun by the vocabulary's word mark). Piece probabilities are fitted
by expectation-maximisation over the same lattice, on word counts of a bounded
sample: at most ``SAMPLE_DOCS`` labelled documents and ``SAMPLE_WORDS`` distinct
words a language, chosen by hash and by count; of longer words training takes
consecutive stretches of ``STRETCH`` characters, the mark included. Everything
else covers all rows. Pieces of two letters or more to which the fit gives less than
``LEAST_PIECE`` in every language are left out of the lattice afterwards; each
segmentation that this takes away has such a piece, so the probability of a word of n
letters falls by n (n + 1) / 2 * 1e-7 at most (prefixes and suffixes sum to 1 at most).

Defined results: a text that is null or has no letter gets ``und`` with score 0;
ties go to the language that sorts first; letters outside the vocabulary weigh
the same in every language; without labelled rows every text gets ``und``, and an
empty table gives no rows; a very long text is read whole, in slices of distinct words;
repeated rows give equal values; other columns are ignored. The score is the
posterior probability of the language predicted.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, unpacked

SAMPLE_DOCS, SAMPLE_WORDS, ROUNDS = 2000, 50_000, 4
LEAST_PIECE = 1e-7  # in some language, for a piece to stay after the fit
UNKNOWN = 1e-9  # of a letter that is no piece
SHARED, FLOOR = 0.02, 1e-8  # share of the languages' mean in each, and the least probability of a piece
MARK = "▁"
STRETCH = 60  # characters of a word that training takes at a time
CACHE = 300_000  # words whose probabilities a worker keeps, before the next slice
SLICE, WORDS = 512, 20_000  # documents, and new words, that it takes at a time

_LETTERS = re.compile(r"[^\W\d_]+")
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters; [] if no character is a letter."""
    found = _LETTERS.findall((text or "").lower())
    if not any(c.isalpha() for w in found[:8] for c in w) and not any(c.isalpha() for w in found for c in w):
        return []
    return found


def vocabulary(path: str) -> list[str]:
    """The vocabulary's pieces of lower-case letters, with or without the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    keep = lambda p: (body := p.removeprefix(MARK)) == body.lower() and all(unicodedata.category(c)[0] == "L" for c in body)
    return sorted({p for p in pieces if keep(p)} | {MARK})


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, length).astype(np.uint64)


def _prefix_hashes(codes: np.ndarray) -> list[np.ndarray]:
    out = [np.zeros(len(codes), np.uint64)]
    for i in range(codes.shape[1]):
        out.append(out[-1] * _BASE + codes[:, i] + np.uint64(1))
    return out


@dataclass
class Pieces:
    """Finds pieces by their hash: a sparse table, where a taken slot leads to the next."""

    hashes: np.ndarray
    longest: int
    shift: np.uint64
    slots: np.ndarray
    powers: np.ndarray

    @classmethod
    def of(cls, pieces: list[str]) -> Pieces:
        hashes = np.array([int(_prefix_hashes(_codes([p], len(p)))[-1][0]) for p in pieces], np.uint64)
        longest = max(map(len, pieces))
        bits = (16 * len(pieces)).bit_length()
        shift = np.uint64(64 - bits)
        slots = np.full(1 << bits, -1, np.int32)
        for i, at in enumerate((hashes * _SPREAD >> shift).tolist()):
            while slots[at] >= 0:
                at = at + 1 & (1 << bits) - 1
            slots[at] = i
        powers = np.array([pow(int(_BASE), i, 1 << 64) for i in range(longest + 1)], np.uint64)
        return cls(hashes, longest, shift, slots, powers)

    def find(self, prefix: list[np.ndarray], start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose substring is a piece, and which."""
        h = prefix[end] - prefix[start] * self.powers[end - start]
        at = (h * _SPREAD >> self.shift).astype(np.int64)
        ids = self.slots[at]
        hit = (ids >= 0) & (self.hashes[ids] == h)
        rest = np.flatnonzero((ids >= 0) & ~hit)
        while len(rest):
            at[rest] = at[rest] + 1 & len(self.slots) - 1
            ids[rest] = self.slots[at[rest]]
            hit[rest] = (ids[rest] >= 0) & (self.hashes[ids[rest]] == h[rest])
            rest = rest[(ids[rest] >= 0) & ~hit[rest]]
        rows = np.flatnonzero(hit)
        return rows, ids[rows]


def log_probabilities(words: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """(words, languages): log of the sum over all segmentations. p: (pieces, languages)."""
    out = np.zeros((len(words), p.shape[1]))
    by = defaultdict(list)
    for i, w in enumerate(words):
        by[len(w) + 1].append(i)
    for length, at in by.items():
        prefix = _prefix_hashes(_codes([MARK + words[i] for i in at], length))
        forward = [np.ones((len(at), p.shape[1]))]  # of the last ``longest`` places, rescaled
        scale = np.zeros((len(at), p.shape[1]))
        for end in range(1, length + 1):
            new = forward[-1] * UNKNOWN
            for n in range(1, min(end, pieces.longest) + 1):
                rows, ids = pieces.find(prefix, end - n, end)
                if len(rows):
                    if n == 1:
                        new[rows] = 0
                    new[rows] += forward[-n][rows] * p[ids]
            forward = [*forward[-pieces.longest + 1 :], new] if pieces.longest > 1 else [new]
            if end % 8 == 0:
                top = np.max(forward, axis=0)
                scale += np.log(top)
                forward = [f / top for f in forward]
        out[at] = np.log(forward[-1]) + scale
    return out


def expected_counts(words: list[str], counts: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """How often each piece is used, over all segmentations of the words, long ones
    by stretches; p: (pieces,)."""
    total = np.zeros(len(p))
    stretches: dict[str, float] = defaultdict(float)
    for w, c in zip(words, counts):
        w = MARK + w
        for k in range(0, len(w), STRETCH):
            stretches[w[k : k + STRETCH]] += c
    by = defaultdict(list)
    for w in stretches:
        by[len(w)].append(w)
    for length, at in by.items():
        prefix = _prefix_hashes(_codes(at, length))
        found = {}
        forward = np.zeros((length + 1, len(at)))  # logarithms, as long products leave the range
        for end in range(1, length + 1):
            new = np.full(len(at), UNKNOWN)  # relative to the place before
            for n in range(1, min(end, pieces.longest) + 1):
                rows, ids = found[end, n] = pieces.find(prefix, end - n, end)
                if n == 1:
                    new[rows] = 0
                new[rows] += np.exp(forward[end - n][rows] - forward[end - 1][rows]) * p[ids]
            forward[end] = forward[end - 1] + np.log(np.maximum(new, 1e-300))
        through = np.zeros((length + 1, len(at)))  # expected uses of each place as a boundary
        through[length] = [stretches[w] for w in at]
        for end in range(length, 0, -1):
            for n in range(1, min(end, pieces.longest) + 1):
                rows, ids = found[end, n]
                use = through[end][rows] * np.exp(forward[end - n][rows] - forward[end][rows]) * p[ids]
                np.add.at(total, ids, use)
                through[end - n][rows] += use
            rest = np.ones(len(at), bool)
            rest[found[end, 1][0]] = False
            through[end - 1][rest] += through[end][rest] * np.exp(forward[end - 1][rest] - forward[end][rest]) * UNKNOWN
    return total


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    pieces: Pieces
    p: np.ndarray

    def score(self, words: list[str]) -> np.ndarray:
        return log_probabilities(words, self.pieces, self.p)


def fit(samples: dict[str, tuple[list[str], np.ndarray, int]], names: list[str], rounds: int = ROUNDS) -> Model:
    """samples: of each language words, their counts, and its number of documents."""
    langs = sorted(samples)
    pieces = Pieces.of(names)
    columns = []
    for lang in langs:
        words, counts, _ = samples[lang]
        p = np.full(len(names), 1 / len(names))
        for _ in range(rounds):
            c = expected_counts(words, counts, pieces, p) + 1e-12
            p = c / c.sum()
        columns.append(p)
    p = np.array(columns).T
    used = (p > LEAST_PIECE).any(axis=1) | np.array([len(x) == 1 for x in names])
    p = p[used]
    p = (1 - SHARED) * p + SHARED * p.mean(axis=1, keepdims=True)
    p = np.maximum(p / p.sum(axis=0), FLOOR)
    docs = np.array([samples[x][2] for x in langs], float) + 1
    return Model(langs, np.log(docs / docs.sum()), Pieces.of([x for x, u in zip(names, used) if u]), p)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int, sample_words: int) -> dict[str, tuple[list[str], np.ndarray, int]]:
    """Word counts of a bounded number of labelled documents, chosen by hash: by a
    threshold that leaves about twice as many, then by rank among those."""
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in ids.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2 * sample_docs / n))])
    few = ids.withColumn("_h", F.xxhash64("id", "text")).where(F.pmod("_h", F.lit(1_000_000)) < 1_000_000 * shares[F.col("lang")])
    one = Window.partitionBy("lang").orderBy("_h", "id")
    chosen = few.withColumn("_n", F.row_number().over(one)).where(F.col("_n") <= sample_docs)
    words = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    most = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    rows = words.withColumn("_n", F.row_number().over(most)).where(F.col("_n") <= sample_words).drop("_n").toPandas()
    return {lang: (g["word"].tolist(), g["n"].to_numpy(float), sizes[lang]) for lang, g in rows.groupby("lang")}


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(all columns of ``docs``, lang_pred, score)."""
    columns = docs.columns
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        table = np.empty((0, len(model.langs) if model else 0))
        for b in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            langs, scores = ["und"] * b.num_rows, np.zeros(b.num_rows)
            if model:
                if len(known) > CACHE:
                    known, table = {}, table[:0]
                lines = [np.fromiter((known.setdefault(w, len(known)) for w in words_of(t.as_py())), np.int32) for t in b.column(at)]
                fresh = list(known)[len(table) :]
                table = np.concatenate([table, *(model.score(fresh[k : k + WORDS]) for k in range(0, len(fresh), WORDS))])
                for i, line in enumerate(lines):
                    if len(line):
                        total = model.prior + table[line].sum(axis=0)
                        k = int(total.argmax())
                        langs[i], scores[i] = model.langs[k], 1 / np.exp(total - total[k]).sum()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores)], names=[*columns, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def default_vocabulary() -> list[str]:
    import public_tokenizers

    return vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def train(labelled: DataFrame, names: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> Model | None:
    found = sample(labelled, id_col, text_col, lang_col, sample_docs, sample_words)
    return fit(found, names or default_vocabulary()) if found else None


def held_out(id_col: str = "doc_id"):
    """Documents that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Per document the language predicted, by a model learned from the others."""
    model = train(docs.where(~held_out()))
    rows = predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


LEAST_SCORE = 0.4  # a threshold for callers that want one


def in_a_language(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The documents that are not ``und``; with a score of ``least`` at least, if that
    is given. The score is a posterior among the languages learned, so it is low for
    short clean texts where there are many, and high for long texts in none of them."""
    model = train(docs.where(~held_out()))
    told = predict(packed(docs, "doc_id", "text"), model)
    return unpacked(told.where((F.col("lang_pred") != "und") & (F.col("score") >= least)), docs, ("doc_id", "text"))
