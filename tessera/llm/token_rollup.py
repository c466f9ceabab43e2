"""Token counts as delta-maintained rollups.

Changes come in batches: a document is inserted, deleted, or its count revised,
for a tokenizer version. A batch becomes signed rows, the old state's with a
minus and the new one's with a plus; summed by source, language and tokenizer
version they are added to the totals, which are never recomputed from documents.

The documents' state is kept in buckets by a hash of their ids, of about
``BUCKET_ROWS`` rows, so a commit has as many tasks as the state needs: a state that
outgrows its buckets twice over is dealt anew, and each row is dealt a constant number
of times on average. Any other batch reads and rewrites the buckets that its documents
fall into, and no other, nor any earlier batch. A version names the folder of each
bucket and of the totals, and its batch; it is a file that appears whole or not at all,
and only if no other writer took its number. A batch commits once: its name is in its
version, and then a file of its own, which the next writer leaves if the first one
ended too early, so a second run changes nothing and no list of batches is carried
along. A run that fails leaves folders that no version names; ``clean`` removes these
by age. Of two batches at once the later one finds its number taken and is applied
anew to what the other left.

Defined results: inserting a document that is there, and revising one that is
not, both set its state; deleting one that is not there does nothing; of several
changes to a document in a batch the one with the greatest ``seq`` counts (ties:
delete, insert, revise, then the greatest counts); null source or language is a
group of its own; rows without doc_id or tokenizer are ignored, as nothing could
revise them; a null count is 0; a null text has no tokens and a very long one is
counted whole; groups whose documents are all gone are left out of the totals; an
empty batch is a version with the same totals; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import drop_folder, folder, publish, published, read_text, subfolders
from .common import WORD, materialize, rows_of, text_or_empty

GROUP = ["source", "lang", "tokenizer"]
STATE = "doc_id long, tokenizer string, source string, lang string, tokens long"
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"
BUCKET_ROWS = 250_000  # rows of three numbers and two names
VOCABULARY = "byte_bpe_50k"

#: Tokenizer versions that need no vocabulary: the token's expression.
PATTERNS = {"words-1": WORD, "lexer-1": r"\p{L}+|\p{N}+|[^\p{L}\p{N}\x20\x09-\x0D]"}


def pattern_counts(docs: DataFrame, patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens): a row per document and version."""
    t = text_or_empty("text")
    counts = F.array(*[F.struct(F.lit(k).alias("tokenizer"), F.regexp_count(t, F.lit(p)).cast("long").alias("tokens")) for k, p in patterns.items()])
    return docs.select("doc_id", "source", "lang", F.inline(counts))


def vocabulary_counts(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """The same by a public tokenizer's vocabulary, which is then the version."""
    from .packing import tokenizer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(name)
        for b in batches:
            n = [len(encode(t.as_py() or "")) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([name] * len(n)), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "tokenizer", "tokens"])

    return docs.select("doc_id", "source", "lang", "text").mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, tokens long")


class Rollup:
    """Totals kept under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, bucket_rows: int = BUCKET_ROWS) -> None:
        self.spark, self.root, self.bucket_rows = spark, root.rstrip("/"), bucket_rows

    def _version(self, path: str) -> dict:
        return json.loads(read_text(self.spark, path))

    def _versions(self) -> dict[int, str]:
        return {int(n): path for n, path in published(self.spark, f"{self.root}/versions").items()}

    def _current(self) -> tuple[int, dict]:
        """The latest version and its number."""
        found = self._versions()
        if not found:
            return 0, {"buckets": 0, "state": {}, "totals": None, "batch": None}
        return max(found), self._version(found[max(found)])

    def _mark(self, batch: str) -> str:
        """The file that tells of a committed batch, whatever its name holds."""
        return f"{self.root}/batches/{hashlib.sha256(batch.encode()).hexdigest()}"

    def committed(self, batch: str) -> bool:
        return self._current()[1]["batch"] == batch or bool(published(self.spark, self._mark(batch)))

    def _publish(self, number: int, version: dict) -> bool:
        return publish(self.spark, f"{self.root}/versions/{number}", json.dumps(version))

    def _state(self, version: dict, of: list[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/{x}" for k, x in sorted(version["state"].items()) if of is None or int(k) in of]
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def _totals(self, version: dict) -> DataFrame:
        return self.spark.read.schema(TOTALS).parquet(f"{self.root}/{version['totals']}") if version["totals"] else self.spark.createDataFrame([], TOTALS)

    def state(self) -> DataFrame:
        """The documents counted now: (doc_id, tokenizer, source, lang, tokens)."""
        return self._state(self._current()[1])

    def totals(self) -> DataFrame:
        return self._totals(self._current()[1]).where("docs <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """changes: op (insert, delete, revise), doc_id, source, lang, tokenizer, tokens
        and, if a document may occur twice, seq. False if the batch was committed before."""
        if self.committed(batch):
            return False
        if "seq" not in changes.columns:
            changes = changes.withColumn("seq", F.lit(0))
        given = changes.where("doc_id is not null and tokenizer is not null")
        whole = F.struct("seq", "op", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), "source", "lang")
        last = materialize(given.groupBy("doc_id", "tokenizer").agg(F.max(whole).alias("n")), "changes")
        while not self.committed(batch):
            number, version = self._current()
            if version["batch"] is not None:  # its writer may have ended before it left the file
                publish(self.spark, self._mark(version["batch"]), str(number))
            if self._publish(number + 1, self._applied(version, last) | {"batch": batch}):
                publish(self.spark, self._mark(batch), str(number + 1))
                return True
        return False

    def clean(self, keep: int = 1, age_ms: int = 86_400_000) -> int:
        """Deletes the buckets and totals that none of the last ``keep`` versions names, and
        what failed or overtaken commits left, if it is older than ``age_ms``; returns how
        many folders went. A commit or a reader that takes longer loses its files."""
        found = self._versions()
        named = set()
        for n in sorted(found)[-max(keep, 1) :]:
            version = self._version(found[n])
            named |= {*version["state"].values(), version["totals"]}
        gone = 0
        before = time.time() * 1000 - age_ms
        for at, changed in subfolders(self.spark, f"{self.root}/data").items():
            if changed > before:
                continue
            parts = [f"data/{at}/{part}" for x in ("", "state/") for n in subfolders(self.spark, f"{self.root}/data/{at}/{x}") if (part := x + n) != "state"]
            left = [x for x in parts if x in named]
            for x in [x for x in parts if x not in named] if left else [f"data/{at}"]:
                drop_folder(self.spark, f"{self.root}/{x}")
                gone += 1
        return gone

    def _applied(self, version: dict, last: DataFrame) -> dict:
        """The version with the last changes of a batch."""
        held = self._totals(version).agg(F.sum("docs").alias("n")).first()["n"] or 0
        wanted = max(1, -(-(held + rows_of(last)) // self.bucket_rows))
        anew = wanted > 2 * version["buckets"]
        buckets = wanted if anew else version["buckets"]
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
        touched = sorted(map(int, version["state"])) if anew else sorted(r[0] for r in last.select(bucket).distinct().collect())
        key = ["doc_id", "tokenizer"]
        old = self._state(version, touched)
        new = last.where("n.op <> 'delete'").select(*key, "n.source", "n.lang", "n.tokens")
        at = f"data/{uuid.uuid4().hex}"
        left = old.join(last.select(*key), key, "left_anti").select(*new.columns).union(new)
        left.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{at}/state")
        there = published(self.spark, f"{self.root}/{at}/state")
        state = {k: x for k, x in version["state"].items() if int(k) not in touched}
        state |= {n.split("=")[1]: f"{at}/state/{n}" for n in there if n.startswith("bucket=")}
        signed = lambda df, sign: df.select(*GROUP, F.lit(sign).cast("long").alias("docs"), (sign * F.col("tokens")).alias("tokens"))
        gone = old.join(last.select(*key), key, "left_semi")
        rows = signed(gone, -1).union(signed(new, 1)).union(self._totals(version).select(*GROUP, "docs", "tokens"))
        rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.root}/{at}/totals")
        return {"buckets": buckets, "state": state, "totals": f"{at}/totals"}


def _distinct_lines() -> Column:
    return F.array_join(F.array_distinct(F.split(text_or_empty("text"), "\n")), "\n")


def _report(docs: DataFrame, count: Callable[[DataFrame], DataFrame], versions: list[str]) -> tuple[DataFrame, DataFrame]:
    """Totals after the first and after the last of four batches over all documents: all
    are inserted; the counts of those with repeated lines are revised to count each
    line once; documents whose text a smaller doc_id has are deleted; and the revision
    comes once more."""
    spark = docs.sparkSession
    rollup = Rollup(spark, folder(spark, "rollup"))
    rollup.commit("load", count(docs).withColumn("op", F.lit("insert")))
    loaded = rollup.totals()
    repeats = docs.where(F.size(F.array_distinct(F.split("text", "\n"))) < F.size(F.split("text", "\n")))
    revised = count(repeats.withColumn("text", _distinct_lines())).withColumn("op", F.lit("revise"))
    rollup.commit("distinct lines", revised)
    hashes = docs.where("text is not null").select("doc_id", "source", "lang", F.sha2("text", 256).alias("h"))
    first = hashes.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    copies = hashes.join(first, "h").where("doc_id <> first")
    version = F.explode(F.array(*map(F.lit, versions))).alias("tokenizer")
    rollup.commit("copies", copies.select("doc_id", "source", "lang", version, F.lit(0).alias("tokens"), F.lit("delete").alias("op")))
    rollup.commit("distinct lines", revised)
    return loaded, rollup.totals()


def rollup_report(docs: DataFrame) -> DataFrame:
    """Per source, language and tokenizer version the documents and tokens after the
    last batch, and as loaded; versions are a public vocabulary and two patterns."""
    docs = docs.select("doc_id", "source", "lang", "text")
    every = lambda d: vocabulary_counts(d).union(pattern_counts(d))
    loaded, last = _report(docs, every, [VOCABULARY, *PATTERNS])
    before = loaded.select(*[F.col(c).alias(f"_{c}") for c in GROUP], F.col("docs").alias("loaded_docs"), F.col("tokens").alias("loaded_tokens"))
    same = [last[c].eqNullSafe(before[f"_{c}"]) for c in GROUP]
    both = before.join(last, same[0] & same[1] & same[2], "left")
    now = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("docs", "tokens")]
    return both.select(*[F.col(f"_{c}").alias(c) for c in GROUP], *now, "loaded_docs", "loaded_tokens")


def pattern_report(docs: DataFrame) -> DataFrame:
    """Totals after the last batch of the versions that are patterns, which SQL can count."""
    return _report(docs.select("doc_id", "source", "lang", "text"), pattern_counts, list(PATTERNS))[1]


#: ``pattern_report`` over the documents table in DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, source, lang, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents),
k AS (SELECT source, lang, array_to_string(list_distinct(string_split(coalesce(text, ''), chr(10))), chr(10)) AS t FROM d WHERE text IS NULL OR rn = 1),
c AS (
  SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n FROM k
  UNION ALL
  SELECT source, lang, 'lexer-1', len(regexp_extract_all(t, '\p{L}+|\p{N}+|[^\p{L}\p{N}\x20\x09-\x0D]')) FROM k)
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM c GROUP BY ALL
"""
