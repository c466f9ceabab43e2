"""From a source tree to files, symbols and edges. Files are read by Spark, parsed
by one Python table function over Arrow batches, and references are resolved by joins
once everything is known, so that no order of files matters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code
from ..operators import governance
from ..plans.storage import cut
from .extract import extract
from .languages import BINARY, BY_EXTENSION, IGNORED, INDEXABLE, gitignore_rules, ignore_pattern



def project_id(path: Column | str) -> Column:
    """The first 16 hexadecimal digits of the path's SHA-256."""
    return F.left(F.sha2(F.lit(path) if isinstance(path, str) else path, 256), F.lit(16))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in BY_EXTENSION.items() for x in pair])
    return F.coalesce(F.element_at(known, extension(path)), F.lit("generic"))


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, with_content: bool = True) -> DataFrame:
    """Files below ``root`` that can be indexed: project_id, id, path, relative_path,
    language, size, mtime (ms), hash, content. Hidden and ignored paths, those that
    the root's .gitignore names, and other extensions are left out before any content
    is read."""
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    plain = base.split(":", 1)[-1].rstrip("/").replace("///", "/")
    relative = F.regexp_replace(F.col("path"), r"^.*?" + _quoted(plain) + "/", "")
    rules = ignore_pattern(tuple(IGNORED + (ignore or [])))
    rows = found.withColumn("relative_path", relative).where(extension(F.col("relative_path")).isin(INDEXABLE) & ~extension(F.col("relative_path")).isin(BINARY) & ~F.col("relative_path").rlike(rules) & ~F.col("relative_path").rlike(r"(^|/)\.") & ~git_ignored(spark, base))
    pid = project_id(plain)
    columns = [pid.alias("project_id"), F.xxhash64(pid, "relative_path").alias("id"), "path", "relative_path", language(F.col("relative_path")).alias("language"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime")]
    if with_content:
        columns += [F.sha2("content", 256).alias("hash"), text_of(F.col("content")).alias("content")]
    return rows.select(*columns)


def text_of(content: Column) -> Column:
    """The text of a file's bytes; what is not UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def git_ignored(spark: SparkSession, root: str) -> Column:
    """Whether relative_path is named by the root's .gitignore as it is now: the last
    line that fits a path or a folder above it counts, and what lies in an ignored
    folder cannot be taken back. As in the reference, letter case does not matter."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.gitignore")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return F.lit(False)
    stream = fs.open(path)
    try:
        rules = gitignore_rules(bytes(x & 0xFF for x in stream.readAllBytes()).decode("utf-8-sig", "replace"))
    finally:
        stream.close()
    parts = F.split("relative_path", "/")

    def ignored(n: Column) -> Column:
        out = F.lit(False)
        for back, folder, expression in rules:
            fits = F.array_join(F.slice(parts, F.lit(1), n), "/").rlike(expression)
            if folder:
                fits &= n < F.size(parts)
            out = out & ~fits if back else out | fits
        return out

    return F.exists(F.sequence(F.lit(1), F.size(parts)), ignored)


def journal(spark: SparkSession, root: str, name: str = "changes.journal") -> DataFrame | None:
    """(relative_path): the files that a journal in the root lists, a line each; None
    without one. Its name must not begin with a dot, as Spark reads no such files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.text(path.toString()).select(F.trim("value").alias("relative_path")).where("relative_path <> ''")


def clear_journal(spark: SparkSession, root: str, name: str = "changes.journal") -> None:
    """Removes the journal, if there is one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text)


def parse(files: DataFrame) -> DataFrame:
    """(project_id, file_id, relative_path, language, symbols, imports, calls) of each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for pid, fid, path, lang, text in b.itertuples(index=False):
                p = extract(text or "", lang)
                symbols = [{"name": s.name, "kind": s.kind, "start_line": s.start_line, "end_line": s.end_line, "signature": s.signature, "body": s.body} for s in p.symbols]
                calls = [{"owner": o, "callee": c, "line": n} for o, c, n in p.calls]
                out.append((pid, fid, path, lang, symbols, p.imports, calls))
            yield pd.DataFrame(out, columns=["project_id", "file_id", "relative_path", "language", "symbols", "imports", "calls"])

    symbol = "struct<name: string, kind: string, start_line: int, end_line: int, signature: string, body: string>"
    schema = f"project_id string, file_id long, relative_path string, language string, symbols array<{symbol}>, imports array<string>, calls array<struct<owner: int, callee: string, line: int>>"
    return files.select("project_id", F.col("id").alias("file_id"), "relative_path", "language", "content").mapInPandas(run, schema)


def _symbol_id(at: Column) -> Column:
    return F.xxhash64("file_id", at)


def _per_language(metric) -> Column:
    out = metric(F.col("body"), "generic")
    for lang in code.CYCLOMATIC:
        if lang != "generic":
            out = F.when(F.col("language") == lang, metric(F.col("body"), lang)).otherwise(out)
    return out


def index(files: DataFrame) -> dict[str, DataFrame]:
    """files, symbols, calls and imports of scanned files. A call is resolved to the
    project's symbol of that name with the least id, an import to the first file it
    may mean; both keep a null where there is none."""
    parsed = cut(parse(files), "parsed")
    rows = parsed.select("project_id", "file_id", "relative_path", "language", F.posexplode("symbols").alias("at", "s"))
    plain = rows.select("project_id", "file_id", "relative_path", "language", _symbol_id(F.col("at")).alias("id"), "s.*")
    symbols = plain.withColumn("qualified_name", F.concat_ws("/", "relative_path", "name")).withColumn("complexity_cyclomatic", _per_language(code.cyclomatic)).withColumn("complexity_cognitive", _per_language(code.cognitive))
    symbols = cut(symbols, "symbols")
    kept_files = cut(files.drop("content"), "files")

    calls = parsed.select("project_id", "file_id", F.explode("calls").alias("c")).select(
        "project_id", F.col("file_id").alias("from_file_id"), F.when(F.col("c.owner") >= 0, _symbol_id(F.col("c.owner"))).alias("from_symbol_id"), F.col("c.callee").alias("call_name"), F.col("c.line").alias("from_line")
    )
    names = governance.resolve_symbols(calls.select("project_id", "call_name"), symbols)
    calls = calls.join(names, ["project_id", "call_name"], "left")

    targets = parsed.select("file_id", F.explode("imports").alias("target"))
    imports = governance.resolve_imports(targets, kept_files)
    imports = imports.join(kept_files.select(F.col("id").alias("file_id"), "project_id"), "file_id")
    return {"files": kept_files, "symbols": symbols.drop("relative_path", "language"), "calls": calls, "imports": imports}


def call_graph(calls: DataFrame) -> DataFrame:
    """(src, dst) of the calls with both ends."""
    return calls.where("from_symbol_id is not null and to_symbol_id is not null").select(F.col("from_symbol_id").alias("src"), F.col("to_symbol_id").alias("dst"))


def import_graph(imports: DataFrame) -> DataFrame:
    return imports.where("to_file_id is not null").select(F.col("file_id").alias("src"), F.col("to_file_id").alias("dst"))


def hashed_vectors(texts: DataFrame, size: int = 384) -> DataFrame:
    """(id, vector): unit vectors of hashed words, where no embedding model is given.
    A text without words has the zero vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        import zlib

        import numpy as np

        for b in batches:
            out = []
            for t in b["text"]:
                v = np.zeros(size, np.float32)
                for w in re.findall(r"\w+", (t or "").lower()):
                    h = zlib.crc32(w.encode())
                    v[h % size] += 1 if h >> 31 else -1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).tolist())
            yield pd.DataFrame({"id": b["id"], "vector": out})

    return texts.select("id", "text").mapInPandas(run, "id long, vector array<float>")
