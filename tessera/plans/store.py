"""The index as versioned Parquet: a change writes new files, then a small file that
says where every table is, so readers see a whole version and a failed change none. A
change is worked out from one version and published as the next; if another writer
took that number, it is worked out again from what that one left.

Files, symbols, calls and imports lie in buckets of a project's files, about
``FILES_A_BUCKET`` files each. A change of some files writes the buckets of these, and
those in which a reference now means something else: names are resolved again where a
changed file has or had a symbol of that name, imports where a path came or went. The
symbols' full-text index gets one segment a change."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fulltext, governance
from ..sources import ingest
from .storage import cut, drop_folder, publish, published, read_text, rows, subfolders

TABLES = {
    "projects": "id string, name string, path string, created_at long, indexed_at long",
    "files": "project_id string, id long, path string, relative_path string, language string, size long, mtime long, hash string",
    "symbols": "project_id string, file_id long, id long, name string, kind string, start_line int, end_line int, signature string, body string, qualified_name string, complexity_cyclomatic int, complexity_cognitive int",
    "calls": "project_id string, call_name string, from_file_id long, from_symbol_id long, from_line int, to_symbol_id long",
    "imports": "project_id string, file_id long, target string, to_file_id long",
    "rules": "project_id string, rule_name string, metric string, warn_threshold double, fail_threshold double",
    "adrs": "project_id string, number int, title string, status string, context_text string, decision string, consequences string, created_at long, updated_at long",
    "vectors": "id long, vector array<float>",
}
#: Tables in buckets, and the column that holds the file.
BUCKETED = {"files": "id", "symbols": "file_id", "calls": "from_file_id", "imports": "file_id"}
FILES_A_BUCKET = 256
#: What of a symbol can be searched.
SEARCHED = ["name", "qualified_name", "signature", "body"]


def now() -> int:
    """Milliseconds since 1970."""
    return int(time.time() * 1000)


def columns(name: str) -> list[str]:
    return [c.split()[0] for c in TABLES[name].split(", ")]


def bucket(file_id: Column, buckets: int) -> Column:
    return F.pmod(file_id, F.lit(buckets))


@dataclass
class Part:
    """What a change puts in place of a project's buckets: per table the rows of the
    buckets in ``touched``, or of all if that is None. ``buckets`` 0: the project goes."""

    buckets: int
    tables: dict[str, DataFrame] = field(default_factory=dict)
    touched: dict[str, set[int]] | None = None


@dataclass
class Work:
    """A change: whole tables, parts by project, and the symbols that the full-text
    index gets and loses."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    parts: dict[str, Part] = field(default_factory=dict)
    added: DataFrame | None = None
    removed: DataFrame | None = None


class Version:
    """The tables of one version."""

    def __init__(self, spark: SparkSession, root: str, number: int, named: dict) -> None:
        self.spark, self.root, self.number, self.named = spark, root, number, named

    def buckets(self, project: str) -> int:
        """Into how many buckets the project's files are dealt; 0 if it has none."""
        return self.named.get("parts", {}).get(project, {}).get("buckets", 0)

    def paths(self, name: str, project: str | None = None, only: set[int] | None = None) -> list[str]:
        return [
            f"{self.root}/data/{folder}/{name}/p={p}/b={b}"
            for p, part in self.named.get("parts", {}).items()
            if project in (None, p)
            for b, folder in part["tables"].get(name, {}).items()
            if only is None or int(b) in only
        ]

    def table(self, name: str, project: str | None = None, only: set[int] | None = None) -> DataFrame:
        """A table, or of one in buckets only a project's, or some of its buckets."""
        if name in BUCKETED:
            paths = self.paths(name, project, only)
        else:
            folder = self.named["tables"].get(name)
            paths = [f"{self.root}/{folder}"] if folder else []
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def index(self) -> fulltext.Index:
        """The full-text index of all projects' symbols."""
        return fulltext.Index(self.spark, f"{self.root}/data", SEARCHED, self.named.get("index"))


Change = Callable[[Version], "dict[str, DataFrame] | Work"]


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def latest(self) -> Version:
        found = {int(n): path for n, path in published(self.spark, f"{self.root}/versions").items()}
        return self._version(max(found, default=0))

    def _version(self, number: int) -> Version:
        return Version(self.spark, self.root, number, json.loads(read_text(self.spark, f"{self.root}/versions/{number}")) if number else {"tables": {}})

    def table(self, name: str, project: str | None = None) -> DataFrame:
        return self.latest().table(name, project)

    def applied(self, batch: str) -> bool:
        return batch in published(self.spark, f"{self.root}/batches")

    def change(self, work: Change, batch: str | None = None) -> None:
        """A new version with what ``work`` makes of the latest one. A batch is applied
        once: its name is in the version that has it, and then a file of its own, so
        that no list of all batches is carried along."""
        while True:
            now = self.latest()
            if batch and (self.applied(batch) or now.named.get("batch") == batch):
                return
            if now.named.get("batch"):  # its writer may have ended before it left the file
                publish(self.spark, f"{self.root}/batches/{now.named['batch']}", str(now.number))
            folder = uuid.uuid4().hex
            done = work(now)
            named = self._written(now, done if isinstance(done, Work) else Work(done), folder) | {"batch": batch}
            if publish(self.spark, f"{self.root}/versions/{now.number + 1}", json.dumps(named)):
                if batch:
                    publish(self.spark, f"{self.root}/batches/{batch}", str(now.number + 1))
                return

    def _written(self, now: Version, work: Work, folder: str) -> dict:
        """Writes the change's files and returns the next version's places."""
        base = f"{self.root}/data/{folder}"
        for name, df in work.tables.items():
            df.select(*columns(name)).write.parquet(f"{base}/{name}")
        parts = dict(now.named.get("parts", {}))
        for project, part in work.parts.items():
            if not part.buckets:
                parts.pop(project, None)
                continue
            places = {t: dict(at) for t, at in parts.get(project, {}).get("tables", {}).items()} if part.touched else {}
            for name, df in part.tables.items():
                laid = df.select(*columns(name), F.lit(project).alias("p"), bucket(F.col(BUCKETED[name]), part.buckets).alias("b"))
                laid.repartition("b").write.partitionBy("p", "b").parquet(f"{base}/{name}")
                old = places.get(name, {}) if part.touched else {}
                left = {b: at for b, at in old.items() if part.touched and int(b) not in part.touched[name]}
                places[name] = left | {b.removeprefix("b="): folder for b in subfolders(self.spark, f"{base}/{name}/p={project}")}
            parts[project] = {"buckets": part.buckets, "tables": places}
        index = now.index()
        if work.added is not None or work.removed is not None:
            none = self.spark.createDataFrame([], TABLES["symbols"])
            ready = lambda df: (none if df is None else df).select("id", *SEARCHED)
            index.change(ready(work.added), ready(work.removed), f"{folder}/fulltext")
        return {"tables": now.named["tables"] | {name: f"data/{folder}/{name}" for name in work.tables}, "parts": parts, "index": index.state()}

    def write(self, tables: dict[str, DataFrame], batch: str | None = None) -> None:
        """A new version with these tables replaced."""
        self.change(lambda now: tables, batch)

    def clean(self, keep: int = 1, age_ms: int = 86_400_000) -> int:
        """Deletes the data of versions before the last ``keep``, and what failed or
        overtaken changes left, if it is older than ``age_ms``; returns how many folders
        went. A change or a reader that takes longer than that loses its files."""
        last = self.latest().number
        kept = json.dumps([self._version(n).named for n in range(max(1, last - keep + 1), last + 1)])
        gone = 0
        for name, changed in subfolders(self.spark, f"{self.root}/data").items():
            if name not in kept and changed < now() - age_ms:
                drop_folder(self.spark, f"{self.root}/data/{name}")
                gone += 1
        return gone

    def index(self, root: str, name: str | None = None, now_ms: int | None = None) -> str:
        """Indexes a source tree in full and returns its project id."""
        plain, stamp = plain_path(root), now() if now_ms is None else now_ms
        files = ingest.scan(self.spark, root)
        project = self.spark.range(1).select(ingest.project_id(plain).alias("id"), F.lit(name or plain.rsplit("/", 1)[-1]).alias("name"), F.lit(plain).alias("path"), F.lit(stamp).cast("long").alias("created_at"), F.lit(stamp).cast("long").alias("indexed_at"))
        pid = project.first()["id"]
        new = ingest.index(files)
        buckets = max(1, -(-rows(new["files"]) // FILES_A_BUCKET))

        def work(now: Version) -> Work:
            known = now.table("projects").where(F.col("id") == pid).select(F.col("created_at").alias("_since")).first()
            row = project if known is None else project.withColumn("created_at", F.lit(known["_since"]).cast("long"))
            tables = {"projects": now.table("projects").where(F.col("id") != pid).unionByName(row)}
            old = now.table("symbols", pid)
            return Work(tables | self._vectors(now, old, new["symbols"]), {pid: Part(buckets, dict(new))}, new["symbols"], old)

        self.change(work)
        return pid

    def changes(self, root: str, by_hash: bool = False) -> DataFrame:
        """(relative_path, status) of the tree against the index, by size and time, without
        reading contents; or by content, where a file that was only touched is unchanged."""
        from ..operators.incremental import detect_changes

        pid = self.project_of(root)
        old = self.table("files", pid)
        new = ingest.scan(self.spark, root, with_content=False)
        found = detect_changes(old, new, "relative_path", ["size", "mtime"]).where("status <> 'unchanged'")
        if by_hash:
            found = cut(found, "changes")
            maybe = found.where("status = 'modified'").select("relative_path")
            hashes = ingest.scan(self.spark, root).join(maybe, "relative_path", "left_semi").select("relative_path", F.col("hash").alias("_new"))
            same = hashes.join(old.select("relative_path", "hash"), "relative_path").where("hash = _new").select("relative_path")
            found = found.join(same, "relative_path", "left_anti")
        return found

    def project_of(self, root: str) -> str:
        return self.spark.range(1).select(ingest.project_id(plain_path(root)).alias("id")).first()["id"]

    def update(self, root: str, by_hash: bool = False, now_ms: int | None = None, journal: str | None = None) -> None:
        """Indexes only what changed, and drops what is gone; with the name of a journal
        that is in the root, only of what that lists, and removes it when that is done."""
        listed = ingest.journal(self.spark, root, journal) if journal else None
        changed = self.changes(root, by_hash)
        if listed is not None:
            changed = changed.join(listed, "relative_path", "left_semi")
        changed = cut(changed, "changes")
        gone = changed.where("status = 'deleted'").select(F.xxhash64(F.lit(self.project_of(root)), "relative_path").alias("id"))
        fresh = changed.where("status <> 'deleted'").select("relative_path")
        self.replace_files(ingest.scan(self.spark, root).join(fresh, "relative_path", "left_semi"), gone=gone, project=self.project_of(root), now_ms=now_ms)
        if listed is not None:
            ingest.clear_journal(self.spark, root, journal)

    def replace_files(self, files: DataFrame, batch: str | None = None, gone: DataFrame | None = None, project: str | None = None, now_ms: int | None = None) -> None:
        """Puts these files of one project in place of what was stored for them, without ``gone`` (ids)."""
        if batch and self.applied(batch):
            return
        new = ingest.index(files)
        if project is None:
            first = new["files"].select("project_id").first()
            if first is None:
                return
            project = first["project_id"]
        stamp = now() if now_ms is None else now_ms
        self.change(lambda now: self._replaced(now, project, new, gone, stamp), batch)

    def _replaced(self, now: Version, pid: str, new: dict[str, DataFrame], gone: DataFrame | None, stamp: int) -> Work:
        """The buckets of the changed files with new rows for old ones, and those in which
        a reference changes its meaning."""
        n = now.buckets(pid) or max(1, -(-rows(new["files"]) // FILES_A_BUCKET))
        ids = new["files"].select("id")
        ids = cut((ids if gone is None else ids.union(gone.select("id"))).distinct(), "changed-files")
        in_buckets = lambda df, key: {r["b"] for r in df.select(bucket(F.col(key), n).alias("b")).distinct().collect()}  # noqa: E731  at most all buckets
        touched = in_buckets(ids, "id")
        spread = ids.select(F.col("id").alias("_id"))
        without = lambda df, key: df.join(spread, F.col(key) == F.col("_id"), "left_anti")
        within = lambda df, key: df.join(spread, F.col(key) == F.col("_id"), "left_semi")

        old_files = now.table("files", pid)
        files = without(now.table("files", pid, touched), "id").unionByName(new["files"])
        before = cut(within(now.table("symbols", pid, touched), "file_id"), "symbols-before")
        symbols = without(now.table("symbols", pid, touched), "file_id").unionByName(new["symbols"])

        names = before.select("name").union(new["symbols"].select("name")).distinct()
        asked = names.select(F.col("name").alias("call_name")).union(new["calls"].select("call_name")).distinct()
        everywhere = without(now.table("symbols", pid).select("file_id", "name", "id"), "file_id").unionByName(new["symbols"].select("file_id", "name", "id"))
        least = everywhere.groupBy(F.col("name").alias("call_name")).agg(F.min("id").alias("_to"))
        meant = cut(asked.join(least, "call_name", "left").withColumn("_asked", F.lit(True)), "names")
        moved = now.table("calls", pid).select("from_file_id", "call_name", "to_symbol_id").join(meant, "call_name").where(~F.col("to_symbol_id").eqNullSafe(F.col("_to")))
        call_buckets = touched | in_buckets(moved, "from_file_id")
        calls = without(now.table("calls", pid, call_buckets), "from_file_id").unionByName(new["calls"])
        calls = calls.join(meant, "call_name", "left").withColumn("to_symbol_id", F.when(F.col("_asked"), F.col("_to")).otherwise(F.col("to_symbol_id")))

        old_paths = within(old_files, "id").select("relative_path")
        new_paths = new["files"].select("relative_path")
        moved_paths = not old_paths.exceptAll(new_paths).isEmpty() or not new_paths.exceptAll(old_paths).isEmpty()
        all_files = without(old_files, "id").unionByName(new["files"])
        import_buckets = touched
        if moved_paths:
            kept = without(now.table("imports", pid), "file_id")
            again = governance.resolve_imports(kept.select("file_id", "target"), all_files).withColumnRenamed("to_file_id", "_to")
            other = kept.join(again, ["file_id", "target"]).where(~F.col("to_file_id").eqNullSafe(F.col("_to")))
            import_buckets = touched | in_buckets(other, "file_id")
        targets = without(now.table("imports", pid, import_buckets), "file_id").unionByName(new["imports"])
        imports = governance.resolve_imports(targets.select("file_id", "target"), all_files).withColumn("project_id", F.lit(pid))

        tables = {"files": files, "symbols": symbols, "calls": calls, "imports": imports}
        where = {"files": touched, "symbols": touched, "calls": call_buckets, "imports": import_buckets}
        fresh = now.buckets(pid) == 0
        projects = now.table("projects").withColumn("indexed_at", F.when(F.col("id") == pid, F.lit(stamp).cast("long")).otherwise(F.col("indexed_at")))
        more = {"projects": projects} if now.named["tables"].get("projects") else {}
        return Work(more | self._vectors(now, before, new["symbols"]), {pid: Part(n, tables, None if fresh else where)}, new["symbols"], before)

    def _vectors(self, now: Version, before: DataFrame, after: DataFrame) -> dict[str, DataFrame]:
        """The vectors without those of symbols that went or whose text is not as it was."""
        if not now.named["tables"].get("vectors"):
            return {}
        from ..operators.search import embedding_text

        stale = cut(embedding_text(before).exceptAll(embedding_text(after)).select("id").distinct(), "stale")
        return {"vectors": now.table("vectors").join(stale, "id", "left_anti")} if rows(stale) else {}

    def drop_project(self, pid: str) -> None:
        self.change(lambda now: self._dropped(now, pid))

    def _dropped(self, now: Version, pid: str) -> Work:
        other = lambda t: now.table(t).where(F.col("project_id") != pid)
        gone = now.table("symbols", pid)
        vectors = now.table("vectors").join(gone.select("id"), "id", "left_anti")
        return Work({"projects": now.table("projects").where(F.col("id") != pid), "rules": other("rules"), "adrs": other("adrs"), "vectors": vectors}, {pid: Part(0)}, None, gone)

    def embed(self, embed=ingest.hashed_vectors) -> None:
        """Vectors for the symbols that have none."""
        from ..operators.search import backlog, embedding_text

        def work(now: Version) -> dict[str, DataFrame]:
            text, vectors = embedding_text(now.table("symbols")), now.table("vectors")
            todo = text.join(backlog(text, vectors), "id", "left_semi")
            return {"vectors": vectors.unionByName(embed(todo))}

        self.change(work)


def plain_path(root: str) -> str:
    return root.rstrip("/").split(":", 1)[-1].replace("///", "/")
