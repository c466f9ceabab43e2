"""Lookups, filters and reports over symbols and files. Lists are ordered to the
last row by an id, so that a limit has one meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code


def view(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with their file's path, language and project."""
    f = files.select(F.col("id").alias("file_id"), "project_id", "relative_path", "language")
    return symbols.join(f, "file_id")


LOCATION = ("id", "name", "kind", "relative_path", "start_line")


def where_exact(symbols_v: DataFrame, name: str, limit: int = 10) -> DataFrame:
    return symbols_v.where(F.col("name") == name).select(*LOCATION).orderBy("id").limit(limit)


def where_partial(symbols_v: DataFrame, part: str, limit: int = 10) -> DataFrame:
    """Names that contain ``part``, in either case; its % and _ are wildcards."""
    return symbols_v.where(F.col("name").ilike(f"%{part}%")).select(*LOCATION).orderBy("id").limit(limit)


def where(symbols_v: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Exact matches, or partial ones if there are none."""
    exact = where_exact(symbols_v, name, limit)
    return exact if not exact.isEmpty() else where_partial(symbols_v, name, limit)


ORDERS = ("name", "start_line", "complexity_cyclomatic", "complexity_cognitive", "role", "kind")


def query_graph(symbols_v: DataFrame, *, kind: str = "", role: str = "", name: str = "", file: str = "", min_cyclomatic: int | None = None, max_cyclomatic: int | None = None, order_by: str = "name", limit: int = 50) -> DataFrame:
    """Symbols by optional filters; an empty filter is none. An unknown order means by name."""
    conditions: list[Column] = []
    if kind:
        conditions.append(F.col("kind") == kind)
    if role:
        conditions.append(F.col("role") == role)
    if name:
        conditions.append(F.col("name").ilike(f"%{name}%"))
    if file:
        conditions.append(F.col("relative_path").ilike(f"%{file}%"))
    if min_cyclomatic is not None:
        conditions.append(F.col("complexity_cyclomatic") >= min_cyclomatic)
    if max_cyclomatic is not None:
        conditions.append(F.col("complexity_cyclomatic") <= max_cyclomatic)
    for c in conditions:
        symbols_v = symbols_v.where(c)
    order = order_by if order_by in ORDERS else "name"
    return symbols_v.select(*LOCATION, "complexity_cyclomatic", "complexity_cognitive").orderBy(order, "id").limit(limit)


def prefix_search(symbols: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    return symbols.where(F.col("name").ilike(f"{prefix}%")).select("id", "name", "kind").orderBy("name", "id").limit(limit)


def file_symbols(symbols_v: DataFrame, path: str) -> DataFrame:
    return symbols_v.where(F.col("relative_path") == path).select("id", "name", "kind", "start_line", "end_line", "complexity_cyclomatic").orderBy("start_line", "id")


def brief(symbols_v: DataFrame, path: str) -> DataFrame:
    """A file's symbols by kind: how many, and their names in order of place."""
    names = F.transform(F.sort_array(F.collect_list(F.struct("start_line", "id", "name"))), lambda s: s["name"])
    return symbols_v.where(F.col("relative_path") == path).groupBy("kind").agg(F.count("*").alias("n"), F.array_join(names, ",").alias("names"))


def importers(imports: DataFrame, files: DataFrame, file_id: int, limit: int = 10) -> DataFrame:
    """Files that import the file, once each."""
    sources = imports.where(F.col("dst") == file_id).select(F.col("src").alias("id"))
    return files.join(sources, "id", "left_semi").select("id", "relative_path").orderBy("id").limit(limit)


def complexity_report(symbols_v: DataFrame, least: int = 5, file: str = "", limit: int = 30) -> DataFrame:
    rows = symbols_v.where(F.col("complexity_cyclomatic") >= least)
    if file:
        rows = rows.where(F.col("relative_path").ilike(f"%{file}%"))
    mi = code.maintainability(F.col("complexity_cyclomatic"), F.col("start_line"), F.col("end_line"))
    shown = rows.select("id", "name", "relative_path", "complexity_cyclomatic", "complexity_cognitive", F.round(mi, 6).alias("maintainability"), (F.col("complexity_cyclomatic") >= 20).alias("alert"))
    return shown.orderBy(F.desc("complexity_cyclomatic"), F.desc("complexity_cognitive"), "id").limit(limit)


def complexity_footer(shown: DataFrame) -> DataFrame:
    """(average, highest) cyclomatic complexity of the rows that a report shows."""
    return shown.agg(F.round(F.avg("complexity_cyclomatic"), 6).alias("average"), F.max("complexity_cyclomatic").alias("highest"))


def maintainability(symbols: DataFrame) -> DataFrame:
    mi = code.maintainability(F.col("complexity_cyclomatic"), F.col("start_line"), F.col("end_line"))
    return symbols.select("id", F.round(mi, 6).alias("maintainability"))


def high_complexity(symbols_v: DataFrame, least: int = 10, limit: int = 20) -> DataFrame:
    return symbols_v.where(F.col("complexity_cyclomatic") >= least).select(*LOCATION, "complexity_cyclomatic").orderBy(F.desc("complexity_cyclomatic"), "id").limit(limit)


def god_files(symbols: DataFrame, files: DataFrame, above: int = 20, limit: int = 10) -> DataFrame:
    counts = symbols.groupBy("file_id").agg(F.count("*").alias("symbols")).where(F.col("symbols") > above)
    return counts.join(files, counts.file_id == files.id).select("id", "relative_path", "symbols").orderBy(F.desc("symbols"), "id").limit(limit)


def language_breakdown(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"))


def top_dirs(files: DataFrame, limit: int = 15) -> DataFrame:
    inside = files.where(F.col("relative_path").contains("/"))
    return inside.groupBy(F.substring_index("relative_path", "/", 1).alias("dir")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "dir").limit(limit)


def architecture_summary(symbols_v: DataFrame) -> DataFrame:
    cc, cog = "complexity_cyclomatic", "complexity_cognitive"
    return symbols_v.groupBy("project_id").agg(
        F.countDistinct("file_id").alias("files"), F.count("*").alias("symbols"), F.round(F.avg(cc), 6).alias("avg_cyclomatic"), F.max(cc).alias("max_cyclomatic"), F.round(F.avg(cog), 6).alias("avg_cognitive"), F.max(cog).alias("max_cognitive")
    )


def list_projects(projects: DataFrame, stats: DataFrame) -> DataFrame:
    """Projects with their counts, by name."""
    return projects.join(stats, projects.id == stats.project_id, "left").select("id", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "symbols", "edges")])


def update_stats(projects: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Files, symbols and edges per project, zero where there are none. edges: src, a file."""
    f = files.groupBy("project_id").agg(F.count("*").alias("files"))
    s = view(symbols, files).groupBy("project_id").agg(F.count("*").alias("symbols"))
    e = edges.join(files.select(F.col("id").alias("src"), "project_id"), "src").groupBy("project_id").agg(F.count("*").alias("edges"))
    ids = projects.select(F.col("id").alias("project_id"))
    joined = ids.join(f, "project_id", "left").join(s, "project_id", "left").join(e, "project_id", "left")
    return joined.select("project_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "symbols", "edges")])


def delete_project(project_id: str, files: DataFrame, symbols: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left: files, their symbols, and edges (src, dst files) that begin in
    them; an edge's end in a deleted file becomes null."""
    left = files.where(F.col("project_id") != project_id)
    ids = left.select(F.col("id").alias("k"))
    kept = edges.join(ids, edges.src == ids.k, "left_semi")
    ends = kept.join(ids, kept.dst == ids.k, "left").select("src", F.col("k").alias("dst"))
    return left, symbols.join(ids, symbols.file_id == ids.k, "left_semi"), ends


def file_tree(files: DataFrame, query: str = "") -> DataFrame:
    """(path, depth, is_dir, files): every folder with how many files lie below it, and
    every file; with a query only files whose path holds it, in either case, and
    their folders."""
    if query:
        files = files.where(F.lower("relative_path").contains(query.lower()))
    parts = files.select(F.split("relative_path", "/").alias("p"))
    nodes = parts.select(F.size("p").alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice("p", 1, k), "/").alias("path")))).alias("x"))
    rows = nodes.groupBy(F.col("x.path").alias("path"), F.col("x.depth").alias("depth"), (F.col("x.depth") < F.col("n")).alias("is_dir"))
    return rows.agg(F.count("*").alias("files"))
