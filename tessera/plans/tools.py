"""The 28 tools over a stored index, by name: each takes the tool's arguments and
returns a DataFrame. An unknown name or symbol gives a message."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governance as gov
from ..operators import graph, metrics, relational, search
from ..sources import ingest
from .store import TABLES, Store, Version, now

TOOLS: dict[str, Callable[..., DataFrame]] = {}


def tool(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    TOOLS[f.__name__.rstrip("_")] = f
    return f


class Project:
    """One project's frames out of a store."""

    def __init__(self, store: Store, project_id: str) -> None:
        self.store, self.id, self.spark = store, project_id, store.spark
        self.version = store.latest()
        of = lambda t: self.version.table(t, project_id)
        self.files, self.symbols, self.all_calls, imports = of("files"), of("symbols"), of("calls"), of("imports")
        self.rules, self.adrs = (self.version.table(t).where(F.col("project_id") == project_id) for t in ("rules", "adrs"))
        self.calls = ingest.call_graph(self.all_calls)
        self.imports = ingest.import_graph(imports)
        self.import_edges = imports.select(F.col("file_id").alias("src"), F.col("to_file_id").alias("dst"))

    @property
    def view(self) -> DataFrame:
        return relational.view(self.symbols.drop("project_id"), self.files)

    @property
    def roles(self) -> DataFrame:
        return metrics.classify_roles(self.symbols, self.calls)

    @property
    def view_with_roles(self) -> DataFrame:
        return self.view.join(self.roles.select("id", "role"), "id")

    def symbol(self, name: str) -> int:
        """The symbol of that name with the least id."""
        row = self.symbols.where(F.col("name") == name).agg(F.min("id").alias("id")).first()
        if row["id"] is None:
            raise LookupError(f"Symbol not found: {name}")
        return row["id"]


def message(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "message string")


def call(store: Store, name: str, **args) -> DataFrame:
    """Runs a tool; what it cannot find or do comes back as a message."""
    if name not in TOOLS:
        return message(store.spark, f"Unknown tool: {name}")
    try:
        return TOOLS[name](store, **args)
    except (LookupError, ValueError) as e:
        return message(store.spark, f"Error: {e}")


@tool
def index_repository(store: Store, path: str, name: str | None = None, incremental: bool = False, semantic: bool = False, now_ms: int | None = None, by_hash: bool = False) -> DataFrame:
    if incremental:
        store.update(path, by_hash, now_ms)
    else:
        store.index(path, name, now_ms)
    if semantic:
        store.embed()
    return list_projects(store)


@tool
def list_projects(store: Store) -> DataFrame:
    p, files, symbols = store.table("projects"), store.table("files"), store.table("symbols").drop("project_id")
    stats = relational.update_stats(p, files, symbols, store.table("imports").select(F.col("file_id").alias("src")))
    return relational.list_projects(p, stats).join(p.select("id", "created_at", "indexed_at"), "id").orderBy(F.desc("created_at"), "id")


@tool
def delete_project(store: Store, project_id: str) -> DataFrame:
    store.drop_project(project_id)
    return list_projects(store)


@tool
def context(store: Store, project_id: str, symbol: str, radius: int = 1) -> DataFrame:
    p = Project(store, project_id)
    node = p.symbol(symbol)
    told = lambda df, what, n: df.limit(n).select(F.lit(what).alias("relation"), "id", "name", "kind")
    own = p.symbols.where(F.col("id") == node).select("file_id")
    siblings = p.symbols.join(own, "file_id", "left_semi").where(F.col("id") != node).orderBy("start_line", "id")
    out = told(p.symbols.where(F.col("id") == node), "symbol", 1)
    if radius > 0:
        out = out.union(told(graph.callers(p.calls, p.symbols, node), "caller", 10)).union(told(graph.callees(p.calls, p.symbols, node), "callee", 10))
    return out.union(told(siblings, "sibling", 15))


@tool
def where(store: Store, project_id: str, symbol: str) -> DataFrame:
    return relational.where(Project(store, project_id).view, symbol)


@tool
def path(store: Store, project_id: str, from_symbol: str, to_symbol: str) -> DataFrame:
    p = Project(store, project_id)
    steps = graph.shortest_path(p.calls, p.symbol(from_symbol), p.symbol(to_symbol))
    return steps.join(p.symbols, steps.node == p.symbols.id).select("step", "id", "name", "kind").orderBy("step")


@tool
def trace_path(store: Store, project_id: str, symbol: str, direction: str = "down", depth: int = 5) -> DataFrame:
    p = Project(store, project_id)
    chain = graph.trace_chain(p.calls, p.symbol(symbol), depth, direction)
    return chain.join(p.symbols, chain.node == p.symbols.id).select("ordinal", "depth", "id", "name", "kind").orderBy("ordinal")


@tool
def brief(store: Store, project_id: str, file: str) -> DataFrame:
    p = Project(store, project_id)
    kinds = relational.brief(p.view, file).select(F.col("kind").alias("what"), "n", "names")
    own = p.files.where(F.col("relative_path") == file).select("id").first()
    if own is None:
        raise LookupError(f"File not found: {file}")
    imp = relational.importers(p.imports, p.files, own["id"])
    return kinds.union(imp.agg(F.lit("imported by").alias("what"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("relative_path")), ",").alias("names")))


@tool
def map_(store: Store, project_id: str, limit: int = 20) -> DataFrame:
    p = Project(store, project_id)
    top = graph.top_connected_files(p.import_edges, p.files, limit).select(F.lit("file").alias("what"), F.col("relative_path").alias("name"), F.col("degree").alias("n"))
    return top.union(relational.language_breakdown(p.files).select(F.lit("language"), "language", "files"))


def _sources(p: Project, relative_path: str | None = None) -> DataFrame:
    """The project's files with their text, or one of them, read from where they are."""
    if relative_path is None:
        rows = ingest.scan(p.spark, store_root(p)).join(p.files.select("id"), "id", "left_semi")
        return rows.select(F.col("id").alias("doc_id"), "relative_path", F.col("content").alias("text"))
    own = p.files.where(F.col("relative_path") == relative_path).select("id", "path", "relative_path")
    row = own.first()
    if row is None:
        return own.select(F.col("id").alias("doc_id"), "relative_path", F.col("path").alias("text")).limit(0)
    read = p.spark.read.format("binaryFile").load(row["path"])
    return read.select(F.lit(row["id"]).alias("doc_id"), F.lit(row["relative_path"]).alias("relative_path"), ingest.text_of(F.col("content")).alias("text"))


def store_root(p: Project) -> str:
    row = p.store.table("projects").where(F.col("id") == p.id).select("path").first()
    if row is None:
        raise LookupError(f"Project not found: {p.id}")
    return row["path"]


@tool
def search_code(store: Store, project_id: str, pattern: str, limit: int = 30) -> DataFrame:
    p = Project(store, project_id)
    hits = search.grep_snippets(_sources(p), pattern, limit)
    return hits.join(p.files.select("id", "relative_path"), "id").select("relative_path", "line_no", "snippet").orderBy("relative_path", "line_no")


@tool
def search_graph(store: Store, project_id: str, query: str, kinds: list[str] | None = None, semantic: bool = False, limit: int = 20) -> DataFrame:
    """Out of the full-text index, whose totals are of all projects and do not change with
    ``kinds``; these are filtered before the limit, in both legs. Where no word of the
    query is found, symbols whose name contains it are."""
    p = Project(store, project_id)
    symbols = p.symbols.where(F.col("kind").isin(kinds)) if kinds else p.symbols
    index = p.version.index()
    found_by = lambda q, n: index.search(q, n, symbols)
    if semantic:
        vectors = p.version.table("vectors").join(symbols.select("id"), "id", "left_semi").select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding"))
        q = ingest.hashed_vectors(store.spark.createDataFrame([(0, query)], "id long, text string")).first()["vector"]
        words = found_by(query, 3 * limit)
        found = words.limit(limit) if vectors.isEmpty() else search.fuse([words, search.vector_topk(vectors, q, 3 * limit)], limit)
    else:
        parts = [q.strip() for q in query.split(";") if q.strip()]
        found = found_by(query, limit) if len(parts) < 2 else search.fuse([found_by(q, 2 * limit) for q in parts], limit)
    named = found.join(p.view, "id").select("id", "score", "name", "kind", "relative_path", "start_line").orderBy(F.desc("score"), "id")
    if found.isEmpty():
        like = search.name_fallback(p.view, query, limit, kinds).join(symbols.select("id", "start_line"), "id")
        return like.select("id", F.lit(0.0).alias("score"), "name", "kind", "relative_path", "start_line").orderBy("id")
    return named


@tool
def query_graph(store: Store, project_id: str, **filters) -> DataFrame:
    return relational.query_graph(Project(store, project_id).view_with_roles, **filters)


@tool
def fn_impact(store: Store, project_id: str, symbol: str, depth: int = 5) -> DataFrame:
    p = Project(store, project_id)
    found = graph.impact(p.calls, p.symbols, p.symbol(symbol), depth)
    return found.join(p.files.select(F.col("id").alias("file_id"), "relative_path"), "file_id").select("relative_path", "depth", "id", "name").orderBy("relative_path", "depth", "id")


@tool
def diff_impact(store: Store, project_id: str, diffs: DataFrame, depth: int = 3) -> DataFrame:
    """diffs: relative_path and diff, the file's unified diff."""
    p = Project(store, project_id)
    hunks = gov.parse_hunks(diffs).join(p.files.select(F.col("id").alias("file_id"), "relative_path"), "relative_path")
    changed = gov.diff_symbols(p.symbols, hunks).select("id", F.lit(0).alias("depth"))
    found = changed.union(gov.diff_impact(p.symbols, hunks, p.calls, depth))
    return found.join(p.symbols, "id").select("id", "depth", "name", "kind").orderBy("depth", "id")


@tool
def detect_changes(store: Store, project_id: str) -> DataFrame:
    return store.changes(store_root(Project(store, project_id))).orderBy("status", "relative_path")


@tool
def branch_compare(store: Store, project_id: str, status_lines: DataFrame) -> DataFrame:
    return gov.branch_compare(status_lines, Project(store, project_id).view).orderBy("change", "relative_path", "id")


@tool
def audit(store: Store, project_id: str, checks: tuple[str, ...] = ("dead_code", "high_complexity", "god_files", "circular_deps")) -> DataFrame:
    p = Project(store, project_id)
    out = message(p.spark, "").select(F.lit("").alias("check"), F.col("message").alias("what"), F.lit(0).cast("long").alias("n")).limit(0)
    at = F.concat_ws(" ", "kind", "name", F.concat_ws(":", "relative_path", "start_line"))
    if "dead_code" in checks:
        out = out.union(metrics.dead_code(p.roles, p.view).select(F.lit("dead_code"), at, F.lit(1).cast("long")))
    if "high_complexity" in checks:
        out = out.union(relational.high_complexity(p.view).select(F.lit("high_complexity"), at, F.col("complexity_cyclomatic").cast("long")))
    if "god_files" in checks:
        out = out.union(relational.god_files(p.symbols, p.files).select(F.lit("god_files"), "relative_path", "symbols"))
    if "circular_deps" in checks:
        out = out.union(graph.mutual_imports(p.imports, p.files).select(F.lit("circular_deps"), F.concat_ws(" <-> ", "file1", "file2"), F.lit(1).cast("long")))
    return out


@tool
def roles(store: Store, project_id: str, role: str = "", limit: int = 50) -> DataFrame:
    """Counts of all roles, or the symbols of one."""
    p = Project(store, project_id)
    return p.roles.where(F.col("role") == role).orderBy("id").limit(limit) if role else metrics.role_summary(p.roles)


@tool
def complexity(store: Store, project_id: str, min_complexity: int = 5, file: str = "", limit: int = 30) -> DataFrame:
    """The report, each row with the average and the highest of those shown."""
    shown = relational.complexity_report(Project(store, project_id).view, min_complexity, file, limit)
    return shown.join(F.broadcast(relational.complexity_footer(shown)))  # one row


@tool
def communities(store: Store, project_id: str, min_size: int = 2, limit: int = 20, samples: int = 8) -> DataFrame:
    """The largest components with their first members' names."""
    p = Project(store, project_id)
    found = graph.communities(p.calls, p.symbols, min_size)
    top = found.select("component", "size").distinct().orderBy(F.desc("size"), "component").limit(limit)
    named = found.join(top.select("component"), "component", "left_semi").join(p.symbols.select("id", "name"), "id")
    ranked = named.withColumn("_r", F.row_number().over(graph.Window.partitionBy("component").orderBy("id"))).where(F.col("_r") <= samples)
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "name"))), lambda s: s["name"]), ",")
    return ranked.groupBy("component", "size").agg(names.alias("names")).orderBy(F.desc("size"), "component")


@tool
def get_architecture(store: Store, project_id: str) -> DataFrame:
    """(section, name, value): languages, folders, roles, complexity, entry points."""
    p = Project(store, project_id)
    row = lambda df, section, name, value: df.select(F.lit(section).alias("section"), F.col(name).alias("name"), F.col(value).cast("double").alias("value"))
    summary = relational.architecture_summary(p.view).unpivot(["project_id"], ["symbols", "avg_cyclomatic", "max_cyclomatic", "avg_cognitive", "max_cognitive"], "name", "value")
    return (
        row(relational.language_breakdown(p.files), "language", "language", "files")
        .union(row(relational.top_dirs(p.files), "folder", "dir", "files"))
        .union(row(metrics.role_summary(p.roles), "role", "role", "symbols"))
        .union(row(summary, "complexity", "name", "value"))
        .union(row(metrics.entry_points(p.view, p.roles, 10), "entry", "name", "tier"))
    )


@tool
def manifesto(store: Store, project_id: str, action: str = "list", rule_name: str = "", metric: str = "", warn_threshold: float | None = None, fail_threshold: float | None = None) -> DataFrame:
    if action == "add":
        if not rule_name or not metric:
            raise ValueError("rule_name and metric are required")
        new = store.spark.createDataFrame([(project_id, rule_name, metric, warn_threshold, fail_threshold)], TABLES["rules"])

        def add(last: Version) -> dict[str, DataFrame]:
            rules = last.table("rules")
            mine = rules.where(F.col("project_id") == project_id)
            return {"rules": rules.where(F.col("project_id") != project_id).unionByName(gov.add_rule(mine, new))}

        store.change(add)
    elif action == "remove":
        if not rule_name:
            raise ValueError("rule_name is required")
        store.change(lambda last: {"rules": last.table("rules").where(~((F.col("project_id") == project_id) & (F.col("rule_name") == rule_name)))})
    elif action != "list":
        raise ValueError(f"unknown action {action}; use list, add or remove")
    return Project(store, project_id).rules.orderBy("rule_name")


@tool
def check(store: Store, project_id: str) -> DataFrame:
    p = Project(store, project_id)
    done = gov.manifesto_check(p.rules, gov.measures(p.symbols, p.roles))
    return done.union(gov.overall(done).select(F.lit("overall"), F.lit(""), F.lit(None).cast("double"), "status"))


@tool
def adr_list(store: Store, project_id: str, status: str = "") -> DataFrame:
    return gov.adr_list(Project(store, project_id).adrs, status)


@tool
def adr_create(store: Store, project_id: str, title: str, context: str | None = None, decision: str | None = None, consequences: str | None = None, status: str = "proposed", now_ms: int | None = None) -> DataFrame:
    def create(last: Version) -> dict[str, DataFrame]:
        all_ = last.table("adrs")
        mine = gov.adr_create(all_.where(F.col("project_id") == project_id), title, context, decision, consequences, status)
        new = mine.withColumn("project_id", F.lit(project_id)).withColumns({c: F.coalesce(c, F.lit(now() if now_ms is None else now_ms).cast("long")) for c in ("created_at", "updated_at")})
        return {"adrs": all_.where(F.col("project_id") != project_id).unionByName(new)}

    store.change(create)
    return adr_list(store, project_id)


@tool
def adr_update(store: Store, project_id: str, number: int, now_ms: int | None = None, **fields: str) -> DataFrame:
    kinds = {"title", "status", "context_text", "decision", "consequences"}
    if unknown := set(fields) - kinds:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    change = store.spark.createDataFrame([(number, *fields.values(), now() if now_ms is None else now_ms)], "number int, " + "".join(f"{k} string, " for k in fields) + "updated_at long")

    def update(last: Version) -> dict[str, DataFrame]:
        all_ = last.table("adrs")
        mine = gov.adr_update(all_.where(F.col("project_id") == project_id), change)
        return {"adrs": all_.where(F.col("project_id") != project_id).unionByName(mine)}

    store.change(update)
    return adr_list(store, project_id)


@tool
def execution_flow(store: Store, project_id: str, entry_point: str = "", depth: int = 5) -> DataFrame:
    """From one symbol, or from the first five entry points."""
    p = Project(store, project_id)
    starts = [p.symbol(entry_point)] if entry_point else [r["id"] for r in metrics.entry_points(p.view, p.roles, 5).collect()]
    if not starts:
        raise LookupError("no entry points; name one")
    flows = None
    for s in starts:
        one = graph.execution_flow(p.calls, s, depth).withColumn("entry", F.lit(s))
        flows = one if flows is None else flows.union(one)
    named = flows.join(p.symbols.select(F.col("id").alias("node"), "name", "kind"), "node", "left")
    label = F.when(F.col("node") == -1, F.concat(F.lit("… "), "more", F.lit(" more"))).otherwise(F.col("name"))
    return named.select("entry", "path", "depth", label.alias("name"), "kind", "cyclic").orderBy("entry", "path")


@tool
def list_entry_points(store: Store, project_id: str, limit: int = 20) -> DataFrame:
    p = Project(store, project_id)
    return metrics.entry_points(p.view, p.roles, limit)


def file_content(store: Store, project_id: str, relative_path: str) -> DataFrame:
    """The text of one indexed file; only paths of the project are served."""
    return _sources(Project(store, project_id), relative_path).select("relative_path", "text")


def file_symbols(store: Store, project_id: str, relative_path: str) -> DataFrame:
    p = Project(store, project_id)
    own = p.files.where(F.col("relative_path") == relative_path).select(F.col("id").alias("file_id"))
    return p.symbols.join(own, "file_id", "left_semi").select("id", "name", "kind", "start_line", "end_line", "signature", "complexity_cyclomatic").orderBy("start_line", "id")


def entry_points(store: Store, project_id: str, limit: int = 30) -> DataFrame:
    """By names and file names in either case, as the drawing's list has them."""
    p = Project(store, project_id)
    return metrics.entry_points_api(p.view, p.roles, limit)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON text, nulls included: what a server would send."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))


def graph_data(store: Store, project_id: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the file graph for drawing: fan in and out, module, band."""
    p = Project(store, project_id)
    nodes = p.files.select("id", F.element_at(F.split("relative_path", "/"), -1).alias("label"), F.col("relative_path").alias("path"), F.coalesce("language", F.lit("unknown")).alias("language"))
    return nodes.join(metrics.node_bands(p.imports, p.files), "id").join(metrics.module_communities(p.files), "id"), graph.visual_edges(p.imports)


def render(df: DataFrame, limit: int = 50) -> str:
    """A plain text table of the first rows."""
    rows = [[("" if v is None else str(v)) for v in r] for r in df.limit(limit).collect()]
    widths = [max(len(c), *(len(r[i]) for r in rows)) if rows else len(c) for i, c in enumerate(df.columns)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths)).rstrip()
    return "\n".join([line(df.columns), line(["-" * w for w in widths]), *map(line, rows)])
