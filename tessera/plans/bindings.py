"""Binds the engine's relations to the driver's star-schema tables, for Spark
here and as common table expressions for DuckDB in ``CTE``."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extension and language by s_suppkey % 5; symbol names by p_partkey % 97.
EXTENSIONS = ("ts", "py", "go", "js", "rb")
LANGUAGES = ("typescript", "python", "go", "javascript", "ruby")
NAMES = ("main", "requestHandler", "UserController", "authRoutes", "getItem", "bootstrap")


class Bound:
    """The relations over one folder of tables. Every property is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def projects(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"))

    @cached_property
    def files(self) -> DataFrame:
        s, n, r = self.table("supplier"), self.table("nation"), self.table("region")
        key = F.col("s_suppkey")
        base = F.when(key % 4 == 0, "index").otherwise(F.regexp_replace(F.lower("s_name"), "#", "_"))
        pick = lambda xs: F.array(*map(F.lit, xs))[(key % len(xs)).cast("int")]
        path = F.concat(F.lower("r_name"), F.lit("/"), F.lower("n_name"), F.lit("/d"), key.cast("string"), F.lit("/"), base, F.lit("."), pick(EXTENSIONS))
        joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        return joined.select(key.alias("id"), F.col("r_regionkey").cast("string").alias("project_id"), path.alias("relative_path"), pick(LANGUAGES).alias("language"))

    @cached_property
    def symbols(self) -> DataFrame:
        key = F.col("p_partkey")
        n = self.table("supplier").agg(F.count("*").alias("_n"))  # one row
        kind = (
            F.when(F.col("p_type").isin("ECONOMY", "STANDARD"), "function")
            .when(F.col("p_type") == "SMALL", "method")
            .when(F.col("p_type") == "MEDIUM", "class")
            .when(F.col("p_type") == "PROMO", "interface")
            .otherwise("variable")
        )
        name = F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), (key % 500).cast("string"))
        for i, fixed in reversed(list(enumerate(NAMES))):
            name = F.when(key % 97 == i, fixed).otherwise(name)
        return (
            self.table("part")
            .join(F.broadcast(n))
            .select(
                key.alias("id"),
                ((key * key) % F.col("_n")).alias("file_id"),
                name.alias("name"),
                F.concat_ws("/", F.lower("p_type"), "p_name").alias("qualified_name"),
                kind.alias("kind"),
                F.col("p_size").alias("start_line"),
                (F.col("p_size") + (key % 40).cast("int")).alias("end_line"),
                F.when(key % 3 == 0, F.concat(F.lit("export "), "p_name")).otherwise(F.col("p_name")).alias("signature"),
                F.lit(None).cast("string").alias("body"),
                F.col("p_size").alias("complexity_cyclomatic"),
                (key % 30).cast("int").alias("complexity_cognitive"),
            )
        )

    def _next_line(self, column: str, most: int) -> DataFrame:
        """Edges from a line item to the order's next one."""
        line = self.table("lineitem").select("l_orderkey", "l_linenumber", column, "l_quantity")
        a = line.where(F.col("l_quantity") <= most).select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col(column).alias("src"))
        return a.join(line.select("l_orderkey", "l_linenumber", F.col(column).alias("dst")), ["l_orderkey", "l_linenumber"]).select("src", "dst")

    @cached_property
    def calls(self) -> DataFrame:
        return self._next_line("l_partkey", 2)

    @cached_property
    def imports(self) -> DataFrame:
        return self._next_line("l_suppkey", 1)

    @cached_property
    def hunks(self) -> DataFrame:
        """Changed line ranges by file."""
        li = self.table("lineitem").where("l_discount = 0.10 and l_tax = 0.08 and l_quantity <= 5")
        return li.select(F.col("l_suppkey").alias("file_id"), F.col("l_linenumber").alias("start"), F.col("l_quantity").cast("long").alias("count"))

    @cached_property
    def old_snapshot(self) -> DataFrame:
        size = F.when(F.col("doc_id") % 11 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
        return self.table("documents").where("doc_id % 7 <> 0").select("doc_id", size.alias("size"))

    @cached_property
    def new_snapshot(self) -> DataFrame:
        return self.table("documents").where("doc_id % 13 <> 0").select("doc_id", F.col("n_chars").alias("size"))

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents").select("doc_id", "text")


def _case(key: str, values: tuple[str, ...], n: int) -> str:
    return f"CASE {key} % {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))


#: The same relations, written independently in SQL.
CTE = {
    "files": f"""SELECT s_suppkey AS id, CAST(r_regionkey AS VARCHAR) AS project_id,
  lower(r_name) || '/' || lower(n_name) || '/d' || s_suppkey || '/' || CASE WHEN s_suppkey % 4 = 0 THEN 'index' ELSE replace(lower(s_name), '#', '_') END || '.' || {_case("s_suppkey", EXTENSIONS, 5)} END AS relative_path,
  {_case("s_suppkey", LANGUAGES, 5)} END AS language
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "symbols": f"""SELECT p_partkey AS id, (p_partkey * p_partkey) % (SELECT count(*) FROM supplier) AS file_id,
  {_case("p_partkey", NAMES, 97)} ELSE replace(p_name, ' ', '_') || '_' || (p_partkey % 500) END AS name,
  lower(p_type) || '/' || p_name AS qualified_name,
  CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'function' WHEN p_type = 'SMALL' THEN 'method' WHEN p_type = 'MEDIUM' THEN 'class' WHEN p_type = 'PROMO' THEN 'interface' ELSE 'variable' END AS kind,
  p_size AS start_line, p_size + CAST(p_partkey % 40 AS INT) AS end_line,
  CASE WHEN p_partkey % 3 = 0 THEN 'export ' || p_name ELSE p_name END AS signature,
  p_size AS complexity_cyclomatic, CAST(p_partkey % 30 AS INT) AS complexity_cognitive FROM part""",
    "calls": "SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity <= 2",
    "imports": "SELECT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity = 1",
    "hunks": "SELECT l_suppkey AS file_id, l_linenumber AS start, CAST(l_quantity AS BIGINT) AS n FROM lineitem WHERE l_discount = 0.10 AND l_tax = 0.08 AND l_quantity <= 5",
    "old_snapshot": "SELECT doc_id, n_chars + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 7 <> 0",
    "new_snapshot": "SELECT doc_id, n_chars AS size FROM documents WHERE doc_id % 13 <> 0",
    "degrees": "SELECT coalesce(o.id, i.id) AS id, coalesce(i.n, 0) AS ind, coalesce(o.n, 0) AS outd FROM (SELECT src AS id, count(*) AS n FROM calls GROUP BY 1) o FULL JOIN (SELECT dst AS id, count(*) AS n FROM calls GROUP BY 1) i ON o.id = i.id",
    "exported": "SELECT DISTINCT name FROM symbols WHERE signature LIKE 'export %'",
    "roles": """SELECT s.*, CASE
    WHEN coalesce(ind, 0) = 0 AND e.name IS NULL AND kind NOT IN ('class', 'interface', 'type') THEN 'dead'
    WHEN e.name IS NOT NULL AND coalesce(ind, 0) >= greatest(1.5 * ai, 2) THEN 'entry'
    WHEN regexp_matches(s.name, '^(main|index|run|start|init|bootstrap|create|build|setup)$', 'i') THEN 'entry'
    WHEN coalesce(ind, 0) >= greatest(2 * ai, 3) THEN 'core'
    WHEN coalesce(outd, 0) = 0 AND coalesce(ind, 0) > 0 THEN 'leaf'
    WHEN coalesce(outd, 0) >= greatest(2 * ao, 3) AND coalesce(ind, 0) > 0 THEN 'adapter'
    WHEN coalesce(ind, 0) <= greatest(ai, 1) AND coalesce(outd, 0) <= greatest(ao, 1) AND regexp_matches(s.name, '^(util|helper|format|parse|convert|transform|validate|check|get|set|is|has|to|from)', 'i') THEN 'utility'
    ELSE 'unknown' END AS role
  FROM symbols s LEFT JOIN degrees d ON s.id = d.id LEFT JOIN exported e ON s.name = e.name CROSS JOIN (SELECT avg(ind) AS ai, avg(outd) AS ao FROM degrees)""",
    "root": "SELECT src AS id FROM calls GROUP BY src ORDER BY count(*) DESC, src LIMIT 1",
}
_NEEDS = {"degrees": ["calls"], "exported": ["symbols"], "roles": ["degrees", "exported"], "root": ["calls"]}


def with_relations(sql: str, *names: str, recursive: bool = False) -> str:
    """``sql`` with the relations it names, and what those need, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(f"{n} AS ({CTE[n]})" for n in order) + ("\n" if sql.lstrip().startswith("SELECT") else ",\n") + sql
