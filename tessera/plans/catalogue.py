"""Every registered query of the engine, over the bound relations, beside DuckDB
SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, words
from ..operators import governance as gov
from ..operators import fulltext, graph, incremental, metrics, relational, search
from ..operators.ordinals import ordinals
from ..plans.storage import cut, folder
from ..streaming import sessions
from .bindings import Bound, with_relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str = "", needs: str = "", recursive: bool = False) -> Callable:
    """Registers a function of the bound relations under its own name."""

    def add(f: Callable[[Bound], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Bound(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_relations(sql, *needs.split(), recursive=recursive) if needs else sql
        return f

    return add


def _view(b: Bound) -> DataFrame:
    return relational.view(b.symbols, b.files)


def _roles(b: Bound) -> DataFrame:
    return metrics.classify_roles(b.symbols, b.calls)


def _root(b: Bound) -> int:
    """The caller with the most call sites."""
    row = b.calls.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").first()
    return row["src"] if row else -1


VIEW = "SELECT s.*, f.project_id, f.relative_path, f.language FROM symbols s JOIN files f ON s.file_id = f.id"

# ---------------------------------------------------------------- files and lookups


@query("SELECT f.id, f.relative_path, coalesce(i.n, 0) + coalesce(o.n, 0) AS degree FROM files f LEFT JOIN (SELECT dst, count(*) AS n FROM imports GROUP BY 1) i ON i.dst = f.id LEFT JOIN (SELECT src, count(*) AS n FROM imports GROUP BY 1) o ON o.src = f.id ORDER BY degree DESC, f.id LIMIT 20", "files imports")
def top_connected_files(b: Bound) -> DataFrame:
    return graph.top_connected_files(b.imports, b.files)


@query("SELECT language, count(*) AS files FROM files GROUP BY 1", "files")
def language_breakdown(b: Bound) -> DataFrame:
    return relational.language_breakdown(b.files)


@query("SELECT split_part(relative_path, '/', 1) AS dir, count(*) AS files FROM files WHERE contains(relative_path, '/') GROUP BY 1 ORDER BY files DESC, dir LIMIT 15", "files")
def top_dirs(b: Bound) -> DataFrame:
    return relational.top_dirs(b.files)


@query(f"SELECT project_id, count(DISTINCT file_id) AS files, count(*) AS symbols, round(avg(complexity_cyclomatic), 6) AS avg_cyclomatic, max(complexity_cyclomatic) AS max_cyclomatic, round(avg(complexity_cognitive), 6) AS avg_cognitive, max(complexity_cognitive) AS max_cognitive FROM ({VIEW}) GROUP BY 1", "files symbols")
def architecture_summary(b: Bound) -> DataFrame:
    return relational.architecture_summary(_view(b))


@query(f"SELECT id, name, kind, relative_path, start_line FROM ({VIEW}) WHERE name = 'requestHandler' ORDER BY id LIMIT 10", "files symbols")
def where_exact(b: Bound) -> DataFrame:
    return relational.where_exact(_view(b), "requestHandler")


@query(f"SELECT id, name, kind, relative_path, start_line FROM ({VIEW}) WHERE name ILIKE '%CONTROL%' ORDER BY id LIMIT 10", "files symbols")
def where_partial(b: Bound) -> DataFrame:
    return relational.where(_view(b), "CONTROL")


@query(f"SELECT id, name, kind, relative_path, start_line, complexity_cyclomatic, complexity_cognitive FROM ({VIEW}) WHERE kind = 'function' AND relative_path ILIKE '%A%' AND complexity_cyclomatic BETWEEN 10 AND 40 ORDER BY complexity_cyclomatic, id LIMIT 50", "files symbols")
def query_graph(b: Bound) -> DataFrame:
    return relational.query_graph(_view(b), kind="function", file="A", min_cyclomatic=10, max_cyclomatic=40, order_by="complexity_cyclomatic")


@query("SELECT id, name, kind FROM symbols WHERE name ILIKE 'RE%' ORDER BY name, id LIMIT 10", "symbols")
def prefix_search(b: Bound) -> DataFrame:
    return relational.prefix_search(b.symbols, "RE")


def _busiest_file(b: Bound) -> str:
    top = b.symbols.groupBy("file_id").agg(F.count("*").alias("n")).join(b.files, F.col("file_id") == F.col("id")).orderBy(F.desc("n"), "file_id").first()
    return top["relative_path"] if top else ""


BUSIEST = "(SELECT file_id FROM symbols JOIN files f ON file_id = f.id GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(f"SELECT id, name, kind, start_line, end_line, complexity_cyclomatic FROM ({VIEW}) WHERE file_id = {BUSIEST}", "files symbols")
def file_symbols(b: Bound) -> DataFrame:
    return relational.file_symbols(_view(b), _busiest_file(b))


@query(f"SELECT kind, count(*) AS n, string_agg(name, ',' ORDER BY start_line, id) AS names FROM ({VIEW}) WHERE file_id = {BUSIEST} GROUP BY 1", "files symbols")
def brief_file(b: Bound) -> DataFrame:
    return relational.brief(_view(b), _busiest_file(b))


@query("SELECT DISTINCT f.id, f.relative_path FROM files f JOIN imports i ON f.id = i.src WHERE i.dst = (SELECT dst FROM imports GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) ORDER BY f.id LIMIT 10", "files imports")
def importers(b: Bound) -> DataFrame:
    top = b.imports.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").first()
    return relational.importers(b.imports, b.files, top["dst"] if top else -1)


@query("SELECT r_regionkey::VARCHAR AS project_id, coalesce(f.n, 0) AS files, coalesce(s.n, 0) AS symbols, coalesce(e.n, 0) AS edges FROM region LEFT JOIN (SELECT project_id, count(*) AS n FROM files GROUP BY 1) f ON f.project_id = r_regionkey::VARCHAR LEFT JOIN (SELECT project_id, count(*) AS n FROM symbols JOIN files f ON file_id = f.id GROUP BY 1) s ON s.project_id = r_regionkey::VARCHAR LEFT JOIN (SELECT project_id, count(*) AS n FROM imports JOIN files f ON src = f.id GROUP BY 1) e ON e.project_id = r_regionkey::VARCHAR", "files symbols imports")
def update_stats(b: Bound) -> DataFrame:
    return relational.update_stats(b.projects, b.files, b.symbols, b.imports)


@query("SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS name, coalesce(f.n, 0) AS files, coalesce(s.n, 0) AS symbols, coalesce(e.n, 0) AS edges FROM region LEFT JOIN (SELECT project_id, count(*) AS n FROM files GROUP BY 1) f ON f.project_id = r_regionkey::VARCHAR LEFT JOIN (SELECT project_id, count(*) AS n FROM symbols JOIN files f ON file_id = f.id GROUP BY 1) s ON s.project_id = r_regionkey::VARCHAR LEFT JOIN (SELECT project_id, count(*) AS n FROM imports JOIN files f ON src = f.id GROUP BY 1) e ON e.project_id = r_regionkey::VARCHAR", "files symbols imports")
def list_projects(b: Bound) -> DataFrame:
    return relational.list_projects(b.projects, relational.update_stats(b.projects, b.files, b.symbols, b.imports))


@query("SELECT src, CASE WHEN d.project_id = '2' THEN NULL ELSE dst END AS dst FROM imports JOIN files s ON src = s.id JOIN files d ON dst = d.id WHERE s.project_id <> '2'", "files imports")
def delete_project(b: Bound) -> DataFrame:
    return relational.delete_project("2", b.files, b.symbols, b.imports)[2]


@query("SELECT path, CAST(depth AS INT) AS depth, depth < n AS is_dir, count(*) AS files FROM (SELECT len(p) AS n, depth, array_to_string(p[1:depth], '/') AS path FROM (SELECT p, unnest(range(1, len(p) + 1)) AS depth FROM (SELECT string_split(relative_path, '/') AS p FROM files WHERE contains(lower(relative_path), 'index')))) GROUP BY ALL", "files")
def file_tree(b: Bound) -> DataFrame:
    return relational.file_tree(b.files, "INDEX")


# ---------------------------------------------------------------- metrics

MI = "CASE WHEN end_line - start_line + 1 <= 0 THEN 100.0 ELSE greatest(0.0, least(100.0, 171 - 21.4 * ln(end_line - start_line + 1) - 0.23 * greatest(1, complexity_cyclomatic))) END"


@query(f"SELECT id, name, relative_path, complexity_cyclomatic, complexity_cognitive, round({MI}, 6) AS maintainability, complexity_cyclomatic >= 20 AS alert FROM ({VIEW}) WHERE complexity_cyclomatic >= 5 ORDER BY complexity_cyclomatic DESC, complexity_cognitive DESC, id LIMIT 30", "files symbols")
def complexity_report(b: Bound) -> DataFrame:
    return relational.complexity_report(_view(b))


@query(f"SELECT id, round({MI}, 6) AS maintainability FROM symbols", "symbols")
def maintainability(b: Bound) -> DataFrame:
    return relational.maintainability(b.symbols)


@query(f"SELECT id, name, kind, relative_path, start_line, complexity_cyclomatic FROM ({VIEW}) WHERE complexity_cyclomatic >= 10 ORDER BY complexity_cyclomatic DESC, id LIMIT 20", "files symbols")
def high_complexity(b: Bound) -> DataFrame:
    return relational.high_complexity(_view(b))


@query("SELECT f.id, relative_path, count(*) AS symbols FROM files f JOIN symbols s ON s.file_id = f.id GROUP BY 1, 2 HAVING count(*) > 20 ORDER BY symbols DESC, f.id LIMIT 10", "files symbols")
def god_files(b: Bound) -> DataFrame:
    return relational.god_files(b.symbols, b.files)


@query("SELECT id, name, kind, role FROM roles", "symbols roles")
def classify_roles(b: Bound) -> DataFrame:
    return _roles(b)


@query("SELECT r.role, count(x.id) AS symbols FROM (VALUES ('entry'), ('core'), ('utility'), ('adapter'), ('dead'), ('leaf'), ('unknown')) r(role) LEFT JOIN roles x ON x.role = r.role GROUP BY 1", "symbols roles")
def role_summary(b: Bound) -> DataFrame:
    return metrics.role_summary(_roles(b))


@query("SELECT r.id, name, kind, relative_path, start_line FROM roles r JOIN files f ON file_id = f.id WHERE role = 'dead' ORDER BY r.id LIMIT 30", "files symbols roles")
def dead_code(b: Bound) -> DataFrame:
    return metrics.dead_code(_roles(b), _view(b))


STOP = ", ".join(f"'{w}'" for w in code.STOP_WORDS)
CALLABLE = "kind IN ('function', 'method', 'class')"


@query(
    f"""SELECT id, name, kind, relative_path, start_line, tier FROM (SELECT r.id, name, kind, relative_path, start_line,
  CASE WHEN role = 'entry' THEN 1
    WHEN {CALLABLE} AND (regexp_matches(name, '^(main|handler|index|start|run|bootstrap|init|listen|serve|launch|setup|createServer|createApp|makeApp)$', 'i') OR regexp_matches(name, 'Handler$|Controller$|Router$|Routes?$')) THEN 2
    WHEN {CALLABLE} AND regexp_matches(relative_path, '/(index|main|app|server|handler|entry|bootstrap|start)\\.[tj]sx?$|/cmd/|/cmd\\.[tj]sx?$|/bin/') THEN 3 END AS tier
  FROM roles r JOIN files f ON file_id = f.id) WHERE tier IS NOT NULL AND name NOT IN ({STOP}) ORDER BY tier, CASE WHEN tier > 1 THEN relative_path END, start_line, id LIMIT 20""",
    "files symbols roles",
)
def entry_points_tiered(b: Bound) -> DataFrame:
    return metrics.entry_points(_view(b), _roles(b))


@query(
    f"""SELECT * FROM (SELECT DISTINCT name, kind, relative_path, start_line FROM roles r JOIN files f ON file_id = f.id
  WHERE (role = 'entry' OR lower(name) IN ({", ".join(f"'{w}'" for w in code.API_NAMES)}) OR name ILIKE '%Handler' OR name ILIKE '%Controller' OR name ILIKE '%Router' OR name ILIKE '%Routes'
    OR {" OR ".join(f"relative_path ILIKE '%{p}'" for p in code.API_FILES)}) AND {CALLABLE} ORDER BY relative_path, start_line, name, kind LIMIT 30) WHERE name NOT IN ({STOP})""",
    "files symbols roles",
)
def entry_points_api(b: Bound) -> DataFrame:
    return metrics.entry_points_api(_view(b), _roles(b))


@query("SELECT id, module, dense_rank() OVER (ORDER BY first) - 1 AS community FROM (SELECT id, module, min(id) OVER (PARTITION BY module) AS first FROM (SELECT id, split_part(relative_path, '/', 1) || '/' || split_part(relative_path, '/', 2) AS module FROM files))", "files")
def module_communities(b: Bound) -> DataFrame:
    return metrics.module_communities(b.files)


FAN = "SELECT f.id, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM files f LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM imports WHERE src <> dst GROUP BY 1) i ON i.dst = f.id LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM imports WHERE src <> dst GROUP BY 1) o ON o.src = f.id"


@query(FAN, "files imports")
def fan_in_out(b: Bound) -> DataFrame:
    return graph.fan(b.imports, b.files)


@query(f"SELECT id, fan_in, fan_out, CASE WHEN n >= 50 THEN 'O' WHEN n >= 26 THEN 'B' WHEN n >= 13 THEN 'A' WHEN n >= 7 THEN 'F' WHEN n >= 4 THEN 'G' WHEN n >= 2 THEN 'K' ELSE 'M' END AS band FROM (SELECT *, fan_in + fan_out AS n FROM ({FAN}))", "files imports")
def node_bands(b: Bound) -> DataFrame:
    return metrics.node_bands(b.imports, b.files)


@query(f"SELECT x.id, relative_path, fan_in FROM ({FAN}) x JOIN files f ON x.id = f.id WHERE fan_in > 0 ORDER BY fan_in DESC, x.id LIMIT 8", "files imports")
def hotspots(b: Bound) -> DataFrame:
    return metrics.hotspots(b.imports, b.files)


@query("SELECT DISTINCT f1.relative_path AS file1, f2.relative_path AS file2 FROM imports a JOIN imports c ON a.src = c.dst AND a.dst = c.src JOIN files f1 ON a.src = f1.id JOIN files f2 ON a.dst = f2.id WHERE f1.relative_path < f2.relative_path ORDER BY 1, 2 LIMIT 20", "files imports")
def circular_deps(b: Bound) -> DataFrame:
    return graph.mutual_imports(b.imports, b.files)


@query("SELECT id, ind AS in_degree, outd AS out_degree FROM degrees", "degrees")
def degrees(b: Bound) -> DataFrame:
    return graph.degrees(b.calls)


@query(f"SELECT id, name, kind, relative_path FROM ({VIEW}) WHERE contains(lower(name), 'getitem') OR contains(lower(qualified_name), 'getitem') ORDER BY id LIMIT 20", "symbols files")
def name_fallback(b: Bound) -> DataFrame:
    return search.name_fallback(_view(b), "GetItem", 20)


_SHOWN = f"SELECT complexity_cyclomatic AS c FROM ({VIEW}) WHERE complexity_cyclomatic >= 5 ORDER BY complexity_cyclomatic DESC, complexity_cognitive DESC, id LIMIT 30"


@query(f"SELECT round(avg(c), 6) AS average, max(c) AS highest FROM ({_SHOWN})", "symbols files")
def complexity_footer(b: Bound) -> DataFrame:
    return relational.complexity_footer(relational.complexity_report(_view(b)))


_PAIRS = "SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) x JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY ALL"


@query(f"SELECT f.relative_path AS path1, f.language AS language1, g.relative_path AS path2, g.language AS language2, n FROM ({_PAIRS}) JOIN files f ON a = f.id JOIN files g ON b = g.id ORDER BY n DESC, a, b LIMIT 50", "files")
def cochange_files(b: Bound) -> DataFrame:
    commits = b.table("lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("file"))
    return gov.cochange_files(gov.cochange(gov.of_known_files(commits, b.files), 50), b.files)


@query("SELECT coalesce(language, 'unknown') AS language, count(*) AS files, sum(d)::BIGINT AS connections FROM files JOIN (SELECT id, (SELECT count(DISTINCT src) FROM imports WHERE dst = f.id AND src <> f.id) + (SELECT count(DISTINCT dst) FROM imports WHERE src = f.id AND dst <> f.id) AS d FROM files f) USING (id) GROUP BY ALL", "files imports")
def language_chips(b: Bound) -> DataFrame:
    return graph.language_chips(b.imports, b.files)


@query("SELECT DISTINCT src, dst FROM imports WHERE src <> dst", "imports")
def visual_edges(b: Bound) -> DataFrame:
    return graph.visual_edges(b.imports)


def _cyclomatic_sql(rx: str) -> str:
    return f"CASE WHEN regexp_matches(text, '\\S') THEN CAST(least(len(regexp_extract_all(text, '{rx}')) + 1, 100) AS INT) ELSE 1 END"


@query("SELECT doc_id, " + ", ".join(f"{_cyclomatic_sql(rx)} AS {lang}" for lang, rx in code.CYCLOMATIC.items()) + " FROM documents")
def cyclomatic(b: Bound) -> DataFrame:
    found = b.documents.select("doc_id", code.decision_points(F.col("text")).alias("_points"))
    return found.select("doc_id", *[code.cyclomatic_of(F.col("_points"), lang).alias(lang) for lang in code.CYCLOMATIC])


def _cognitive_sql(lang: str) -> str:
    n = f"len(list_filter(l, lambda x: regexp_matches(x, '\\b({'|'.join(code.NESTING[lang].split())})\\b')))"
    return f"CAST(least({n} * ({n} + 1) // 2 + ops, 100) AS INT)"


_BRACE = [x for x in code.NESTING if x not in code.UNNESTING]


_CODE_LINES = (
    "WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '' AND NOT starts_with(x, '//') AND NOT starts_with(x, '#')) AS l FROM documents), "
    "o AS (SELECT doc_id, l, len(regexp_extract_all(array_to_string(l, chr(10)), '&&')) + len(regexp_extract_all(array_to_string(l, chr(10)), '\\|\\|')) AS ops FROM l) "
)


@query(_CODE_LINES + "SELECT doc_id, " + ", ".join(f"{_cognitive_sql(x)} AS {x}" for x in _BRACE) + " FROM o")
def cognitive_brace(b: Bound) -> DataFrame:
    lines = b.documents.select("doc_id", "text", code.code_lines(F.col("text")).alias("_lines"))
    marked = lines.select("doc_id", "text", code.nesting_marks(F.col("_lines"), _BRACE).alias("_marks"), code.operators(F.col("_lines")).alias("_ops"))
    return marked.select("doc_id", *[code.cognitive_of(F.col("text"), F.col("_marks"), F.col("_ops"), k).alias(x) for k, x in enumerate(_BRACE)])


def _cognitive(b: Bound, languages: list[str]) -> DataFrame:
    cleaned = b.documents.select("doc_id", "text", code.code_lines(F.col("text")).alias("_lines"))
    return cleaned.select("doc_id", *[code.cognitive(F.col("text"), x, F.col("_lines")).alias(x) for x in languages])


def _nested_sql(lang: str) -> str:
    words = lambda x: f"'\\b({'|'.join(x.split())})\\b'"
    row = f"{{'t': 0::BIGINT, 'n': 0::BIGINT, 'u': regexp_matches(x, {words(code.NESTING[lang])}), 'd': regexp_matches(x, {words(code.UNNESTING[lang])}) OR x IN ('}}', 'end')}}"
    fold = "{'t': a.t + CASE WHEN x.u THEN 1 + a.n ELSE 0 END, 'n': CASE WHEN x.d THEN greatest(a.n + x.u::BIGINT - 1, 0) ELSE a.n + x.u::BIGINT END, 'u': false, 'd': false}"
    return f"CAST(least(list_reduce(list_prepend({{'t': 0::BIGINT, 'n': 0::BIGINT, 'u': false, 'd': false}}, list_transform(l, lambda x: {row})), lambda a, x: {fold}).t + ops, 100) AS INT)"


@query(_CODE_LINES + "SELECT doc_id, " + ", ".join(f"{_nested_sql(x)} AS {x}" for x in code.UNNESTING) + " FROM o")
def cognitive_nested(b: Bound) -> DataFrame:
    """Python and Ruby leave levels, so this is a fold over lines."""
    return _cognitive(b, list(code.UNNESTING))


# ---------------------------------------------------------------- text and vectors

LINES = "SELECT doc_id AS id, CAST(i AS INT) AS line_no, l[i] AS line, l FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


@query(f"SELECT id, line_no, line FROM ({LINES}) WHERE contains(lower(line), 'license') ORDER BY id, line_no LIMIT 30")
def grep_literal(b: Bound) -> DataFrame:
    return search.grep(b.documents, "License")


@query(f"SELECT id, line_no, line FROM ({LINES}) WHERE regexp_matches(line, '(the|la) [a-c]+e', 'i') ORDER BY id, line_no LIMIT 30")
def grep_regex(b: Bound) -> DataFrame:
    return search.grep(b.documents, "/(the|la) [a-c]+e/")


@query(f"SELECT id, line_no, substring(array_to_string(l[greatest(line_no - 1, 1):line_no + 1], chr(10)), 1, 300) AS snippet FROM ({LINES}) WHERE contains(lower(line), 'license') ORDER BY id, line_no LIMIT 30")
def grep_snippet(b: Bound) -> DataFrame:
    return search.grep_snippets(b.documents, "license")


TOKENS = "tok AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS t FROM documents), len AS (SELECT id, count(*) AS n FROM tok GROUP BY 1), tot AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(n) FROM len) / (SELECT count(*) FROM documents) AS a)"


def _bm25_sql(words: list[str], limit: int) -> str:
    w = ", ".join(f"('{x}')" for x in words)
    return f"""SELECT id, round(sum(greatest(1e-6, ln((tn - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM (
  SELECT w, p.id, p.tf, len.n AS dl, count(*) OVER (PARTITION BY w) AS df, tot.n AS tn, tot.a FROM (SELECT w, id, count(*) AS tf FROM tok JOIN (VALUES {w}) q(w) ON starts_with(t, w) GROUP BY 1, 2) p JOIN len ON p.id = len.id CROSS JOIN tot)
  GROUP BY id ORDER BY score DESC, id LIMIT {limit}"""


@query(f"WITH {TOKENS} {_bm25_sql(['licen', 'thion'], 20)}")
def bm25_prefix(b: Bound) -> DataFrame:
    return search.bm25(b.documents, 'licen* "thion"')


def _rrf_sql(lists: list[str], limit: int) -> str:
    ranked = " UNION ALL ".join(f"SELECT id, 1 / (61 + row_number() OVER (ORDER BY score DESC, id) - 1) AS s FROM ({x})" for x in lists)
    return f"SELECT id, round(sum(s), 9) AS score FROM ({ranked}) GROUP BY id ORDER BY score DESC, id LIMIT {limit}"


@query(f"WITH {TOKENS} {_rrf_sql([_bm25_sql(['license', 'version'], 40), _bm25_sql(['erin'], 40)], 20)}")
def multi_query_rrf(b: Bound) -> DataFrame:
    return search.multi_query(b.documents, "license version; erin")


DOT = "round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])), 6)"


# Words of the full-text index: accents of the letters that have them, then Porter's steps one after the other.
_BARE = "strip_accents(lower(text))"
_STEM_STEPS = [
    "CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END",
    f"CASE WHEN w LIKE '%eed' THEN CASE WHEN regexp_matches(left(w, length(w) - 3), '{words.SOME}') THEN left(w, length(w) - 1) ELSE w END WHEN w LIKE '%ed' AND regexp_matches(left(w, length(w) - 2), '{words.VOWEL}') THEN left(w, length(w) - 2) || '+' WHEN w LIKE '%ing' AND regexp_matches(left(w, length(w) - 3), '{words.VOWEL}') THEN left(w, length(w) - 3) || '+' ELSE w END",
    f"CASE WHEN w NOT LIKE '%+' THEN w WHEN regexp_matches(w, '(at|bl|iz)\\+$') THEN replace(w, '+', 'e') WHEN length(w) > 2 AND w[-2] = w[-3] AND NOT regexp_matches(w[-2], '[aeioulsz]') THEN left(w, length(w) - 2) WHEN regexp_matches(replace(w, '+', ''), '{words.SHORT}') THEN replace(w, '+', 'e') ELSE replace(w, '+', '') END",
    f"CASE WHEN w LIKE '%y' AND regexp_matches(left(w, length(w) - 1), '{words.VOWEL}') THEN left(w, length(w) - 1) || 'i' ELSE w END",
    *[
        "CASE " + " ".join(f"WHEN w LIKE '%{old}' THEN CASE WHEN regexp_matches(left(w, length(w) - {len(old)}), '{need}'{more}) THEN left(w, length(w) - {len(old)}) || '{new}' ELSE w END" for old, new, more in sorted(pairs, key=lambda p: -len(p[0]))) + " ELSE w END"
        for need, pairs in (
            (words.SOME, [(*p.split(" "), "") for p in words.STEP_2.split(",")]),
            (words.SOME, [(*p.split(" "), "") for p in words.STEP_3.split(",")]),
            (words.MANY, [(p, "", "") for p in words.STEP_4.split(",")] + [("ion", "", ") AND regexp_matches(left(w, length(w) - 3), '[st]$'")]),
        )
    ],
    f"CASE WHEN w LIKE '%e' AND (regexp_matches(left(w, length(w) - 1), '{words.MANY}') OR regexp_matches(left(w, length(w) - 1), '{words.ONE}') AND NOT regexp_matches(left(w, length(w) - 1), '{words.SHORT}')) THEN left(w, length(w) - 1) ELSE w END",
    f"CASE WHEN w LIKE '%ll' AND regexp_matches(w, '{words.MANY}') THEN left(w, length(w) - 1) ELSE w END",
]
STEMS = "".join(f", stem{k + 1} AS (SELECT t, long, {step} AS w FROM stem{k})" for k, step in enumerate(_STEM_STEPS))
STEMMED = f"""texts AS (SELECT doc_id, list_filter(regexp_split_to_array({_BARE}, '[^\\pL\\pN]+'), lambda t: t <> '') AS ts FROM documents),
each AS (SELECT doc_id, unnest(ts) AS t, unnest(range(len(ts))) AS pos, len(ts) AS doc_len FROM texts),
stem0 AS (SELECT t, length(t) BETWEEN 3 AND 64 AND NOT regexp_matches(t, '[0-9]') AS long, t AS w FROM (SELECT DISTINCT t FROM each)){STEMS},
stems AS (SELECT t, CASE WHEN long THEN w ELSE t END AS w FROM stem{len(_STEM_STEPS)}),
sized AS (SELECT count(*) AS n, avg(coalesce(len(ts), 0)) AS avg_len FROM texts)"""


@query(f"WITH {STEMMED} SELECT w AS stem, count(*) AS n, count(DISTINCT each.t) AS forms FROM each JOIN stems USING (t) GROUP BY w")
def stemmed_words(b: Bound) -> DataFrame:
    """Every stem of the documents, how often it comes and in how many forms."""
    plain = b.documents.select(F.explode(words.words(F.col("text"), stems=False)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return plain.groupBy(words.stem(F.col("w")).alias("stem")).agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


#: Two words that begin stems, and a run of two, in the documents that are left after a change.
FULLTEXT = "licenses version the_on"


@query(
    f"""WITH changed AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' ' || text ELSE text END AS text FROM documents WHERE doc_id % 13 <> 0),
{STEMMED.replace("FROM documents", "FROM changed")},
places AS (SELECT doc_id, pos, doc_len, w FROM each JOIN stems USING (t)),
found AS (SELECT 0 AS k, doc_id, doc_len FROM places WHERE w LIKE 'licens%' UNION ALL SELECT 1, doc_id, doc_len FROM places WHERE w LIKE 'version%'
  UNION ALL SELECT 2, a.doc_id, a.doc_len FROM places a JOIN places b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.w = 'the' AND b.w LIKE 'on%'),
per AS (SELECT k, doc_id, doc_len, count(*) AS tf FROM found GROUP BY ALL),
df AS (SELECT k, count(*) AS df FROM per GROUP BY k)
SELECT doc_id AS id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS score
FROM per JOIN df USING (k), sized GROUP BY doc_id ORDER BY score DESC, id LIMIT 20"""
)
def fulltext_after_change(b: Bound) -> DataFrame:
    """A search in an index of two segments: all documents, then a change that takes a
    share of them away and makes others twice as long."""
    all_ = b.documents.select(F.col("doc_id").alias("id"), "text")
    twice = F.when(F.col("id") % 7 == 0, F.concat_ws(" ", "text", "text")).otherwise(F.col("text"))
    index = fulltext.Index(b.spark, folder(b.spark, "fulltext"), ["text"])
    index.change(all_, all_.limit(0), "load")
    index.change(all_.where("id % 7 = 0 and id % 13 <> 0").withColumn("text", twice), all_.where("id % 7 = 0 or id % 13 = 0"), "change")
    return index.search(FULLTEXT)


def _vector(b: Bound) -> list[float]:
    row = b.table("embeddings").where("vec_id = 0").select("embedding").first()
    return list(row["embedding"]) if row else []


@query(f"SELECT vec_id AS id, {DOT} AS score FROM embeddings ORDER BY score DESC, id LIMIT 30")
def vector_topk(b: Bound) -> DataFrame:
    return search.vector_topk(b.table("embeddings"), _vector(b), 30)


@query(f"WITH {TOKENS} {_rrf_sql([_bm25_sql(['license'], 60), f'SELECT vec_id AS id, {DOT} AS score FROM embeddings ORDER BY score DESC, id LIMIT 60'], 20)}")
def hybrid_rrf(b: Bound) -> DataFrame:
    return search.hybrid(b.documents, b.table("embeddings"), "license", _vector(b))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def embedding_backlog(b: Bound) -> DataFrame:
    return search.backlog(b.documents.select(F.col("doc_id").alias("id")), b.table("embeddings").select(F.col("vec_id").alias("id")))


@query("SELECT id, kind || ' ' || name || chr(10) || signature AS text FROM symbols", "symbols")
def embedding_text(b: Bound) -> DataFrame:
    return search.embedding_text(b.symbols)


# ---------------------------------------------------------------- graph


@query("SELECT s.id, name, kind FROM calls JOIN symbols s ON s.id = src WHERE dst = (SELECT dst FROM calls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)", "calls symbols")
def callers(b: Bound) -> DataFrame:
    top = b.calls.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").first()
    return graph.callers(b.calls, b.symbols, top["dst"] if top else -1)


@query("SELECT s.id, name, kind FROM calls JOIN symbols s ON s.id = dst WHERE src = (SELECT id FROM root)", "calls symbols root")
def callees(b: Bound) -> DataFrame:
    return graph.callees(b.calls, b.symbols, _root(b))


@query("SELECT DISTINCT s.id, name, kind, file_id FROM symbols s WHERE s.id <> (SELECT id FROM root) AND (file_id = (SELECT file_id FROM symbols WHERE id = (SELECT id FROM root)) OR s.id IN (SELECT dst FROM calls WHERE src = (SELECT id FROM root)) OR s.id IN (SELECT src FROM calls WHERE dst = (SELECT id FROM root)))", "calls symbols root")
def context_neighborhood(b: Bound) -> DataFrame:
    return graph.neighbourhood(b.calls, b.symbols, _root(b))


def _reach_sql(edges: str, a: str, c: str, start: str, depth: int) -> str:
    return f"walk AS (SELECT id, 0 AS d FROM ({start}) UNION SELECT {c}, d + 1 FROM walk JOIN {edges} ON {a} = walk.id WHERE d < {depth}) "


@query(_reach_sql("calls", "src", "dst", "SELECT id FROM root", 5) + "SELECT s.id, name, file_id, min(d) AS depth FROM walk JOIN symbols s ON s.id = walk.id WHERE d > 0 AND s.id <> (SELECT id FROM root) GROUP BY 1, 2, 3", "calls symbols root", recursive=True)
def flow_reach_bfs(b: Bound) -> DataFrame:
    return graph.impact(b.calls, b.symbols, _root(b), 5, "down")


@query(_reach_sql("calls", "dst", "src", "SELECT dst AS id FROM calls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1", 5) + "SELECT s.id, name, file_id, min(d) AS depth FROM walk JOIN symbols s ON s.id = walk.id WHERE d > 0 AND s.id NOT IN (SELECT id FROM walk WHERE d = 0) GROUP BY 1, 2, 3", "calls symbols", recursive=True)
def fn_impact_bfs(b: Bound) -> DataFrame:
    top = b.calls.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").first()
    return graph.impact(b.calls, b.symbols, top["dst"] if top else -1, 5, "up")


GOAL = "goal AS (SELECT id FROM (SELECT id, min(d) AS d FROM walk GROUP BY 1) WHERE id <> (SELECT id FROM root) ORDER BY d DESC, id LIMIT 1)"


@query(
    _reach_sql("calls", "src", "dst", "SELECT id FROM root", 5)
    + f", dist AS (SELECT id, min(d) AS d FROM walk GROUP BY 1), {GOAL}, back AS (SELECT id AS node, (SELECT d FROM dist WHERE dist.id = goal.id) AS step FROM goal UNION ALL SELECT (SELECT min(src) FROM calls JOIN dist ON dist.id = src WHERE dst = back.node AND dist.d = back.step - 1), step - 1 FROM back WHERE step > 0) SELECT CAST(step AS INT) AS step, node FROM back",
    "calls symbols root",
    recursive=True,
)
def shortest_path(b: Bound) -> DataFrame:
    """From the root to the farthest symbol within five calls."""
    root = _root(b)
    calls = cut(b.calls, "calls")
    far = graph.reach(calls, graph.one(b.spark, root), 5).where(F.col("node") != root).orderBy(F.desc("depth"), "node").first()
    return graph.shortest_path(calls, root, far["node"] if far else root)


@query(
    """adj AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r, count(*) OVER (PARTITION BY src) AS n FROM (SELECT DISTINCT src, dst FROM imports)),
start AS (SELECT src AS id FROM imports WHERE src <> dst GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
flow AS (SELECT [id] AS path, id AS node, -1 AS depth, FALSE AS cyclic, 0 AS more FROM start UNION ALL
  SELECT list_append(path, CASE WHEN r <= 10 THEN dst ELSE -1 END), CASE WHEN r <= 10 THEN dst ELSE -1 END, depth + 1, r <= 10 AND list_contains(path, dst), CASE WHEN r <= 10 THEN 0 ELSE n - 10 END FROM flow JOIN adj ON src = node AND r <= 11 WHERE NOT cyclic AND depth < 2)
SELECT array_to_string(path, '>') AS path, node, depth, cyclic, more FROM flow WHERE depth >= 0""",
    "imports",
    recursive=True,
)
def execution_flow(b: Bound) -> DataFrame:
    """Over imports, which have cycles, three levels deep."""
    top = b.imports.where("src <> dst").groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").first()
    flow = graph.execution_flow(b.imports, top["src"] if top else -1, 3)
    return flow.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query()
def trace_chain(b: Bound) -> DataFrame:
    """Depth-first order; tests compare with a recursive walk."""
    chain = graph.trace_chain(cut(b.calls, "calls"), _root(b), 5)
    return chain.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query("e AS (SELECT src AS a, dst AS b FROM calls UNION SELECT dst, src FROM calls), walk AS (SELECT id, id AS c FROM symbols UNION SELECT e.b, c FROM walk JOIN e ON e.a = walk.id AND c < e.b), comp AS (SELECT id, min(c) AS component FROM walk GROUP BY 1) SELECT id, component, size FROM (SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM comp) WHERE size >= 2", "calls symbols", recursive=True)
def communities_cc(b: Bound) -> DataFrame:
    return graph.communities(b.calls, b.symbols)


@query("e AS (SELECT src AS a, dst AS b FROM calls UNION SELECT dst, src FROM calls), walk AS (SELECT id, id AS c FROM symbols UNION SELECT e.b, c FROM walk JOIN e ON e.a = walk.id AND c < e.b), comp AS (SELECT id, min(c) AS component FROM walk GROUP BY 1) SELECT id, component, dense_rank() OVER (ORDER BY component) - 1 AS ordinal FROM (SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM comp) WHERE size >= 2", "calls symbols", recursive=True)
def community_ordinals(b: Bound) -> DataFrame:
    """Components numbered as their first symbols come."""
    found = cut(graph.communities(b.calls, b.symbols), "communities")
    return found.join(ordinals(found, "component", "ordinal"), "component").select("id", "component", "ordinal")


@query(
    "m AS (SELECT id, split_part(relative_path, '/', 1) || '/' || split_part(relative_path, '/', 2) AS module FROM files), c AS (SELECT module, count(*) AS size, min(id) AS first FROM m GROUP BY 1), n AS (SELECT *, dense_rank() OVER (ORDER BY first) - 1 AS community FROM c) SELECT split_part(module, '/', 1) AS prefix, community, module AS name, size FROM n WHERE size >= 2 AND contains(module, 'a') ORDER BY size DESC, community",
    "files",
)
def community_list(b: Bound) -> DataFrame:
    found = metrics.module_communities(b.files).select("community", F.col("module").alias("name"))
    return metrics.community_list(found, 2, "A", "count-desc")


@query("e AS (SELECT src AS a, dst AS b FROM imports UNION SELECT dst, src FROM imports), start AS (SELECT src AS id FROM imports WHERE src <> dst GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), walk AS (SELECT id, 0 AS d FROM start UNION SELECT b, d + 1 FROM walk JOIN e ON a = walk.id WHERE d < 2) SELECT id AS node, min(d) AS depth FROM walk WHERE id NOT IN (SELECT id FROM start) GROUP BY 1", "imports", recursive=True)
def k_hop(b: Bound) -> DataFrame:
    top = b.imports.where("src <> dst").groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").first()
    return graph.reach(b.imports, graph.one(b.spark, top["src"] if top else -1), 2, "both")


# ---------------------------------------------------------------- governance and change

RULES = "('cyc', 'max_cyclomatic', 20.0, 45.0), ('cog', 'max_cognitive', 10.0, NULL), ('avg', 'avg_cyclomatic', NULL, 1000.0), ('file', 'max_file_symbols', 5.0, 10.0), ('dead', 'dead_symbol_count', NULL, NULL), ('all', 'total_symbols', 1.0, 1e9), ('ratio', 'max_dead_ratio', 0.1, 0.9), ('odd', 'no_such_metric', 1.0, 2.0)"


def _rules(b: Bound) -> DataFrame:
    return b.spark.sql(f"SELECT rule_name, metric, CAST(w AS DOUBLE) AS warn_threshold, CAST(f AS DOUBLE) AS fail_threshold FROM VALUES {RULES} AS t(rule_name, metric, w, f)")


@query(
    f"""m AS (SELECT 'max_cyclomatic' AS metric, max(complexity_cyclomatic)::DOUBLE AS value FROM roles UNION ALL SELECT 'max_cognitive', max(complexity_cognitive) FROM roles UNION ALL SELECT 'avg_cyclomatic', avg(complexity_cyclomatic) FROM roles
  UNION ALL SELECT 'max_file_symbols', max(n) FROM (SELECT count(*) AS n FROM roles GROUP BY file_id) UNION ALL SELECT 'dead_symbol_count', count(*) FILTER (role = 'dead') FROM roles UNION ALL SELECT 'total_symbols', count(*) FROM roles UNION ALL SELECT 'max_dead_ratio', count(*) FILTER (role = 'dead') / count(*) FROM roles)
SELECT rule_name, r.metric, round(value, 6) AS value, CASE WHEN value IS NULL THEN 'SKIP' WHEN value >= f THEN 'FAIL' WHEN value >= w THEN 'WARN' ELSE 'PASS' END AS status FROM (VALUES {RULES}) r(rule_name, metric, w, f) LEFT JOIN m ON m.metric = r.metric""",
    "symbols roles",
)
def manifesto_check(b: Bound) -> DataFrame:
    return gov.manifesto_check(_rules(b), gov.measures(b.symbols, _roles(b)))




#: Decision records: an order each, numbered by its key; what the order's lines say revises it.
_ADR_SQL = "a AS (SELECT CAST(o_orderkey AS INT) AS number, 'Order of ' || o_custkey AS title, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'P' THEN 'superseded' ELSE 'proposed' END AS status, o_orderpriority AS context_text, 'buy for ' || CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) AS decision, CAST(NULL AS VARCHAR) AS consequences FROM orders), r AS (SELECT CAST(l_orderkey AS INT) AS number, CASE WHEN min(l_returnflag) = 'R' THEN 'deprecated' END AS status, CASE WHEN count(*) > 3 THEN count(*) || ' lines' END AS context_text FROM lineitem GROUP BY 1)"


def _adrs(b: Bound) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "P", "superseded").otherwise("proposed")
    decision = F.concat(F.lit("buy for "), F.round("o_totalprice").cast("long").cast("string"))
    return b.table("orders").select(F.col("o_orderkey").cast("int").alias("number"), F.concat(F.lit("Order of "), F.col("o_custkey").cast("string")).alias("title"), status.alias("status"), F.col("o_orderpriority").alias("context_text"), decision.alias("decision"), F.lit(None).cast("string").alias("consequences"))


@query(f"WITH {_ADR_SQL} SELECT CAST(coalesce(max(number), 0) + 1 AS INT) AS number FROM a")
def adr_next(b: Bound) -> DataFrame:
    return gov.adr_next(_adrs(b))


@query(f"WITH {_ADR_SQL} SELECT a.number, title, coalesce(r.status, a.status) AS status, coalesce(r.context_text, a.context_text) AS context_text, decision, consequences FROM a LEFT JOIN r ON r.number = a.number")
def adr_update(b: Bound) -> DataFrame:
    n = F.count("*")
    revised = b.table("lineitem").groupBy(F.col("l_orderkey").cast("int").alias("number")).agg(F.when(F.min("l_returnflag") == "R", "deprecated").alias("status"), F.when(n > 3, F.concat(n.cast("string"), F.lit(" lines"))).alias("context_text"))
    return gov.adr_update(_adrs(b), revised)


@query(f"WITH {_ADR_SQL} SELECT * FROM a WHERE status = 'proposed' UNION ALL SELECT CAST(max(number) + 1 AS INT), 'New', 'proposed', NULL, 'do', NULL FROM a")
def adr_create_list(b: Bound) -> DataFrame:
    return gov.adr_list(gov.adr_create(_adrs(b), "New", decision="do"), "proposed")


@query("WITH c AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_suppkey AS file1, b.l_suppkey AS file2, count(*) AS n FROM c a JOIN c b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 200")
def cochange_topk(b: Bound) -> DataFrame:
    return gov.cochange(b.table("lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("file")))


HIT = "SELECT DISTINCT s.id, name, kind, s.file_id FROM symbols s JOIN hunks h ON s.file_id = h.file_id AND h.start <= end_line AND h.start + n - 1 >= start_line WHERE n > 0"


@query(HIT, "symbols hunks")
def diff_symbols(b: Bound) -> DataFrame:
    return gov.diff_symbols(b.symbols, b.hunks)


@query(f"hit AS ({HIT}), walk AS (SELECT id, 0 AS d FROM hit UNION SELECT src, d + 1 FROM walk JOIN calls ON dst = walk.id WHERE d < 3) SELECT walk.id, min(d) AS depth FROM walk JOIN symbols USING (id) WHERE id NOT IN (SELECT id FROM hit) GROUP BY 1", "symbols hunks calls", recursive=True)
def diff_impact(b: Bound) -> DataFrame:
    return gov.diff_impact(b.symbols, b.hunks, b.calls)


STATUS = "CASE id % 4 WHEN 0 THEN 'M' || chr(9) || relative_path WHEN 1 THEN 'A' || chr(9) || relative_path WHEN 2 THEN 'D' || chr(9) || relative_path ELSE 'R100' || chr(9) || 'old/' || relative_path || chr(9) || relative_path END"


@query(f"l AS (SELECT {STATUS} AS line FROM files) SELECT v.id, v.name, v.relative_path, CASE line[1] WHEN 'A' THEN 'added' WHEN 'M' THEN 'modified' ELSE 'deleted' END AS change FROM l JOIN ({VIEW}) v ON v.relative_path = string_split(line, chr(9))[-1] WHERE line[1] <> 'R'", "files symbols")
def branch_compare(b: Bound) -> DataFrame:
    return gov.branch_compare(b.files.selectExpr(f"{STATUS} AS line"), _view(b))


CHANGES = "SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.size <> n.size THEN 'modified' ELSE 'unchanged' END AS status FROM old_snapshot o FULL JOIN new_snapshot n ON o.doc_id = n.doc_id"


@query(CHANGES, "old_snapshot new_snapshot")
def detect_changes(b: Bound) -> DataFrame:
    return incremental.detect_changes(b.old_snapshot, b.new_snapshot, "doc_id", ["size"])


@query("SELECT doc_id, size FROM new_snapshot", "new_snapshot")
def apply_incremental(b: Bound) -> DataFrame:
    """Equal to indexing the new snapshot in full."""
    return incremental.apply_changes(b.old_snapshot, b.new_snapshot, detect_changes(b), "doc_id")


TARGETS = "'./index', './' || regexp_extract(relative_path, '([^/]+)[.][a-z]+$', 1), './' || regexp_extract(relative_path, '([^/]+)[.][a-z]+$', 1) || '.js', '.', '../' || split_part(relative_path, '/', 3), '../../' || split_part(relative_path, '/', 2) || '/./' || split_part(relative_path, '/', 3) || '/index.js', 'react'"


@query(
    f"""i AS (SELECT DISTINCT id AS file_id, project_id, relative_path, unnest([{TARGETS}]) AS target FROM files),
a AS (SELECT *, CASE WHEN starts_with(target, '.') THEN regexp_replace(relative_path, '/[^/]+$', '/') || target END AS p FROM i),
n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '/[.]/', '/', 'g'), '/[.]$', ''), '/[^/.]+/[.][.]/', '/'), '/[^/.]+/[.][.]/', '/') AS q FROM a),
x AS (SELECT * FROM (VALUES (0, 'ts'), (1, 'tsx'), (2, 'js'), (3, 'jsx'), (4, 'mts'), (5, 'cts'), (6, 'mjs')) e(k, ext)),
c AS (SELECT file_id, project_id, target, k, q || '.' || ext AS cand FROM n, x UNION ALL SELECT file_id, project_id, target, 7 + k, q || '/index.' || ext FROM n, x UNION ALL SELECT file_id, project_id, target, 14, regexp_replace(q, '[.]js$', '.ts') FROM n WHERE target LIKE '%.js')
SELECT i.file_id, i.target, m.id AS to_file_id FROM i LEFT JOIN (SELECT c.file_id, c.target, arg_min(f.id, k) AS id FROM c JOIN files f ON f.project_id = c.project_id AND f.relative_path = c.cand GROUP BY 1, 2) m ON m.file_id = i.file_id AND m.target = i.target""",
    "files",
)
def import_resolution(b: Bound) -> DataFrame:
    targets = b.files.selectExpr("id AS file_id", f"explode(array({TARGETS})) AS target")
    return gov.resolve_imports(targets, b.files)


@query(f"v AS ({VIEW}), n AS (SELECT DISTINCT a.project_id, s.name AS call_name FROM calls JOIN v a ON a.id = src JOIN symbols s ON s.id = dst) SELECT n.project_id, call_name, min(v.id) AS to_symbol_id FROM n LEFT JOIN v ON v.project_id = n.project_id AND v.name = call_name GROUP BY 1, 2", "files symbols calls")
def symbol_resolution(b: Bound) -> DataFrame:
    """Every name called from a project, resolved within that project."""
    v = _view(b)
    names = b.calls.join(v.select(F.col("id").alias("src"), "project_id"), "src").join(b.symbols.select(F.col("id").alias("dst"), F.col("name").alias("call_name")), "dst")
    return gov.resolve_symbols(names.select("project_id", "call_name"), v)


@query("WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e) SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS changes FROM s GROUP BY user_id, g")
def debounce_sessions(b: Bound) -> DataFrame:
    return sessions.debounce(b.table("events"), "user_id", "ts", "1 hour")
