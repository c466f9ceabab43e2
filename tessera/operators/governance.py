"""Rules, decision records, co-change and changes between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import cut, rows, small_enough
from . import graph
from .intervals import overlapping

# The metrics that rules may name.
METRICS = ("max_cyclomatic", "max_cognitive", "avg_cyclomatic", "max_file_symbols", "dead_symbol_count", "total_symbols", "max_dead_ratio")


def measures(symbols: DataFrame, roles: DataFrame) -> DataFrame:
    """(metric, value) of all symbols: one pass over them, one over files' counts."""
    joined = symbols.join(roles.select("id", "role"), "id")
    per_file = joined.groupBy("file_id").agg(
        F.count("*").alias("n"), F.max("complexity_cyclomatic").alias("mc"), F.sum("complexity_cyclomatic").alias("sc"), F.max("complexity_cognitive").alias("mg"), F.count_if(F.col("role") == "dead").alias("d")
    )
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    one = per_file.agg(
        zero(F.max("mc")).alias("max_cyclomatic"), zero(F.max("mg")).alias("max_cognitive"), zero(F.sum("sc") / F.nullif(F.sum("n"), F.lit(0))).alias("avg_cyclomatic"), zero(F.max("n")).alias("max_file_symbols"),
        zero(F.sum("d")).alias("dead_symbol_count"), zero(F.sum("n")).alias("total_symbols"), zero(F.sum("d") / F.nullif(F.sum("n"), F.lit(0))).alias("max_dead_ratio"),
    )
    return one.unpivot([], list(METRICS), "metric", "value")


def manifesto_check(rules: DataFrame, values: DataFrame) -> DataFrame:
    """(rule_name, metric, value, status): FAIL or WARN from a threshold on, which
    counts only if it is set; SKIP for an unknown metric."""
    at_least = lambda t: F.col(t).isNotNull() & (F.col("value") >= F.col(t))
    status = F.when(F.col("value").isNull(), "SKIP").when(at_least("fail_threshold"), "FAIL").when(at_least("warn_threshold"), "WARN").otherwise("PASS")
    return rules.join(values, "metric", "left").select("rule_name", "metric", F.round("value", 6).alias("value"), status.alias("status"))


def overall(checked: DataFrame) -> DataFrame:
    """The worst status, one row."""
    worst = F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0))
    return checked.agg(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL"))[F.coalesce(worst, F.lit(0))].alias("status"))


def add_rule(rules: DataFrame, rule: DataFrame) -> DataFrame:
    """Adds a rule, in place of one with the same name."""
    return rules.join(rule.select("rule_name"), "rule_name", "left_anti").unionByName(rule)


def remove_rule(rules: DataFrame, name: str) -> DataFrame:
    return rules.where(F.col("rule_name") != name)


def adr_next(adrs: DataFrame) -> DataFrame:
    return adrs.agg((F.coalesce(F.max("number"), F.lit(0)) + 1).alias("number"))


def adr_create(adrs: DataFrame, title: str, context: str | None = None, decision: str | None = None, consequences: str | None = None, status: str = "proposed") -> DataFrame:
    new = adr_next(adrs).select("number", *[F.lit(v).cast("string").alias(k) for k, v in (("title", title), ("status", status), ("context_text", context), ("decision", decision), ("consequences", consequences))])
    return adrs.unionByName(new, allowMissingColumns=True)


def adr_update(adrs: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: number and new values; a null leaves the old one."""
    fields = [c for c in changes.columns if c != "number"]
    c = changes.select("number", *[F.col(f).alias(f"_{f}") for f in fields])
    return adrs.join(c, "number", "left").select(*[F.coalesce(f"_{x}", x).alias(x) if x in fields else F.col(x) for x in adrs.columns])


def adr_list(adrs: DataFrame, status: str = "") -> DataFrame:
    return (adrs.where(F.col("status") == status) if status else adrs).orderBy("number")


FILES_A_BLOCK, A_TASK = 256, 1_000_000  # rows or pairs of a task


def tasks_for(df: DataFrame, n: int) -> int:
    """As many as Spark is set to, or more, so that a task's share doesn't grow with the input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // A_TASK))


def commit_files(commits: DataFrame) -> DataFrame:
    """(commit, file, size): each file of a commit once, with the number of them."""
    dealt = commits.select("commit", "file").dropna()
    dealt = dealt.repartition(tasks_for(dealt, commits.count()), "commit").distinct()
    return dealt.withColumn("size", F.count("*").over(Window.partitionBy("commit")))


def blocks(files: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The two sides that ``commit_blocks`` describes, of ``commit_files``."""
    n = F.ceil(F.col("size") / F.lit(most)).cast("int")
    dealt = files.withColumn("_n", n).withColumn("_b", F.pmod(F.xxhash64("file"), F.col("_n")).cast("int"))
    left = dealt.select("commit", F.col("_b").alias("i"), F.explode(F.sequence("_b", F.col("_n") - 1)).alias("j"), "file")
    right = dealt.select("commit", F.explode(F.sequence(F.lit(0), "_b")).alias("i"), F.col("_b").alias("j"), "file")
    return left, right


def commit_blocks(commits: DataFrame, most: int = FILES_A_BLOCK) -> tuple[DataFrame, DataFrame]:
    """A commit's files as two sides of (commit, i, j, file) with i <= j: files are dealt
    into blocks of about ``most``, and block i stands against each block j from itself on.
    So a commit of very many files is many tasks, of two blocks each."""
    return blocks(commit_files(commits), most)


def cochange(commits: DataFrame, limit: int | None = 200, most: int = FILES_A_BLOCK) -> DataFrame:
    """(file1, file2, n): pairs of files by how many commits change both. commits:
    commit, file. Blocks of a commit's files are brought together, each pair of blocks once, in as
    many tasks as the number of pairs asks for; each task adds up its pairs before they
    are dealt by file."""
    files = cut(commit_files(commits), "commits")
    tasks = tasks_for(files, files.agg(F.coalesce(F.sum(F.col("size") - 1), F.lit(0))).first()[0] // 2)
    slot = F.pmod(F.xxhash64("commit", "i", "j"), F.lit(16 * tasks))  # so many that tasks get even shares
    left, right = blocks(files, most)
    none = F.lit(None).cast(files.schema["file"].dataType)
    sides = left.withColumn("_l", F.col("file")).withColumn("_r", none).union(right.where("i < j").withColumn("_l", none).withColumn("_r", F.col("file")))
    met = sides.withColumn("_s", slot).repartition(tasks, "_s").groupBy("_s", "commit", "i", "j").agg(F.collect_list("_l").alias("_l"), F.collect_list("_r").alias("_r"))  # two blocks at most
    other = F.when(F.col("i") < F.col("j"), F.col("_r")).otherwise(F.col("_l"))
    each = met.select("_s", "i", "j", F.explode("_l").alias("file"), other.alias("_o")).select("_s", "i", "j", "file", F.explode("_o").alias("_other"))
    both = each.where((F.col("i") < F.col("j")) | (F.col("file") < F.col("_other")))
    added = both.groupBy("_s", F.least("file", "_other").alias("file1"), F.greatest("file", "_other").alias("file2")).agg(F.count("*").alias("n"))
    counts = added.repartition(tasks, "file1", "file2").groupBy("file1", "file2").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "file1", "file2").limit(limit) if limit else counts


def of_known_files(commits: DataFrame, files: DataFrame) -> DataFrame:
    """The commits without the files that are not among ``files`` (a column id)."""
    missing = cut(commits.select("file").distinct().join(files.select(F.col("id").alias("file")), "file", "left_anti"), "missing")
    return commits.join(small_enough(missing), "file", "left_anti") if rows(missing) else commits


def cochange_files(pairs: DataFrame, files: DataFrame, limit: int = 50) -> DataFrame:
    """The most frequent pairs (file1, file2, n) with both files' paths and languages."""
    of = lambda k: files.select(F.col("id").alias(f"file{k}"), F.col("relative_path").alias(f"path{k}"), F.col("language").alias(f"language{k}"))
    named = pairs.join(of(1), "file1").join(of(2), "file2")
    return named.orderBy(F.desc("n"), "file1", "file2").limit(limit).select("path1", "language1", "path2", "language2", "n")


HUNK = r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def parse_hunks(diffs: DataFrame, diff_col: str = "diff") -> DataFrame:
    """New-side ranges of unified diffs: other columns, start, count. A missing count is 1; ranges of 0 lines go."""
    found = F.arrays_zip(F.regexp_extract_all(diff_col, F.lit(HUNK), F.lit(1)).alias("s"), F.regexp_extract_all(diff_col, F.lit(HUNK), F.lit(2)).alias("c"))
    rest = [c for c in diffs.columns if c != diff_col]
    rows = diffs.select(*rest, F.explode(found).alias("h"))
    count = F.when(F.col("h.c") == "", F.lit(1)).otherwise(F.try_to_number(F.nullif(F.col("h.c"), F.lit("")), F.lit("999999999"))).cast("long")
    return rows.select(*rest, F.col("h.s").cast("int").alias("start"), count.alias("count")).where("count > 0")


def diff_symbols(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """Symbols whose lines a changed range overlaps. hunks: file_id, start, count."""
    changed = hunks.where("count > 0").select("file_id", F.col("start").alias("first"), (F.col("start") + F.col("count") - 1).alias("last"))
    hit = overlapping(symbols.select("id", "file_id", "start_line", "end_line"), changed, "file_id", ("id", "start_line", "end_line"))
    return symbols.join(hit, "id", "left_semi").select("id", "name", "kind", "file_id")


def diff_impact(symbols: DataFrame, hunks: DataFrame, calls: DataFrame, depth: int = 3) -> DataFrame:
    """(id, depth): what calls the changed symbols, without those."""
    changed = diff_symbols(symbols, hunks).select(F.col("id").alias("node"))
    found = graph.reach(calls, changed, depth, "up")
    return found.join(symbols.select("id"), found.node == F.col("id")).select("id", "depth")


def branch_compare(status_lines: DataFrame, symbols_v: DataFrame) -> DataFrame:
    """(id, name, relative_path, change) of the symbols in files added, modified or
    deleted; ``line`` is a name-status line, whose last field is the path. Renames are passed over."""
    change = F.element_at(F.create_map(F.lit("A"), F.lit("added"), F.lit("M"), F.lit("modified"), F.lit("D"), F.lit("deleted")), F.substring("line", 1, 1))
    rows = status_lines.select(change.alias("change"), F.element_at(F.split("line", "\t"), -1).alias("relative_path")).where("change is not null").distinct()
    return symbols_v.join(rows, "relative_path").select("id", "name", "relative_path", "change")


def import_candidates(path: Column, target: Column) -> Column:
    """The files a relative import may mean, in order of precedence; [] if it is not relative."""
    extensions = ("ts", "tsx", "js", "jsx", "mts", "cts", "mjs")  # fixed values, in this order
    folder = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    parts = F.concat(folder, F.split(target, "/"))
    step = lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    base = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    plain = [F.concat(base, F.lit(f".{e}")) for e in extensions]
    index = [F.concat(base, F.lit(f"/index.{e}")) for e in extensions]
    swapped = F.when(target.endswith(".js"), F.concat(F.substring(base, F.lit(1), F.length(base) - 3), F.lit(".ts")))
    return F.when(target.startswith("."), F.filter(F.array(*plain, *index, swapped), lambda c: c.isNotNull())).otherwise(F.array().cast("array<string>"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, target, to_file_id): the first candidate that is a file of the project, or null. imports: file_id, target."""
    f = files.select(F.col("id").alias("file_id"), "project_id", "relative_path")
    rows = imports.distinct().join(f, "file_id")
    tried = rows.select("file_id", "project_id", "target", F.posexplode(import_candidates(F.col("relative_path"), F.col("target"))).alias("k", "candidate"))
    known = files.select("project_id", F.col("relative_path").alias("candidate"), "id")
    best = tried.join(known, ["project_id", "candidate"]).groupBy("file_id", "target").agg(F.min(F.struct("k", "id"))["id"].alias("to_file_id"))
    return rows.select("file_id", "target").join(best, ["file_id", "target"], "left")


def resolve_symbols(names: DataFrame, symbols_v: DataFrame) -> DataFrame:
    """(project_id, call_name, to_symbol_id): the project's symbol of that name with the least id, or null. names: project_id, call_name."""
    first = symbols_v.groupBy("project_id", F.col("name").alias("call_name")).agg(F.min("id").alias("to_symbol_id"))
    return names.distinct().join(first, ["project_id", "call_name"], "left")
