"""Roles, entry points, modules and bands of a bound graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import code
from . import graph
from .ordinals import ordinals


def exported_names(symbols: DataFrame) -> DataFrame:
    """Names exported by a signature, body, qualified name or the name itself."""
    c = F.col
    hit = c("signature").startswith("export ") | c("body").startswith("export ") | c("qualified_name").startswith("export/") | c("name").startswith("module.exports")
    return symbols.where(hit).select("name").distinct()


def classify_roles(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, name, kind, role). The averages are over symbols with a call (one row, broadcast)."""
    deg = graph.degrees(calls)
    avg = deg.agg(F.coalesce(F.avg("in_degree"), F.lit(0.0)).alias("_ai"), F.coalesce(F.avg("out_degree"), F.lit(0.0)).alias("_ao"))
    exported = exported_names(symbols).withColumn("_e", F.lit(True))
    rows = symbols.join(deg, "id", "left").join(exported, "name", "left").join(F.broadcast(avg))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    role = code.role(F.col("name"), F.col("kind"), zero("in_degree"), zero("out_degree"), F.col("_ai"), F.col("_ao"), F.coalesce("_e", F.lit(False)))
    return rows.select("id", "name", "kind", role.alias("role"))


def role_summary(roles: DataFrame) -> DataFrame:
    """All seven roles with their counts, zero where a role is missing."""
    known = roles.sparkSession.createDataFrame([(r,) for r in code.ROLES], "role string")
    return known.join(roles.groupBy("role").agg(F.count("*").alias("n")), "role", "left").select("role", F.coalesce("n", F.lit(0)).alias("symbols"))


def dead_code(roles: DataFrame, symbols_v: DataFrame, limit: int | None = 30) -> DataFrame:
    dead = roles.where("role = 'dead'").select("id")
    rows = symbols_v.join(dead, "id", "left_semi").select("id", "name", "kind", "relative_path", "start_line").orderBy("id")
    return rows.limit(limit) if limit else rows


def entry_points(symbols_v: DataFrame, roles: DataFrame, limit: int = 20) -> DataFrame:
    """By tiers: role, name, file, body; a symbol counts in its first tier. Within the
    first tier by line, else by path and line."""
    v = symbols_v.join(roles.select("id", "role"), "id")
    callable_ = F.col("kind").isin("function", "method", "class")
    tier = (
        F.when(F.col("role") == "entry", 1)
        .when(callable_ & F.col("name").rlike(code.ENTRY_NAMES), 2)
        .when(callable_ & F.col("relative_path").rlike(code.ENTRY_FILES), 3)
        .when(callable_ & F.col("body").rlike(code.ENTRY_BODIES), 4)
    )
    found = v.withColumn("tier", tier).where(F.col("tier").isNotNull() & ~F.col("name").isin(code.STOP_WORDS))
    order = ["tier", F.when(F.col("tier") > 1, F.col("relative_path")), "start_line", "id"]
    return found.orderBy(*order).limit(limit).select("id", "name", "kind", "relative_path", "start_line", "tier")


def entry_points_api(symbols_v: DataFrame, roles: DataFrame, limit: int = 30) -> DataFrame:
    """The one-filter form: names and file names in either case."""
    v = symbols_v.join(roles.select("id", "role"), "id")
    name, path = F.lower("name"), F.lower("relative_path")
    hit = (F.col("role") == "entry") | name.isin(code.API_NAMES)
    for s in code.API_SUFFIXES:
        hit |= name.endswith(s)
    for s in code.API_FILES:
        hit |= path.endswith(s)
    rows = v.where(hit & F.col("kind").isin("function", "method", "class")).select("name", "kind", "relative_path", "start_line").distinct()
    return rows.orderBy("relative_path", "start_line", "name", "kind").limit(limit).where(~F.col("name").isin(code.STOP_WORDS))


def module_communities(files: DataFrame) -> DataFrame:
    """(id, module, community): communities are numbered as their first file comes."""
    keyed = files.select("id", code.module_key(F.col("relative_path")).alias("module"))
    first = keyed.groupBy("module").agg(F.min("id").alias("_f"))
    numbered = first.join(ordinals(first, "_f", "community"), "_f").select("module", "community")
    return keyed.join(numbered, "module").select("id", "module", "community")


def community_list(members: DataFrame, least: int = 0, contains: str = "", sort: str = "id") -> DataFrame:
    """(prefix, community, name, size): the communities of a list of (community, name),
    a row a member, with at least ``least`` members and a text in their name. The
    prefix is what comes before the first ``·`` or ``/`` of the name, ``_`` without one.
    sort: id, name, count-desc or count-asc."""
    orders = {"id": ["community"], "name": ["name", "community"], "count-desc": [F.desc("size"), "community"], "count-asc": ["size", "community"]}
    if sort not in orders:
        raise ValueError(f"unknown order {sort}; use {', '.join(orders)}")
    sized = members.groupBy("community").agg(F.max("name").alias("name"), F.count("*").alias("size")).where((F.col("size") >= least) & F.lower("name").contains(contains.lower()))
    before = lambda mark: F.when(F.col("name").contains(mark), F.substring_index("name", mark, 1))
    prefix = F.coalesce(before("·"), before("/"), F.lit("_"))
    return sized.select(prefix.alias("prefix"), "community", "name", "size").orderBy(*orders[sort])


def node_bands(imports: DataFrame, files: DataFrame) -> DataFrame:
    f = graph.fan(imports, files)
    return f.select("id", "fan_in", "fan_out", code.band(F.col("fan_in") + F.col("fan_out")).alias("band"))


def hotspots(imports: DataFrame, files: DataFrame, limit: int = 8) -> DataFrame:
    f = graph.fan(imports, files).where("fan_in > 0")
    return f.join(files, "id").select("id", "relative_path", "fan_in").orderBy(F.desc("fan_in"), "id").limit(limit)
