"""Change detection between snapshots and incremental application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detect_changes(old: DataFrame, new: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """(key, status): added, deleted, modified or unchanged, by one full join. A row
    is modified if a compared column differs; nulls are equal to nulls."""
    o = old.select(F.col(key).alias("_ok"), *[F.col(c).alias(f"_o{c}") for c in compare])
    n = new.select(F.col(key).alias("_nk"), *[F.col(c).alias(f"_n{c}") for c in compare])
    differs = F.lit(False)
    for c in compare:
        differs |= ~F.col(f"_o{c}").eqNullSafe(F.col(f"_n{c}"))
    status = F.when(F.col("_ok").isNull(), "added").when(F.col("_nk").isNull(), "deleted").when(differs, "modified").otherwise("unchanged")
    return o.join(n, F.col("_ok") == F.col("_nk"), "full").select(F.coalesce("_ok", "_nk").alias(key), status.alias("status"))


def apply_changes(old: DataFrame, new: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The next snapshot: unchanged rows as they were, added and modified ones as they are."""
    same = changes.where("status = 'unchanged'").select(key)
    fresh = changes.where("status in ('added', 'modified')").select(key)
    return old.join(same, key, "left_semi").unionByName(new.join(fresh, key, "left_semi"))


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows)


def detach(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges after symbols (a column id) were deleted: their ends become null."""
    g = gone.select("id").distinct()
    f = g.select(F.col("id").alias("_f"))
    t = g.select(F.col("id").alias("_t"))
    rows = edges.join(f, edges.from_symbol_id == F.col("_f"), "left").join(t, edges.to_symbol_id == F.col("_t"), "left")
    ends = {"from_symbol_id": "_f", "to_symbol_id": "_t"}
    return rows.select(*[F.when(F.col(ends[c]).isNull(), F.col(c)).alias(c) if c in ends else F.col(c) for c in edges.columns])
