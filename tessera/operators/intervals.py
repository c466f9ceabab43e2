"""Which ranges overlap which, by dyadic cells: a range is the least set of cells, two
of each size at most, that cover it, and a point lies in one cell of each size. So a
point is in a range where a cell of it is one of the range's, which is an equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 32


def cover(first: Column, last: Column) -> Column:
    """The cells (level, cell) of the whole numbers from ``first`` to ``last``, from 0 up."""
    def at(k: Column) -> Column:
        low = F.expr("1L").cast("long")
        width = F.call_function("shiftleft", low, k.cast("int"))
        left, right = F.floor((first.cast("long") + width - 1) / width), F.floor((last.cast("long") + 1) / width)
        cell = lambda c: F.struct(k.cast("int").alias("level"), c.cast("long").alias("cell"))
        odd = lambda c: c % 2 == 1
        return F.concat(F.when((left < right) & odd(left), F.array(cell(left))).otherwise(F.array()), F.when((left < right) & odd(right), F.array(cell(right - 1))).otherwise(F.array()))

    return F.when(first <= last, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), at)))


def cells(point: Column) -> Column:
    """The cells that the point lies in."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.struct(k.cast("int").alias("level"), F.call_function("shiftright", point.cast("long"), k.cast("int")).alias("cell")))


def overlapping(ranges: DataFrame, others: DataFrame, group: str, own: tuple[str, str, str]) -> DataFrame:
    """Ids of the ranges that overlap one of ``others`` in the same group. ranges: the
    columns ``own`` (id, first, last) and group; others: group, first, last. Two ranges
    overlap if one begins in the other; each side is looked up as a set of cells, so
    work grows with the rows and not with the pairs."""
    id_, first, last = own
    near = ranges.where(F.col(first) <= F.col(last)).join(others.select(group).distinct(), group, "left_semi")
    spread = lambda df, what: df.withColumn("_c", F.explode(what)).select("*", "_c.level", "_c.cell")
    key = [group, "level", "cell"]
    points = spread(others.where("first <= last").select(group, "first").distinct(), cells(F.col("first"))).select(*key).distinct()
    begun_in = spread(near.select(id_, group, first, last), cover(F.col(first), F.col(last))).join(points, key, "left_semi").select(id_)
    covers = spread(others.where("first <= last").select(group, "first", "last").distinct(), cover(F.col("first"), F.col("last"))).select(*key).distinct()
    begin_in = spread(near.select(id_, group, first), cells(F.col(first))).join(covers, key, "left_semi").select(id_)
    return begun_in.union(begin_in).distinct()
