"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import cut as materialize
from ..plans.storage import rows as rows_of
from ..plans.storage import shared_folder as scratch
from ..plans.storage import small_enough

__all__ = ["WORD", "materialize", "packed", "rows_of", "scratch", "small_batches", "small_enough", "table", "text_or_empty", "unpacked"]

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """While it holds, what runs hands batches of ``size`` at most to Python workers."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def packed(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, and all others out of the way in a struct ``_rest``."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in keep]
    return docs.select(*keep, (F.struct(*others) if others else F.lit(None)).alias("_rest"))


def unpacked(rows: DataFrame, like: DataFrame, keep: tuple[str, ...], **new: Column) -> DataFrame:
    """The columns of ``like`` out of packed rows, some of them new."""
    old = lambda c: F.col(c) if c in keep else F.col("_rest").getField(c)
    return rows.select(*[new[f.name].cast(f.dataType).alias(f.name) if f.name in new else old(f.name).alias(f.name) for f in like.schema])
