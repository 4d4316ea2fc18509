"""Joins that an array index stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def required(value: Column, message: str, kind: str = "long") -> Column:
    """``value``, or an error where it is null."""
    return F.coalesce(value, F.raise_error(F.lit(message)).cast(kind))


def looked_up(df: DataFrame, index: str, table: DataFrame, key: str, value: str, out: str, message: str | None = None, kind: str = "long") -> DataFrame:
    """``df`` with ``out``, the ``value`` of ``table`` where ``key`` is ``df``'s ``index``; an index beyond is an error.

    The side to broadcast is the planner's choice, by size.
    """
    side = table.select(F.col(key).alias("_k"), F.col(value).alias(out))
    joined = df.join(side, F.col(index) == F.col("_k"), "left").drop("_k")
    return joined.withColumn(out, required(F.col(out), message, kind)) if message else joined


def extents(directories: DataFrame, entries: int | Column) -> DataFrame:
    """``directories`` with ``next_entry``: entries [first_entry, next_entry) are a directory's; ``entries``: their number."""
    after = directories.select((F.col("inode") - 1).alias("inode"), F.col("first_entry").alias("next_entry"))
    end = entries if isinstance(entries, Column) else F.lit(entries)
    return directories.join(after, "inode", "left").withColumn("next_entry", F.coalesce("next_entry", end).cast("long"))


def members(extended: DataFrame) -> DataFrame:
    """``parent, entry`` of each entry of each extent: an equi-join key in place of a range join."""
    some = extended.filter("next_entry > first_entry")
    return some.select(F.col("inode").alias("parent"), F.explode(F.sequence(F.col("first_entry"), F.col("next_entry") - 1)).alias("entry"))


def first_writers(files: DataFrame, content: str, order: str, name: str) -> DataFrame:
    """``files`` with ``writer`` (the ``name`` of the first of its ``content`` by ``order``) and ``is_writer``."""
    first = files.groupBy(content).agg(F.min(F.struct(order, name)).alias("_f"))
    return files.join(first, content).withColumn("writer", F.col(f"_f.{name}")).withColumn("is_writer", F.col(f"_f.{order}") == F.col(order)).drop("_f")


def offsets_by_kind(inodes: DataFrame, kinds: dict[str, list[str]], total: Column) -> DataFrame:
    """One row: for each name, the first inode of its kinds, or ``total``."""
    return inodes.agg(*[F.coalesce(F.min(F.when(F.col("kind").isin(k), F.col("inode"))), total).alias(n) for n, k in kinds.items()])


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """The distinct values with where they are first seen."""
    return df.groupBy(value).agg(F.min(order).alias("first_seen"))


def page(listing: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of one directory's listing by ``order``, with ``cookie`` to go on from."""
    numbered = listing.withColumn("cookie", F.row_number().over(W.orderBy(order)))
    return numbered.filter((F.col("cookie") > offset) & (F.col("cookie") <= offset + limit))
