"""Sorted results: ranks over a whole table, and ordered merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.lineage import cut


def ranked(df: DataFrame, order: list, rank: str = "rank") -> DataFrame:
    """Gapless ranks from 1 in a total order, by a range-partitioned sort: tasks number their own rows and add what lies before them."""
    rows = cut(df.orderBy(*order).select("*", F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))  # one row for each partition
    return rows.withColumn("_part", part).join(starts, "_part").withColumn(rank, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_at", "_before")


def running(df: DataFrame, group: list[str], order: list[str], value: str, rank: str = "rank", total: str = "total") -> DataFrame:
    """``df`` with each row's place (from 1) in its group's order and the sum of ``value`` up to it, whatever a group's size: sums of range partitions run over a small table. Equal rows of the order come in any order."""
    at = F.monotonically_increasing_id()
    sorted_rows = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    rows = cut(sorted_rows.withColumn("_part", F.shiftright(at, 33)).withColumn("_row", at))
    sums = rows.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    along = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", *group, F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(along), F.lit(0)).alias("_s0"))
    own = Window.partitionBy("_part", *group).orderBy("_row")
    placed = rows.withColumn(rank, F.row_number().over(own)).withColumn(total, F.sum(value).over(own))
    before = sums.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g_{c}") for c in group], "_n0", "_s0")
    same = F.col("_part") == F.col("_p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    out = placed.join(before, same)
    return out.withColumn(rank, F.col(rank) + F.col("_n0")).withColumn(total, F.col(total) + F.col("_s0")).select(*df.columns, rank, total)


def merged(tables: list[DataFrame], order: list, rank: str = "rank") -> DataFrame:
    """All rows of tables with the same columns, in one order; tables that don't fit fail before anything runs."""
    if any(t.dtypes != tables[0].dtypes for t in tables):
        raise ValueError("the tables have different columns")
    return ranked(reduce(DataFrame.union, tables), order, rank)


def gathered(tables: list[DataFrame], order: list[str], rank: str = "rank") -> DataFrame:
    """The rows of parts that follow one another, with their place over all parts. A part that doesn't begin where the one before ends, or has other columns, fails before anything is returned."""
    if any(t.dtypes != tables[0].dtypes for t in tables):
        raise ValueError("the parts have different columns")
    parts = reduce(DataFrame.union, [t.withColumn("_src", F.lit(k)) for k, t in enumerate(tables)])
    ends = parts.groupBy("_src").agg(F.min(F.struct(*order)).alias("lo"), F.max(F.struct(*order)).alias("hi"))  # one row a part
    before = Window.orderBy("_src").rowsBetween(Window.unboundedPreceding, -1)
    wrong = ends.withColumn("_before", F.max("hi").over(before)).where("lo < _before").first()
    if wrong is not None:
        raise ValueError(f"part {wrong['_src']} begins before an earlier one ends")
    return ranked(parts, ["_src", *order], rank).drop("_src")
