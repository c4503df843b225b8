"""Greedy bins of rows in order. A bin closes when the next row would exceed its size, so where bins start follows from where the one before did.

A group of moderate size is walked in one task, from bin to bin by a search in its running totals. A larger one is never in one task: the running totals
of range partitions tell each row where a bin that starts there would end, by a lookup among buckets of totals; which of these rows are starts is found by
following pointers from the first row, twice as far each round. Both give the same bins.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.lineage import cut, removed, written
from weftline.operators.ordering import running

#: Rows of a group that one task walks, at most.
WALKED = 1_000_000


def _walk(order: str, size: str, most: float):
    def bins(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(order, "ascending"), (size, "ascending")], null_placement="at_start"))
        totals = np.cumsum(np.nan_to_num(table.column(size).cast(pa.float64()).to_numpy(zero_copy_only=False)))
        starts, at = [], 0
        while at < len(totals):
            starts.append(at)
            at = max(at + 1, int(np.searchsorted(totals, (totals[at - 1] if at else 0.0) + most, "right")))
        number = np.repeat(np.arange(len(starts)), np.diff([*starts, len(totals)]))
        return table.append_column("bin", pa.array(number, pa.int64()))

    return bins


def _starts(rows: DataFrame, group: list[str], most: float) -> DataFrame:
    """(group, _i, _next) of the rows (group, _i, _s, _v: place, running total, size) that bins start at; ``_next`` is where the next bin does, null at the end."""
    spot = lambda v: F.floor(v / most)
    ends = rows.select(*group, spot(F.col("_s")).alias("_b"), F.col("_s").alias("_at"), F.lit(0).alias("_asks"), "_i")
    limit = F.col("_s") - F.col("_v") + most
    asks = rows.select(*group, spot(limit).alias("_b"), limit.alias("_at"), F.lit(1).alias("_asks"), "_i")
    both = ends.unionByName(asks)
    # Backwards, so that the row behind is the last one seen; a row that just fills the bin comes before the question.
    back = Window.partitionBy(*group, "_b").orderBy(F.desc("_at"), F.desc("_asks"), F.desc("_i")).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("_found", F.last(F.when(F.col("_asks") == 0, F.col("_i")), ignorenulls=True).over(back)).where("_asks = 1")
    buckets = both.groupBy(*group, "_b").agg(F.min(F.when(F.col("_asks") == 0, F.col("_i"))).alias("_first"))
    later = Window.partitionBy(*group).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_later", F.last("_first", ignorenulls=True).over(later)).select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_b").alias("_gb"), "_later")
    same = reduce(lambda a, b: a & b, [F.col("_b") == F.col("_gb"), *[F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]])
    found = seen.join(buckets, same).select(*group, "_i", F.greatest(F.coalesce("_found", "_later"), F.when(F.coalesce("_found", "_later").isNotNull(), F.col("_i") + 1)).alias("_next"))
    key = F.struct(*group, F.lit(0).alias("_")).alias("g")
    jumps = written(found.select(key, "_i", F.col("_next").alias("_to")))
    steps = written(jumps)
    reached = written(rows.where("_i = 1").select(key, "_i"))
    while True:
        on = reached.join(jumps, ["g", "_i"]).where("_to is not null").select("g", F.col("_to").alias("_i"))
        wider = written(reached.union(on).distinct())
        if wider.count() == reached.count():
            break
        far = jumps.select("g", F.col("_i").alias("_to"), F.col("_to").alias("_far"))
        longer = written(jumps.join(far, ["g", "_to"]).where("_far is not null").select("g", "_i", F.col("_far").alias("_to")))
        removed(jumps)
        removed(reached)
        jumps, reached = longer, wider
    return cut(wider.join(steps, ["g", "_i"]).select(*[F.col(f"g.{c}").alias(c) for c in group], "_i", F.col("_to").alias("_next")))


def _chained(rows: DataFrame, order: str, size: str, most: float, group: list[str]) -> DataFrame:
    placed = cut(running(rows.withColumn("_v", F.coalesce(F.col(size), F.lit(0)).cast("double")), group, [order, size], "_v", "_i", "_s"))
    starts = _starts(placed.select(*group, "_i", "_s", "_v"), group, most)
    numbered = running(starts.withColumn("_one", F.lit(1)), group, ["_i"], "_one", "_k", "_t")
    ends = placed.groupBy(*group).agg(F.max("_i").alias("_n")).select(*[F.col(c).alias(f"_g_{c}") for c in group], "_n")
    same = reduce(lambda a, b: a & b, [F.lit(True), *[F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]])
    inside = numbered.join(ends, same) if group else numbered.join(F.broadcast(ends))  # one row without groups
    each = inside.select(*[F.col(c).alias(f"_h_{c}") for c in group], (F.col("_k") - 1).alias("bin"), F.explode(F.sequence(F.col("_i"), F.coalesce(F.col("_next") - 1, F.col("_n")))).alias("_j"))
    match = reduce(lambda a, b: a & b, [F.col("_i") == F.col("_j"), *[F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in group]])
    return placed.join(each, match).select(*rows.columns, F.col("bin").cast("long").alias("bin"))


def pack(sizes: DataFrame, order: str, size: str, most: float, group: list[str] | None = None, walked: int | None = None) -> DataFrame:
    """``sizes`` with ``bin``, from 0 in each group: greedy bins of a group's rows in order. A larger row than ``most`` sits alone. Sizes aren't negative; a null one is 0."""
    group, walked = group or [], WALKED if walked is None else walked
    counts = sizes.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    large = cut(counts.where(F.col("_rows") > walked).drop("_rows").withColumn("_large", F.lit(True)))
    schema = T.StructType([*sizes.schema.fields, T.StructField("bin", T.LongType())])
    if large.isEmpty():
        return sizes.groupBy(*group).applyInArrow(_walk(order, size, most), schema)
    if not group:
        return _chained(sizes, order, size, most, group)
    same = reduce(lambda a, b: a & b, [sizes[c].eqNullSafe(large[c]) for c in group])
    small = sizes.join(large, same, "left_anti").groupBy(*group).applyInArrow(_walk(order, size, most), schema)
    return small.unionByName(_chained(sizes.join(large, same, "left_semi"), order, size, most, group))
