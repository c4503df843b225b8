"""Coverage by position as a sweep: intervals become +1 and -1 events, and running totals over the events are the depth.

There is no row for a covered position, so the work is linear in the intervals however long they are. The positions of a
contig are dealt to bins; a bin's events are combined before they meet, the totals of bins run over a small table, and each bin
then runs over its own events from what lies before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.lineage import cut

#: Positions of a bin.
BIN = 1 << 16


def joined(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """``a`` with the other columns of ``b``, where all of ``on`` are equal or null in both."""
    named = b.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in b.columns if c not in on])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return a.join(named, same).drop(*[f"_on_{c}" for c in on])


def _events(df: DataFrame, contig: list[str], lo: str, hi: str, weight: int) -> DataFrame:
    spans = df.where(F.col(lo) <= F.col(hi))
    edges = F.array(F.struct(F.col(lo).cast("long").alias("at"), F.lit(weight).alias("delta")), F.struct((F.col(hi).cast("long") + 1).alias("at"), F.lit(-weight).alias("delta")))
    return spans.select(*contig, F.explode(edges).alias("_e")).select(*contig, "_e.at", "_e.delta")


def depth_runs(df: DataFrame, contig: list[str], lo: str = "lo", hi: str = "hi", borders: DataFrame | None = None, bin_size: int = BIN) -> DataFrame:
    """(contig, lo, hi, depth): runs of positions that equally many of the closed intervals cover, from a contig's first event to its last.

    Runs touch: between islands lie runs of depth 0. With ``borders`` (contig, lo, hi) runs also begin where one of these begins and behind its
    end, so that each is tiled by whole runs, at depth 0 where nothing covers it. An interval that ends before it starts covers nothing.
    """
    events = _events(df, contig, lo, hi, 1)
    if borders is not None:
        events = events.unionByName(_events(borders, contig, lo, hi, 0))
    points = events.groupBy(*contig, "at").agg(F.sum("delta").alias("delta"), F.bool_or(F.col("delta") == 0).alias("border"))
    points = cut(points.where("delta <> 0 or border").withColumn("bin", F.floor(F.col("at") / bin_size)))
    bins = points.groupBy(*contig, "bin").agg(F.sum("delta").alias("total"), F.min("at").alias("first"))
    along = Window.partitionBy(*contig).orderBy("bin")
    bins = bins.select(*contig, "bin", (F.sum("total").over(along) - F.col("total")).alias("before"), F.lead("first").over(along).alias("next"))
    own = Window.partitionBy(*contig, "bin").orderBy("at")
    ends = F.coalesce(F.lead("at").over(own), F.col("next")) - 1
    runs = joined(points, bins, [*contig, "bin"]).select(*contig, F.col("at").alias(lo), ends.alias(hi), (F.col("before") + F.sum("delta").over(own)).alias("depth"))
    return runs.where(F.col(hi).isNotNull())


def islands(df: DataFrame, contig: list[str], lo: str = "lo", hi: str = "hi", gap: int = 0, bin_size: int = BIN) -> DataFrame:
    """(contig, lo, hi): unions of closed intervals of whole numbers that overlap, or begin at most ``gap`` behind another's end.

    As for depths, bins of positions run by themselves from what lies before them; an island begins where the depth leaves 0, and ends where it comes back next,
    be it bins later. Intervals that end before they start are left out.
    """
    spans = df.where(F.col(lo) <= F.col(hi))
    # An end lies half a position behind its last one, so that what begins at the next position doesn't meet it.
    edges = F.array(F.struct((2 * F.col(lo).cast("long")).alias("at"), F.lit(1).alias("delta")), F.struct((2 * (F.col(hi).cast("long") + gap) + 1).alias("at"), F.lit(-1).alias("delta")))
    points = spans.select(*contig, F.explode(edges).alias("_e")).groupBy(*contig, F.col("_e.at").alias("at")).agg(F.sum("_e.delta").alias("delta")).withColumn("bin", F.floor(F.col("at") / (2 * bin_size)))
    along, own = Window.partitionBy(*contig).orderBy("bin"), Window.partitionBy(*contig, "bin").orderBy("at")
    bins = points.groupBy(*contig, "bin").agg(F.sum("delta").alias("total")).withColumn("before", F.sum("total").over(along) - F.col("total")).drop("total")
    rows = joined(points.withColumn("after", F.sum("delta").over(own)), bins, [*contig, "bin"]).withColumn("after", F.col("after") + F.col("before"))
    ends = rows.where((F.col("after") == 0) | (F.col("after") == F.col("delta")))
    firsts = ends.groupBy(*contig, "bin").agg(F.min("at").alias("first")).withColumn("next", F.lead("first").over(along)).drop("first")
    paired = joined(ends.withColumn("end", F.lead("at").over(own)), firsts, [*contig, "bin"])
    found = paired.where(F.col("after") == F.col("delta")).withColumn("end", F.coalesce("end", "next"))
    kinds = {c: df.schema[c].dataType for c in (lo, hi)}
    return found.select(*contig, F.floor(F.col("at") / 2).cast(kinds[lo]).alias(lo), (F.floor(F.col("end") / 2) - gap).cast(kinds[hi]).alias(hi))


def depth_histogram(runs: DataFrame, contig: list[str], lo: str = "lo", hi: str = "hi", most: int | None = None) -> DataFrame:
    """(contig, depth, positions): how many positions have a depth; depths above ``most`` count as that."""
    depth = F.least("depth", F.lit(most)) if most is not None else F.col("depth")
    return runs.groupBy(*contig, depth.alias("depth")).agg(F.sum(F.col(hi) - F.col(lo) + 1).alias("positions"))


def depth_summary(histogram: DataFrame, contig: list[str], at_least: list[int]) -> DataFrame:
    """(contig, positions, mean, sd, median, pct_<k>): of a histogram, which has one row for each depth of a contig."""
    so_far = Window.partitionBy(*contig).orderBy("depth")
    rows = histogram.withColumn("_below", F.sum("positions").over(so_far)).withColumn("_all", F.sum("positions").over(Window.partitionBy(*contig)))
    n, total = F.sum("positions"), F.sum(F.col("depth") * F.col("positions"))
    squares = F.sum(F.col("depth") * F.col("depth") * F.col("positions"))
    shares = [(F.sum(F.when(F.col("depth") >= k, F.col("positions")).otherwise(0)) / n).alias(f"pct_{k}") for k in at_least]
    return rows.groupBy(*contig).agg(
        n.alias("positions"), (total / n).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), squares / n - (total / n) * (total / n))).alias("sd"),
        F.min(F.when(2 * F.col("_below") >= F.col("_all"), F.col("depth"))).alias("median"), *shares,
    )


def target_depth(df: DataFrame, targets: DataFrame, key: list[str], contig: list[str], at_least: list[int], lo: str = "lo", hi: str = "hi", bin_size: int = BIN) -> DataFrame:
    """(key, positions, mean, least, most, pct_<k>) of each target: the depth over its positions, covered or not. Targets may overlap."""
    runs = depth_runs(df, contig, lo, hi, targets, bin_size).withColumn("_bin", F.floor(F.col(lo) / bin_size))
    goals = targets.where(F.col(lo) <= F.col(hi)).select(*contig, *[c for c in key if c not in contig], F.col(lo).alias("_from"), F.col(hi).alias("_to"))
    goals = goals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_from") / bin_size), F.floor(F.col("_to") / bin_size))))
    within = joined(runs, goals, [*contig, "_bin"]).where(F.col(lo).between(F.col("_from"), F.col("_to")))
    size = F.col(hi) - F.col(lo) + 1
    n = F.sum(size)
    shares = [(F.sum(F.when(F.col("depth") >= k, size).otherwise(0)) / n).alias(f"pct_{k}") for k in at_least]
    return within.groupBy(*key).agg(n.alias("positions"), (F.sum(F.col("depth") * size) / n).alias("mean"), F.min("depth").alias("least"), F.max("depth").alias("most"), *shares)
