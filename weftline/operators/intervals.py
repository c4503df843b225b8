"""Algebra of closed intervals by contig: pad, union, intersection, complement, difference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.lineage import cut
from weftline.operators import merge_intervals


def bin_width(*lists: DataFrame, lo: str = "lo", hi: str = "hi") -> int:
    """The mean length of the intervals, so that they fill about two bins each."""
    total, n = 0, 0
    for df in lists:
        row = df.agg(F.sum(F.col(hi) - F.col(lo) + 1), F.count(F.lit(1))).first()
        total, n = total + (row[0] or 0), n + row[1]
    return max(1, -(-int(total) // max(1, n)))


def pad(df: DataFrame, by: int, lo: str = "lo", hi: str = "hi", contig: list[str] | None = None) -> DataFrame:
    wider = df.withColumn(lo, F.col(lo) - by).withColumn(hi, F.col(hi) + by)
    return merge_intervals(wider, lo, hi, contig, 1)


def intersect(a: DataFrame, b: DataFrame, lo: str = "lo", hi: str = "hi", contig: list[str] | None = None) -> DataFrame:
    """Points in both lists, as disjoint intervals: an equi-join on bins; a pair counts in the bin where it starts to overlap."""
    contig = contig or []
    return _overlaps(merge_intervals(a, lo, hi, contig, 1), merge_intervals(b, lo, hi, contig, 1), lo, hi, contig)


def _overlaps(a: DataFrame, b: DataFrame, lo: str, hi: str, contig: list[str]) -> DataFrame:
    """``intersect`` of lists that are disjoint already."""
    a, b = cut(a), cut(b)  # each is read twice
    width = bin_width(a, b, lo=lo, hi=hi)

    def binned(df: DataFrame, name: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))
        return df.select(*contig, F.col(lo).alias(f"{name}_lo"), F.col(hi).alias(f"{name}_hi"), F.explode(bins).alias("_bin"))

    both = binned(a, "_a").join(binned(b, "_b"), [*contig, "_bin"])
    both = both.select(*contig, "_bin", F.greatest("_a_lo", "_b_lo").alias(lo), F.least("_a_hi", "_b_hi").alias(hi))
    return both.where((F.col(lo) <= F.col(hi)) & (F.floor(F.col(lo) / width) == F.col("_bin"))).drop("_bin")


def invert(df: DataFrame, extent: DataFrame, lo: str = "lo", hi: str = "hi", contig: list[str] | None = None) -> DataFrame:
    """The gaps that ``df`` leaves within each contig's ``extent`` (contig, lo, hi: one row each)."""
    contig = contig or []
    ends = extent.select(*contig, F.col(lo).alias("_from"), F.col(hi).alias("_to"))
    # An interval that ends before the extent, and one that begins after it, frame the gaps.
    frame = ends.select(*contig, (F.col("_from") - 1).alias(lo), (F.col("_from") - 1).alias(hi)).union(ends.select(*contig, (F.col("_to") + 1).alias(lo), (F.col("_to") + 1).alias(hi)))
    after = Window.partitionBy(*contig).orderBy(lo, hi)
    framed = merge_intervals(df.select(*contig, lo, hi).union(frame), lo, hi, contig, 1)
    gaps = framed.select(*contig, (F.col(hi) + 1).alias("_gap_lo"), (F.lead(lo).over(after) - 1).alias("_gap_hi")).where("_gap_hi is not null")
    gaps = gaps.join(ends, contig) if contig else gaps.join(F.broadcast(ends))
    gaps = gaps.select(*contig, F.greatest("_gap_lo", "_from").alias(lo), F.least("_gap_hi", "_to").alias(hi))
    return gaps.where(F.col(lo) <= F.col(hi))


def subtract(a: DataFrame, b: DataFrame, lo: str = "lo", hi: str = "hi", contig: list[str] | None = None) -> DataFrame:
    """Points of ``a`` that aren't in ``b``."""
    extent = a.groupBy(*(contig or [])).agg(F.min(lo).alias(lo), F.max(hi).alias(hi))
    return _overlaps(merge_intervals(a, lo, hi, contig or [], 1), invert(b, extent, lo, hi, contig), lo, hi, contig or [])
