"""Joint view of several samples' records: variants at sites, and blocks that say that nothing was found over a stretch.

Every site that any sample varies at sees what each sample's records say there. Records meet sites by bins of positions; a record that spans bins is carried
into those of them that have sites, so a long block costs a row for each bin it meets and nothing for the positions between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import operators as op
from weftline.lineage import cut
from weftline.operators import coverage

BIN = 1 << 12


def site_matrix(records: DataFrame, contig: list[str], sample: str, variant: str, values: list[str], lo: str = "lo", hi: str = "hi", bin_size: int = BIN) -> DataFrame:
    """(contig, pos, sample, variant, *values) of each site (``lo`` of a record whose ``variant`` holds) and record over it.

    A sample without a record there has no row. Where a sample has several, a variant that begins at the site comes before a block, then the record of later start, then of least values.
    """
    sites = cut(records.where(F.col(variant)).select(*contig, F.col(lo).alias("pos")).distinct().withColumn("_bin", F.floor(F.col("pos") / bin_size)))
    filled = sites.select(*contig, "_bin").distinct()
    spans = op.in_bins(records.where(F.col(lo) <= F.col(hi)), F.col(lo), F.col(hi), bin_size).withColumnRenamed("bin", "_bin").join(filled, [*contig, "_bin"], "left_semi")
    over = spans.join(sites, [*contig, "_bin"]).where(F.col("pos").between(F.col(lo), F.col(hi)) & (~F.col(variant) | (F.col(lo) == F.col("pos"))))
    order = F.struct(~F.col(variant), -F.col(lo), *values)
    return over.groupBy(*contig, "pos", sample).agg(F.min_by(F.struct(variant, *values), order).alias("_r")).select(*contig, "pos", sample, "_r.*")


def site_summary(matrix: DataFrame, contig: list[str], sample: str, variant: str) -> DataFrame:
    """(contig, pos, n_called, n_variant, n_block) of each site."""
    return matrix.groupBy(*contig, "pos").agg(F.count(F.lit(1)).alias("n_called"), F.count_if(F.col(variant)).alias("n_variant"), F.count_if(~F.col(variant)).alias("n_block"))


def site_counts(records: DataFrame, contig: list[str], sample: str, variant: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``site_summary`` of ``site_matrix`` without its rows, which are sites times samples: (contig, pos, n_called, n_variant, n_block).

    A sample's blocks are made disjoint and cut out at its own variants; how many lie over a site is then told by a sweep over their ends. Records whose ``variant`` is null don't count.
    """
    own = [*contig, sample]
    sites = cut(records.where(F.col(variant)).select(*contig, F.col(lo).cast("long").alias("pos"), F.col(lo) <= F.col(hi), sample).toDF(*contig, "pos", "_valid", sample).distinct())
    variants = sites.where("_valid").select(*own, F.col("pos").alias(lo), F.col("pos").alias(hi))
    runs = coverage.depth_runs(records.where(~F.col(variant)), own, lo, hi, borders=variants).where("depth > 0").select(*own, lo, hi)
    marked = variants.select(*[F.col(c).alias(f"_v_{c}") for c in own], F.col(lo).alias("_at"))
    same = F.col(lo) == F.col("_at")
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col(f"_v_{c}"))
    blocks = runs.join(marked, same, "left_anti")
    counts = sites.groupBy(*contig, "pos").agg(F.count_if("_valid").alias("n_variant"))
    depth = coverage.depth_runs(blocks, contig, lo, hi, borders=counts.select(*contig, F.col("pos").alias(lo), F.col("pos").alias(hi)))
    found = coverage.joined(counts, depth.select(*contig, F.col(lo).alias("pos"), "depth"), [*contig, "pos"])
    return found.select(*contig, "pos", (F.col("n_variant") + F.col("depth")).alias("n_called"), "n_variant", F.col("depth").cast("long").alias("n_block")).where("n_called > 0")
