"""The share of a second source in a mixed sample, by maximum likelihood.

At a site whose second letter has the frequency f, the sample's own genotype and the stranger's are drawn by it; a read shows the stranger's with the chance
alpha, and a wrong letter by its quality. A site's reads are counted by letter and quality; its likelihood is then a sum over nine pairs of genotypes, for each
alpha of a grid. The grid of sums over all sites is all that is brought together. A second grid lies around the best of the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.lineage import cut


def site_counts(reads: DataFrame, site: list[str], freq: str, is_alt: str, qual: str) -> DataFrame:
    """(site, freq, seen): each site's reads counted by letter and quality. Reads without a letter, and sites without a frequency within 0 and 1, don't count."""
    counted = reads.where(F.col(is_alt).isNotNull() & F.col(qual).isNotNull() & F.col(freq).between(0, 1)).groupBy(*site, F.col(freq).cast("double").alias("freq"), F.col(is_alt).alias("alt"), F.col(qual).cast("double").alias("qual")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    wrong = F.least(F.pow(F.lit(10.0), -F.col("qual") / 10), F.lit(0.75))
    return counted.groupBy(*site, "freq").agg(F.collect_list(F.struct("alt", wrong.alias("wrong"), "n")).alias("seen"))


PAIRS = [(own, other) for own in range(3) for other in range(3)]


def _log_likelihoods(batches: Iterator[pa.RecordBatch], grid: list[float]) -> Iterator[pa.RecordBatch]:
    """(freq, seen) to (alpha, l), summed over a task's sites. A letter's chance depends on its quality, the genotypes and alpha only, so it is taken once for each."""
    total, any_site = np.zeros(len(grid)), False
    for batch in batches:
        freq, lists = batch.column(0).to_numpy(), batch.column(1)
        if not len(freq):
            continue
        any_site, seen, size = True, lists.flatten(), lists.value_lengths().to_numpy()
        alt, wrong, n = (seen.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        kinds, kind = np.unique(np.where(alt, -1.0 - wrong, wrong), return_inverse=True)
        is_alt, error = kinds < 0, np.where(kinds < 0, -1.0 - kinds, kinds)
        genotype = np.stack([(1 - freq) ** 2, 2 * freq * (1 - freq), freq**2])
        prior = np.stack([genotype[a] * genotype[b] for a, b in PAIRS], axis=1)
        start = np.cumsum(size) - size
        for k, alpha in enumerate(grid):
            share = np.array([(1 - alpha) * (a / 2) + alpha * (b / 2) for a, b in PAIRS])
            share, e = np.where(is_alt[:, None], share, 1 - share), error[:, None]
            chance = np.log(np.maximum(share * (1 - e) + (1 - share) * e / 3, 1e-300))
            l = np.add.reduceat(n[:, None] * chance[kind], start)  # noqa: E741
            top = np.where(prior > 0, l, -np.inf).max(axis=1)
            total[k] += (top + np.log((prior * np.exp(np.minimum(l - top[:, None], 0))).sum(axis=1))).sum()
    if any_site:
        yield pa.record_batch([pa.array(grid), pa.array(total)], ["alpha", "l"])


def likelihoods(sites: DataFrame, grid: list[float]) -> DataFrame:
    """(alpha, log_likelihood) over all sites, for each alpha of the grid."""
    grid = [float(a) for a in grid]
    sums = sites.select("freq", "seen").mapInArrow(lambda batches: _log_likelihoods(batches, grid), "alpha double, l double")
    return sums.groupBy("alpha").agg(F.sum("l").alias("log_likelihood"))


def estimate(sites: DataFrame, coarse: float = 0.05, fine: float = 0.0025, most: float = 0.5) -> tuple[float, DataFrame]:
    """The most likely share, and (alpha, log_likelihood) of the fine grid around the best of the coarse one. Without sites the share is 0."""
    sites = cut(sites)
    first = [round(k * coarse, 10) for k in range(int(most / coarse) + 1)]
    best = max(likelihoods(sites, first).collect(), key=lambda r: (r["log_likelihood"], -r["alpha"]), default=None)  # one row a grid point
    middle = best["alpha"] if best is not None else 0.0
    steps = int(math.ceil(coarse / fine))
    around = sorted({round(min(most, max(0.0, middle + k * fine)), 10) for k in range(-steps, steps + 1)})
    table = cut(likelihoods(sites, around))
    top = max(table.collect(), key=lambda r: (r["log_likelihood"], -r["alpha"]), default=None)
    return (top["alpha"] if top is not None else 0.0), table
