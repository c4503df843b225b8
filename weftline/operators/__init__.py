"""Record-level operators on DataFrames. Those that stand for external tools are this library's own definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.coverage import islands
from weftline.operators.packing import pack  # noqa: F401


def failed_filters(limits: dict[str, Column]) -> Column:
    """Comma-joined names of the conditions that don't hold; empty if all do. A null condition fails."""
    return F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in limits.items()])), ",")


def differ(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def region(name: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%d-%d", name, start - 1, end)


def mask_ambiguous(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[KMRYSWBVHDX]", "N")


def mark_duplicates(df: DataFrame, key: list[str], best: list) -> DataFrame:
    """Add is_dup: all but the best row of a key."""
    return df.withColumn("is_dup", F.row_number().over(Window.partitionBy(*key).orderBy(*best)) > 1)


def in_bins(df: DataFrame, lo: Column, hi: Column, width: int) -> DataFrame:
    """One row for each bin of ``width`` that [lo, hi] touches."""
    return df.withColumn("bin", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))


def overlap_join(points: DataFrame, point: str, intervals: DataFrame, lo: str, hi: str, width: int = 64, how: str = "inner") -> DataFrame:
    """Points within intervals: an equi-join on bins, then the exact bounds."""
    intervals = in_bins(intervals, F.col(lo), F.col(hi), width)
    points = points.withColumn("bin", F.floor(F.col(point) / width))
    return points.join(intervals, (points["bin"] == intervals["bin"]) & F.col(point).between(F.col(lo), F.col(hi)), how)


def split_at_bands(df: DataFrame, lo: str, hi: str, band: int) -> DataFrame:
    """Intervals cut at multiples of ``band``."""
    out = in_bins(df, F.col(lo), F.col(hi), band)
    return out.withColumn(lo, F.greatest(F.col(lo), F.col("bin") * band)).withColumn(hi, F.least(F.col(hi), F.col("bin") * band + band - 1)).drop("bin")


def merge_intervals(df: DataFrame, lo: str, hi: str, contig: list[str] | None = None, gap: int = 0) -> DataFrame:
    """Islands of overlapping intervals, within each contig: by bins of positions for whole numbers, else by a window over each contig."""
    contig = contig or []
    if all(df.schema[c].dataType.typeName() in ("integer", "long", "short", "byte") for c in (lo, hi)):
        return islands(df, contig, lo, hi, gap)
    over = Window.partitionBy(*contig).orderBy(lo, hi)
    before = F.max(hi).over(over.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(F.col(lo) <= before + gap, 0).otherwise(1))
    numbered = marked.withColumn("_island", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*contig, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")


def nearest(observed: DataFrame, known: DataFrame, value: str, target: str, most: int, margin: int) -> DataFrame:
    """(value, best, dist) of the closest known string within ``most`` edits, if the runner-up is ``margin`` further.

    Strings within k edits share a text that each becomes without k letters at most, so candidates, runners-up
    too, meet by an equi-join on those texts.
    """
    reach = most + max(0, margin - 1)

    def keys(df: DataFrame, c: str) -> DataFrame:
        def shorter(text: Column) -> Column:
            each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
            return F.array_append(each, text)

        rows = df.select(c, F.array(c).alias("_keys"))
        for _ in range(reach):
            rows = rows.withColumn("_keys", F.array_distinct(F.flatten(F.transform("_keys", shorter))))
        return rows.select(c, F.explode("_keys").alias("_key"))

    pairs = keys(observed.select(value).distinct(), value).join(keys(known.select(target).distinct(), target), "_key").select(value, target).distinct()
    pairs = pairs.withColumn("dist", F.levenshtein(value, target))
    ranked = pairs.groupBy(value).agg(F.sort_array(F.collect_list(F.struct("dist", target))).alias("near"))
    first, second = F.col("near")[0], F.get("near", F.lit(1))
    return ranked.where((first["dist"] <= most) & (second.isNull() | (second["dist"] - first["dist"] >= margin))).select(value, first[target].alias("best"), first["dist"].alias("dist"))


def zipped(*lists: Column) -> Column:
    """Lists side by side, as an array of structs; unequal lengths fail the query."""
    same = F.size(lists[0]) == F.size(lists[-1])
    for one in lists[1:-1]:
        same = same & (F.size(lists[0]) == F.size(one))
    return F.when(same, F.arrays_zip(*lists)).otherwise(F.raise_error(F.lit("the lists have different lengths")))


def without_tags(tags: Column, names: list[str]) -> Column:
    """A map without the named keys."""
    return F.map_filter(tags, lambda k, _: ~k.isin(names))


def consensus(df: DataFrame, group: list[str], text: str, min_reads: int = 1, max_error: float = 1.0) -> DataFrame:
    """(group, pos, ch, depth, errors): the most frequent letter at each place of a group's texts (ties: the least), N where fewer than ``min_reads`` texts reach or more than ``max_error`` of them disagree."""
    letters = df.select(*group, F.posexplode(F.regexp_extract_all(F.col(text), F.lit("(?s)."), F.lit(0))).alias("pos", "ch"))
    counts = letters.groupBy(*group, "pos", "ch").agg(F.count(F.lit(1)).alias("n"))
    called = counts.groupBy(*group, "pos").agg(F.min_by("ch", F.struct(-F.col("n"), "ch")).alias("ch"), F.sum("n").alias("depth"), (F.sum("n") - F.max("n")).alias("errors"))
    sure = (F.col("depth") >= min_reads) & (F.col("errors") <= max_error * F.col("depth"))
    return called.withColumn("ch", F.when(sure, F.col("ch")).otherwise("N"))


def majority(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """The most frequent value of a group; the least among equals."""
    counts = df.groupBy(*group, value).count()
    return counts.groupBy(*group).agg(F.min_by(value, F.struct(-F.col("count"), value)).alias(out))
