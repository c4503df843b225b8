"""Columns of alternatives (arrays), and of the sample's choices among them (indices from 1; 0 is the reference)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seen_alternatives(alts: Column, chosen: Column) -> Column:
    """The alternatives that some sample has. A null choice is no choice."""
    return F.filter(alts, lambda _, i: F.exists(chosen, lambda g: g.eqNullSafe(i + 1)))


def unique_alternatives(alts: Column, ref: Column) -> Column:
    """Each alternative once, in order of first mention, without the reference."""
    return F.array_remove(F.array_distinct(alts), ref)


def allele_counts(alts: Column, chosen: Column) -> Column:
    """How many samples have each alternative."""
    return F.transform(alts, lambda _, i: F.size(F.filter(chosen, lambda g: g.eqNullSafe(i + 1))))


def primitives(df: DataFrame, pos: str, ref: str, alt: str, where: Column | None = None) -> DataFrame:
    """One row for each place where ``ref`` and ``alt``, of one length, differ; rows of unlike lengths, and those for which ``where`` doesn't hold, stay whole."""
    one = F.struct(F.lit(0).alias("at"), F.col(ref).alias("ref"), F.col(alt).alias("alt"))
    each = F.transform(F.sequence(F.lit(0), F.length(ref) - 1), lambda i: F.struct(i.alias("at"), F.substring(ref, i + 1, F.lit(1)).alias("ref"), F.substring(alt, i + 1, F.lit(1)).alias("alt")))
    apart = F.length(ref) == F.length(alt)
    pieces = F.when(apart if where is None else where & apart, F.filter(each, lambda p: p["ref"] != p["alt"])).otherwise(F.array(one))
    rest = [c for c in df.columns if c not in (pos, ref, alt)]
    return df.withColumn("_piece", F.explode(pieces)).select(*rest, (F.col(pos) + F.col("_piece.at")).alias(pos), F.col("_piece.ref").alias(ref), F.col("_piece.alt").alias(alt))


def trimmed(pos: Column, ref: Column, alt: Column) -> Column:
    """The shortest equal statement, as a struct (pos, ref, alt): the common end goes first, then the common beginning; both keep one letter."""
    shortest = F.least(F.length(ref), F.length(alt)) <= 1
    whole = F.struct((pos + F.lit(0)).alias("pos"), ref.alias("ref"), alt.alias("alt"))

    def shared(a: Column, b: Column, part) -> Column:
        lengths = F.sequence(F.lit(0), F.greatest(F.least(F.length(a), F.length(b)) - 1, F.lit(0)))
        return F.array_max(F.filter(lengths, lambda k: (k == 0) | (part(a, k) == part(b, k))))

    tail = shared(ref, alt, lambda s, k: F.substring(s, F.length(s) - k + 1, k))
    ref, alt = F.substring(ref, F.lit(1), F.length(ref) - tail), F.substring(alt, F.lit(1), F.length(alt) - tail)
    head = shared(ref, alt, lambda s, k: F.substring(s, F.lit(1), k))
    cut = F.struct((pos + head).alias("pos"), F.substring(ref, head + 1, F.length(ref)).alias("ref"), F.substring(alt, head + 1, F.length(alt)).alias("alt"))
    return F.when(shortest, whole).otherwise(cut)


def best_per_key(df: DataFrame, key: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key. A window with a row limit keeps no more than that of a key in each task before the exchange."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
