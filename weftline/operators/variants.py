"""Verdicts on counted alternatives, by exact tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import exact
from weftline.operators import alignment, mask_ambiguous
from weftline.operators.alleles import primitives


def share(part: Column, rest: Column) -> Column:
    return F.when(part + rest > 0, part / (part + rest)).otherwise(F.lit(0.0))


def somatic_status(df: DataFrame, normal: tuple[str, str], tumor: tuple[str, str], min_share: float = 0.01, p_value: float = 0.2, somatic_p: float = 0.05, error: float = 0.001) -> DataFrame:
    """Add p_variant, p_somatic and status, from (reference, alternative) counts of a normal and a tumor sample.

    ``p_variant``: the chance of so many alternatives in both samples if each letter were one by ``error``. ``p_somatic``: of so uneven a table of the samples if they
    were alike, one-sided to the tumor's side where it has the larger share, else to the other. Status: Reference where neither share reaches ``min_share``;
    Somatic where only the tumor's does and ``p_somatic`` is small; LOH where both or only the normal's do and the samples differ by ``p_somatic``; Germline where both do, they don't differ and
    ``p_variant`` is small; else Unknown.
    """
    nr, na, tr, ta = (F.col(c).cast("long") for c in (*normal, *tumor))
    more = share(ta, tr) >= share(na, nr)
    table = exact.fisher(ta, tr, na, nr)
    rows = df.withColumn("p_variant", exact.binomial(na + ta, na + ta + nr + tr, F.lit(error))["greater"]).withColumn("_t", table)
    rows = rows.withColumn("p_somatic", F.when(more, F.col("_t.greater")).otherwise(F.col("_t.less"))).drop("_t")
    in_normal, in_tumor = share(na, nr) >= min_share, share(ta, tr) >= min_share
    differ = F.col("p_somatic") <= somatic_p
    status = F.when(~in_normal & ~in_tumor, "Reference").when(~in_normal & differ, "Somatic").when(in_normal & differ, "LOH").when(in_normal & in_tumor & (F.col("p_variant") <= p_value), "Germline")
    return rows.withColumn("status", status.otherwise("Unknown"))


def near_ends(df: DataFrame, counts: tuple[str, str, str, str], p_value: float) -> DataFrame:
    """Add p_end and end_artifact: whether alternatives lie near the ends of their reads more often than references do. ``counts``: alternative near, far; reference near, far."""
    p = exact.fisher(*[F.col(c).cast("long") for c in counts])["greater"]
    return df.withColumn("p_end", p).withColumn("end_artifact", F.col("p_end") <= p_value)


def cleaned_calls(calls: DataFrame, chunks: DataFrame, min_qual: float = 5, width: int = alignment.WIDTH) -> DataFrame:
    """(contig, pos, ref, alt, samples, ac, ns) from called records, in one plan of the steps in order.

    ``calls`` are (contig, pos, ref, alts, qual, chosen): each sample's chosen alternative (from 1; 0 is the reference, null nothing). Records at or below ``min_qual`` go, but for those
    with the open alternative ``<*>``; ambiguous letters of the reference become N; alternatives that no sample chose, and missing ones (``.``, empty or null), go; a change of several
    letters for as many becomes one row a letter; the samples that have it (``samples``, in order) are counted anew (``ac``), with those that chose anything (``ns``); insertions and deletions
    move to their leftmost place over ``chunks`` of the reference; what states one change twice becomes one row, and what equals the reference goes.
    """
    kept = calls.where((F.col("qual") > min_qual) | F.coalesce(F.array_contains("alts", "<*>"), F.lit(False)))
    kept = kept.select("contig", "pos", mask_ambiguous(F.col("ref")).alias("ref"), "chosen", F.size(F.filter("chosen", lambda g: g.isNotNull())).alias("ns"), F.posexplode("alts").alias("_k", "alt"))
    kept = kept.where(F.array_contains("chosen", F.col("_k") + 1) & F.col("alt").isNotNull() & ~F.col("alt").isin("", "."))
    who = F.filter(F.transform("chosen", lambda g, i: F.when(g.eqNullSafe(F.col("_k") + 1), i)), lambda i: i.isNotNull())
    kept = kept.withColumn("samples", who).drop("chosen", "_k")
    plain = F.col("alt").rlike(r"^[A-Za-z]+\z")  # $ would let a last line break pass
    moved = alignment.left_aligned(primitives(kept, "pos", "ref", "alt", plain), chunks, width=width, where=plain)
    once = moved.where("ref <> alt").groupBy("contig", "pos", "ref", "alt").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("samples")))).alias("samples"), F.max("ns").alias("ns"))
    return once.select("contig", "pos", "ref", "alt", "samples", F.size("samples").alias("ac"), "ns")
