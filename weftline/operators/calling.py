"""Consensus letters by likelihood, within families of reads of one molecule and across its two strands.

A letter of quality q is wrong with probability 10^(-q/10), and by ``after`` once more, as errors also arise after the families were marked;
a wrong letter is any of the three others. The likelihood of each of the four letters is a product over a family's reads, so a family needs
sums of logarithms only, which are combined before they are exchanged. What went wrong before (``before``) bounds the quality of the call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import barcodes

LETTERS = "ACGT"
#: Likelihoods closer than this are equal.
EQUAL = 1e-9
LEAST_QUAL, MOST_QUAL = 2.0, 90.0


def error(qual: Column) -> Column:
    return F.pow(F.lit(10.0), -qual / 10)


def either(a: Column, b: Column) -> Column:
    """Chance of a wrong letter after two errors, the second of which may set the first right."""
    return a + b - a * b * (4.0 / 3.0)


def called_quality(wrong: Column) -> Column:
    return F.greatest(F.lit(LEAST_QUAL), F.least(F.lit(MOST_QUAL), -10 * F.log10(F.greatest(wrong, F.lit(1e-300)))))


def placed_letters(df: DataFrame, group: list[str], seq: str = "seq", quals: str = "quals", meet: list[str] | None = None) -> DataFrame:
    """(group, pos, letter, qual): the letters of reads, from 0.

    Reads of a group (or of its columns ``meet``) meet before their letters are listed, so that what is counted by group and place isn't exchanged again; a task reads its groups' reads one after the other.
    """
    df = df.repartition(*(meet or group))
    each = F.arrays_zip(F.slice(F.split(seq, ""), F.lit(1), F.length(seq)).alias("letter"), F.col(quals).alias("qual"))
    return df.select(*group, F.posexplode(each).alias("pos", "_v")).select(*group, "pos", F.upper("_v.letter").alias("letter"), F.col("_v.qual").cast("double").alias("qual"))


def likely_letters(letters: DataFrame, group: list[str], before: float = 45, after: float = 40, min_qual: float = 10, min_reads: int = 1) -> DataFrame:
    """(group, pos, letter, qual, posterior, depth, errors) of the most likely letter at each place of a group.

    Letters below ``min_qual`` and others than A, C, G and T don't count. Where two letters are equally likely, or fewer than ``min_reads`` reads count, the call is N
    of the least quality; a place that nothing counts for isn't returned.
    """
    wrong = F.least(either(error(F.col("qual")), error(F.lit(float(after)))), F.lit(0.75))
    counting = letters.where((F.col("qual") >= min_qual) & F.col("letter").isin(*LETTERS)).withColumn("_right", F.log(1 - wrong)).withColumn("_wrong", F.log(wrong / 3))
    sums = [F.sum(F.when(F.col("letter") == c, F.col("_right")).otherwise(F.col("_wrong"))).alias(f"_{c}") for c in LETTERS]
    reads = [F.count_if(F.col("letter") == c).alias(f"_n{c}") for c in LETTERS]
    rows = counting.groupBy(*group, "pos").agg(F.count(F.lit(1)).alias("depth"), *sums, *reads)
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(F.col(f"_{c}").alias("likely"), F.lit(c).alias("letter"), F.col(f"_n{c}").alias("n")) for c in LETTERS])))
    rows = rows.withColumn("_ranked", ranked)
    first, second = F.col("_ranked")[0], F.col("_ranked")[1]
    others = F.aggregate(F.slice("_ranked", 2, 3), F.lit(0.0), lambda acc, x: acc + F.exp(x["likely"] - first["likely"]))
    sure = (first["likely"] - second["likely"] > EQUAL) & (F.col("depth") >= min_reads)
    wrong_call = either(others / (1 + others), error(F.lit(float(before))))
    return rows.select(
        *group, "pos", F.when(sure, first["letter"]).otherwise("N").alias("letter"), F.when(sure, called_quality(wrong_call)).otherwise(F.lit(LEAST_QUAL)).alias("qual"),
        F.when(sure, 1 / (1 + others)).otherwise(F.lit(0.0)).alias("posterior"), "depth", F.when(sure, F.col("depth") - first["n"]).otherwise(F.col("depth")).alias("errors"),
    )


def swapped(code: Column) -> Column:
    halves = F.split(code, "-")
    return F.concat_ws("-", F.get(halves, F.lit(1)), F.get(halves, F.lit(0)))


def strand(code: Column) -> Column:
    """Of a code ``a-b``: A if it isn't after ``b-a`` in order, else B."""
    return F.when(code <= swapped(code), "A").otherwise("B")


def paired_families(df: DataFrame, key: list[str], code: str, edits: int = 1) -> DataFrame:
    """(key, code, strand, family) of each distinct code ``a-b``: ``a-b`` and ``b-a`` are of one family, on its two strands."""
    folded = df.select(*key, code).distinct().withColumn("_folded", F.least(F.col(code), swapped(F.col(code))))
    found = barcodes.families(df, key, code, "paired", edits).select(*key, F.col(code).alias("_folded"), "family")
    return folded.join(found, [*key, "_folded"]).select(*key, code, strand(F.col(code)).alias("strand"), "family")


def duplex(calls: DataFrame, group: list[str], strand: str = "strand", min_reads: tuple[int, int, int] = (1, 1, 0)) -> DataFrame:
    """(group, pos, letter, qual, depth, errors, strands) from the calls of each group's strands A and B.

    Strands that agree add their qualities. Of strands that don't the surer letter stays, at the difference of both; equal ones, and N on either, give N.
    ``min_reads`` are of both strands together, of the deeper and of the other one. A place of one strand alone is called if that allows it.
    """
    column = lambda name, s: F.max(F.when(F.col(strand) == s, F.col(name)))
    both = calls.groupBy(*group, "pos").agg(*[column(c, s).alias(f"_{c}_{s}") for c in ("letter", "qual", "depth", "errors") for s in "AB"])
    a, b = F.col("_letter_A"), F.col("_letter_B")
    qa, qb = F.col("_qual_A"), F.col("_qual_B")
    da, db = F.coalesce("_depth_A", F.lit(0)), F.coalesce("_depth_B", F.lit(0))
    enough = (da + db >= min_reads[0]) & (F.greatest(da, db) >= min_reads[1]) & (F.least(da, db) >= min_reads[2])
    letter = F.when(~enough | (a == "N") | (b == "N"), "N").when(a.isNull(), b).when(b.isNull(), a).when(a == b, a).when(F.abs(qa - qb) <= EQUAL, "N").when(qa > qb, a).otherwise(b)
    qual = F.when(a.isNull(), qb).when(b.isNull(), qa).when(a == b, F.least(qa + qb, F.lit(MOST_QUAL))).otherwise(F.greatest(F.abs(qa - qb), F.lit(LEAST_QUAL)))
    other_errors = F.when(letter == "N", F.lit(0)).when((a != b) & (letter == a), db - F.coalesce("_errors_B", F.lit(0))).when((a != b) & (letter == b), da - F.coalesce("_errors_A", F.lit(0))).otherwise(F.lit(0))
    return both.select(
        *group, "pos", letter.alias("letter"), F.when(letter == "N", F.lit(LEAST_QUAL)).otherwise(qual).alias("qual"), (da + db).alias("depth"),
        (F.coalesce("_errors_A", F.lit(0)) + F.coalesce("_errors_B", F.lit(0)) + other_errors).alias("errors"), (F.when(a.isNotNull(), 1).otherwise(0) + F.when(b.isNotNull(), 1).otherwise(0)).alias("strands"),
    )


def filtered(calls: DataFrame, group: list[str], min_reads: int, max_read_errors: float, max_letter_errors: float, min_qual: float, max_uncalled: float, min_mean_qual: float | None = None) -> DataFrame:
    """Calls of the groups that pass, with unsure letters made N.

    A group goes whose letters disagree with their reads in more than ``max_read_errors`` of all, whose reads are fewer than ``min_reads`` at the deepest place, whose mean
    quality is below ``min_mean_qual``, or more than ``max_uncalled`` of whose letters are N after the masking of letters by depth, errors and quality.
    """
    unsure = (F.col("depth") < min_reads) | (F.col("errors") > max_letter_errors * F.col("depth")) | (F.col("qual") < min_qual)
    own = Window.partitionBy(*group)
    rows = calls.withColumn("_was", F.col("qual")).withColumn("letter", F.when(unsure, "N").otherwise(F.col("letter"))).withColumn("qual", F.when(unsure, F.lit(LEAST_QUAL)).otherwise(F.col("qual")))
    passes = (F.sum("errors").over(own) <= max_read_errors * F.sum("depth").over(own)) & (F.max("depth").over(own) >= min_reads) & (F.count_if(F.col("letter") == "N").over(own) <= max_uncalled * F.count(F.lit(1)).over(own))
    if min_mean_qual is not None:
        passes = passes & (F.avg("_was").over(own) >= min_mean_qual)
    return rows.withColumn("_passes", passes).where("_passes").drop("_passes", "_was")


def consensus_reads(calls: DataFrame, group: list[str]) -> DataFrame:
    """(group, seq, quals) of calls: places that nothing was called for are N."""
    listed = calls.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("letter", "qual")))).alias("_calls"), F.max("pos").alias("_last"))
    each = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda k: F.coalesce(F.get(F.array(F.element_at("_calls", k)), F.lit(0)), F.struct(F.lit("N").alias("letter"), F.lit(LEAST_QUAL).alias("qual"))))
    return listed.withColumn("_each", each).select(*group, F.array_join(F.transform("_each", lambda c: c["letter"]), "").alias("seq"), F.transform("_each", lambda c: F.round(c["qual"]).cast("int")).alias("quals"))
