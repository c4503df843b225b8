"""Short codes with errors: the nearest known code, and families of codes that differ by errors.

Candidates meet by equi-joins on pieces of the codes, so no pair is formed that has
nothing in common: codes that differ in at most k places agree in one of k + 1 pieces. Codes that differ in one place agree in what is left without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans import graph

NO_CALL = "N"


def places_apart(a: Column, b: Column) -> Column:
    """In how many places two texts of one length differ."""
    return F.size(F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))


def pieces(code: Column, n: int) -> Column:
    """(length, place, text) of ``n`` pieces of nearly equal size."""
    def piece(k: Column) -> Column:
        start = F.floor(F.length(code) * k / n).cast("int")
        stop = F.floor(F.length(code) * (k + 1) / n).cast("int")
        return F.struct(F.length(code).alias("length"), k.alias("place"), F.substring(code, start + 1, stop - start).alias("text"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), piece)


def without_one(code: Column) -> Column:
    """(place, text) for each place of a code: the code without it."""
    each = F.transform(F.sequence(F.lit(1), F.length(code)), lambda i: F.struct(i.alias("place"), F.concat(F.left(code, i - 1), F.substring(code, i + 1, F.length(code))).alias("text")))
    return F.when(F.length(code) > 0, each)


def candidates(a: DataFrame, b: DataFrame, x: str, y: str, most: int, key: list[str] | None = None) -> DataFrame:
    """Pairs (key, x, y) of codes of one length that may differ in at most ``most`` places."""
    key = key or []
    left = a.select(*key, x, F.explode(pieces(F.col(x), most + 1)).alias("_piece"))
    right = b.select(*key, y, F.explode(pieces(F.col(y), most + 1)).alias("_piece"))
    return left.join(right, [*key, "_piece"]).select(*key, x, y).distinct()


def assign(observed: DataFrame, known: DataFrame, code: str, target: str, most: int, margin: int, no_calls: int) -> DataFrame:
    """(code, best, mismatches) for each distinct observed code that has a call.

    The best known code (ties: the least) differs in at most ``most`` called places, the runner-up in at least
    ``margin`` more, and at most ``no_calls`` places aren't called. Known codes have no uncalled places.
    """
    unsure = F.length(code) - F.length(F.replace(F.col(code), F.lit(NO_CALL), F.lit("")))
    seen = observed.select(code).distinct().where(unsure <= no_calls)
    near = candidates(seen, known.select(target).distinct(), code, target, most + max(0, margin - 1) + no_calls)
    near = near.withColumn("mismatches", places_apart(F.col(code), F.col(target)) - unsure)
    ranked = near.groupBy(code).agg(F.sort_array(F.collect_list(F.struct("mismatches", target))).alias("near"))
    first, second = F.col("near")[0], F.get("near", F.lit(1))
    sure = (first["mismatches"] <= most) & (second.isNull() | (second["mismatches"] - first["mismatches"] >= margin))
    return ranked.where(sure).select(code, first[target].alias("best"), first["mismatches"].alias("mismatches"))


def families(df: DataFrame, key: list[str], code: str, strategy: str = "adjacency", edits: int = 1) -> DataFrame:
    """(key, code, n, family): the family of each distinct code of a key, named by one of its codes.

    * ``identity``: equal codes.
    * ``edit``: codes linked by at most ``edits`` differing places, over any number of steps; the least code names them.
    * ``adjacency``: a code also takes in one that it outnumbers (n >= 2 m - 1), over any number of steps; the most frequent (then least) that reaches a code names its family.
    * ``paired``: as adjacency, where ``a-b`` and ``b-a`` are one code.
    """
    if strategy == "paired":
        halves = F.split(code, "-")
        swapped = F.concat_ws("-", F.get(halves, F.lit(1)), F.get(halves, F.lit(0)))
        df, strategy = df.withColumn(code, F.least(F.col(code), swapped)), "adjacency"
    counts = df.groupBy(*key, code).agg(F.count(F.lit(1)).alias("n"))
    if strategy == "identity":
        return counts.withColumn("family", F.col(code))
    if strategy not in ("edit", "adjacency"):
        raise ValueError(f"no such strategy: {strategy}")
    node, counts = F.struct(*key, code), counts.dropna(subset=[*key, code])
    other = counts.select(*key, F.col(code).alias("_other"), F.col("n").alias("_m"))
    if edits == 1 and strategy == "edit":
        # All codes of one rest are linked, so each is linked to the least: as many edges as places, however many codes meet.
        spots = counts.select(*key, code, F.explode(without_one(F.col(code))).alias("_spot"))
        near = spots.join(spots.groupBy(*key, "_spot").agg(F.min(code).alias("_other")), [*key, "_spot"]).where(F.col(code) != F.col("_other"))
    elif edits == 1:
        spots = counts.withColumn("_spot", F.explode(without_one(F.col(code))))
        near = spots.join(other.withColumn("_spot", F.explode(without_one(F.col("_other")))), [*key, "_spot"]).where(F.col(code) != F.col("_other"))
    else:
        near = candidates(counts.select(*key, code), other.select(*key, "_other"), code, "_other", edits, key)
        near = near.where(F.col(code) != F.col("_other")).where(places_apart(F.col(code), F.col("_other")) <= edits)
        near = near.join(counts, [*key, code]).join(other, [*key, "_other"])
    if strategy == "adjacency":
        near = near.where("n >= 2 * _m - 1")
    edges = near.select(node.alias("src"), F.struct(*key, F.col("_other").alias(code)).alias("dst"))
    if strategy == "edit":
        linked = graph.connected(edges).select(*[F.col(f"node.{c}").alias(c) for c in [*key, code]], F.col(f"component.{code}").alias("_family"))
        return counts.join(linked, [*key, code], "left").withColumn("family", F.coalesce("_family", code)).drop("_family")
    order = F.struct((-F.col("n")).alias("rank"), F.col(code).alias("code"))
    spread = graph.spread(edges, counts.select(node.alias("node"), order.alias("label")))
    named = spread.select(*[F.col(f"node.{c}").alias(c) for c in [*key, code]], F.col("label.code").alias("family"))
    return counts.join(named, [*key, code])
