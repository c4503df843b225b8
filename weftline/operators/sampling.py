"""Samples of exact size. Rows of one key stay together, and which keys are taken follows from their hashes alone, however the rows lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.lineage import cut

#: Hashes are numbers below 2^60; a round looks at so many more of their bits, and the last keys are ranked once so few are left.
BITS, STEP, FEW = 60, 12, 10_000


def hashed(*key: Column) -> Column:
    """A hash of 60 bits, by md5."""
    return F.conv(F.left(F.md5(F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("\x1e")) for k in key])), F.lit(BITS // 4)), 16, 10).cast("long")


def fraction(df: DataFrame, key: list[str], share: float) -> DataFrame:
    """Rows of the keys whose hash lies within ``share`` of all: about that share of the keys, in one pass."""
    return df.where(hashed(*map(F.col, key)) < int(min(1.0, share) * (1 << BITS)))


def exactly(df: DataFrame, key: list[str], n: int, step: int = STEP, few: int = FEW) -> DataFrame:
    """All rows of exactly ``n`` keys (of all, if there are fewer): those of least hash, then least key.

    The n-th hash is found by counting: a round counts the keys by the next bits of their hashes, and goes on within the bucket that the n-th lies in. What a round
    brings back is one bucket; keys are ranked only among the few that share the last one. Null is a key as any other.
    """
    if n <= 0:
        return df.limit(0)
    keys = cut(df.select(*key).distinct().withColumn("_h", hashed(*map(F.col, key))))
    low, width, left, inside = 0, BITS, n, keys
    while width > 0 and inside.count() > few:
        bits = min(step, width)
        width -= bits
        counts = inside.groupBy(F.shiftright("_h", width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))  # 2^bits rows at most
        so_far = counts.withColumn("total", F.sum("n").over(Window.orderBy("bucket")))
        found = so_far.where(F.col("total") >= left).orderBy("bucket").first()
        if found is None:
            return df
        left -= found["total"] - found["n"]
        low = found["bucket"] << width
        inside = keys.where((F.col("_h") >= low) & (F.col("_h") < low + (1 << width)))
    # All keys below are in; of the bucket's few (or of those of one hash) the first ones.
    last = inside.orderBy("_h", *key).limit(left)
    taken = keys.where(F.col("_h") < low).unionByName(last).drop("_h")
    same = [df[k].eqNullSafe(taken[k]) for k in key]
    condition = same[0]
    for one in same[1:]:
        condition = condition & one
    return df.join(taken, condition, "left_semi")


def chained(df: DataFrame, key: list[str], n: int, expected: int) -> DataFrame:
    """As ``exactly``, over a first pass that keeps somewhat more than ``n`` of about ``expected`` keys; too small an estimate is made up for by a whole pass."""
    share = min(1.0, 1.1 * n / max(1, expected) + 10 / max(1, expected) ** 0.5)
    first = cut(fraction(df, key, share))
    if share < 1.0 and first.select(*key).distinct().count() < n:
        return exactly(df, key, n)
    return exactly(first, key, n)
