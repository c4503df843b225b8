"""Shared pieces of the training-data operators: lineage cuts, graph components, ranks, text hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.lineage import cut, written

#: Separators of words: space and the ASCII controls from tab to carriage return.
SPACE = r"[ \t-\r]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes (as JSON text) of a table that may be broadcast, at most.
MAX_BYTES = 64 << 20


def fits(small: DataFrame, max_rows: int) -> bool:
    """Whether a materialised table is small enough to be broadcast, by its rows and bytes."""
    if small.limit(max(0, max_rows + 1)).count() > max_rows:
        return False
    return (small.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0) <= MAX_BYTES


def small_join(big: DataFrame, small: DataFrame, on, how: str = "inner", max_rows: int = 50_000) -> DataFrame:
    """Join with a materialised lookup table: broadcast when it has at most ``max_rows`` rows and ``MAX_BYTES``, else by shuffle."""
    return big.join(F.broadcast(small) if fits(small, max_rows) else small, on, how)


def keyed_join(big: DataFrame, small: DataFrame, key: str, rows: str, max_rows: int = 20_000, heavy: int = 50_000) -> DataFrame:
    """Inner join with a lookup table of unique ``key`` that counts the ``rows`` of ``big`` for each.

    A large table is joined by shuffle but for keys of over ``heavy`` rows, of which there are at most
    a ``heavy``-th as many as rows: these are broadcast, so no key brings more than that to one task.
    """
    if fits(small, max_rows):
        return big.join(F.broadcast(small.drop(rows)), key)
    often = small.where(F.col(rows) > heavy).drop(rows)
    rare = big.join(F.broadcast(often.select(key)), key, "left_anti").join(small.where(F.col(rows) <= heavy).drop(rows), key)
    return rare.unionByName(big.join(F.broadcast(often), key))


def keyed_rest(big: DataFrame, small: DataFrame, key: str, rows: str, max_rows: int = 20_000, heavy: int = 50_000) -> DataFrame:
    """What ``keyed_join`` leaves: the rows of ``big`` whose key ``small`` hasn't; rows without a key aren't exchanged."""
    if fits(small, max_rows):
        return big.join(F.broadcast(small.select(key)), key, "left_anti")
    named = big.where(F.col(key).isNotNull()).join(F.broadcast(small.where(F.col(rows) > heavy).select(key)), key, "left_anti")
    return big.where(F.col(key).isNull()).unionByName(named.join(small.where(F.col(rows) <= heavy).select(key), key, "left_anti"))


def ascii_lower(word: Column) -> Column:
    """Lower-case A-Z only. ``lower`` serves where it changes nothing, which is most words."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def ascii_lower_text(text: Column) -> Column:
    """Lower-case A-Z only, for whole texts: ``lower`` serves where it changes nothing beyond ASCII."""
    other = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    plain = (F.octet_length(text) == F.char_length(text)) | (F.lower(other) == other)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def space_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often and within whatever lambdas the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ranked(df: DataFrame, group: list[str], order: list, rank: str, buckets: int, spread: Column) -> DataFrame:
    """Gapless ranks from 0 within ``group``, without putting a group into one task.

    Rows go to ``buckets`` by ``spread`` (an integer in [0, buckets)); each
    bucket is ranked by a window of its own and shifted by the counts of the
    buckets before it, so the order is (bucket, ``order``).
    """
    df = df.withColumn("_bucket", spread)
    sizes = df.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    within = Window.partitionBy(*group, "_bucket").orderBy(*order)
    df = df.withColumn("_row", F.row_number().over(within))
    return small_join(df, starts, [*group, "_bucket"]).withColumn(rank, F.col("_start") + F.col("_row") - 1).drop("_bucket", "_row", "_start")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable over undirected edges.

    Minimum labels with pointer jumping; the labels are cut after each round
    and the rounds end when no label changes. Nulls are not nodes.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = written(pairs.union(pairs.select("y", "x")).distinct())
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")))
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.x).select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        moved = written(step.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("component")))
        labels = moved.drop("old")
        if moved.where("old <> component").isEmpty():
            return labels


# Vectorised hashing of whole texts, for use inside Arrow tasks.

_MIX_1, _MIX_2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_POWERS = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


_PLAIN = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
_FOLDED = _PLAIN.copy()
_FOLDED[65:91] = _PLAIN[97:123]
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        n = max(n, 1 << 20)
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS.update(n=n, up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return _POWERS["up"], _POWERS["down"]


def text_blocks(column: pa.Array, max_bytes: int = 1 << 20):
    """Yield (first row, bytes, offsets) for runs of rows of at most ``max_bytes``; a longer text is a run of its own. Null: empty."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE_BYTES, fold: bool = True, prefixes: tuple[int, ...] = ()):
    """Per word of a block: hash, row within the block, first byte, end byte. Words never cross rows.

    With ``prefixes`` the hash is an array of rows (word, its first k bytes for each k); 0 stands where a word is no longer than k.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64) if not prefixes else np.zeros((0, 1 + len(prefixes)), np.uint64), none, none, none
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _PLAIN)[data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    row = np.searchsorted(offsets, start, "right") - 1
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    if prefixes:
        cuts = [np.where(end - start > k, mix((sums[np.minimum(start + k, len(data))] - sums[start]) * down[start] + np.uint64((k << 32) + 1)), np.uint64(0)) for k in prefixes]
        hashes = np.stack([hashes, *cuts], axis=1)
    return hashes, row, start, end


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hashes of all runs of ``n`` words (of the whole array; the caller masks runs across rows)."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + words[k : k + size]
    return mix(out + np.uint64(n))
