"""Greedy bins in one task and across partitions, against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from weftline.operators import ordering
from weftline.operators.packing import pack


def brute(rows, most):
    out, bin_, total, n = {}, 0, 0.0, 0
    for i, size in sorted(rows):
        if n and total + size > most:
            bin_, total = bin_ + 1, 0.0
        total, n = total + size, n + 1
        out[i] = bin_
    return out


@pytest.mark.parametrize("walked", [10_000, 20, 0])
def test_bins(spark, walked):
    dice, rows = random.Random(1), []
    for g, sizes in {"a": [30, 80, 0, 100, 1], "b": [0], "c": [250, 0, 0, 90, 10, 0, 1], None: [1, 2, 50]}.items():
        rows += [(g, i, dice.choice(sizes), "x") for i in range(dice.randrange(8, 60))]
    df = spark.createDataFrame(rows, "g string, i int, size int, other string").repartition(4)
    got = pack(df, "i", "size", 100, ["g"], walked=walked)
    assert got.columns == ["g", "i", "size", "other", "bin"]
    found = {(r["g"], r["i"]): r["bin"] for r in got.collect()}
    want = {(g, i): b for g in {r[0] for r in rows} for i, b in brute([(r[1], r[2]) for r in rows if r[0] == g], 100).items()}
    assert found == want
    one = {r["i"]: r["bin"] for r in pack(df.where("g = 'a'"), "i", "size", 100, walked=walked).collect()}
    assert one == {i: b for (g, i), b in want.items() if g == "a"}
    assert pack(df.limit(0), "i", "size", 100, ["g"], walked=walked).count() == 0


def test_a_large_group_takes_seconds(spark):
    df = spark.range(100_000).select("id", (F.col("id") * 7919 % 97).alias("size"))
    began = time.time()
    got = pack(df, "id", "size", 1000)
    assert got.agg(F.max("bin")).first()[0] == max(brute([(i, i * 7919 % 97) for i in range(100_000)], 1000).values())
    assert time.time() - began < 20


def test_running(spark):
    dice = random.Random(2)
    rows = [(dice.choice(["a", "b", None]), k, dice.randrange(5)) for k in range(300)]
    got = ordering.running(spark.createDataFrame(rows, "g string, k int, v int").repartition(5), ["g"], ["k"], "v").collect()
    for g in ("a", "b", None):
        mine = sorted(r for r in rows if r[0] == g) if g else sorted((r for r in rows if r[0] is None), key=lambda r: r[1])
        assert sorted((r["k"], r["rank"], r["total"]) for r in got if r["g"] == g) == [(r[1], n + 1, sum(x[2] for x in mine[: n + 1])) for n, r in enumerate(mine)]
