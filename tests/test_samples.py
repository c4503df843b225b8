"""Exact samples, near points, mixtures and joint sites against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftline import lineage
from weftline.operators import mixture, proximity, sampling, sites
from weftline.plans import graph


def md5_60(*key):
    text = "\x1f".join("\x1e" if k is None else str(k) for k in key)
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("step, few", [(12, 10_000), (3, 4), (1, 1)])
def test_exact_sample(spark, step, few):
    rows = [(k % 300, k) for k in range(700)] + [(None, -1), (None, -2)]
    df = spark.createDataFrame(rows, "name int, v int").repartition(5)
    order = sorted({r[0] for r in rows}, key=lambda k: (md5_60(k), k is not None, k or 0))
    for n in (0, 1, 17, 300, 301, 900):
        got = sorted(tuple(r) for r in sampling.exactly(df, ["name"], n, step, few).fillna(-9, ["name"]).collect())
        want = sorted((-9 if r[0] is None else r[0], r[1]) for r in rows if r[0] in order[:n])
        assert got == want
    again = sampling.exactly(df.repartition(2), ["name"], 17, step, few)
    assert sorted(r["v"] for r in again.collect()) == sorted(r[1] for r in rows if r[0] in order[:17])
    assert sampling.exactly(df.limit(0), ["name"], 5).count() == 0


def test_equal_hashes(spark, monkeypatch):
    monkeypatch.setattr(sampling, "hashed", lambda *key: F.lit(7).cast("long"))
    df = spark.createDataFrame([(k,) for k in range(50)], "name int")
    assert sorted(r[0] for r in sampling.exactly(df, ["name"], 12, 4, 3).collect()) == list(range(12))


def test_chained_sample(spark):
    df = spark.createDataFrame([(k,) for k in range(400)], "name int")
    want = sorted(sorted(range(400), key=md5_60)[:60])
    for expected in (400, 100_000, 1):
        assert sorted(r[0] for r in sampling.chained(df, ["name"], 60, expected).collect()) == want


def brute_clusters(points, distance):
    left, out = set(points), []
    while left:
        todo, found = [left.pop()], set()
        while todo:
            p = todo.pop()
            found.add(p)
            near = {q for q in left if q[0] == p[0] and abs(q[1] - p[1]) <= distance and abs(q[2] - p[2]) <= distance}
            left -= near
            todo += near
        out.append(frozenset(found))
    return set(out)


@pytest.mark.parametrize("distance", [0, 1, 7, 40])
def test_clusters(spark, distance):
    dice = random.Random(distance)
    rows = [(k, dice.choice("ab"), dice.randrange(-150, 150), dice.randrange(-150, 150)) for k in range(260)] + [(900, "a", None, 3), (901, None, 5, 5), (902, None, 5, 5)]
    got = proximity.clusters(spark.createDataFrame(rows, "id int, g string, x long, y long").repartition(3), ["g"], "x", "y", distance).collect()
    assert len(got) == len(rows)
    by_cluster = defaultdict(set)
    for r in got:
        if r["x"] is None:
            assert r["cluster"] is None
        elif r["g"] is not None:
            by_cluster[r["cluster"]].add((r["g"], r["x"], r["y"]))
    assert {frozenset(v) for v in by_cluster.values()} == brute_clusters({r[1:] for r in rows if r[2] is not None and r[1] is not None}, distance)


def test_optical_in_a_large_set(spark):
    df = spark.range(100_000).select("id", F.lit("k").alias("key"), F.lit(1).alias("tile"), (F.col("id") % 300 * 50).alias("x"), (F.floor(F.col("id") / 300) % 300 * 50).alias("y"))
    marked = proximity.mark_optical(df, ["key"], ["tile"], "x", "y", 10, ["id"])
    # 90,000 places, each a cluster of its own: what comes to a place again is optical.
    row = marked.agg(F.count_if("is_dup").alias("d"), F.count_if("is_optical").alias("o"), F.max(F.when(F.col("is_optical"), 0).otherwise(F.col("id"))).alias("last")).first()
    assert (row["d"], row["o"], row["last"]) == (99_999, 10_000, 89_999)


def test_connected_removes_its_tables(spark):
    import os

    folder = lineage.shared_folder(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath()
    before = {f for f in os.listdir(path) if f.endswith(".parquet")}
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (200, 200), (None, 5)]
    got = {r["node"]: r["component"] for r in graph.connected(spark.createDataFrame(chain, "src int, dst int")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert len({f for f in os.listdir(path) if f.endswith(".parquet")} - before) == 1


@pytest.mark.parametrize("share", [0.0, 0.035, 0.2])
def test_mixture_finds_a_planted_share(spark, share):
    dice, rows = random.Random(6), []
    for site in range(1500):
        f = dice.uniform(0.1, 0.9)
        own, other = (sum(dice.random() < f for _ in range(2)) for _ in range(2))
        for _ in range(40):
            q = dice.choice([20, 30, 40])
            alt = dice.random() < (other if dice.random() < share else own) / 2
            if dice.random() < 10 ** (-q / 10):
                alt = not alt if dice.random() < 1 / 3 else alt
            rows.append((site, f, alt, q))
    rows += [(9000, None, True, 30), (9001, 0.5, None, 30), (9002, 1.5, True, 30)]
    reads = spark.createDataFrame(rows, "site int, f double, alt boolean, q int")
    found, grid = mixture.estimate(mixture.site_counts(reads, ["site"], "f", "alt", "q"))
    assert abs(found - share) <= 0.005
    assert grid.count() <= 41
    assert mixture.estimate(mixture.site_counts(reads.limit(0), ["site"], "f", "alt", "q"))[0] == 0.0


@pytest.mark.parametrize("bin_size", [4, 64])
def test_sites(spark, bin_size):
    dice, rows = random.Random(8), []
    for s in ("a", "b", None):
        for c in ("x", "y"):
            at = 1
            while at < 120:
                n = dice.choice([1, 1, 3, 40])
                rows.append((s, c, at, at + n - 1, n == 1 and dice.random() < 0.6, at * 10))
                at += n + dice.choice([0, 0, 5])
    rows += [("z", "x", 50, 40, False, 0), ("z", "x", 1, 10**6, False, 7)]
    df = spark.createDataFrame(rows, "sample string, contig string, lo long, hi long, varies boolean, v int")
    want = defaultdict(list)
    for c, pos in {(r[1], r[2]) for r in rows if r[4]}:
        for s, c2, lo, hi, varies, v in rows:
            if c2 == c and lo <= pos <= hi and (not varies or lo == pos):
                want[c, pos, s].append((not varies, -lo, v))
    got = sites.site_matrix(df, ["contig"], "sample", "varies", ["v"], bin_size=bin_size)
    assert sorted(((r["contig"], r["pos"], str(r["sample"])), r["v"]) for r in got.collect()) == sorted(((c, p, str(s)), min(x)[2]) for (c, p, s), x in want.items())
    assert sites.site_matrix(df.where("not varies"), ["contig"], "sample", "varies", ["v"]).count() == 0
