"""Sharding by balanced label propagation.

Documents of equal text are linked. Every document starts in a seeded shard; in
each round a Spark join tells linked documents which shard most of their group
is in, and they move there as far as the quota between each pair of shards
allows: moves in both directions cancel out, and more than that only as a shard
has room for linked documents (unlinked ones make way later). At last the shards are evened out exactly (counts
at most one apart, law ``rows``), moving unlinked documents first, and each
document gets a gapless slot in its shard.

Defined results: a null text has no bytes and links with nothing; empty texts
are equal texts. A repeated row is a document of its own. A null doc_id is
placed like any other. An empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common

SHARDS, ROUNDS = 24, 4
#: Rows ranked by one window, about.
RANKED = 50_000


def quotas(flows: dict[tuple[int, int], int], sizes: list[int], capacity: int) -> list[tuple[int, int, float]]:
    """(from, to, share of the movers admitted): what flows back and forth cancels out, the rest enters as room allows."""
    surplus = {(i, j): f - min(f, flows.get((j, i), 0)) for (i, j), f in flows.items()}
    wish = [sum(s for (_, to), s in surplus.items() if to == j) for j in range(len(sizes))]
    admitted = {j: min(1.0, max(0, capacity - sizes[j]) / wish[j]) if wish[j] else 0.0 for j in range(len(sizes))}
    return [(i, j, (f - surplus[i, j] + surplus[i, j] * admitted[j]) / f) for (i, j), f in flows.items()]


def propagate(rows: DataFrame, shards: int, rounds: int, capacity: int) -> DataFrame:
    """Rounds of label propagation over (.., grp, shard) rows, all of them linked."""
    spark = rows.sparkSession
    for k in range(rounds):
        votes = rows.groupBy("grp", "shard").count()
        best = votes.groupBy("grp").agg(F.max(F.struct("count", F.xxhash64("grp", "shard", F.lit(k)), "shard")).alias("best"), F.sum("count").alias("members"))
        wanted = common.cut(common.keyed_join(rows, best.select("grp", F.col("best.shard").alias("wanted"), "members"), "grp", "members"))
        counts = wanted.groupBy("shard", "wanted").count().collect()  # at most shards x shards rows
        sizes = [sum(c["count"] for c in counts if c["shard"] == j) for j in range(shards)]
        flows = {(c["shard"], c["wanted"]): c["count"] for c in counts if c["wanted"] != c["shard"]}
        if not flows:
            return wanted.drop("wanted")
        admitted = spark.createDataFrame(quotas(flows, sizes, capacity), "shard int, wanted int, admitted double")
        lot = F.pmod(F.xxhash64("doc_id", "grp", F.lit(k)), F.lit(1 << 20)) / (1 << 20)
        moved = wanted.join(F.broadcast(admitted), ["shard", "wanted"], "left")
        rows = moved.withColumn("shard", F.when(lot < F.coalesce("admitted", F.lit(0.0)), F.col("wanted")).otherwise(F.col("shard"))).drop("wanted", "admitted")
    return common.cut(rows)


def even_out(rows: DataFrame, shards: int, total: int, buckets: int) -> DataFrame:
    """Move the fewest rows, unlinked ones first, so that counts are at most one apart."""
    counts = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}
    sizes = [counts.get(j, 0) for j in range(shards)]
    order = sorted(range(shards), key=lambda j: (-sizes[j], j))
    due = {j: total // shards + (k < total % shards) for k, j in enumerate(order)}
    leave = [max(0, sizes[j] - due[j]) for j in range(shards)]
    ends, targets, filled = [], [], 0
    for j in range(shards):
        if due[j] > sizes[j]:
            filled += due[j] - sizes[j]
            ends.append(filled)
            targets.append(j)
    if not filled:
        return rows
    spread = F.pmod(F.xxhash64("grp", "doc_id"), F.lit(buckets)).cast("int") + F.when(F.col("linked"), buckets).otherwise(0)
    rows = common.ranked(rows, ["shard"], ["grp", "doc_id", "size"], "rank", 2 * buckets, spread)
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    at = F.col("shard") + 1
    number = F.element_at(longs([sum(leave[:j]) for j in range(shards)]), at) + F.col("rank")
    target = F.element_at(longs(targets), F.size(F.filter(longs(ends), lambda e: e <= number)) + 1).cast("int")
    return rows.withColumn("shard", F.when(F.col("rank") < F.element_at(longs(leave), at), target).otherwise(F.col("shard"))).drop("rank")


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row of ``docs``."""
    words = F.col(text).cast("string")
    rows = common.cut(docs.select(
        F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(words), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(words, F.lit("")).cast("binary")).alias("text_crc32"), F.md5(words.cast("binary")).alias("grp"),
    ))
    total = rows.count()
    buckets = max(1, total // (RANKED * shards))
    groups = common.cut(rows.where("grp is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("start"), "doc_id", "size"), F.lit(shards)).cast("int"))
    # Only linked rows meet by text; the others, null texts too, stay where they are read.
    linked = propagate(common.keyed_join(rows, groups, "grp", "members"), shards, rounds, total // shards)
    alone = common.keyed_rest(rows, groups, "grp", "members")
    rows = linked.select(*rows.columns, F.lit(True).alias("linked")).unionByName(alone.withColumn("linked", F.lit(False)))
    rows = common.cut(even_out(common.cut(rows), shards, total, buckets))
    # By all that tells rows apart, so that neither null texts nor the copies of one text lie in one bucket.
    spread = F.pmod(F.xxhash64("grp", "doc_id", "size"), F.lit(buckets)).cast("int")
    rows = common.ranked(rows, ["shard"], ["grp", "doc_id"], "slot", buckets, spread)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(common.documents(spark, sf_dir))
