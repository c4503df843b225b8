"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source's target is a share of ``share`` times all words by weight, stopped
at ``most`` times its own size, with the excess shared out again by weight. The
targets are turned into integer numbers of ``BLOCK``-word blocks by highest
quotients (target / 1, / 3, / 5 ...), first among sources, then among the
shards of a source. Within a shard, documents lie in a seeded order; the quota
takes the whole shard as often as it goes, and for the rest a run of blocks from
a seeded start, so nearly all documents are taken whole.

Defined results: a null text has no words. A null source is a source, last in
order; the empty string is a source like others. A source without words has
target 0. Rows with equal ids and sizes are interchangeable; repeated rows are
all mixed. An empty table gives an empty result. Columns besides the named ones
are kept aside in a struct, so their names don't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import common

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Words in a block, and words in a shard, about.
BLOCK, SHARD = 32, 4_000_000
SEED = "mix-1"


def seeded(*parts) -> Column:
    """28 bits of an md5 digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts)), 1, 7), 16, 10).cast("long")


def water_levels(sources: DataFrame) -> DataFrame:
    """Targets of (source, source_size): least(most * size, level * weight), with one level for all that aren't full."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    picked = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    sources = sources.withColumn("weight", picked).withColumn("ratio", MOST * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    full = MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (SHARE * F.sum("source_size").over(everything) - full) / left
    sources = sources.withColumn("level", level)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level")))
    return sources.withColumn("level", level.over(everything)["level"]).select(
        "source", "source_size", F.coalesce(F.least(1.0 * MOST * F.col("source_size"), F.col("level") * F.col("weight")), F.lit(0.0)).alias("target")
    )


def highest_quotients(parties: DataFrame, votes: str, seats: str, group: list[str], ties: list[str]) -> DataFrame:
    """Add ``quota``: Sainte-Laguë seats of each party in its group.

    Seats are contested only near the rounded share: with m parties, highest
    quotients differ from it by at most share * m / 2 + 1, so the seats below
    are sure, those above out of reach, and about 3 m candidates are ranked.
    """
    whole = Window.partitionBy(*group)
    total = F.sum(votes).over(whole)
    share = F.when(total > 0, F.col(votes) / total).otherwise(0.0)
    parties = parties.withColumn("_near", F.floor(share * F.col(seats) + 0.5)).withColumn("_reach", F.ceil(share * F.count(F.lit(1)).over(whole) / 2) + 1)
    parties = parties.withColumn("_sure", F.greatest(F.lit(0), F.col("_near") - F.col("_reach")))
    parties = parties.withColumn("_open", F.col(seats) - F.sum("_sure").over(whole))
    contested = parties.select("*", F.explode(F.sequence("_sure", F.col("_near") + F.col("_reach"))).alias("_seat"))
    rank = F.row_number().over(whole.orderBy((F.col(votes) / (2 * F.col("_seat") + 1)).desc(), *[F.col(t).asc_nulls_last() for t in ties], "_seat"))
    kept = [c for c in parties.columns if not c.startswith("_")]
    won = contested.withColumn("_won", ((rank <= F.col("_open")) & (F.col(votes) > 0)).cast("long"))
    return won.groupBy(*kept, "_sure").agg(F.sum("_won").alias("_won")).select(*kept, (F.col("_sure") + F.col("_won")).alias("quota"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: bool = False) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken; with ``keep`` also ``row`` (the input row), ``whole`` (times taken whole), and the words taken besides: ``part_1`` after the first ``skip_1``, ``part_2`` from the start."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.size(common.space_words(F.col(text))).cast("long").alias("size"),
        *([F.struct("*").alias("row")] if keep else []),
    )
    sources = water_levels(common.cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    blocks = F.round(F.sum("target").over(Window.partitionBy()) / BLOCK).cast("long")
    sources = common.cut(
        highest_quotients(sources.withColumn("seats", blocks), "target", "seats", [], ["source"])
        .withColumn("shards", F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / SHARD))
        .withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
        .select("key", "source_size", "target", "quota", "shards")
    )
    rows = common.small_join(rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).drop("source"), sources, "key")
    rows = rows.withColumn("shard", F.floor(seeded(F.col("doc_id").cast("string")) * F.col("shards") / (1 << 28)))
    sizes = rows.groupBy("key", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("seats"))
    shards = highest_quotients(sizes, "shard_size", "seats", ["key"], ["shard"])
    n = F.greatest(F.ceil(F.col("shard_size") / BLOCK), F.lit(1))
    quota = F.least("quota", MOST * F.col("n"))
    shards = common.cut(
        shards.withColumn("n", n).withColumn("whole", F.floor(quota / F.col("n"))).withColumn("over", quota % F.col("n"))
        .withColumn("first", seeded("key", F.col("shard").cast("string")) % F.col("n"))
        .select("key", "shard", "shard_size", "whole", (F.col("first") * BLOCK).alias("from_1"), F.least("shard_size", (F.col("first") + F.col("over")) * BLOCK).alias("to_1"), (F.greatest(F.lit(0), F.col("first") + F.col("over") - F.col("n")) * BLOCK).alias("to_2"))
    )
    seat = Window.partitionBy("key", "shard").orderBy(F.md5(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string"))), "doc_id", "size")
    rows = common.small_join(rows.withColumn("end", F.sum("size").over(seat)), shards, ["key", "shard"]).withColumn("start", F.col("end") - F.col("size"))
    part_1 = F.greatest(F.lit(0), F.least("end", "to_1") - F.greatest("start", "from_1"))
    part_2 = F.greatest(F.lit(0), F.least("end", "to_2") - F.col("start"))
    rows = rows.withColumn("part_1", part_1).withColumn("part_2", part_2)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part_1") + F.col("part_2")).cast("long").alias("taken"), *(["row", "whole", "part_1", "part_2", F.greatest(F.lit(0), F.col("from_1") - F.col("start")).alias("skip_1")] if keep else []))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of ``docs``: a document taken twice is two rows, one taken in part has that part of its text (and n_chars)."""
    taken = mix(docs, keep=True).withColumn("text", F.col("row.text"))
    pieces = F.split("text", r"(?<=[ \t-\r])(?=[^ \t-\r])")
    # A text that starts with separators has one piece before its first word.
    lead = F.col("text").rlike(r"^[ \t-\r]").cast("int")

    def part(skip: Column, n: Column) -> Column:
        some = F.when(n > 0, F.array_join(F.slice(pieces, (skip + 1 + lead).cast("int"), n.cast("int")), ""))
        return F.when(n >= F.col("size"), F.when(n > 0, F.col("text"))).otherwise(some)

    copies = F.array_repeat("text", F.col("whole").cast("int"))
    rest = F.array_compact(F.array(part(F.col("skip_1"), F.col("part_1")), part(F.lit(0), F.col("part_2"))))
    rows = taken.where("taken > 0").select("row", F.explode(F.concat(copies, rest)).alias("text"))
    return rows.select(*[F.col("text") if c == "text" else F.when(F.col("text") == F.col("row.text"), F.col("row.n_chars")).otherwise(F.length("text")).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op1_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir))


_HEX = " + ".join(f"(strpos('0123456789abcdef', substr(m, {i}, 1)) - 1) * {16 ** (7 - i)}" for i in range(1, 8))
ORACLE = rf"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS k, source,
    len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT k, source, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, sum(source_size) OVER () AS t FROM s0),
s2 AS (SELECT *, 2 * source_size / w AS ratio FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * t - 2 * coalesce(sum(source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lv FROM s2
    WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, least(2.0::DOUBLE * source_size, (SELECT arg_min(lv, ratio) FROM s3 WHERE lv <= ratio) * w) AS target FROM s3),
n AS (SELECT round(sum(target) / 32)::BIGINT AS seats FROM s4),
q0 AS (SELECT k, unnest(generate_series(0, (2 * source_size / 32 + 20)::BIGINT)) AS seat, target, source FROM s4 WHERE target > 0),
q1 AS (SELECT k, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, source NULLS LAST, seat) AS r FROM q0),
q AS (SELECT k, count(*) FILTER (r <= (SELECT seats FROM n)) AS quota FROM q1 GROUP BY k),
sh AS (SELECT s4.k, source_size, target, coalesce(quota, 0) AS quota, ceil(greatest(source_size, 1) / 4000000)::BIGINT AS shards FROM s4 LEFT JOIN q ON s4.k = q.k),
e0 AS (SELECT doc_id, size, sh.*, md5('mix-1:' || doc_id) AS m FROM d JOIN sh ON d.k = sh.k),
e1 AS (SELECT *, (({_HEX}) * shards) // 268435456 AS shard FROM e0),
p0 AS (SELECT k, shard, sum(size) AS shard_size, any_value(quota) AS seats FROM e1 GROUP BY ALL),
p1 AS (SELECT k, shard, shard_size, unnest(generate_series(0, (2 * shard_size / 32 + 20)::BIGINT)) AS seat, seats FROM p0),
p2 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY shard_size / (2 * seat + 1) DESC, shard, seat) AS r FROM p1),
p3 AS (SELECT k, shard, any_value(shard_size) AS shard_size, count(*) FILTER (r <= seats AND shard_size > 0) AS quota, greatest(ceil(any_value(shard_size) / 32), 1)::BIGINT AS nb, md5('mix-1:' || k || ':' || shard) AS m FROM p2 GROUP BY k, shard),
p AS (SELECT k, shard, shard_size, least(quota, 2 * nb) // nb AS whole, least(quota, 2 * nb) % nb AS over, nb, ({_HEX}) % nb AS first FROM p3),
f AS (SELECT e1.*, p.* EXCLUDE (k, shard), sum(size) OVER (PARTITION BY e1.k, e1.shard ORDER BY m, doc_id, size ROWS UNBOUNDED PRECEDING) AS e FROM e1 JOIN p ON e1.k = p.k AND e1.shard = p.shard)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(e, least(shard_size, (first + over) * 32)) - greatest(e - size, first * 32))
    + greatest(0, least(e, greatest(0, first + over - nb) * 32) - (e - size)))::BIGINT AS taken FROM f
"""
