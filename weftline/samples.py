"""Queries of exact samples, clusters of near points, mixtures of samples, joint sites and files of records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline import lineage
from weftline.operators import mixture, proximity, sampling, sites
from weftline.registry import query, table
from weftline.sources import reads
from weftline.streaming import ordering

NEAR = 20


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) ORDER BY left(md5(l_orderkey::VARCHAR), 15), l_orderkey LIMIT 700)")
def ds_exact(spark, sf_dir):
    """All lines of exactly 700 orders."""
    return sampling.exactly(table(spark, sf_dir, "lineitem"), ["l_orderkey"], 700, few=50).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT c_custkey FROM customer ORDER BY left(md5(c_custkey::VARCHAR), 15), c_custkey LIMIT 120)")
def ds_chained(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return sampling.chained(customers, ["c_custkey"], 120, customers.count()).select("c_custkey")


_POINTS = "points AS (SELECT *, l_extendedprice::BIGINT % 1000 AS x, (l_partkey * 7 + l_linenumber * 13) % 1000 AS y FROM lineitem)"


@query(f"""WITH RECURSIVE {_POINTS}, d AS (SELECT DISTINCT l_suppkey, l_returnflag, x, y FROM points),
e AS (SELECT a.l_suppkey, a.l_returnflag, a.x, a.y, b.x AS tx, b.y AS ty FROM d a JOIN d b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = b.l_returnflag AND abs(a.x - b.x) <= {NEAR} AND abs(a.y - b.y) <= {NEAR}),
r AS (SELECT l_suppkey, l_returnflag, x, y, tx, ty FROM e UNION SELECT r.l_suppkey, r.l_returnflag, r.x, r.y, e.tx, e.ty FROM r JOIN e ON e.l_suppkey = r.l_suppkey AND e.l_returnflag = r.l_returnflag AND e.x = r.tx AND e.y = r.ty),
c AS (SELECT l_suppkey, l_returnflag, x, y, min(tx * 1000 + ty) AS cluster FROM r GROUP BY ALL)
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice) > 1 AS is_dup,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice) > 1 AND row_number() OVER (PARTITION BY l_suppkey, l_returnflag, cluster ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice) > 1 AS is_optical
FROM points JOIN c USING (l_suppkey, l_returnflag, x, y)""")
def w_optical(spark, sf_dir):
    """Lines of one supplier are copies; those that also lie near each other on a plane (a return flag) are optical."""
    x, y = F.expr("CAST(bround(l_extendedprice, 0) AS BIGINT) % 1000"), (F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % 1000
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice", x.alias("x"), y.alias("y"))
    best = [F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return proximity.mark_optical(points, ["l_suppkey"], ["l_returnflag"], "x", "y", NEAR, best).select("l_orderkey", "l_linenumber", "is_dup", "is_optical")


# A sample of which every tenth read is a stranger's

_U = "('0x' || left(md5({0}), 6))::BIGINT / 16777216.0"
_MIXED = f"""sites AS (SELECT DISTINCT l_partkey, 0.1 + 0.8 * (l_partkey % 97) / 97.0 AS freq FROM lineitem),
drawn AS (SELECT l_partkey, freq, {_U.format("'g' || l_partkey")} AS g, {_U.format("'s' || l_partkey")} AS s FROM sites),
types AS (SELECT l_partkey, freq, CASE WHEN g < freq * freq THEN 2 WHEN g < freq * freq + 2 * freq * (1 - freq) THEN 1 ELSE 0 END AS own, CASE WHEN s < freq * freq THEN 2 WHEN s < freq * freq + 2 * freq * (1 - freq) THEN 1 ELSE 0 END AS other FROM drawn),
named AS (SELECT l_partkey, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS name, 20 + 2 * l_linenumber AS qual FROM lineitem),
seen AS (SELECT l_partkey, freq, {_U.format("'l' || name")} < CASE WHEN {_U.format("'c' || name")} < 0.1 THEN other ELSE own END / 2.0 AS alt, least(0.75, power(10.0, -qual / 10.0)) AS wrong, count(*) AS n FROM named JOIN types USING (l_partkey) GROUP BY ALL)"""


def _grid_sql(grid: str) -> str:
    return f"""(SELECT alpha, sum(l) AS l FROM (SELECT alpha, l_partkey, any_value(top) + ln(sum(p * exp(l - top))) AS l FROM (SELECT *, max(l) OVER (PARTITION BY alpha, l_partkey) AS top FROM (
  SELECT alpha, l_partkey, a, b, power(1 - freq, 2 - a) * power(freq, a) * CASE a WHEN 1 THEN 2 ELSE 1 END * power(1 - freq, 2 - b) * power(freq, b) * CASE b WHEN 1 THEN 2 ELSE 1 END AS p,
  sum(n * ln(greatest(1e-300, CASE WHEN alt THEN s * (1 - wrong) + (1 - s) * wrong / 3 ELSE (1 - s) * (1 - wrong) + s * wrong / 3 END))) AS l
  FROM (SELECT *, (1 - alpha) * a / 2.0 + alpha * b / 2.0 AS s FROM seen, {grid}, (SELECT unnest([0, 1, 2]) AS a), (SELECT unnest([0, 1, 2]) AS b)) GROUP BY alpha, l_partkey, a, b, freq)) GROUP BY alpha, l_partkey) GROUP BY alpha)"""


@query(f"""WITH {_MIXED}, coarse AS (SELECT unnest(generate_series(0, 10)) * 0.05::DOUBLE AS alpha), c AS (SELECT arg_max(alpha, l) AS best FROM {_grid_sql('coarse')}),
fine AS (SELECT DISTINCT round(least(0.5, greatest(0, best + k * 0.0025)), 10)::DOUBLE AS alpha FROM c, (SELECT unnest(generate_series(-20, 20)) AS k)) SELECT alpha, round(l, 3) AS log_likelihood FROM {_grid_sql('fine')}""")
def x_mixture(spark, sf_dir):
    """The likelihood of each share of the stranger, around the best."""
    u = lambda mark, of: F.conv(F.left(F.md5(F.concat(F.lit(mark), of)), F.lit(6)), 16, 10).cast("long") / 16777216.0
    part = F.col("l_partkey").cast("string")
    freq = F.lit(0.1) + F.lit(0.8) * (F.col("l_partkey") % 97) / 97.0
    name = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    draw = lambda chance: F.when(chance < F.col("freq") * F.col("freq"), 2).when(chance < F.col("freq") * F.col("freq") + 2 * F.col("freq") * (1 - F.col("freq")), 1).otherwise(0)
    reads = table(spark, sf_dir, "lineitem").select("l_partkey", freq.alias("freq"), name.alias("name"), (20 + 2 * F.col("l_linenumber")).alias("qual"), u("g", part).alias("g"), u("s", part).alias("s"))
    reads = reads.withColumn("type", F.when(u("c", F.col("name")) < 0.1, draw(F.col("s"))).otherwise(draw(F.col("g")))).withColumn("alt", u("l", F.col("name")) < F.col("type") / 2)
    _, grid = mixture.estimate(mixture.site_counts(reads, ["l_partkey"], "freq", "alt", "qual"))
    return grid.withColumn("log_likelihood", F.round("log_likelihood", 3))


# Sites that any sample varies at

_RECORDS = "records AS (SELECT user_id, event_id AS lo, CASE WHEN event_type = 'error' THEN event_id ELSE coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), event_id + 500) - 1 END AS hi, event_type = 'error' AS varies, value FROM events)"


def event_records(spark, sf_dir: str) -> DataFrame:
    """An error is a variant of its user; another event a block up to the user's next one."""
    error = F.col("event_type") == "error"
    following = F.coalesce(F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id")), F.col("event_id") + 500)
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("lo"), F.when(error, F.col("event_id")).otherwise(following - 1).alias("hi"), error.alias("varies"), "value")


@query(f"""WITH {_RECORDS}, s AS (SELECT DISTINCT lo AS pos FROM records WHERE varies), m AS (SELECT pos, user_id, r.varies, value FROM s JOIN records r ON pos BETWEEN r.lo AND r.hi)
SELECT pos, count(*) AS n_called, count(*) FILTER (varies) AS n_variant, count(*) FILTER (NOT varies) AS n_block FROM m GROUP BY 1""")
def j_sites(spark, sf_dir):
    return sites.site_counts(event_records(spark, sf_dir), [], "user_id", "varies")


# Files of records


@query("SELECT c_name AS name, c_mktsegment AS comment, translate(md5(c_custkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq, '@' || left(md5(c_name), 31) AS qual FROM customer")
def src_reads(spark, sf_dir):
    """Written in compressed blocks and read back, many tasks a file; qualities begin as a record does."""
    qual = F.concat(F.lit("@"), F.left(F.md5("c_name"), F.lit(31)))
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("comment"), F.translate(F.md5(F.col("c_custkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"), qual.alias("qual"))
    path = f"{lineage.shared_folder(spark)}/{uuid.uuid4().hex}.reads"
    reads.write_reads(rows, path)
    return reads.read_reads(spark, path, split=1 << 15).select("name", "comment", "seq", "qual")


@query("""SELECT o_orderkey AS name, mate, translate(md5(mate || '-' || o_orderkey), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq, list_sum(list_transform(string_split(md5(o_orderkey::VARCHAR), ''), lambda c: ord(c) - 33))::BIGINT AS total FROM orders, (SELECT unnest([1, 2]) AS mate)""")
def src_pairs(spark, sf_dir):
    """Two plain files of mates, read and joined by name."""
    orders, folder = table(spark, sf_dir, "orders"), f"{lineage.shared_folder(spark)}/{uuid.uuid4().hex}"

    def file(mate: int) -> DataFrame:
        key = F.col("o_orderkey").cast("string")
        rows = orders.select(F.concat(key, F.lit(f"/{mate}")).alias("name"), F.lit("").alias("comment"), F.translate(F.md5(F.concat(F.lit(f"{mate}-"), key)), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"), F.md5(key).alias("qual"))
        reads.write_reads(rows, f"{folder}-{mate}.reads", blocks=False)
        return reads.read_reads(spark, f"{folder}-{mate}.reads", split=1 << 16)

    out = reads.unaligned(file(1), file(2), "s")
    return out.select(F.col("name").cast("long").alias("name"), "mate", "seq", F.aggregate("quals", F.lit(0).cast("long"), lambda a, q: a + q).alias("total"))


# A stream in order


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) - 1 AS number FROM events")
def w_stream_sort(spark, sf_dir):
    """Events that arrive up to six hours late, in two runs of one stream that goes on from its checkpoint."""
    folder = f"{lineage.shared_folder(spark)}/{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp_ltz").alias("ts"))
    delay = F.conv(F.left(F.md5(F.col("event_id").cast("string")), F.lit(6)), 16, 10).cast("long") % (6 * 3600)
    arrives = F.unix_seconds("ts") + delay
    ends = events.agg(F.min(arrives).alias("lo"), F.max(arrives).alias("hi")).first()
    last = events.select("user_id").distinct().select(F.lit(-1).cast("long").alias("event_id"), "user_id", F.timestamp_seconds(F.lit((ends["hi"] or 0) + 365 * 86400)).alias("ts"))  # moves the watermark past all others
    for k in range(2):
        part = events.where(F.floor((arrives - (ends["lo"] or 0)) * 2 / ((ends["hi"] or 0) - (ends["lo"] or 0) + 1)) == k)
        (part if k < 1 else part.unionByName(last)).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        run = ordering.reordered(stream, ["user_id"], "ts", "6 hours", ["event_id"]).writeStream.format("parquet")
        run.option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("user_id", "event_id", "number")
