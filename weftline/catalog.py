"""Register of the library's queries on the provided tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline import functions as fn
from weftline import operators as op
from weftline import alignments, records, samples  # noqa: F401  (their queries register themselves)
from weftline.plans import graph
from weftline.plans.scatter import Scatter
from weftline.registry import oracle_sql, queries, query, table  # noqa: F401

def lines(spark: SparkSession, sf_dir: str) -> Scatter:
    return Scatter(table(spark, sf_dir, "documents")).flat_map(lambda df: df.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")))


_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"
_COUNT = "CASE WHEN line = '' THEN 1 WHEN rtrim(line, ' ') = '' THEN 0 ELSE len(string_split(rtrim(line, ' '), ' ')) END"
_PARTS = "parts AS (SELECT p_partkey, p_partkey * 5 AS lo, p_partkey * 5 + p_size AS hi FROM part)"


@query(f"WITH {_LINES} SELECT ({_COUNT})::INT AS n_words, count(*) AS n_lines FROM lines GROUP BY 1")
def t_wc_hist(spark, sf_dir):
    counted = lines(spark, sf_dir).map(n_words=fn.words_in_line(F.col("line")))
    return counted.group_by("n_words", n_lines=F.count(F.lit(1))).rows


@query(f"WITH {_LINES}, n AS (SELECT {_COUNT} AS n FROM lines) SELECT sum(n)::BIGINT AS total, sum(n * n)::BIGINT AS total_sq FROM n")
def t_sum_counts(spark, sf_dir):
    return lines(spark, sf_dir).map(n=fn.words_in_line(F.col("line")).cast("long")).gather(total=F.sum("n"), total_sq=F.sum(F.col("n") * F.col("n")))


@query("WITH w AS (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS w FROM documents) SELECT length(w)::INT AS word_len, count(*) AS n FROM w WHERE w <> '' GROUP BY 1")
def t_flat_len(spark, sf_dir):
    words = Scatter(table(spark, sf_dir, "documents")).flat_map(lambda df: df.select(F.explode(F.split("text", "[ \n]+")).alias("w")).where("w <> ''"))
    return words.map(word_len=F.length("w")).group_by("word_len", n=F.count(F.lit(1))).rows


@query("SELECT count(*) AS n_words FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS w FROM documents) WHERE w <> ''")
def t_flat_sum(spark, sf_dir):
    words = Scatter(table(spark, sf_dir, "documents")).flat_map(lambda df: df.select(F.explode(F.split("text", "[ \n]+")).alias("w")).where("w <> ''"))
    return words.gather(n_words=F.count(F.lit(1)))


@query(f"WITH {_LINES} SELECT sum({_COUNT})::BIGINT AS n_words FROM lines WHERE pos % 2 = 1")
def t_flat_empty(spark, sf_dir):
    odd = lines(spark, sf_dir).flat_map(lambda df: df.where("pos % 2 = 1"))
    return odd.map(n=fn.words_in_line(F.col("line")).cast("long")).gather(n_words=F.sum("n"))


@query(f"WITH {_LINES}, n AS (SELECT pos, {_COUNT} AS n FROM lines) SELECT sum(n)::BIGINT AS n_words FROM n WHERE pos % 2 = 1")
def t_flat_single(spark, sf_dir):
    counted = lines(spark, sf_dir).map(pos=F.col("pos"), n=fn.words_in_line(F.col("line")).cast("long"))
    return counted.flat_map(lambda df: df.where("pos % 2 = 1")).gather(n_words=F.sum("n"))


@query("SELECT count(*) AS n_pairs, count(DISTINCT user_id) AS n_users FROM (SELECT DISTINCT user_id, event_type FROM events)")
def t_merge_libs(spark, sf_dir):
    merged = Scatter(table(spark, sf_dir, "events")).group_by("user_id", "event_type", n=F.count(F.lit(1)))
    return merged.gather(n_pairs=F.count(F.lit(1)), n_users=F.countDistinct("user_id"))


@query("WITH l AS (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) SELECT length(w)::INT AS word_len, count(*) AS n FROM l GROUP BY 1")
def t_iter(spark, sf_dir):
    words = Scatter(table(spark, sf_dir, "part")).flat_map(lambda df: df.select(F.explode(F.split("p_name", " ")).alias("w")))
    return words.map(word_len=F.length("w")).group_by("word_len", n=F.count(F.lit(1))).rows


@query("SELECT o_custkey, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1")
def sg_groupby(spark, sf_dir):
    keys = F.array_join(F.sort_array(F.collect_list("o_orderkey")).cast("array<string>"), ",")
    return Scatter(table(spark, sf_dir, "orders")).group_by("o_custkey", n=F.count(F.lit(1)), keys=keys).rows


@query("SELECT p_brand, sum(p_size)::BIGINT AS n FROM part WHERE p_size >= 1 GROUP BY 1")
def sg_flatmap(spark, sf_dir):
    units = Scatter(table(spark, sf_dir, "part").where("p_size >= 1")).flat_map(lambda df: df.select("p_brand", F.explode(F.sequence(F.lit(1), "p_size"))))
    return units.group_by("p_brand", n=F.count(F.lit(1))).rows


@query("SELECT l_returnflag, count(*) * least(1.0, 1000::DOUBLE / (SELECT count(*) FROM lineitem)) AS expected FROM lineitem GROUP BY 1")
def g_link(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").count()
    total = counts.agg(F.sum("count")).scalar()
    return counts.select("l_returnflag", (F.col("count") * F.least(F.lit(1.0), 1000 / total)).alias("expected"))


@query("WITH c AS (SELECT CASE WHEN avg(l_discount) > 0.05 THEN 'R' ELSE 'A' END AS b FROM lineitem) SELECT b AS branch, count(*) AS n FROM lineitem, c WHERE l_returnflag = b GROUP BY 1")
def g_either(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    branch = F.when(items.agg(F.avg("l_discount")).scalar() > 0.05, "R").otherwise("A")
    return items.where(F.col("l_returnflag") == branch).groupBy(F.col("l_returnflag").alias("branch")).agg(F.count(F.lit(1)).alias("n"))


# Dependencies among the tables' own rows

_TURNS = "e AS (SELECT DISTINCT conv_id || '/' || role AS src, conv_id || '/' || next AS dst FROM (SELECT conv_id, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS next FROM conversations) WHERE next IS NOT NULL)"
_DAYS = "e AS (SELECT DISTINCT 'n' || c_nationkey AS src, 's' || o_orderstatus || c_nationkey AS dst FROM customer JOIN orders ON c_custkey = o_custkey UNION SELECT DISTINCT 's' || o_orderstatus || c_nationkey, 'p' || o_orderpriority || c_nationkey % 5 FROM customer JOIN orders ON c_custkey = o_custkey UNION SELECT DISTINCT 'p' || o_orderpriority || c_nationkey % 5, 'm' || c_mktsegment FROM customer JOIN orders ON c_custkey = o_custkey)"
_REACH = "r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"


def turn_edges(spark, sf_dir) -> DataFrame:
    """Within a conversation, a role is followed by the next turn's."""
    following = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", following.alias("next")).where("next is not null")
    node = lambda c: F.concat_ws("/", F.col("conv_id").cast("string"), c)
    return turns.select(node("role").alias("src"), node("next").alias("dst")).distinct()


def nation_edges(spark, sf_dir) -> DataFrame:
    """Nations to the states of their orders, these to priorities, and these to market segments: four levels."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    nation = F.col("c_nationkey")
    state, priority = text("s", F.col("o_orderstatus"), nation), text("p", F.col("o_orderpriority"), nation % 5)
    pairs = F.array(*[F.struct(a.alias("src"), b.alias("dst")) for a, b in ((text("n", nation), state), (state, priority), (priority, text("m", F.col("c_mktsegment"))))])
    return rows.select(F.explode(pairs).alias("e")).select("e.src", "e.dst").distinct()


@query(f"WITH RECURSIVE {_DAYS}, {_REACH} SELECT src, dst FROM r")
def g_closure(spark, sf_dir):
    return graph.closure(nation_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {_DAYS}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), l AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT dst FROM e) UNION SELECT e.dst, level + 1 FROM l JOIN e ON l.node = e.src) SELECT node, max(level)::INT AS level FROM l GROUP BY 1")
def g_levels(spark, sf_dir):
    return graph.levels(nation_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {_TURNS}, {_REACH} SELECT DISTINCT src AS node FROM r WHERE src = dst")
def g_cycle(spark, sf_dir):
    return graph.cyclic(turn_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {_TURNS}, {_REACH}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), m AS (SELECT a.src, min(a.dst) AS least FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1) SELECT node, least(node, coalesce(least, node)) AS component FROM n LEFT JOIN m ON node = src")
def g_scc(spark, sf_dir):
    return graph.components(turn_edges(spark, sf_dir))


@query(f"WITH {_DAYS} SELECT DISTINCT dst AS node FROM e WHERE src NOT IN (SELECT 's' || o_orderstatus || c_nationkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 480000)")
def g_orphan(spark, sf_dir):
    """Whose predecessors have no order above 480,000."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 480000"), F.col("c_custkey") == F.col("o_custkey"))
    kept = rows.select(F.concat(F.lit("s"), "o_orderstatus", F.col("c_nationkey").cast("string")).alias("node")).distinct()
    return graph.orphans(nation_edges(spark, sf_dir), kept)


@query(f"WITH {_DAYS}, b AS (SELECT DISTINCT 's' || o_orderstatus || c_nationkey AS src FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P') SELECT src, dst FROM e WHERE NOT (src IN (SELECT src FROM b) AND dst LIKE 'p1%')")
def g_break(spark, sf_dir):
    """The edges from pending states to urgent priorities are cut."""
    edges = nation_edges(spark, sf_dir)
    cut = edges.where(F.col("src").startswith("sP") & F.col("dst").startswith("p1"))
    return graph.without(edges, cut)


@query("SELECT concat('run.', 'in.', p_type, '.end', '.x') AS name, count(*) AS n FROM part GROUP BY 1")
def g_names(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(graph.named(F.col("p_type"), [("run.", ".end"), ("in.", ".x")]).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IS DISTINCT FROM l_linestatus")
def f_ne_cols(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where(op.differ(F.col("l_returnflag"), F.col("l_linestatus"))).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_brand || ':' || (p_partkey * 5 - 1) || '-' || (p_partkey * 5 + p_size) AS region FROM part")
def p_region(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", op.region(F.col("p_brand"), F.col("p_partkey") * 5, F.col("p_partkey") * 5 + F.col("p_size")).alias("region"))


@query("SELECT p_partkey, regexp_replace(upper(p_name), '[KMRYSWBVHDX]', 'N', 'g') AS name_n FROM part")
def p_iupac(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", op.mask_ambiguous(F.col("p_name")).alias("name_n"))


@query("SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_discount <= 0.08 THEN NULL ELSE 'discount' END, CASE WHEN l_tax <= 0.06 THEN NULL ELSE 'tax' END, CASE WHEN l_quantity >= 5 THEN NULL ELSE 'quantity' END) AS failed FROM lineitem")
def f_hard(spark, sf_dir):
    limits = {"discount": F.col("l_discount") <= 0.08, "tax": F.col("l_tax") <= 0.06, "quantity": F.col("l_quantity") >= 5}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", op.failed_filters(limits).alias("failed"))


@query("SELECT c_custkey, left(c_name, 12) AS name FROM customer WHERE length(c_name) >= 12")
def f_exclude_short(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.length("c_name") >= 12).select("c_custkey", F.substring("c_name", 1, 12).alias("name"))


@query("SELECT coalesce(quality, -1)::INT AS truth, coalesce(call, -1)::INT AS call, count(*) AS n FROM labels FULL JOIN (SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS call FROM documents) d ON labels.doc_id = d.doc_id GROUP BY 1, 2")
def j_concord(spark, sf_dir):
    calls = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("call"))
    both = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth")).join(calls, "doc_id", "full_outer")
    return both.groupBy(F.coalesce("truth", F.lit(-1)).cast("int").alias("truth"), F.coalesce("call", F.lit(-1)).alias("call")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(m, 0.0) AS max_price FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS m FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def j_align_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("m"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("m", F.lit(0.0)).alias("max_price"))


@query("SELECT s_suppkey, r_name FROM supplier LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) n ON s_nationkey = n_nationkey")
def j_dbsnp(spark, sf_dir):
    known = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(known, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "r_name")


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 5).alias("lo"), (F.col("p_partkey") * 5 + F.col("p_size")).alias("hi"))


@query(f"WITH {_PARTS} SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM parts WHERE o_orderkey BETWEEN lo AND hi)")
def j_region(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select("o_orderkey")
    return op.overlap_join(points, "o_orderkey", _parts(spark, sf_dir), "lo", "hi", how="left_semi").select("o_orderkey")


@query(f"WITH {_PARTS} SELECT p_partkey, count(o_orderkey) AS n FROM parts LEFT JOIN orders ON o_orderkey BETWEEN lo AND hi GROUP BY 1")
def j_target_cov(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    hits = op.overlap_join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", parts, "lo", "hi").groupBy("p_partkey").agg(F.count(F.lit(1)).alias("k"))
    return parts.join(hits, "p_partkey", "left").select("p_partkey", F.coalesce("k", F.lit(0)).alias("n"))


@query("WITH w AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS t FROM part), o AS (SELECT DISTINCT substr(t, 2) AS v FROM w), d AS (SELECT v, t, levenshtein(v, t) AS d, row_number() OVER g AS r, lead(levenshtein(v, t)) OVER g AS next FROM o, w WINDOW g AS (PARTITION BY v ORDER BY levenshtein(v, t), t)) SELECT v AS observed, t AS best, d::INT AS dist FROM d WHERE r = 1 AND d <= 1 AND coalesce(next - d >= 1, true)")
def j_umi_fix(spark, sf_dir):
    known = table(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("target")).distinct()
    observed = known.select(F.expr("substring(target, 2)").alias("observed"))
    return op.nearest(observed, known, "observed", "target", 1, 1)


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, quantile_cont(l_quantity, 0.5) AS median_qty FROM lineitem")
def a_multi(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.min("l_extendedprice").alias("min_price"), F.max("l_extendedprice").alias("max_price"), F.percentile("l_quantity", F.lit(0.5)).alias("median_qty"),
    )


@query("WITH h AS (SELECT l_quantity::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1) SELECT bin, n FROM h WHERE n >= 0.02 * (SELECT sum(n) FROM h)")
def a_insert_size(spark, sf_dir):
    bins = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.where(F.col("n") >= 0.02 * bins.agg(F.sum("n")).scalar())


@query("WITH c AS (SELECT c_name, unnest(generate_series(1, length(c_name))) AS pos FROM customer) SELECT pos::INT AS pos, substr(c_name, pos, 1) AS ch, count(*) AS n FROM c GROUP BY 1, 2")
def a_by_cycle(spark, sf_dir):
    letters = table(spark, sf_dir, "customer").where("length(c_name) > 0").select(F.posexplode(F.split("c_name", "(?!^)")).alias("at", "ch")).where("ch <> ''")
    return letters.groupBy((F.col("at") + 1).alias("pos"), "ch").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_partkey, arg_min(l_returnflag, (-n, l_returnflag)) AS flag FROM c GROUP BY 1")
def a_consensus(spark, sf_dir):
    return op.majority(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_returnflag", "flag")


@query("SELECT size AS set_size, count(*) AS n FROM (SELECT l_partkey, l_suppkey, count(*) AS size FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def a_complexity(spark, sf_dir):
    sets = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("set_size"))
    return sets.groupBy("set_size").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) > 1 AS is_dup FROM lineitem")
def w_dedup(spark, sf_dir):
    best = [F.desc("l_quantity"), "l_orderkey", "l_linenumber"]
    return op.mark_duplicates(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], best).select("l_orderkey", "l_linenumber", "is_dup")


@query("WITH RECURSIVE s AS (SELECT p_partkey, p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part), r AS (SELECT p_partkey, p_brand, i, p_size AS total, 0 AS bin FROM s WHERE i = 1 UNION ALL SELECT s.p_partkey, s.p_brand, s.i, CASE WHEN r.total > 0 AND r.total + s.p_size > 100 THEN s.p_size ELSE r.total + s.p_size END, CASE WHEN r.total > 0 AND r.total + s.p_size > 100 THEN r.bin + 1 ELSE r.bin END FROM r JOIN s ON s.p_brand = r.p_brand AND s.i = r.i + 1) SELECT p_brand, p_partkey, bin::BIGINT AS bin FROM r")
def w_greedy_bins(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
    return op.pack(parts, "p_partkey", "p_size", 100, ["p_brand"]).select("p_brand", "p_partkey", "bin")


@query(f"WITH {_PARTS}, b AS (SELECT *, unnest(generate_series(lo // 64, hi // 64)) AS bin FROM parts) SELECT p_partkey, greatest(lo, bin * 64) AS lo, least(hi, bin * 64 + 63) AS hi FROM b")
def w_band_split(spark, sf_dir):
    return op.split_at_bands(_parts(spark, sf_dir), "lo", "hi", 64)


@query("WITH p AS (SELECT p_brand, p_partkey * 5 AS lo, p_partkey * 5 + p_size AS hi FROM part), m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY p_brand ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM p), i AS (SELECT *, sum(new) OVER (PARTITION BY p_brand ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isl FROM m) SELECT p_brand, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY p_brand, isl")
def u_intervals(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_brand", (F.col("p_partkey") * 5).alias("lo"), (F.col("p_partkey") * 5 + F.col("p_size")).alias("hi"))
    return op.merge_intervals(parts, "lo", "hi", ["p_brand"])


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS src, o_orderkey FROM orders")
def u_gather(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return orders.where("o_orderkey % 2 = 0").select(F.lit(0).alias("src"), "o_orderkey").unionByName(orders.where("o_orderkey % 2 <> 0").select(F.lit(1).alias("src"), "o_orderkey"))


@query("SELECT event_id, event_type, (row_number() OVER (ORDER BY value DESC, event_id))::INT AS rn FROM events ORDER BY rn LIMIT 20")
def s_top(spark, sf_dir):
    top = table(spark, sf_dir, "events").select("event_id", "event_type", "value").orderBy(F.desc_nulls_first("value"), "event_id").limit(20)
    return top.select("event_id", "event_type", F.row_number().over(Window.orderBy(F.desc_nulls_first("value"), "event_id")).alias("rn"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a_status_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, round(sum(value), 6) AS used, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1")
def a_util(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'click'").groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("used"), F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type IN ('error', 'view')) AS others, coalesce(bool_or(event_type = 'error'), false) AS has_error, coalesce(bool_and(value >= 0), true) AS all_valued FROM events")
def a_task_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(
        F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type").isin("error", "view")).alias("others"),
        F.coalesce(F.bool_or(F.col("event_type") == "error"), F.lit(False)).alias("has_error"), F.coalesce(F.bool_and(F.col("value") >= 0), F.lit(True)).alias("all_valued"),
    )


@query("SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, bool_or(event_type = 'error') AS failed, (epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))))::BIGINT AS elapsed FROM events GROUP BY 1")
def a_rollup_dates(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.bool_or(F.col("event_type") == "error").alias("failed"),
        (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("elapsed"),
    )


_SIZE_TEXT = "CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'k' WHEN 2 THEN 'K' WHEN 3 THEN 'kb' WHEN 4 THEN 'Gb' WHEN 5 THEN 't' WHEN 6 THEN 'P' WHEN 7 THEN 'x' ELSE '000000000' END"


@query(f"WITH t AS (SELECT event_id, event_id || {_SIZE_TEXT} AS text FROM events) SELECT event_id, text, CASE WHEN event_id % 9 = 7 THEN -1 ELSE regexp_extract(text, '^[0-9]+')::HUGEINT * CASE lower(regexp_extract(text, '[A-Za-z]')) WHEN 'k' THEN 1024 WHEN 'g' THEN 1073741824 WHEN 't' THEN 1099511627776 WHEN 'p' THEN 1125899906842624 ELSE 1 END END::VARCHAR AS out FROM t")
def fn_parse_size(spark, sf_dir):
    texts = table(spark, sf_dir, "events").select("event_id", F.concat(F.col("event_id").cast("string"), F.expr(_SIZE_TEXT)).alias("text"))
    return texts.select("event_id", "text", fn.parse_size(F.col("text")).cast("string").alias("out"))


_SIZE_SHOWN = "CASE WHEN size > {u} THEN (size // {u})::VARCHAR ELSE regexp_replace(regexp_replace(printf('%.2f', size / {u}.0), '0+$', ''), '\\.$', '') END || '{s}'"


@query(f"SELECT size, {_SIZE_SHOWN.format(u=1 << 20, s='m')} AS out FROM (SELECT o_orderkey * 997 + 13 AS size FROM orders)")
def fn_fmt_size(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 997 + 13).alias("size")).select("size", fn.format_size(F.col("size"), 1 << 20, "m").alias("out"))


@query(f"SELECT size, CASE WHEN size > 1073741824 THEN {_SIZE_SHOWN.format(u=1 << 30, s='g')} WHEN size > 1048576 THEN {_SIZE_SHOWN.format(u=1 << 20, s='m')} ELSE {_SIZE_SHOWN.format(u=1 << 10, s='k')} END AS out FROM (SELECT o_orderkey * o_orderkey * 997 + 13 AS size FROM orders)")
def fn_pretty(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") * F.col("o_orderkey") * 997 + 13).alias("size")).select("size", fn.pretty_size(F.col("size")).alias("out"))


@query("SELECT s_suppkey, CASE WHEN length(s_suppkey::VARCHAR) >= 3 THEN s_suppkey::VARCHAR ELSE lpad(s_suppkey::VARCHAR, 3, '0') END || 'X' AS out FROM supplier")
def fn_pad(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", fn.pad(F.col("s_suppkey"), 3, "X").alias("out"))


@query("SELECT p_partkey, floor(p_retailprice / 100 + 0.5)::BIGINT AS cores, least(1.0, 1000 / p_retailprice) AS proportion FROM part")
def fn_numbers(spark, sf_dir):
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", fn.round_half_up(price / 100).alias("cores"), F.least(F.lit(1.0), 1000 / price).alias("proportion"))


@query("SELECT o_orderkey FROM orders WHERE md5(o_orderkey::VARCHAR) < '40'")
def ds_md5(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.md5(F.col("o_orderkey").cast("string")) < "40").select("o_orderkey")


@query("""WITH n AS (SELECT DISTINCT p_brand || p_type || 'Of' || split_part(p_name, ' ', 1) || 'XML' || p_size AS name FROM part),
c AS (SELECT name, i, substr(name, i - 1, 1) AS a, substr(name, i, 1) AS b, substr(name, i + 1, 1) AS d FROM (SELECT name, unnest(generate_series(1, length(name))) AS i FROM n))
SELECT name, string_agg(CASE WHEN i > 1 AND ((b BETWEEN 'A' AND 'Z' AND (NOT a BETWEEN 'A' AND 'Z' OR d BETWEEN 'a' AND 'z')) OR (regexp_matches(a, '[A-Za-z]') AND NOT regexp_matches(b, '[A-Za-z]'))) THEN ' ' ELSE '' END || b, '' ORDER BY i) AS label FROM c GROUP BY name""")
def fn_human(spark, sf_dir):
    first = F.split("p_name", " ")[0]
    names = table(spark, sf_dir, "part").select(F.concat("p_brand", "p_type", F.lit("Of"), first, F.lit("XML"), F.col("p_size").cast("string")).alias("name")).distinct()
    return names.select("name", fn.human_name(F.col("name")).alias("label"))
