"""Queries of the record operators on the provided tables: filters, projections, joins, metrics, sorts, sets of intervals, scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline import functions as fn
from weftline import operators as op
from weftline.operators import alleles, barcodes, intervals, ordering
from weftline.registry import query, table

_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"
#: One call for each order: a reference, alternatives in order, and the samples' choices among them.
_CALLS = """calls AS (SELECT l_orderkey AS pos, min(l_returnflag) AS ref, list(l_returnflag || l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS alts,
  list((l_linenumber * 2 % 5)::INT ORDER BY l_linenumber) AS chosen FROM lineitem GROUP BY 1)"""


def lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def calls(spark, sf_dir) -> DataFrame:
    mention = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pos")).agg(
        F.min("l_returnflag").alias("ref"), F.transform(F.sort_array(F.collect_list(mention)), lambda m: F.concat(m["l_returnflag"], m["l_linestatus"])).alias("alts"),
        F.transform(F.sort_array(F.collect_list("l_linenumber")), lambda n: (n * 2 % 5).cast("int")).alias("chosen"),
    )


def joined(items: Column) -> Column:
    return F.array_join(items, ",")


# Filters and projections


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS n FROM lines WHERE NOT starts_with(line, 'A') GROUP BY 1")
def f_drop_header(spark, sf_dir):
    return lines(spark, sf_dir).where(~F.col("line").startswith("A")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW' OR o_totalprice > 250000")
def f_qual(spark, sf_dir):
    return table(spark, sf_dir, "orders").where((F.col("o_orderpriority") == "5-LOW") | (F.col("o_totalprice") > 250_000)).select("o_orderkey")


@query(f"WITH {_LINES} SELECT doc_id, pos::INT AS pos FROM lines WHERE starts_with(line, 'T') OR string_split(line, ' ')[4] <> 'the'")
def f_missing(spark, sf_dir):
    fourth = F.get(F.split("line", " "), F.lit(3))
    return lines(spark, sf_dir).where(F.col("line").startswith("T") | (fourth != "the")).select("doc_id", "pos")


@query(f"WITH {_CALLS} SELECT pos, array_to_string(list_filter(alts, lambda a, i: list_contains(chosen, i)), ',') AS kept FROM calls")
def f_trim_alts(spark, sf_dir):
    return calls(spark, sf_dir).select("pos", joined(alleles.seen_alternatives(F.col("alts"), F.col("chosen"))).alias("kept"))


@query(f"WITH {_CALLS}, c AS (SELECT pos, ref || 'F' AS ref, alts FROM calls) SELECT pos, array_to_string(list_filter(alts, lambda a, i: list_position(alts, a) = i AND a <> ref), ',') AS kept FROM c")
def f_uniq_alleles(spark, sf_dir):
    return calls(spark, sf_dir).select("pos", joined(alleles.unique_alternatives(F.col("alts"), F.concat("ref", F.lit("F")))).alias("kept"))


@query(f"WITH {_CALLS} SELECT pos, array_to_string(list_transform(range(1, len(alts) + 1), lambda i: len(list_filter(chosen, lambda g: g = i))), ',') AS counts, len(chosen)::INT AS samples FROM calls")
def p_fixup(spark, sf_dir):
    return calls(spark, sf_dir).select("pos", joined(alleles.allele_counts(F.col("alts"), F.col("chosen")).cast("array<string>")).alias("counts"), F.size("chosen").alias("samples"))


_CODES = "codes AS (SELECT p_partkey AS id, p_partkey * 10 AS pos, lpad(p_partkey::VARCHAR, 6, '0') AS ref, lpad((p_partkey * 7 % 100000)::VARCHAR, 6, '0') AS alt FROM part)"


@query(f"WITH {_CODES} SELECT id, pos + i - 1 AS pos, substr(ref, i, 1) AS ref, substr(alt, i, 1) AS alt FROM codes, (SELECT unnest(generate_series(1, 6)) AS i) WHERE substr(ref, i, 1) <> substr(alt, i, 1)")
def p_split_mnp(spark, sf_dir):
    key = F.col("p_partkey")
    codes = table(spark, sf_dir, "part").select(key.alias("id"), (key * 10).alias("pos"), F.lpad(key.cast("string"), 6, "0").alias("ref"), F.lpad((key * 7 % 100_000).cast("string"), 6, "0").alias("alt"))
    return alleles.primitives(codes, "pos", "ref", "alt")


@query("""WITH c AS (SELECT p_partkey AS id, p_partkey AS pos, p_brand AS ref, 'Brand#' || p_size || right(p_brand, 1) AS alt FROM part),
t AS (SELECT *, list_max(list_filter(range(0, least(length(ref), length(alt))), lambda k: right(ref, k) = right(alt, k) OR k = 0)) AS k FROM c),
u AS (SELECT id, pos, left(ref, length(ref) - k) AS ref, left(alt, length(alt) - k) AS alt FROM t),
v AS (SELECT *, list_max(list_filter(range(0, least(length(ref), length(alt))), lambda k: left(ref, k) = left(alt, k))) AS h FROM u)
SELECT id, pos + h AS pos, substr(ref, h + 1) AS ref, substr(alt, h + 1) AS alt FROM v""")
def p_trim(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), alleles.trimmed(F.col("p_partkey"), F.col("p_brand"), F.concat(F.lit("Brand#"), F.col("p_size").cast("string"), F.right("p_brand", F.lit(1)))).alias("t"))
    return rows.select("id", "t.pos", "t.ref", "t.alt")


@query("""SELECT o_custkey, string_agg(p || '=' || n, ',' ORDER BY p) AS tags FROM (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') GROUP BY 1, 2) GROUP BY 1
UNION ALL SELECT o_custkey, '' FROM orders GROUP BY 1 HAVING bool_and(o_orderpriority IN ('1-URGENT', '5-LOW'))""")
def p_drop_tags(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    tags = counts.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("tags"))
    kept = F.map_entries(op.without_tags(F.col("tags"), ["1-URGENT", "5-LOW"]))
    return tags.select("o_custkey", joined(F.transform(F.sort_array(kept), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))).alias("tags"))


@query("SELECT s_suppkey, 'lib-1' AS library, 'lane' AS platform, s_name AS sample FROM supplier")
def p_set_const(spark, sf_dir):
    fixed = {"library": F.lit("lib-1"), "platform": F.lit("lane")}
    return table(spark, sf_dir, "supplier").withColumnRenamed("s_name", "sample").withColumns(fixed).select("s_suppkey", "library", "platform", "sample")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN lower(o_orderpriority) END, o_orderpriority) AS priority FROM orders")
def p_revert(spark, sf_dir):
    original = F.when(F.col("o_orderstatus") == "F", F.lower("o_orderpriority"))
    derived = table(spark, sf_dir, "orders").withColumn("original", original).drop("o_totalprice")
    return derived.select("o_orderkey", F.coalesce("original", "o_orderpriority").alias("priority"))


@query("SELECT p_partkey, p_partkey * 5 - 1 AS lo, p_partkey * 5 + p_size AS hi FROM part")
def p_to_bed(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 5 - 1).alias("lo"), (F.col("p_partkey") * 5 + F.col("p_size")).alias("hi"))


@query("SELECT c_custkey, '@' || c_name || chr(10) || c_mktsegment || chr(10) || '+' || chr(10) || repeat('I', length(c_mktsegment)) AS record FROM customer")
def p_to_reads(spark, sf_dir):
    record = F.concat_ws("\n", F.concat(F.lit("@"), "c_name"), "c_mktsegment", F.lit("+"), F.expr("repeat('I', length(c_mktsegment))"))
    return table(spark, sf_dir, "customer").select("c_custkey", record.alias("record"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 40 ELSE l_quantity END AS quantity, CASE WHEN l_linestatus = 'O' THEN 0 ELSE l_discount END::DOUBLE AS discount FROM lineitem")
def p_clean(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.least("l_quantity", F.lit(40.0)).alias("quantity"), F.when(F.col("l_linestatus") == "O", F.lit(0.0)).otherwise(F.col("l_discount")).alias("discount")
    )


@query("SELECT c_custkey, strpos(c_name, '00') AS adapter_at, CASE WHEN strpos(c_name, '00') > 0 THEN left(c_name, strpos(c_name, '00') - 1) ELSE c_name END AS name FROM customer")
def p_mark_adapter(spark, sf_dir):
    at = F.locate("00", "c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", at.cast("long").alias("adapter_at"), F.when(at > 0, F.substring("c_name", F.lit(1), at - 1)).otherwise(F.col("c_name")).alias("name"))


@query("SELECT c_custkey, substr(c_name, 1, 4) || '-' || substr(c_name, 11, 5) AS code, substr(c_name, 16) AS rest FROM customer")
def p_extract_code(spark, sf_dir):
    shape = F.lit("4M6S5M+T")

    def cut_out(kind: str):
        return F.transform(fn.segments(shape, kind), lambda s: F.substring("c_name", s["start"], F.coalesce(s["length"], F.lit(1 << 30))))

    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(cut_out("M"), "-").alias("code"), F.array_join(cut_out("T"), "").alias("rest"))


@query("SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter(['quantity', 'discount', 'flag'], lambda r, i: CASE i WHEN 1 THEN l_quantity < 2 WHEN 2 THEN l_discount > 0.09 ELSE l_returnflag = l_linestatus END)) AS rule FROM lineitem) GROUP BY 1")
def f_validate(spark, sf_dir):
    rules = {"quantity": F.col("l_quantity") < 2, "discount": F.col("l_discount") > 0.09, "flag": F.col("l_returnflag") == F.col("l_linestatus")}
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return table(spark, sf_dir, "lineitem").select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# Joins


@query("SELECT coalesce(f.o_custkey, o.o_custkey) AS o_custkey, f.n AS n_f, o.n AS n_o FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) f JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) o ON f.o_custkey = o.o_custkey")
def j_tumor_normal(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    of = lambda s: orders.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count(F.lit(1)).alias(f"n_{s.lower()}"))
    return of("F").join(of("O"), "o_custkey")


@query(f"WITH {_CALLS}, z AS (SELECT pos, unnest(alts) AS alt, unnest(chosen) AS choice, generate_subscripts(alts, 1) AS k FROM calls) SELECT pos, alt, choice, k::INT AS place FROM z")
def j_zip3(spark, sf_dir):
    places = F.transform("alts", lambda _, i: i + 1)
    rows = calls(spark, sf_dir).withColumn("places", places).select("pos", F.explode(op.zipped(F.col("alts"), F.col("chosen"), F.col("places"))).alias("z"))
    return rows.select("pos", F.col("z.alts").alias("alt"), F.col("z.chosen").alias("choice"), F.col("z.places").alias("place"))


@query("SELECT c_custkey, min(l_shipdate) AS first, max(l_shipdate) AS last, bool_or(l_returnflag = 'R') AS returned FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def j_enclosing(spark, sf_dir):
    # Each level is rolled up before it meets the next, so only one row an order is joined with its customer.
    orders = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"))
    customers = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(orders, "o_orderkey").join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return customers.groupBy("c_custkey").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.bool_or("returned").alias("returned"))


_READS = """known AS (SELECT DISTINCT upper(translate(substr(md5(n_name), 1, 8), '0123456789', 'ghijklmopq')) AS code FROM nation),
seen AS (SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN code WHEN 1 THEN left(code, c_custkey % 8) || 'N' || substr(code, c_custkey % 8 + 2) WHEN 2 THEN left(code, c_custkey % 8) || 'Z' || substr(code, c_custkey % 8 + 2)
  WHEN 3 THEN 'ZZZ' || substr(code, 4) ELSE 'NNN' || substr(code, 4) END AS seen FROM customer JOIN (SELECT n_nationkey, upper(translate(substr(md5(n_name), 1, 8), '0123456789', 'ghijklmopq')) AS code FROM nation) ON c_nationkey = n_nationkey)"""


@query(f"""WITH {_READS}, m AS (SELECT seen, code, hamming(seen, code) - (8 - length(replace(seen, 'N', ''))) AS d FROM seen, known WHERE 8 - length(replace(seen, 'N', '')) <= 2),
r AS (SELECT *, row_number() OVER w AS k, lead(d) OVER w AS next FROM m WINDOW w AS (PARTITION BY seen ORDER BY d, code)) SELECT seen, code AS best, d::INT AS mismatches FROM r WHERE k = 1 AND d <= 1 AND coalesce(next - d >= 2, true)""")
def j_demux(spark, sf_dir):
    # No known code has an N, which is what can't be called.
    code = F.upper(F.translate(F.substring(F.md5("n_name"), 1, 8), "0123456789", "ghijklmopq"))
    known = table(spark, sf_dir, "nation").select("n_nationkey", code.alias("code"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(known), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations at any scale
    at = (F.col("c_custkey") % 8).cast("int")
    with_ = lambda c: F.concat(F.substring("code", F.lit(1), at), F.lit(c), F.substring("code", at + 2, F.lit(8)))
    kind, tail = F.col("c_custkey") % 5, F.substring("code", 4, 8)
    seen = F.when(kind == 0, F.col("code")).when(kind == 1, with_("N")).when(kind == 2, with_("Z")).when(kind == 3, F.concat(F.lit("ZZZ"), tail)).otherwise(F.concat(F.lit("NNN"), tail))
    return barcodes.assign(rows.select(seen.alias("seen")), known, "seen", "code", 1, 2, 2)


_FIX = "w AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS t FROM part), o AS (SELECT DISTINCT substr(t, 2) || 'x' AS v FROM w)"


@query(f"WITH {_FIX}, d AS (SELECT v, t, levenshtein(v, t) AS d, row_number() OVER g AS r, lead(levenshtein(v, t)) OVER g AS next FROM o, w WINDOW g AS (PARTITION BY v ORDER BY levenshtein(v, t), t)) SELECT v AS observed, t AS best, d::INT AS dist FROM d WHERE r = 1 AND d <= 2 AND coalesce(next - d >= 2, true)")
def j_umi_fix_far(spark, sf_dir):
    known = table(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("target")).distinct()
    return op.nearest(known.select(F.concat(F.expr("substring(target, 2)"), F.lit("x")).alias("observed")), known, "observed", "target", 2, 2)


@query("SELECT a.l_orderkey, a.l_linenumber, a.l_suppkey, min(b.l_suppkey) AS mate FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY ALL")
def j_mates(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    mates = items.groupBy("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber")).agg(F.min("l_suppkey").alias("mate"))
    return items.select("l_orderkey", "l_linenumber", "l_suppkey").distinct().join(mates, ["l_orderkey", "l_linenumber"])


# Metrics


@query("SELECT max(m) AS most FROM (SELECT user_id, quantile_cont(value, 0.5) AS m FROM events GROUP BY 1)")
def a_max_median(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.percentile("value", F.lit(0.5)).alias("m")).agg(F.max("m").alias("most"))


@query("SELECT count(*) AS n, sum(l_quantity)::BIGINT AS total, count(*) FILTER (l_quantity >= 20) AS n_20, count(*) FILTER (l_quantity >= 30) AS n_30, coalesce(sum(l_quantity) FILTER (l_quantity >= 30), 0)::BIGINT AS total_30 FROM lineitem")
def a_yield(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").agg(
        F.count(F.lit(1)).alias("n"), F.sum(q).cast("long").alias("total"), F.count_if(q >= 20).alias("n_20"), F.count_if(q >= 30).alias("n_30"), F.coalesce(F.sum(F.when(q >= 30, q)), F.lit(0)).cast("long").alias("total_30")
    )


@query("SELECT (length(regexp_replace(p_name, '[^aeiou]', '', 'g')) * 10 // length(p_name))::INT AS bin, count(*) AS n, round(avg(p_retailprice), 6) AS mean_price FROM part WHERE length(p_name) > 0 GROUP BY 1")
def a_gc(spark, sf_dir):
    share = F.floor(F.length(F.regexp_replace("p_name", "[^aeiou]", "")) * 10 / F.length("p_name")).cast("int")
    return table(spark, sf_dir, "part").where(F.length("p_name") > 0).groupBy(share.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean_price"))


@query("WITH f AS (SELECT size, count(*) AS n FROM (SELECT user_id, event_type, count(*) AS size FROM events GROUP BY 1, 2) GROUP BY 1) SELECT size, n, (SELECT sum(g.n) FROM f g WHERE g.size >= f.size)::BIGINT AS n_or_more FROM f")
def a_family(spark, sf_dir):
    sizes = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    # One row for each size of a family.
    return sizes.select("size", "n", F.sum("n").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)).alias("n_or_more"))


@query("""WITH c AS (SELECT p_type, i - 1 AS pos, substr(p_name, i, 1) AS ch FROM (SELECT p_type, p_name, unnest(generate_series(1, length(p_name))) AS i FROM part)), n AS (SELECT p_type, pos, ch, count(*) AS n FROM c GROUP BY ALL),
g AS (SELECT p_type, pos, arg_min(ch, (-n, ch)) AS ch, sum(n)::BIGINT AS depth, (sum(n) - max(n))::BIGINT AS errors FROM n GROUP BY 1, 2) SELECT p_type, pos::INT AS pos, CASE WHEN depth >= 3 AND errors <= 0.8 * depth THEN ch ELSE 'N' END AS ch, depth, errors FROM g""")
def a_consensus_reads(spark, sf_dir):
    return op.consensus(table(spark, sf_dir, "part"), ["p_type"], "p_name", 3, 0.8)


@query("""WITH c AS (SELECT p_type, i - 1 AS pos, substr(p_name, i, 1) AS ch FROM (SELECT p_type, p_name, unnest(generate_series(1, length(p_name))) AS i FROM part)), n AS (SELECT p_type, pos, ch, count(*) AS n FROM c GROUP BY ALL)
SELECT pos::INT AS pos, sum(depth)::BIGINT AS depth, sum(depth - most) / sum(depth) AS error_rate FROM (SELECT p_type, pos, sum(n) AS depth, max(n) AS most FROM n GROUP BY 1, 2) GROUP BY 1""")
def a_err_by_pos(spark, sf_dir):
    called = op.consensus(table(spark, sf_dir, "part"), ["p_type"], "p_name")
    return called.groupBy("pos").agg(F.sum("depth").alias("depth"), (F.sum("errors") / F.sum("depth")).alias("error_rate"))


@query("SELECT coalesce(l_returnflag, 'ALL') AS category, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS n_f, round(avg(l_quantity), 6) AS mean_qty FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def a_by_category(spark, sf_dir):
    rolled = table(spark, sf_dir, "lineitem").rollup("l_returnflag")
    return rolled.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("n_f"), F.round(F.avg("l_quantity"), 6).alias("mean_qty")).select(F.coalesce("l_returnflag", F.lit("ALL")).alias("category"), "n", "n_f", "mean_qty")


@query("WITH d AS (SELECT p_partkey, coalesce(n, 0) AS depth FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey) SELECT round(avg(depth), 6) AS mean, quantile_cont(depth, 0.5) AS median, avg(CASE WHEN depth >= 1 THEN 1.0 ELSE 0 END) AS at_1, avg(CASE WHEN depth >= 30 THEN 1.0 ELSE 0 END) AS at_30 FROM d")
def a_depth(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    depth = table(spark, sf_dir, "part").select("p_partkey").join(counts, "p_partkey", "left").select(F.coalesce("n", F.lit(0)).alias("depth"))
    at = lambda k: F.avg(F.when(F.col("depth") >= k, 1.0).otherwise(0.0))
    return depth.agg(F.round(F.avg("depth"), 6).alias("mean"), F.percentile("depth", F.lit(0.5)).alias("median"), at(1).alias("at_1"), at(30).alias("at_30"))


@query("SELECT count(*) AS n, count(quality) AS n_known, count(*) FILTER (quality IS NULL) AS n_novel, count(*) FILTER (quality = 1 AND n_chars > 500) AS n_agreed FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON documents.doc_id = l.doc_id")
def a_known_calls(spark, sf_dir):
    known = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    found = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(known, "doc_id", "left")
    return found.agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("n_known"), F.count_if(F.col("quality").isNull()).alias("n_novel"), F.count_if((F.col("quality") == 1) & (F.col("n_chars") > 500)).alias("n_agreed"))


# Families of codes


_UMIS = "u AS (SELECT p_brand, substr(md5(p_partkey::VARCHAR), 1, 3) AS umi, count(*) AS n FROM part GROUP BY 1, 2)"


def _umis(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand", F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 3).alias("umi"))


@query(f"WITH {_UMIS} SELECT p_brand, umi, n, umi AS family FROM u")
def w_umi_identity(spark, sf_dir):
    return barcodes.families(_umis(spark, sf_dir), ["p_brand"], "umi", "identity")


@query(f"WITH RECURSIVE {_UMIS}, e AS (SELECT a.p_brand, a.umi AS src, b.umi AS dst FROM u a JOIN u b ON a.p_brand = b.p_brand AND hamming(a.umi, b.umi) = 1), r AS (SELECT p_brand, umi, umi AS seen FROM u UNION SELECT r.p_brand, r.umi, e.dst FROM r JOIN e ON e.p_brand = r.p_brand AND e.src = r.seen) SELECT p_brand, umi, n, family FROM u JOIN (SELECT p_brand, umi, min(seen) AS family FROM r GROUP BY 1, 2) f USING (p_brand, umi)")
def w_umi_edit(spark, sf_dir):
    return barcodes.families(_umis(spark, sf_dir), ["p_brand"], "umi", "edit")


_DIRECTED = "e AS (SELECT a.p_brand, a.umi AS src, b.umi AS dst FROM u a JOIN u b ON a.p_brand = b.p_brand AND a.umi <> b.umi AND hamming(a.umi, b.umi) <= 1 AND a.n >= 2 * b.n - 1), r AS (SELECT p_brand, umi AS root, n AS root_n, umi FROM u UNION SELECT r.p_brand, r.root, r.root_n, e.dst FROM r JOIN e ON e.p_brand = r.p_brand AND e.src = r.umi)"


@query(f"WITH RECURSIVE {_UMIS}, {_DIRECTED} SELECT p_brand, umi, n, family FROM u JOIN (SELECT p_brand, umi, arg_min(root, (-root_n, root)) AS family FROM r GROUP BY 1, 2) f USING (p_brand, umi)")
def w_umi_adjacency(spark, sf_dir):
    return barcodes.families(_umis(spark, sf_dir), ["p_brand"], "umi", "adjacency")


_PAIRS = "u AS (SELECT p_brand, least(a || '-' || b, b || '-' || a) AS umi, count(*) AS n FROM (SELECT p_brand, substr(md5(p_partkey::VARCHAR), 1, 1) AS a, substr(md5(p_partkey::VARCHAR), 5, 1) AS b FROM part) GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {_PAIRS}, {_DIRECTED} SELECT p_brand, umi, n, family FROM u JOIN (SELECT p_brand, umi, arg_min(root, (-root_n, root)) AS family FROM r GROUP BY 1, 2) f USING (p_brand, umi)")
def w_umi_paired(spark, sf_dir):
    digest = F.md5(F.col("p_partkey").cast("string"))
    codes = table(spark, sf_dir, "part").select("p_brand", F.concat_ws("-", F.substring(digest, 1, 1), F.substring(digest, 5, 1)).alias("umi"))
    return barcodes.families(codes, ["p_brand"], "umi", "paired")


# Sorts, limits and unions


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rank FROM orders")
def s_sam(spark, sf_dir):
    return ordering.ranked(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_name DESC, c_custkey) AS rank FROM customer")
def s_bam(spark, sf_dir):
    return ordering.ranked(table(spark, sf_dir, "customer").select("c_name", "c_custkey"), [F.desc("c_name"), "c_custkey"]).drop("c_name")


@query("SELECT p_brand, p_partkey, row_number() OVER (ORDER BY p_brand, p_partkey) AS rank FROM part")
def s_vcf(spark, sf_dir):
    return ordering.ranked(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), ["p_brand", "p_partkey"])


@query("SELECT key, name, row_number() OVER (ORDER BY name, key) AS rank FROM (SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier)")
def u_merge_sam(spark, sf_dir):
    named = lambda t, k, n: table(spark, sf_dir, t).select(F.col(k).alias("key"), F.col(n).alias("name"))
    return ordering.merged([named("customer", "c_custkey", "c_name"), named("supplier", "s_suppkey", "s_name")], ["name", "key"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders WHERE o_orderstatus <> 'P'")
def u_merge_vcf(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return ordering.merged([orders.where(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in ("F", "O")], ["o_orderkey"])


@query("SELECT DISTINCT l_partkey, l_returnflag, l_linestatus FROM lineitem")
def u_uniq(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus").distinct()


@query("SELECT l_partkey, p, n FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, p) AS k FROM (SELECT l_partkey, l_returnflag || l_linestatus AS p, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE k <= 4")
def l_best_n(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.concat("l_returnflag", "l_linestatus").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return alleles.best_per_key(counts, ["l_partkey"], [F.desc("n"), "p"], 4)


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS k FROM lineitem) WHERE k <= 10")
def l_depth(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return alleles.best_per_key(items, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"], 10).select("l_partkey", "l_orderkey", "l_linenumber")


@query("SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1")
def l_head(spark, sf_dir):
    return table(spark, sf_dir, "nation").orderBy("n_nationkey").limit(1).select("n_name")


# Sets of intervals, against the sets of their points


_A = "a AS (SELECT DISTINCT p_brand, unnest(generate_series(p_partkey * 5, p_partkey * 5 + p_size)) AS x FROM part)"
_B = "b AS (SELECT DISTINCT p_brand, unnest(generate_series(p_partkey * 7, p_partkey * 7 + p_size // 2)) AS x FROM part WHERE p_brand <> 'Brand#1')"
_ISLANDS = "SELECT p_brand, min(x) AS lo, max(x) AS hi FROM (SELECT p_brand, x, x - row_number() OVER (PARTITION BY p_brand ORDER BY x) AS g FROM p) GROUP BY p_brand, g"


def _spans(spark, sf_dir, step: int, share: int) -> DataFrame:
    lo = F.col("p_partkey") * step
    return table(spark, sf_dir, "part").select("p_brand", lo.alias("lo"), (lo + F.floor(F.col("p_size") / share)).alias("hi"))


@query(f"WITH {_A}, {_B}, p AS (SELECT * FROM a INTERSECT SELECT * FROM b) {_ISLANDS}")
def u_intersect(spark, sf_dir):
    return intervals.intersect(_spans(spark, sf_dir, 5, 1), _spans(spark, sf_dir, 7, 2).where("p_brand <> 'Brand#1'"), contig=["p_brand"])


@query(f"WITH {_A}, {_B}, p AS (SELECT * FROM a EXCEPT SELECT * FROM b) {_ISLANDS}")
def u_subtract(spark, sf_dir):
    return intervals.subtract(_spans(spark, sf_dir, 5, 1), _spans(spark, sf_dir, 7, 2).where("p_brand <> 'Brand#1'"), contig=["p_brand"])


@query(f"WITH {_A}, w AS (SELECT p_brand, unnest(generate_series(0, 400)) AS x FROM (SELECT DISTINCT p_brand FROM part)), p AS (SELECT * FROM w EXCEPT SELECT * FROM a) {_ISLANDS}")
def u_invert(spark, sf_dir):
    extent = table(spark, sf_dir, "part").select("p_brand").distinct().select("p_brand", F.lit(0).cast("long").alias("lo"), F.lit(400).cast("long").alias("hi"))
    return intervals.invert(_spans(spark, sf_dir, 5, 1), extent, contig=["p_brand"])


@query(f"WITH {_A}, p AS (SELECT DISTINCT p_brand, x + unnest([-3, -2, -1, 0, 1, 2, 3]) AS x FROM a) {_ISLANDS}")
def u_pad(spark, sf_dir):
    return intervals.pad(_spans(spark, sf_dir, 5, 1), 3, contig=["p_brand"])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND EXISTS (SELECT 1 FROM part WHERE o_orderkey BETWEEN p_partkey * 5 AND p_partkey * 5 + p_size)")
def f_intervals(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") != "P") & (F.col("o_orderpriority") != "5-LOW")).select("o_orderkey")
    spans = op.merge_intervals(_spans(spark, sf_dir, 5, 1).drop("p_brand"), "lo", "hi", gap=1)
    return op.overlap_join(orders, "o_orderkey", spans, "lo", "hi", intervals.bin_width(spans), "left_semi").select("o_orderkey")


# Scalars


_ARG = "CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN replace(p_name, ' ', '''') WHEN 3 THEN 'it''s ' || p_name WHEN 4 THEN p_brand || chr(9) || 'x' ELSE '[' || p_type || ']{}' END"
_SPECIAL = r"[ `\"\\#()!~&<>|;*?\t$]"


@query(f"WITH a AS (SELECT p_partkey, {_ARG} AS arg FROM part) SELECT p_partkey, arg, CASE WHEN regexp_matches(arg, '{_SPECIAL}') AND NOT contains(arg, '''') THEN '''' || arg || '''' ELSE CASE WHEN contains(arg, '''') THEN regexp_replace(arg, '({_SPECIAL}|'')', '\\\\\\1', 'g') ELSE arg END END AS out FROM a")
def fn_quote(spark, sf_dir):
    args = table(spark, sf_dir, "part").select("p_partkey", F.expr(_ARG.replace("''''", "\"'\"").replace("'it''s '", "\"it's \"")).alias("arg"))
    return args.select("p_partkey", "arg", fn.quote(F.col("arg")).alias("out"))


@query("SELECT p_partkey, CASE WHEN length(p_name) > 9 THEN left(p_name, 6) || '...' ELSE p_name END AS out FROM part")
def fn_truncate(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fn.truncate(F.col("p_name"), 9).alias("out"))


@query("WITH t AS (SELECT o_orderkey, o_orderdate AS a, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_seconds(o_orderkey) END AS b FROM orders) SELECT o_orderkey, coalesce((epoch(b) - epoch(a))::BIGINT::VARCHAR, 'NA') AS elapsed, coalesce(strftime(b, '%Y-%m-%d %H:%M:%S'), 'NA') AS ended, strftime(a, '%Y/%m/%d') AS day FROM t")
def fn_times(spark, sf_dir):
    ended = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.make_interval(secs=F.col("o_orderkey")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", ended.alias("ended"))
    return rows.select("o_orderkey", fn.elapsed(F.col("o_orderdate"), F.col("ended")).alias("elapsed"), fn.timestamp_or_na(F.col("ended")).alias("ended"), F.date_format("o_orderdate", "yyyy/MM/dd").alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey * 1000000 < 10000000 THEN 5 ELSE ceil(ln(o_orderkey * 1000000) / ln(4) - 7) END::INT AS least FROM orders")
def fn_min_identical(spark, sf_dir):
    n = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") * 1_000_000)
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.min_identical(F.lit(5), n).alias("least"))


_PATH = "'/data.x/' || p_type || '/' || replace(p_name, ' ', '.')"


@query(f"WITH p AS (SELECT p_partkey, {_PATH} AS path, replace(p_name, ' ', '.') AS name FROM part) SELECT p_partkey, name, '/data.x/' || split_part(path, '/', 3) || '/' || regexp_replace(name, '\\.[^.]*$', '') || '.txt' AS other, '/data.x/' || split_part(path, '/', 3) || '/' || regexp_replace(name, '\\.[^.]*$', '') || '.a.hist' AS metrics, '/data.x/' || split_part(path, '/', 3) || '/' || replace(name, 'a', 'A') AS renamed FROM p")
def fn_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/data.x/"), "p_type", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("."))).alias("path"))
    path = F.col("path")
    return rows.select("p_partkey", fn.base_name(path).alias("name"), fn.replace_extension(path, ".txt").alias("other"), fn.metrics_path(path, "hist", extension=".a").alias("metrics"), fn.rename_file(path, "a", "A").alias("renamed"))


@query("SELECT p_partkey, p_name AS name, p_partkey || 'T8B' AS structure FROM part")
def fn_guards(spark, sf_dir):
    structure = F.concat(F.col("p_partkey").cast("string"), F.lit("T8B"))
    return table(spark, sf_dir, "part").select("p_partkey", fn.without_separator(F.col("p_name"), ":").alias("name"), fn.plain_structure(structure).alias("structure"))
