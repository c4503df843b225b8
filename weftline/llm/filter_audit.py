"""Filter interaction audit: what each filter removes, in every order of filters.

Every document becomes a mask of the filters that it fails. Documents count by cell: part, mask and
labels. The cells are unpivoted against the steps of all orders of the filters; a running bit-or over
an order's earlier steps tells whether a document is gone already, conditional sums give the counts of a
step, and a window over a part's rows of one filter its total over all orders. The long form has one
row for each cell, order and step, however many documents there are.

Defined results: a null text is empty, a null language is the part ``''``. Words are runs of other than
space and tab to carriage return. A row without an id fails no duplicate filter and makes no other row
fail it; equal ids aren't smaller than each other, so repeated rows are duplicates only of a smaller id.
A document is good or toxic if any row of ``labels`` says so; labels that are null, or of unknown ids,
count nothing. A repeated row counts each time. An empty table gives no parts, so no rows. Only the named columns are read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import common

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3


def text_failures(text: Column) -> Column:
    """The mask of the filters that need nothing but the text: bit 0 few words, 1 repetitive, 2 capitals, 3 symbols."""
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    counts = common.let(common.space_words(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))

    def mask(c: Column) -> Column:
        fails = [c["n"] < LEAST_WORDS, 100 * c["distinct"] < LEAST_DISTINCT * c["n"], 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike(r"[#$%&*|]")]
        bits = [F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)]
        return bits[0] + bits[1] + bits[2] + bits[3]

    return common.let(counts, mask)


def with_duplicates(rows: DataFrame, bit: int) -> DataFrame:
    """Rows (doc_id, grp, mask, ..) whose mask has ``bit`` too where a smaller doc_id has the same ``grp``."""
    named = rows.where("doc_id is not null")
    groups = common.cut(named.groupBy("grp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("members")).where("members > 1"))
    same = common.keyed_join(named, groups, "grp", "members")
    same = same.withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("first_id"), F.lit(bit)).otherwise(F.lit(0)))
    alone = common.keyed_rest(named, groups, "grp", "members")
    return same.select(*rows.columns).unionByName(alone).unionByName(rows.where("doc_id is null"))


def cells(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters they fail and their labels."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = common.cut(rows.select("doc_id", "part", F.md5(F.col("text").cast("binary")).alias("grp"), text_failures(F.col("text")).alias("mask")))
    rows = with_duplicates(rows, 1 << 4)
    # An id may have any number of rows: what meets its label is counted first.
    counted = rows.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    marked = counted.join(known, "doc_id", "left")
    no = F.lit(False)
    return marked.groupBy("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.sum("n").alias("n"))


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step.

    Bit k of ``mask`` stands for letter k of ``filters``. There are n! orders of n filters, so ``filters`` should be few.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    long = cells.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    long = long.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    bits = F.create_map(*[F.lit(x) for k, letter in enumerate(filters) for x in (letter, 1 << k)])
    long = long.withColumn("bit", F.element_at(bits, F.col("letter"))).withColumn("hit", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("gone", F.coalesce(F.bit_or("hit").over(before), F.lit(0)) != 0)
    fails, gone = F.col("hit") != 0, F.col("gone")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))

    steps = long.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(fails & ~gone & F.col("good")).alias("good_lost"), total(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(cells(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
known AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
   'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first_id, false)} AS x FROM w LEFT JOIN known USING (doc_id)),
c AS (SELECT part, good, toxic, (CASE WHEN x.A THEN 'A' ELSE '' END) || (CASE WHEN x.B THEN 'B' ELSE '' END) || (CASE WHEN x.C THEN 'C' ELSE '' END) || (CASE WHEN x.D THEN 'D' ELSE '' END) || (CASE WHEN x.E THEN 'E' ELSE '' END) AS fails FROM f),
n AS (SELECT part, good, toxic, fails, count(*) AS n FROM c GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM l a JOIN l b ON a.l <> b.l JOIN l c ON c.l NOT IN (a.l, b.l) JOIN l d ON d.l NOT IN (a.l, b.l, c.l) JOIN l e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
g AS (SELECT n.*, s.*, contains(fails, letter) AS hit, translate(fails, earlier, '') <> fails AS gone FROM n, s),
r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
  coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = letter), 0) AS unique_fails,
  coalesce(sum(n) FILTER (hit AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (hit AND NOT gone AND toxic), 0) AS toxic_lost FROM g GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
