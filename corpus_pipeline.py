"""A corpus pipeline of five stages over ``documents``; each works on all that its predecessor kept.

1. quality: documents that the quality rules reject go.
2. near_duplicates: of each component of the n-gram Jaccard join, the row of least id stays (null
   ids last; of one id, the least digest of text). Equal rows are one; a row without words is a component.
3. decontaminate: documents that hold a benchmark window go.
4. mix: documents are taken as often as their source's target says; one taken twice is two rows.
5. shard: the mix is dealt to shards, repeats of a text together where they fit.

Stages but the last return the columns of their input, whatever their names. Null ids and sources, null,
empty and wordless texts stay or go by their stage's operator (a text without words fails the quality
rules, is no duplicate, isn't contaminated, and isn't taken by the mix); repeated rows are judged alike, and one stays among near
duplicates. Empty tables give empty results. No SQL expresses the
stages; ``tests/llm/test_pipeline.py`` holds near_duplicates against a brute-force version,
also on null and repeated ids, and all stages on hostile rows, and ``tests/llm/test_operators.py`` checks all stages on sf0.001.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.llm.decontaminate import contamination
from weftline.llm.jaccard_join import jaccard_components
from weftline.llm.quality import judge
from weftline.llm.sharding import shard_documents
from weftline.llm.source_mix import mixed_documents

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=True).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Rows are told apart by a digest of all their columns and of which are null, so a null or repeated id stands for no other row.
    mark = "_row"
    while mark in docs.columns:
        mark = f"_{mark}"
    docs = docs.withColumn(mark, F.xxhash64(*[F.col(c).isNull() for c in docs.columns], *docs.columns))
    found = jaccard_components(docs, doc_id=mark).select(F.col("doc_id").alias(mark), F.col("component_id").alias("_component")).distinct()
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("text"), mark)
    placed = common.cut(docs.select(mark, order.alias("_order")).groupBy(mark).agg(F.min("_order").alias("_order"), F.count(F.lit(1)).alias("_times")).join(found, mark))
    best = common.cut(placed.groupBy("_component").agg(F.min("_order").alias("_best"), F.count(F.lit(1)).alias("_rows")))
    placed = common.cut(common.keyed_join(placed, best, "_component", "_rows").select(mark, "_times", (F.col("_order") == F.col("_best")).alias("_stays")))
    kept = common.small_join(docs, placed.where("not _stays").select(mark), mark, "left_anti", max_rows=1_000_000)
    repeated = placed.where("_stays and _times > 1").select(mark)
    if not repeated.isEmpty():
        once = common.small_join(kept, repeated, mark, "left_semi").dropDuplicates([mark])
        kept = common.small_join(kept, repeated, mark, "left_anti").unionByName(once)
    return kept.drop(mark)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=True)
    return found.where("not contaminated").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
