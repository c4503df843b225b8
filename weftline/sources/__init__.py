"""Readers and writers of tabular text formats, as plain Spark sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated metrics file with ``#`` comments and a header."""
    return spark.read.csv(path, sep="\t", header=True, comment="#", inferSchema=True)


def metric_of(spark: SparkSession, path: str, column: str, value: str):
    """The first row of a metrics file whose ``column`` is ``value``; it must exist."""
    found = read_metrics(spark, path).where(F.col(column) == value).head()
    if found is None:
        raise LookupError(f"no row of {path} has {column} {value}")
    return found


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(sample): one row for each read group of a header; null where it names none."""
    lines = spark.read.text(path).where(F.col("value").startswith("@RG"))
    return lines.select(F.nullif(F.regexp_extract("value", r"\tSM:([^\t]*)", 1), F.lit("")).alias("sample"))


def read_group_samples(spark: SparkSession, path: str) -> DataFrame:
    """(sample): the distinct samples that a header's read groups name."""
    return read_groups(spark, path).where("sample is not null").distinct()


def first_sample(spark: SparkSession, path: str) -> str:
    """The sample of a header's first read group; both must exist."""
    group = read_groups(spark, path).head()
    if group is None or group["sample"] is None:
        raise LookupError(f"{path} has no read group with a sample")
    return group["sample"]


def write_lines(df: DataFrame, path: str, append: bool = False, compressed: bool = False) -> None:
    """The one column as text, in place of what is there or after it. Compressed text reads back by its extension."""
    df.write.mode("append" if append else "overwrite").option("compression", "gzip" if compressed else "none").text(path)


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, end): an interval list; lines that begin with ``@`` are its header."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    return lines.select(parts[0].alias("contig"), parts[1].cast("int").alias("start"), parts[2].cast("int").alias("end"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, end): one interval for each sequence named in a header."""
    lines = spark.read.text(path).where(F.col("value").startswith("@SQ"))
    return lines.select(F.regexp_extract("value", r"\tSN:([^\t]*)", 1).alias("contig"), F.lit(1).alias("start"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("int").alias("end"))


def sample_names(spark: SparkSession, path: str) -> DataFrame:
    """(pos, sample) in order from a variant file's column header."""
    header = spark.read.text(path).where(F.col("value").startswith("#CHROM")).select(F.split("value", "\t").alias("c"))
    return header.select(F.posexplode(F.slice("c", 10, 1 << 30)).alias("pos", "sample"))


def log_contains(spark: SparkSession, path: str, token: str) -> bool:
    """Whether any line has the token; a missing file has none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return False
    return not spark.read.text(path).where(F.col("value").contains(token)).isEmpty()


def write_by_partition(df: DataFrame, path: str, column: str) -> None:
    df.write.partitionBy(column).mode("overwrite").parquet(path)


def write_map(df: DataFrame, key: str, value: str, path: str) -> None:
    df.select(key, value).write.csv(path, sep="\t", mode="overwrite")
