"""The line pipelines over a growing folder of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import words_in_line


def line_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming histogram (n_words, n_lines) of the lines that arrive in ``folder``; write it in complete mode."""
    lines = spark.readStream.text(folder)
    return lines.groupBy(words_in_line(F.col("value")).alias("n_words")).agg(F.count(F.lit(1)).alias("n_lines"))
