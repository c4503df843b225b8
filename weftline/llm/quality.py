"""Quality rules: plain counts, and a hashed n-gram log-likelihood ratio.

Words and pairs of words are hashed into ``BUCKETS``. A trusted multinomial comes
from all documents labelled 1, the raw one from all documents, both in one pass. A document's score is the mean over
its features, and ``NEUTRAL`` more that say nothing, of log(trusted / raw); it passes if that is at least the threshold,
which is the exact ``TAIL`` quantile of all trusted documents' own scores less
``MARGIN``. So the same tables always give the same verdicts. DataFrame functions
only.

Defined results: a null text is an empty one: no words, so it fails the base
rules. Without trusted documents every score is 0 and the method rejects
nothing. Labels that are null, or of unknown documents, are ignored. Repeated
rows are judged each, and count each in the raw multinomial. An empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import common

BUCKETS, SMOOTH = 8192, 1.0
TAIL, MARGIN, NEUTRAL = 0.001, 0.015, 16
LEAST_WORDS, WIDTH, MOST_REPEATED = 10, 5, 20
#: Ids of trusted documents that are broadcast; more are joined by an exchange.
MOST_BROADCAST = 1_000_000


def _longs() -> Column:
    return F.array().cast("array<long>")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def features(hashes: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(0), F.size(hashes) - 2), lambda i: F.pmod(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1)), F.lit(BUCKETS)))
    return F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS))), F.when(F.size(hashes) >= 2, pairs).otherwise(_longs()))


def bucket_counts(docs: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """Features by bucket, of the documents marked ``good`` and of all: at most ``BUCKETS`` rows."""
    found = common.let(word_hashes(common.space_words(F.col("text"))), features)
    rows = docs.select("good", F.explode(found).alias("b")).groupBy("b").agg(F.count_if("good").alias("good"), F.count(F.lit(1)).alias("all")).collect()
    return {r["b"]: r["good"] for r in rows if r["good"]}, {r["b"]: r["all"] for r in rows}


def low_quantile(values: DataFrame, share: float) -> float | None:
    """The exact quantile, between neighbours in proportion, of a column ``v``: only values up to it are sorted."""
    at = share * ((values.count() or 1) - 1)
    below = values.orderBy("v").limit(int(at) + 2)
    last = [r["v"] for r in below.orderBy(F.desc("v")).limit(2).collect()][::-1]  # two values
    if len(last) < 2:
        return last[0] if last else None
    return last[0] + (last[1] - last[0]) * (at - int(at))


def weights(trusted: dict[int, int], raw: dict[int, int]) -> list[float]:
    if not trusted:
        return [0.0] * BUCKETS
    t, r = sum(trusted.values()) + SMOOTH * BUCKETS, sum(raw.values()) + SMOOTH * BUCKETS
    return [round(math.log((trusted.get(b, 0) + SMOOTH) / t) - math.log((raw.get(b, 0) + SMOOTH) / r), 4) for b in range(BUCKETS)]


def ratio(hashes: Column, table: list[float]) -> Column:
    """Mean weight of a row's features; the table is one folded literal of bounded size."""
    literal = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    n = F.size(hashes) + F.greatest(F.size(hashes) - 1, F.lit(0))
    return F.aggregate(features(hashes), F.lit(0.0), lambda a, b: a + F.get(literal, b.cast("int"))) / (n + NEUTRAL)


def repeated_words(hashes: Column) -> Column:
    """Number of words within runs of ``WIDTH`` words that occur twice or more in the text."""
    runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - WIDTH), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WIDTH)]))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        add = lambda a, i: F.struct((a["n"] + F.least(F.lit(WIDTH), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(F.sort_array(F.transform(again, lambda x: x["i"])), F.struct(F.lit(0).alias("n"), F.lit(-WIDTH).alias("last")), add)["n"]

    def count(r: Column) -> Column:
        placed = F.sort_array(F.transform(r, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0)).otherwise(common.let(placed, covered))

    return common.let(F.when(F.size(hashes) > WIDTH, runs).otherwise(_longs()), count)


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) per document; with ``keep`` also ``row``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    good = common.cut(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("good", F.lit(True)))
    marked = common.small_join(rows, good, "doc_id", "left", max_rows=MOST_BROADCAST).select(F.coalesce("good", F.lit(False)).alias("good"), "text")
    table = weights(*bucket_counts(marked))
    score = common.let(word_hashes(common.space_words(F.col("text"))), lambda h: ratio(h, table))
    own = low_quantile(common.cut(marked.where("good").select(score.alias("v"))), TAIL)
    threshold = (own if own is not None else 0.0) - MARGIN

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *([F.struct("*").alias("row")] if keep else []))
    measured = common.let(
        common.space_words(F.col("text")),
        lambda w: common.let(word_hashes(w), lambda h: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(h).cast("long").alias("n_repeat_words"), ratio(h, table).alias("score"),
        )),
    )
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    rows = rows.withColumn("measured", measured).select(
        "doc_id", *(["row"] if keep else []), "measured.n_words", "measured.word_chars",
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        common.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), "measured.n_repeat_words", "measured.score",
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", *(["row"] if keep else []))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
