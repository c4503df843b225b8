"""Benchmark decontamination by a prefix-filtered set join.

Every window of ``WINDOW`` words of a benchmark item (the whole item if it has
fewer) is a set of shingles of up to ``SHINGLE`` words. The shingles are ordered
by rarity, by their counts over all documents. As a window must be contained
whole, its rarest shingle alone is a necessary prefix, so only that is joined
with the documents' shingles; the place of the shingle in the window then bounds
where the window would start and end in the document, and exact comparison of
the words verifies it. DataFrame functions only. All texts are read three times:
for the counts, for the hits and for the documents' rows.

Defined results: null and wordless texts have no words and aren't contaminated;
null and wordless items have no windows. Items with the same id count once. An
item with a null id contaminates like any other (n_hit, contaminated), but isn't
counted or named (n_items, items_sha256).
Repeated documents come back as often as they came. Empty tables give empty or
clean results. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import common

WINDOW, SHINGLE = 10, 3
#: Tasks that copies of one text go to where hits are too many to broadcast.
SPREAD = 64
#: What is not a digit, a letter or beyond ASCII; A-Z are letters, and lower-cased after.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def plain_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SEPARATORS), "")


def words(text: Column) -> Column:
    return plain_words(common.ascii_lower_text(text.cast("string")))


def with_runs(df: DataFrame, widths: list[int], place: str | None = None) -> DataFrame:
    """``df`` with a row per run of words of its column ``words`` and width: ``token``, a hash of the run, and its ``place``.

    Neighbours are zipped and exploded, so that no lambda keeps a text's words out of generated code:
    they aren't copied for each run. A run that passes the end is null behind it and is left out.
    """
    widest = max(widths)
    zipped = F.arrays_zip(F.col("words").alias("w0"), *[F.slice("words", k + 1, F.size("words")).alias(f"w{k}") for k in range(1, widest)])
    found = df.select("*", F.posexplode(zipped).alias(place, "_run") if place else F.explode(zipped).alias("_run"))

    def token(n: int) -> Column:
        return F.when(F.col(f"_run.w{n - 1}").isNotNull(), F.xxhash64(F.lit(n), *[F.col(f"_run.w{k}") for k in range(n)]))

    if len(widths) == 1:
        found = found.withColumn("token", token(widths[0]))
    else:
        found = found.withColumn("token", F.explode(F.array(*[token(n) for n in widths])))
    return found.drop("_run").where("token is not null")


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(window, words, length, items): distinct windows with the ids of their items, as strings."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(WINDOW))
    rows = rows.select("item", "words", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("words") - length + 1)).alias("at"))
    rows = rows.select("item", F.slice("words", F.col("at"), F.col("length")).alias("words"))
    return rows.groupBy("words").agg(F.collect_set("item").alias("items")).select(F.xxhash64("words").alias("window"), "words", F.size("words").alias("length"), "items")


def occurrences(docs: DataFrame, wanted: DataFrame, most_tokens: int = 1_000_000, most_windows: int = 200_000) -> DataFrame:
    """(text_key, window, start, length) of every occurrence of the ``wanted`` windows in (text_key, words).

    Beyond ``most_tokens`` shingles or ``most_windows`` windows (or ``common.MAX_BYTES``) nothing is
    broadcast but shingles of very many occurrences, and shingles are exchanged with the words around them only.
    """
    width = F.least("length", F.lit(SHINGLE))
    widths = sorted(r["width"] for r in wanted.select(width.alias("width")).distinct().collect())
    if not widths:
        return docs.where(F.lit(False)).select("text_key", F.lit(0).cast("long").alias("window"), F.lit(0).alias("start"), F.lit(0).alias("length"))
    tokens = None
    for n in widths:
        some = with_runs(wanted.where(width == n).select("window", "words"), [n], "offset").drop("words")
        tokens = some if tokens is None else tokens.union(some)
    tokens = common.cut(tokens)
    runs = with_runs(docs.select("text_key", "words"), widths, "place")
    every = with_runs(docs.select("words"), widths).select("token")
    distinct = common.cut(tokens.select("token").distinct())
    if common.fits(distinct, most_tokens):
        counts = every.join(F.broadcast(distinct), "token").groupBy("token").count()
    else:
        counts = every.groupBy("token").count().join(distinct, "token")
    rarest = tokens.join(counts, "token", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token", "offset")).alias("rarest"))
    prefix = common.cut(rarest.where("rarest.count > 0").select("window", "rarest.*").join(wanted.select("window", F.col("words").alias("sought"), "length"), "window"))
    if common.fits(prefix, most_windows):
        met = runs.withColumn("low", F.lit(0)).join(F.broadcast(prefix), "token")
    else:
        before = F.greatest(F.col("place") - (WINDOW - 1), F.lit(0))
        near = runs.select("text_key", F.slice("words", before + 1, F.lit(2 * WINDOW - 1)).alias("words"), before.alias("low"), (F.col("place") - before).alias("place"), "token")
        met = common.keyed_join(near, prefix, "token", "count", max_rows=-1)
    start = F.col("place") - F.col("offset")
    return met.where(
        (start >= 0) & (start + F.col("length") <= F.size("words")) & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("length")) == F.col("sought"))
    ).select("text_key", "window", (F.col("low") + start).alias("start"), "length")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: bool = False, most_hits: int = 20_000) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per document; with ``keep`` also ``row``, the input row."""
    key = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))
    wanted = common.cut(windows(items))
    hits = occurrences(docs.select(key.alias("text_key"), words(F.col(text)).alias("words")), wanted)
    hits = common.cut(hits.groupBy("text_key").agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set("window").alias("windows")))

    def cover(acc: Column, s: Column) -> Column:
        end = s["start"] + s["length"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(s["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    n_hit = F.aggregate(F.sort_array("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), cover)["n"]
    named = hits.select("text_key", F.explode("windows").alias("window")).join(wanted.select("window", F.explode("items").alias("item")), "window")
    named = named.groupBy("text_key").agg(F.sort_array(F.collect_set("item")).alias("ids"))
    hits = common.cut(hits.select("text_key", n_hit.cast("long").alias("n_hit")).join(named, "text_key", "left"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), key.alias("text_key"), F.size(plain_words(F.col(text))).cast("long").alias("n_words"), *([F.struct("*").alias("row")] if keep else []))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    if common.fits(hits, most_hits):
        found = rows.join(F.broadcast(hits), "text_key", "left")
    else:
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int")
        each = hits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        found = rows.withColumn("_salt", salt).join(each, ["text_key", "_salt"], "left")
    return found.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), *(["row"] if keep else []),
    )


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, list_slice(ws, s, s + least(len(ws), 10) - 1) AS win FROM (SELECT *, unnest(generate_series(1, len(ws) - least(len(ws), 10) + 1)) AS s FROM b WHERE len(ws) > 0)),
ls AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT r, s, n, list_slice(ws, s, s + n - 1) AS win FROM (SELECT r, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS s FROM w, ls WHERE len(ws) >= n)),
h AS (SELECT r, s, n, item FROM dw JOIN bw ON dw.win = bw.win),
p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM h) GROUP BY r),
i AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN p ON w.r = p.r LEFT JOIN i ON w.r = i.r
"""
