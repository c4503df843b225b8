"""Language identification by known words first, then ever shorter character n-grams.

A word the model knows adds its log frequency in each language (blended with
``BLEND`` of its frequency in all, so small languages don't gain by words they
lack); an unknown word
adds the mean of its longest known n-grams (``GRAMS`` characters down to one,
with the word's edges marked). The document's language is the one of highest sum
with the log prior; its score is the softmax of that, for at most ``SURE`` words'
worth of evidence.

The model is fitted on a bounded sample of the labelled rows that aren't held
out: those of least hash, about ``FIT`` a language, and keeps all words and
n-grams seen twice or more there, whatever their language and order.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and so is every text if there is nothing to learn from; a language whose
documents have no word isn't learned. Ties go to the first
language by code point. Repeated rows come back as often as they came. An empty
table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import common

FIT, GRAMS, SURE, BLEND = 2_000, 4, 50, 0.01
#: Vectors of unknown words that a task keeps.
KEPT = 50_000
_LETTERS = regex.compile(r"\p{L}+")
#: Letters, and numerals that are neither letters nor digits.
_NEARLY = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    text = (text or "").lower()
    found = _NEARLY.findall(text)
    return found if text.isascii() or "".join(found).isalpha() else _LETTERS.findall(text)


def grams(word: str, n: int) -> list[str]:
    word = f"<{word}>"
    return [word[i : i + n] for i in range(len(word) - n + 1)] if n > 1 else list(word[1:-1])


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, feature, count) of the batches' texts; n = 0 for whole words."""
    for batch in batches:
        seen: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen[lang].update(words(text))
        rows: Counter = Counter()
        for lang, found in seen.items():
            for word, count in found.items():
                rows[lang, 0, word] += count
                for n in range(1, GRAMS + 1):
                    for gram in grams(word, n):
                        rows[lang, n, gram] += count
        lang, n, feature = zip(*rows) if rows else ((), (), ())
        yield pa.record_batch([pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array(feature, pa.string()), pa.array(list(rows.values()), pa.int64())], ["lang", "n", "feature", "count"])


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray, list[dict[str, np.ndarray]]]:
    """Languages, log priors, and log frequencies by order (0: words) and feature, from (lang, text, doc_id)."""
    totals = common.cut(labelled.groupBy("lang").count())
    fraction = common.small_join(labelled, totals, "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("count").cast("double") ** -1 * FIT * (1 << 30))
    found = fraction.select("lang", "text").mapInArrow(count_features, "lang string, n int, feature string, count long")
    found = common.cut(found.groupBy("lang", "n", "feature").agg(F.sum("count").alias("count")))
    sums = found.groupBy("lang", "n").agg(F.sum("count").alias("total")).collect()
    top = found.groupBy("n", "feature").agg(F.sum("count").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "count"))).alias("by")).where("all >= 2")
    rows = top.collect()
    counts = {r["lang"]: r["count"] for r in totals.collect()}
    langs = sorted({r["lang"] for r in sums if r["n"] == 0})
    total, whole = {(r["lang"], r["n"]): r["total"] for r in sums}, Counter()
    for r in sums:
        whole[r["n"]] += r["total"]
    tables: list[dict[str, np.ndarray]] = [{} for _ in range(GRAMS + 1)]
    for r in rows:
        n, common_share = r["n"], BLEND * r["all"] / whole[r["n"]]
        tables[n][r["feature"]] = np.array([math.log((1 - BLEND) * r["by"].get(x, 0) / max(1, total.get((x, n), 0)) + common_share) for x in langs])
    prior = np.log(np.array([counts[x] for x in langs], float) / max(1, sum(counts[x] for x in langs))) if langs else np.zeros(0)
    return langs, prior, tables


def predictor(langs: list[str], prior: np.ndarray, tables: list[dict[str, np.ndarray]]):
    def backoff(word: str) -> np.ndarray:
        for n in range(GRAMS, 0, -1):
            known = [v for g in grams(word, n) if (v := tables[n].get(g)) is not None]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables[0]
        index = {word: i for i, word in enumerate(known)}
        vectors = np.zeros((len(known) + KEPT, len(langs)))
        if known:
            vectors[: len(known)] = list(known.values())
        kept: list[str] = []

        def evidence(found: Counter) -> np.ndarray:
            """Sum of the words' vectors; those of unknown words are kept until there are ``KEPT``."""
            at, counts = list(map(index.get, found)), np.fromiter(found.values(), float, len(found))
            if None not in at:
                return counts @ vectors[at]
            seen = np.array([i is not None for i in at])
            total = counts[seen] @ vectors[[i for i in at if i is not None]] if seen.any() else np.zeros(len(langs))
            for word, i, count in zip(found, at, counts):
                if i is None:
                    if len(kept) == KEPT:
                        for old in kept:
                            del index[old]
                        kept.clear()
                    i = index[word] = len(known) + len(kept)
                    kept.append(word)
                    vectors[i] = backoff(word)
                    total += count * vectors[i]
            return total

        for batch in batches:
            langs_out, scores = [], []
            for text in batch.column(2):
                found = Counter(words(text.as_py()))
                if not found or not langs:
                    langs_out.append("und")
                    scores.append(0.0)
                    continue
                total, n = evidence(found), sum(found.values())
                best = int(np.argmax(total + prior))
                spread = total * (min(n, SURE) / n) + prior
                langs_out.append(langs[best])
                scores.append(float(min(1.0, 1 / np.exp(np.minimum(spread - spread[best], 700)).sum())))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(langs_out, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row; learns from rows with a language that aren't ``held_out``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    model = learn(rows.where("not held_out and lang is not null").select("lang", "text", "doc_id"))
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    return rows.select("doc_id", "held_out", "text").mapInArrow(predictor(*model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(common.documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
