"""Toxicity by multiple-instance learning: sentences are the instances, documents the labelled bags.

A sentence's probability is a logistic function of its words and their beginnings
(which catches inflected and disguised forms); a document's is their noisy-or, so it is toxic if any sentence is. The weights are trained from
document labels alone, by gradient steps on a bounded sample of the labelled rows
that aren't held out (those of least hash, about ``FIT`` of each label, and fewer if they
have over ``WORDS`` features together, a whole text each). No held-out label is read, not even
to count it. Weights of 0.02 or less are left out. Scoring tells which sentences offend.

Defined results: null, empty and wordless texts have score 0. Labels that are
null are not learned from; without both labels every score is 0. A document
labelled twice is learned twice. Repeated rows come back as often as they came.
An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import common

FIT, STEPS, RATE, DECAY, START = 2_000, 60, 0.3, 3e-5, -4.0
#: Words and beginnings of words in the sample, at most: 16 bytes each on the driver.
WORDS = 16_000_000
#: Features in fewer sampled documents than this have no weight. Beginnings: so many bytes.
LEAST_DOCS, BEGINNINGS = 4, (4, 5, 6)
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True


def sentence_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of texts: number of rows, and of each feature its hash, row, and sentence (numbered over the block; gaps where sentences have no word)."""
    for _, data, offsets in common.text_blocks(column):
        words, row, start, _ = common.word_hashes(data, offsets, _BREAK, prefixes=BEGINNINGS)
        ends = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_END[data], out=ends[1:])
        real = words.ravel() != 0
        each = words.shape[1]
        yield len(offsets) - 1, words.ravel()[real], np.repeat(row, each)[real], np.repeat(ends[start] + row, each)[real]


def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lot, toxic, words, sentences) of (lot, toxic, text): each row's word hashes and sentence numbers."""
    for batch in batches:
        at = 0
        for n, words, row, sentence in sentence_words(batch.column(2)):
            cuts = np.searchsorted(row, np.arange(n + 1))
            yield pa.record_batch(
                [batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array([words[a:b].view(np.int64) for a, b in zip(cuts[:-1], cuts[1:])], pa.list_(pa.int64())), pa.array([sentence[a:b] - sentence[a] if b > a else [] for a, b in zip(cuts[:-1], cuts[1:])], pa.list_(pa.int64()))],
                ["lot", "toxic", "words", "sentences"],
            )
            at += n


def fit(sample: pa.Table) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted feature hashes, their weights and the bias, by full gradient steps (Adam) on the noisy-or likelihood."""
    labels = sample["toxic"].to_numpy().astype(float)
    none = np.zeros(0, np.uint64), np.zeros(0), -50.0
    if not len(labels) or labels.min() == labels.max():
        return none
    lists = sample["words"].combine_chunks()
    words = lists.flatten().to_numpy().view(np.uint64)
    doc = np.repeat(np.arange(len(labels)), lists.value_lengths().to_numpy())
    local = sample["sentences"].combine_chunks().flatten().to_numpy()
    sizes = np.zeros(len(labels), np.int64)
    np.maximum.at(sizes, doc, local + 1)
    shift = np.concatenate([[0], np.cumsum(sizes)])
    sentence = local + shift[doc]
    doc_of = np.repeat(np.arange(len(labels)), sizes)
    order = np.lexsort((doc, words))
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    vocabulary, counts = np.unique(words[order][fresh], return_counts=True)
    vocabulary = vocabulary[counts >= LEAST_DOCS]
    if not len(vocabulary):
        return none
    column = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    keep = vocabulary[column] == words
    column, sentence = column[keep], sentence[keep]
    theta, m, v = np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1)
    theta[-1] = START
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(theta[-1] + np.bincount(sentence, theta[column], shift[-1]), -30, 30)))
        clean = np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(labels)))
        pull = np.where(labels == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0)[doc_of] * p / len(labels)
        grad = np.append(np.bincount(column, pull[sentence], len(vocabulary)) + DECAY * theta[:-1], pull.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    strong = np.abs(theta[:-1]) > 0.02
    return vocabulary[strong], theta[:-1][strong], float(theta[-1])


def scorer(vocabulary: np.ndarray, weights: np.ndarray, bias: float):
    """An Arrow function: (doc_id, held_out, text) to scores and offending sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for n, words, row, sentence in sentence_words(batch.column(2)):
                if len(vocabulary) and len(words):
                    column = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                    gain = np.where(vocabulary[column] == words, weights[column], 0.0)
                else:
                    gain = np.zeros(len(words))
                spots, first, which = np.unique(sentence, return_index=True, return_inverse=True)
                p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(which, gain, len(spots)), -30, 30)))
                owner = row[first]
                score = -np.expm1(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), n))
                begin = np.full(n, np.iinfo(np.int64).max)
                np.minimum.at(begin, owner, spots)
                bad: list[list[int]] = [[] for _ in range(n)]
                for k in np.flatnonzero(p >= 0.5):
                    bad[owner[k]].append(int(spots[k] - begin[owner[k]]))
                score = np.clip(score, 0.0, 1.0)
                yield pa.record_batch(
                    [batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(bad, pa.list_(pa.int64()))],
                    ["doc_id", "held_out", "score", "predicted", "offending"],
                )
                at += n

    return run


def sampled(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """(toxic, words, sentences) of the sample: (doc_id, toxic) of least hash with their (doc_id, text)."""
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, FIT / max(1, counts.get(1, 0)))).otherwise(min(1.0, FIT / max(1, counts.get(0, 0))))
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30) / share
    chosen = common.cut(marked.withColumn("lot", lot).where("lot < 1"))
    found = common.small_join(rows, chosen, "doc_id").select("lot", "toxic", "text").mapInArrow(bags, "lot double, toxic int, words array<long>, sentences array<long>")
    found = common.cut(found)
    band = F.floor(F.col("lot") * 64)
    sizes = {r["band"]: r["n"] for r in found.groupBy(band.alias("band")).agg(F.sum(F.size("words")).alias("n")).collect()}
    last, room = 63, WORDS
    for k in range(64):
        room -= sizes.get(k, 0)
        if room < 0:
            last = k - 1
            break
    return found.where(band <= last).select("toxic", "words", "sentences")


def detect(docs: DataFrame, labels: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, offending): ``offending`` numbers the sentences, from the first with a word, that are toxic by themselves.

    ``held_out`` is a condition on the id column alone; it tells documents and labels apart alike.
    """
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    marked = labels.select(F.col("doc_id").alias(doc_id), F.col("toxic").cast("int").alias("toxic")).where(F.col(doc_id).isNotNull() & F.col("toxic").isin(0, 1) & ~F.coalesce(held_out, F.lit(False)))
    model = fit(sampled(rows.where("not held_out").select("doc_id", "text"), marked.withColumnRenamed(doc_id, "doc_id")).toArrow())
    return rows.mapInArrow(scorer(*model), f"doc_id {kind}, held_out boolean, score double, predicted int, offending array<long>")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return detect(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out)
