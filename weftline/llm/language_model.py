"""Language-model scoring with a hashed maximum-entropy model.

Every word has a path of up to ``LEVELS`` steps of sixteen in a tree: its class (64 of them, by its
last two bytes before punctuation; the end token has one of its own), then ever finer
classes of the words of a class. The probability of a token is the product of
its steps, each a maximum-entropy softmax over sixteen outcomes, times its smoothed share of
the counts at the path's end. A step's logits are the log counts below each outcome
plus weights of hashed features of the history and the step's node: the word before and its class and, in the classes' steps,
also the two words before, the word before the last (a skip) and the two classes before. So an untrained model is the smoothed counts' own, and all probabilities sum to one.

The model grows with the input: counts are taken of all words of all training
documents, the tree has about as many ends as there are distinct words (up to
sixteen to the ``LEVELS``; beyond that, an end holds several words told apart by their counts), and the weights'
rows grow with the square root of the training tokens, up to 2 to the ``MOST_BITS`` (64 MB), as every task holds them.

The weights are trained by distributed gradient updates: each of ``ROUNDS`` rounds
goes over its own share of the training documents, dealt by hash to parts of a
fixed number of tokens and sorted there, however they were partitioned. Gradient steps are taken on
every token of a part; each row of weights moves by the mean of the updates of
the parts that met it, weighted by the tokens that met it. Scoring runs over
sparse numpy batches. The counts of the most frequent words (at most ``HEAD``) go to the tasks;
all other words are looked up by a join, so no count is missed.

Defined results: a null text is empty; it has the end token alone. A null doc_id
counts as the empty string when held-out rows are told apart. Without training
rows the model is uniform over its tree, which is finite. Repeated rows are
trained on and scored as often as they come. An empty table gives an empty
result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import common

CLASSES, LEVELS, HEAD, MOST_BITS = 64, 5, 262_144, 20
ROUNDS, RATE, DAMP, BATCH, SMOOTH = 3, 0.3, 3.0, 16384, 0.1
#: Features of a step: those of the classes' steps, and of the finer ones. Tokens in a part of 65,536 rows of weights, or fewer; rows in a block of updates.
TOP_FEATURES, FEATURES, TASK_TOKENS, BLOCK = 5, (0, 3), 2_000_000, 128
_ODD, _ONES = np.uint32(0x9E3779B1), np.ones(16, np.float32)


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Per token of a block, ends included: word hash (0 for an end), row, class."""
    words, row, start, end = common.word_hashes(data, offsets)
    n = len(offsets) - 1
    folded = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    stop = end - 1
    if len(words):
        last = folded[stop]
        stop = np.where((last < 97) & (stop > start), stop - 1, stop)
        tail = folded[stop] + (folded[np.maximum(stop - 1, start)] << np.uint64(8))
        kind = (common.mix(tail + np.uint64(1)) % np.uint64(CLASSES - 1)).astype(np.int64) + 1
    else:
        kind = np.zeros(0, np.int64)
    order = np.argsort(np.concatenate([row * 2, np.arange(n) * 2 + 1]), kind="stable")
    out = np.concatenate([words, np.zeros(n, np.uint64)])[order], np.concatenate([row, np.arange(n)])[order], np.concatenate([kind, np.zeros(n, np.int64)])[order]
    return out


def paths(words: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """A word's path: five digits of sixteen, of which the first one and a half are its class."""
    fine = (words >> np.uint64(40)).astype(np.int64) & 0x3FFF
    return (((kind << 2) | (fine & 3)) << 12) | (fine >> 2)


def histories(words: np.ndarray, row: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """32-bit hashes of each token's history: (``TOP_FEATURES``, tokens)."""
    n = len(words)

    def back(values: np.ndarray, k: int, none) -> np.ndarray:
        out = np.full(n, none, values.dtype)
        if n > k:
            out[k:] = np.where(row[k:] == row[:-k], values[:-k], none)
        return out

    one = np.uint64(1)
    w1, w2 = back(words, 1, one), back(words, 2, one)
    c1, c2 = (back(kind.astype(np.uint64), k, np.uint64(CLASSES)) for k in (1, 2))
    parts = [w1, common.mix(w1) * np.uint64(3) + w2, w2, c1, c1 * np.uint64(CLASSES + 1) + c2]
    return np.stack([(common.mix(p * np.uint64(TOP_FEATURES) + np.uint64(k)) >> np.uint64(32)).astype(np.uint32) for k, p in enumerate(parts)])


class Tree:
    """Log shares of the counts below each node's outcomes by level, log10 of the counts at each end, and the weights."""

    def __init__(self, levels: int, ends: np.ndarray, bits: int):
        self.levels, self.bits = levels, bits
        self.table = np.zeros((1 << bits, 16), np.float32)
        self.end_log = np.log10(np.maximum(ends, 1e-30))
        self.masses, self.nodes = [], []
        for k in range(levels):
            mass = ends.reshape(16 ** (k + 1), -1).sum(axis=1).reshape(-1, 16)
            share = mass / np.maximum(mass.sum(axis=1, keepdims=True), 1e-30)
            self.masses.append(np.where(mass > 0, np.log(np.maximum(share, 1e-30)), -1e9).astype(np.float32))
            self.nodes.append((common.mix(np.arange(16**k, dtype=np.uint64) + np.uint64((k + 1) << 32)) >> np.uint64(32)).astype(np.uint32))
        #: The level of each of a token's features.
        self.level = np.repeat(np.arange(levels), [TOP_FEATURES if k < 2 else len(FEATURES) for k in range(levels)])

    def digits(self, path: np.ndarray) -> np.ndarray:
        """The outcomes of each step: (levels, tokens)."""
        return np.stack([(path >> (4 * (LEVELS - 1 - k))) & 15 for k in range(self.levels)])

    def rows(self, history: np.ndarray, path: np.ndarray) -> np.ndarray:
        """The rows of weights of each token's features: (features, tokens)."""
        out = []
        for k in range(self.levels):
            node = self.nodes[k].take(path >> (4 * (LEVELS - k)))
            out += [((history[j] ^ node) * _ODD) >> np.uint32(32 - self.bits) for j in (range(TOP_FEATURES) if k < 2 else FEATURES)]
        return np.stack(out)

    def logits(self, table: np.ndarray, rows: np.ndarray, path: np.ndarray) -> np.ndarray:
        """(levels, tokens, 16)"""
        out = np.stack([self.masses[k].take(path >> (4 * (LEVELS - k)), axis=0) for k in range(self.levels)])
        for k, features in zip(self.level, rows):
            out[k] += table.take(features, axis=0)
        return np.minimum(out, 80, out=out)  # shares are at most 1, so only weights could overflow

    def log_share(self, history: np.ndarray, path: np.ndarray) -> np.ndarray:
        """log10 of the probability of each path, without what is told apart at its end."""
        x = self.logits(self.table, self.rows(history, path), path)
        chosen = np.take_along_axis(x, self.digits(path)[:, :, None], axis=2)[:, :, 0]
        return (chosen - np.log(np.exp(x, out=x) @ _ONES)).sum(axis=0, dtype=float) / math.log(10)


def by_row(rows: np.ndarray) -> np.ndarray:
    """The order that sorts ``rows``: by radix, sixteen bits at a time."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    return order if rows.max(initial=0) < 1 << 16 else order[np.argsort((rows >> 16).astype(np.uint16)[order], kind="stable")]


def sums_by_row(error: np.ndarray, token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``error[token]`` over the runs that start at ``first``, and the runs in the order of the sums: long ones one by one, the others place by place."""
    length = np.diff(np.r_[first, len(token)])
    by = np.argsort(-length, kind="stable")
    first, length = first[by], length[by]
    long = int(np.count_nonzero(length > 32))
    out = error.take(token[first], axis=0)
    for i in range(long):
        out[i] = np.ones(length[i], error.dtype) @ error.take(token[first[i] : first[i] + length[i]], axis=0)
    for k in range(1, 32):
        more = int(np.count_nonzero(length > k))
        if more <= long:
            break
        out[long:more] += error.take(token[first[long:more] + k], axis=0)
    return out, by


def step(tree: Tree, table: np.ndarray, speed: np.ndarray, history: np.ndarray, path: np.ndarray) -> np.ndarray:
    """One adaptive gradient step on a batch; the rows of its features."""
    rows, n = tree.rows(history, path), history.shape[1]
    error = tree.logits(table, rows, path)
    np.exp(error, out=error)
    error = error.reshape(-1, 16)
    error /= (error @ _ONES)[:, None]
    error[np.arange(len(error)), tree.digits(path).ravel()] -= 1
    flat = rows.ravel()
    order = by_row(flat)
    sorted_rows = flat[order]
    first = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]])
    token = (np.arange(n) + (tree.level * n)[:, None]).ravel()[order]
    gradient, by = sums_by_row(error, token, first)
    at = sorted_rows[first[by]]
    speed[at] += np.einsum("ij,ij->i", gradient, gradient) / 4
    table[at] -= (RATE / np.sqrt(speed[at]))[:, None] * gradient
    return flat


def counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, path, n): the task's words, added up over runs of about two million tokens; the end token has word and path 0."""
    held, size = [], 0

    def summed() -> pa.RecordBatch:
        words = np.concatenate([h[0] for h in held]) if held else np.zeros(0, np.uint64)
        path = np.concatenate([h[1] for h in held]) if held else np.zeros(0, np.int32)
        values, first, n = np.unique(words, return_index=True, return_counts=True)
        held.clear()
        return pa.record_batch([pa.array(values.view(np.int64)), pa.array(path[first]), pa.array(n)], ["word", "path", "n"])

    for batch in batches:
        for _, data, offsets in common.text_blocks(batch.column(0)):
            words, _, kind = tokens(data, offsets)
            held.append((words, paths(words, kind).astype(np.int32)))
            size += len(words)
            if size > 2_000_000:
                yield summed()
                size = 0
    yield summed()


def trainer(tree: Tree):
    """An Arrow function: the part's updates of the weights, and how many tokens met each row, as float32 in blocks of rows; blocks that none met are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, speed, seen = tree.table.copy(), np.full(len(tree.table), DAMP, np.float32), np.zeros(len(tree.table), np.int64)
        for batch in batches:
            for _, data, offsets in common.text_blocks(batch.column(0), 1 << 18):
                words, row, kind = tokens(data, offsets)
                history, path = histories(words, row, kind), paths(words, kind)
                met = [step(tree, table, speed, history[:, at : at + BATCH], path[at : at + BATCH]) for at in range(0, len(words), BATCH)]
                seen += np.bincount(np.concatenate(met), minlength=len(seen))
        seen = seen.astype(np.float32).reshape(-1, BLOCK)
        change = (table - tree.table).reshape(len(seen), -1)
        met = np.flatnonzero(seen.any(axis=1))
        for lo in range(0, len(met), 64):
            part = met[lo : lo + 64]
            yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array([seen[k].tobytes() for k in part], pa.binary()), pa.array([change[k].tobytes() for k in part], pa.binary())], ["block", "seen", "change"])

    return run


def part_trainer(tree: Tree):
    """``trainer`` for a part: (place, text) rows, taken in the order of ``place``."""
    run = trainer(tree)

    def part(rows: pa.Table) -> pa.Table:
        texts = rows.set_column(1, "text", rows.column(1).cast(pa.large_string())).sort_by("place").select(["text"]).combine_chunks()
        empty = pa.schema([("block", pa.int32()), ("seen", pa.binary()), ("change", pa.binary())])
        return pa.Table.from_batches(run(iter(texts.to_batches(max_chunksize=10_000))), empty)

    return part


def mean_change(group: pd.DataFrame) -> pd.DataFrame:
    """A block's change: each row's mean over the parts that met it, by tokens, added up in an order that the rows alone decide."""
    total, weight = 0.0, np.zeros(BLOCK)
    for seen, change in sorted(zip(group["seen"], group["change"])):
        seen = np.frombuffer(seen, np.float32).astype(float)
        total = total + np.frombuffer(change, np.float32).reshape(BLOCK, -1) * seen[:, None]
        weight += seen
    change = (total / np.maximum(weight, 1)[:, None]).astype(np.float32)
    return pd.DataFrame({"block": group["block"].iloc[:1], "change": [change.tobytes()]})


def scorer(tree: Tree, head: tuple[np.ndarray, np.ndarray], ends: int):
    """An Arrow function: per row the sums over known head words, and its other words."""
    head_words, head_logs = head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, data, offsets in common.text_blocks(batch.column(3), 1 << 18):
                n = len(offsets) - 1
                words, row, kind = tokens(data, offsets)
                history, path = histories(words, row, kind), paths(words, kind)
                model = -tree.end_log[path >> (4 * (LEVELS - tree.levels))]
                for lo in range(0, len(words), BATCH):
                    part = slice(lo, lo + BATCH)
                    model[part] += tree.log_share(history[:, part], path[part])
                is_end = kind == 0
                place = np.minimum(np.searchsorted(head_words, words), max(0, len(head_words) - 1))
                known = (head_words[place] == words) & ~is_end if len(head_words) else np.zeros(len(words), bool)
                logs = np.where(known, head_logs[place] if len(head_words) else 0.0, 0.0)
                logs[is_end] = math.log10(ends + SMOOTH)
                tail = ~known & ~is_end
                lists = np.r_[0, np.cumsum(np.bincount(row[tail], minlength=n))]
                sums = lambda w: pa.array(np.bincount(row, w, n))
                found = np.bincount(row, known | (is_end & (ends > 0)), n).astype(np.int64)
                yield pa.record_batch(
                    [batch.column(k).slice(at, n) for k in range(3)] + [pa.array(np.bincount(row, minlength=n)), pa.array(found), sums(logs), sums(model + logs), pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), pa.array(words[tail].view(np.int64)))],
                    ["row", "doc_id", "held_out", "n_tokens", "n_head", "head_logs", "model", "tail"],
                )
                at += n

    return run


def grown_tree(vocabulary: DataFrame, distinct: int, total: int) -> Tree:
    """The untrained tree: as many levels as have ends for the distinct words, and rows of weights by the tokens."""
    levels = min(LEVELS, max(2, int(math.log(max(distinct, 1), 16))))
    shift = 4 * (LEVELS - levels)
    found = vocabulary.groupBy(F.shiftright("path", shift).alias("end")).agg(F.sum(F.col("n") + SMOOTH).alias("mass")).toPandas()  # at most 16 ** LEVELS rows
    ends = np.zeros(16**levels)
    # A word that isn't known adds the smoothing alone: every end but the end token's siblings has room for one.
    ends[16 ** (levels - 1) // 4 :] = SMOOTH
    np.add.at(ends, found["end"].to_numpy(np.int64), found["mass"].to_numpy(float))
    if ends[0] == 0:
        ends[0] = SMOOTH
    bits = min(MOST_BITS, max(13, math.ceil(math.log2(max(total, 1)) / 2 + 3.5)))
    return Tree(levels, ends, bits)


def frequent_words(vocabulary: DataFrame, most: int = HEAD) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and log10 of the smoothed counts of the most frequent words, at most ``most``: all with counts above a bound found by a histogram of logs."""
    level = F.floor(4 * F.log2("n"))
    histogram = vocabulary.groupBy(level.alias("level")).count().collect()
    least, room = 1 << 30, most
    for r in sorted(histogram, key=lambda r: -r["level"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    top = vocabulary.where(level >= least).select("word", "n").toPandas()
    order = np.argsort(top["word"].to_numpy(np.int64).view(np.uint64))
    return top["word"].to_numpy(np.int64).view(np.uint64)[order], np.log10(top["n"].to_numpy(float)[order] + SMOOTH)


def train(texts: DataFrame, tree: Tree, total: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Train the tree's weights on all texts, in rounds."""
    task_tokens = TASK_TOKENS * max(1, (1 << tree.bits) >> 16)
    parts = math.ceil(total / ROUNDS / task_tokens)
    for k in range(ROUNDS if total else 0):
        share = texts.select(F.xxhash64(doc_id, text).alias("place"), F.col(text).alias("text")).where(F.pmod("place", F.lit(ROUNDS)) == k)
        changes = share.groupBy(F.pmod(F.xxhash64("place"), F.lit(parts)).alias("part")).applyInArrow(part_trainer(tree), "block int, seen binary, change binary")
        blocks = tree.table.reshape(-1, BLOCK, 16)
        for r in changes.groupBy("block").applyInPandas(mean_change, "block int, change binary").collect():  # the table of weights
            blocks[r["block"]] += np.frombuffer(r["change"], np.float32).reshape(BLOCK, 16)


def learned(rows: DataFrame) -> tuple[Tree, DataFrame, int, int, int]:
    """The trained tree, the vocabulary (word, path, n), all tokens, distinct tokens and end tokens of (doc_id, text) rows."""
    vocabulary = common.cut(rows.select("text").mapInArrow(counter, "word long, path int, n long").groupBy("word", "path").agg(F.sum("n").alias("n")))
    sums = vocabulary.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.sum(F.when(F.col("path") == 0, F.col("n"))).alias("ends")).first()
    total, distinct, ends = sums["total"] or 0, sums["distinct"], sums["ends"] or 0
    tree = grown_tree(vocabulary, distinct, total)
    train(rows, tree, total)
    return tree, vocabulary.where("path > 0"), total, distinct, ends


def score_texts(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row; learns from rows that aren't held out."""
    id_type = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    tree, vocabulary, total, distinct, ends = learned(rows.where("not held_out").select("doc_id", "text"))
    scored = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(
        scorer(tree, frequent_words(vocabulary), ends),
        f"row long, doc_id {id_type}, held_out boolean, n_tokens long, n_head long, head_logs double, model double, tail array<long>",
    )
    # The numbers of rows are frozen by the cut.
    scored = common.cut(scored)
    tails = scored.select("row", F.explode("tail").alias("word")).join(vocabulary.select("word", "n"), "word", "left")
    logs = tails.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("tail_logs"), F.count("n").alias("n_tail"))
    out = scored.drop("tail").join(logs, "row", "left")
    tail_logs = F.coalesce("tail_logs", F.lit(0.0))
    level = math.log10(total + SMOOTH * (distinct + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("head_logs") + tail_logs - level * F.col("n_tokens")).alias("base_score"), (F.col("model") + tail_logs).alias("score"),
    )


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return score_texts(common.documents(spark, sf_dir), held_out)
