"""Harmonic packing of token sequences.

Whole texts are encoded with a public vocabulary and ended by one id. A document is cut into pieces; a
piece of length n is of class ``capacity // n``, and a bin of class j takes j pieces, whatever their
lengths. Cuts are free, so a document is cut where its pieces fill their bins best: the plan for each
remainder is the one of least padding, where a further piece costs ``CUT`` tokens. Each task fills the
bins of its own rows, with one open bin a class; what is in open bins at the end of the task is laid end
to end and cut at the capacity, and the last stretch into powers of two, which need no padding. So there is
no exchange, a task holds one bin a class, and a task that runs again packs its rows as before.

Defined results: a null text is empty; an empty text is the end id alone. A repeated row, and a row without
an id, is a document of its own. An empty table gives no pieces. Strings of special tokens within a text
are ordinary text. Only the named columns are read. Rows should come from a table (or a cut): a sequence's
number is the task's and a running number within it.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from weftline.llm import common

CAPACITY, END = 1024, 0
#: What a further cut costs, in tokens of padding, and the least piece that a cut leaves.
CUT, LEAST = 4, 16
#: Characters encoded at once; stretches remembered by a task (twice as many at most), and their characters.
BLOCK, REMEMBERED, LONGEST = 1 << 20, 500_000, 64
#: Characters, one of which marks where a text is taken apart (one that it doesn't hold).
MARKS = [chr(k) for k in range(9)] + ["\uffff"]

_ENCODERS: dict = {}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, by way of remembered stretches of text.

    The vocabulary's pattern never joins a letter or sign with the white space after it, so a text may be
    taken apart before a space or line feed that follows anything but white space, and each stretch encoded alone.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has dealt out the cores
        from tokenizers import Tokenizer

        self.vocabulary = Tokenizer.from_file(path)
        self.vocabulary.encode_special_tokens = True
        self.feed = self.vocabulary.encode("\n", add_special_tokens=False).ids[0]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.vocabulary.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of stretches. Those without other white space than their first space are encoded as the lines of one text."""
        plain = [p for p in new if p[:1] == " " and p.split() == [p[1:]]]
        odd = list(set(new).difference(plain))
        found = dict(zip(odd, (x.tobytes() for x in self.ids(odd)), strict=True))
        if plain:
            joined = self.ids(["\n" + "\n".join(plain)])[0]
            at = np.append(np.flatnonzero(joined == self.feed), len(joined)) * 4
            data = joined.tobytes()
            found.update((p, data[lo + 4 : hi]) for p, lo, hi in zip(plain, at[:-1].tolist(), at[1:].tolist(), strict=True))
        return found

    @staticmethod
    def stretches(text: str) -> list[str]:
        """Parts that make up ``text``; all but the first begin with a space or line feed."""
        mark = next((c for c in MARKS if c not in text), None)
        return [text] if mark is None else text.replace(" ", f"{mark} ").replace("\n", f"{mark}\n").split(mark)

    def block(self, text: str) -> bytes:
        parts = self.stretches(text)
        if new := set(parts).difference(self.known):
            if any(p[-1:].isspace() for p in new):  # white space stays with what follows it
                whole = [parts[0]]
                for p in parts[1:]:
                    if whole[-1][-1:].isspace():
                        whole[-1] += p
                    else:
                        whole.append(p)
                parts, new = whole, set(whole).difference(self.known)
            if len(self.known) > REMEMBERED:
                self.known, self.older = {}, self.known
                new = set(parts)
            made = {p: self.older[p] for p in new if p in self.older}
            made.update(self.learn([p for p in new if p not in made]))
            self.known.update((p, x) for p, x in made.items() if len(p) <= LONGEST and not p[-1:].isspace())
            return b"".join([made[p] if p in made else self.known[p] for p in parts])
        return b"".join(map(self.known.__getitem__, parts))

    def encode(self, text: str) -> bytes:
        at, out = 0, []
        while len(text) - at > BLOCK:
            stop = text.find(" ", at + BLOCK)
            while stop > 0 and text[stop - 1].isspace():
                stop = text.find(" ", stop + 1)
            if stop < 0:
                break
            out.append(self.block(text[at:stop]))
            at = stop
        return b"".join([*out, self.block(text[at:])])


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut_plans(capacity: int, cut: int = CUT, least: int = LEAST) -> list[list[int]]:
    """For each length up to the capacity the pieces, longest first, of least padding: a piece of length n leaves its share of what ``capacity // n`` of them leave."""
    lengths = np.arange(1, capacity + 1)
    fit = capacity // lengths
    cost = (capacity - fit * lengths) / fit + cut
    best, plans = np.zeros(capacity + 1), [[] for _ in range(capacity + 1)]
    for n in range(1, capacity + 1):
        tries = [n, *range(least, n - least + 1)]
        totals = cost[np.array(tries) - 1] + best[n - np.array(tries)]
        first = tries[int(np.argmin(totals))]
        best[n], plans[n] = totals.min(), sorted([first, *plans[n - first]], reverse=True)
    return plans


def twos(n: int) -> list[int]:
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


class Bins:
    """The open bins of one task. ``add`` and ``finish`` yield (document, start, ids, document's tokens, sequence, offset)."""

    def __init__(self, task: int, capacity: int):
        self.next, self.capacity, self.open = task << 33, capacity, {}

    def _close(self, pieces: list[tuple]):
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, self.next, at
            at += len(ids) // 4
        self.next += 1

    def add(self, doc, start: int, ids: bytes, total: int):
        size = self.capacity // (len(ids) // 4)
        bin_ = self.open.setdefault(size, [])
        bin_.append((doc, start, ids, total))
        if len(bin_) == size:
            yield from self._close(self.open.pop(size))

    def finish(self):
        rest = [piece for size in sorted(self.open) for piece in self.open[size]]
        left = sum(len(ids) for _, _, ids, _ in rest) // 4
        ends = [self.capacity] * (left // self.capacity) + twos(left % self.capacity)
        pieces, room = [], 0
        for doc, start, ids, total in rest:
            while ids:
                if not room:
                    room = ends.pop(0)
                take, ids = ids[: 4 * room], ids[4 * room :]
                pieces.append((doc, start, take, total))
                start, room = start + len(take) // 4, room - len(take) // 4
                if not room:
                    yield from self._close(pieces)
                    pieces = []


def pack_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) per piece; ``ids`` are little-endian unsigned 32-bit numbers."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType
    longs = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in longs]])
    arrow = pa.schema([("doc_id", to_arrow_type(kind)), ("ids", pa.binary()), *[(c, pa.int64()) for c in longs]])
    last = np.array([end], "<u4").tobytes()

    def packed(batches):
        encode, plans = encoder(vocabulary).encode, cut_plans(capacity)
        bins = Bins(TaskContext.get().partitionId(), capacity)

        def pieces():
            for batch in batches:
                for doc, words in zip(batch.column(0), batch.column(1), strict=True):
                    ids = encode(words.as_py()) + last
                    total, start = len(ids) // 4, 0
                    for n in [capacity] * (total // capacity) + plans[total % capacity]:
                        yield from bins.add(doc.as_py(), start, ids[4 * start : 4 * (start + n)], total)
                        start += n
            yield from bins.finish()

        held, size = [], 0

        def batch_of(held):
            doc, start, ids, total, sequence, offset = zip(*held, strict=True)
            columns = [doc, ids, start, [len(x) // 4 for x in ids], total, sequence, offset]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for piece in pieces():
            held.append(piece)
            size += len(piece[2]) + 64
            if size > 4 << 20:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    return rows.mapInArrow(packed, schema).select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def sequences(pieces: DataFrame, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(sequence_id, n_tokens, ids) of whole sequences, padded to the capacity with the end id unless their length is a power of two."""
    listed = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))
    missing = F.when(F.bit_count("n_tokens") == 1, F.lit(0)).otherwise(capacity - F.col("n_tokens")).cast("int")
    pad = F.unhex(F.repeat(F.lit(end.to_bytes(4, "little").hex()), missing))
    return listed.select("sequence_id", "n_tokens", F.concat(ids, pad).alias("ids"))


def op12_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack_documents(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
