"""Files of four-line records (name, letters, ``+``, qualities), plain or in compressed blocks, as a Spark data source.

A file is dealt out in ranges of bytes. The task of a range finds the first record border within it, and reads on until the record that
begins past its end, so any ranges give the same records, and one file is read by many tasks. Files in blocks of their own length (a gzip file
whose members name it) are dealt out the same way: a range's first block is found by its header. A gzip file without block lengths is one task's.
Files are opened by ``pyarrow.fs``, by a path or URI.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME, SCHEMA = "reads", "name string, comment string, seq string, qual string, file string, at long"
SPLIT, CHUNK = 64 << 20, 1 << 20
#: About so many ranges of one read; beyond that they are longer than asked for, up to ``SPLIT``. Records of a batch.
RANGES, BATCH = 256, 10_000
#: Fixed values of the block format: how a block begins, and the empty block that ends a file.
MAGIC = b"\x1f\x8b\x08\x04"
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Letters of a block before compression, at most.
BLOCK = 0xFF00


def located(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:/"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return pafs.FileSystem.from_uri(path)


def block_length(head: bytes) -> int | None:
    """The length of the block that begins with ``head``; null if none does."""
    if len(head) < 18 or head[:4] != MAGIC:
        return None
    extra, at = struct.unpack("<H", head[10:12])[0], 12
    while at + 4 <= min(12 + extra, len(head)):
        size = struct.unpack("<H", head[at + 2 : at + 4])[0]
        if head[at : at + 2] == b"BC" and size == 2:
            return struct.unpack("<H", head[at + 4 : at + 6])[0] + 1
        at += 4 + size
    return None


def compressed_blocks(data: Iterator[bytes]) -> Iterator[bytes]:
    """The blocks of a file, each of ``BLOCK`` bytes of ``data``, and the one that ends it."""

    def packed(piece: bytes) -> bytes:
        engine = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = engine.compress(piece) + engine.flush()
        head = MAGIC + bytes([0, 0, 0, 0, 0, 0xFF]) + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
        return head + body + struct.pack("<II", zlib.crc32(piece), len(piece))

    held = b""
    for piece in data:
        held += piece
        while len(held) >= BLOCK:
            yield packed(held[:BLOCK])
            held = held[BLOCK:]
    if held:
        yield packed(held)
    yield LAST_BLOCK


class Text:
    """The bytes of a plain file from a position on, as (position, bytes)."""

    def __init__(self, path: str):
        self.path = path
        system, self.inner = located(path)
        self.file = system.open_input_file(self.inner)
        self.size = self.file.size()

    def pieces(self, start: int) -> Iterator[tuple[int, bytes]]:
        self.file.seek(start)
        while piece := self.file.read(CHUNK):
            yield start, piece
            start += len(piece)

    def order(self, at: int) -> int:
        """The position of the range border ``at`` among the positions of lines."""
        return at


class Blocks(Text):
    """The text of a file in compressed blocks. A position is that of a block, and the place in its text, as one number."""

    def first(self, start: int) -> int:
        """Where the first block from ``start`` on begins."""
        at = start
        while at < self.size:
            self.file.seek(at)
            piece = self.file.read(2 * BLOCK + 64)
            k = piece.find(MAGIC)
            while k >= 0:
                length = block_length(piece[k : k + 64])
                if length is not None:
                    self.file.seek(at + k + length)
                    if at + k + length == self.size or self.file.read(4) == MAGIC:
                        return at + k
                k = piece.find(MAGIC, k + 1)
            at += max(1, len(piece) - 64)
        return self.size

    def pieces(self, start: int) -> Iterator[tuple[int, bytes]]:
        at = self.first(start) if start else 0
        while at < self.size:
            self.file.seek(at)
            length = block_length(self.file.read(64))
            if length is None or at + length > self.size:
                raise ValueError(f"{self.path}: no whole block at byte {at}")
            self.file.seek(at)
            body = self.file.read(length)
            text = zlib.decompress(body[12 + struct.unpack("<H", body[10:12])[0] : -8], -15)
            if text:
                yield at << 16, text
            at += length

    def order(self, at: int) -> int:
        return self.first(at) << 16


class Stream(Text):
    """The text of a gzip file without block lengths, from its start."""

    def pieces(self, start: int) -> Iterator[tuple[int, bytes]]:
        at, engine = 0, zlib.decompressobj(31)
        self.file.seek(0)
        while piece := self.file.read(CHUNK):
            while piece:
                text = engine.decompress(piece)
                if text:
                    yield at, text
                    at += len(text)
                piece = engine.unused_data
                if engine.eof:
                    engine = zlib.decompressobj(31)
        if engine.unconsumed_tail:
            raise ValueError(f"{self.path}: the file ends early")


def lines(pieces: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """(position of its first byte, line without its end) of pieces."""
    held, began = b"", None
    for at, piece in pieces:
        if b"\n" not in piece:
            held, began = held + piece, at if began is None else began
            continue
        first, *whole, last = piece.split(b"\n")
        yield (at if began is None else began), (held + first).removesuffix(b"\r")
        at += len(first) + 1
        for line in whole:
            yield at, line.removesuffix(b"\r")
            at += len(line) + 1
        held, began = last, at if last else None
    if began is not None:
        yield began, held.removesuffix(b"\r")


def begins(found: list[tuple[int, bytes]]) -> bool | None:
    """Whether a record begins at the first of these lines; null if the file ends before that shows."""
    if not found[0][1].startswith(b"@"):
        return False
    return found[2][1].startswith(b"+") if len(found) > 2 else None


def records(text: Text, start: int, end: int, step: int = 1 << 16) -> Iterator[tuple[int, list[bytes]]]:
    """(position, four lines) of the records that begin after ``start`` (at it, for 0) and not after ``end``."""
    low, high = text.order(start) if start else -1, text.order(end)
    back = start
    while True:
        each = lines(text.pieces(back))
        if back:
            next(each, None)  # the line that the range before ends with
        ahead = list(islice(each, 3))
        while back and ahead and (sure := begins(ahead)) is False:
            ahead = [*ahead[1:], *islice(each, 1)]
        # Near the end of a file too few lines may be left to tell: then the records are counted from further back.
        if not back or (ahead and sure):
            break
        if not ahead and back < start:
            return
        back, step = max(0, back - step), step * 2

    def whole():
        yield from ahead
        yield from each

    rest = whole()
    while found := list(islice(rest, 4)):
        at = found[0][0]
        if at > high:
            return
        body = [line for _, line in found]
        if not any(body):
            if not any(line for _, line in rest):
                return
            raise ValueError(f"{text.path}: no whole record at {at}")
        if len(body) < 4 or not body[0].startswith(b"@") or not body[2].startswith(b"+") or len(body[1]) != len(body[3]):
            if at > low:
                raise ValueError(f"{text.path}: no whole record at {at}")
        elif at > low:
            yield at, body


@dataclass
class Span(InputPartition):
    path: str
    kind: str
    start: int
    end: int


KINDS = {"text": Text, "blocks": Blocks, "stream": Stream}


class ReadsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[Span]:
        system, inner = located(self.path)
        found = system.get_file_info(inner)
        files = [found] if found.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(inner, recursive=True))
        spans, files = [], sorted((f for f in files if f.type == pafs.FileType.File and f.size), key=lambda f: f.path)
        files = [f for f in files if not any(part.startswith(("_", ".")) for part in f.path.removeprefix(inner).split("/"))]
        split = max(self.split, min(SPLIT, -(-sum(f.size for f in files) // RANGES)))
        for f in files:
            with system.open_input_file(f.path) as opened:
                head = opened.read(64)
            kind = "blocks" if block_length(head) is not None else "stream" if head[:2] == MAGIC[:2] else "text"
            step = f.size if kind == "stream" else split
            path = f.path if isinstance(system, pafs.LocalFileSystem) else self.path.split(inner)[0] + f.path
            spans += [Span(path, kind, at, min(at + step, f.size)) for at in range(0, f.size, step)]
        return spans

    def read(self, span: Span):
        text = KINDS[span.kind](span.path)
        end = (1 << 62) if span.kind == "stream" else span.end
        each = records(text, span.start, end) if span.kind != "stream" else records(_Endless(text), 0, end)
        while found := list(islice(each, BATCH)):
            heads = [body[0][1:].partition(b" ") for _, body in found]
            columns = [[name for name, _, _ in heads], [comment or None for _, _, comment in heads], [body[1] for _, body in found], [body[3] for _, body in found]]
            yield pa.record_batch([*(pa.array(c, pa.binary()).cast(pa.string()) for c in columns), pa.repeat(span.path, len(found)), pa.array([at for at, _ in found], pa.int64())], ["name", "comment", "seq", "qual", "file", "at"])


class _Endless:
    """A stream as ``records`` reads it: it has no borders."""

    def __init__(self, text: Text):
        self.path, self.pieces, self.order = text.path, text.pieces, lambda at: at


class ReadsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.blocks, self.run = options["path"], options.get("blocks", "true").lower() == "true", uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, inner = located(self.path)
        folder, task = f"{inner}/_tmp-{self.run}", TaskContext.get()
        system.create_dir(folder, recursive=True)
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.fq{'.gz' if self.blocks else ''}"

        def text():
            for batch in batches:
                name, comment, seq, qual = (batch.column(c).cast(pa.large_string()) for c in ("name", "comment", "seq", "qual"))
                bad = pc.not_equal(pc.utf8_length(seq), pc.utf8_length(qual))
                for column in (name, comment, seq, qual):
                    bad = pc.or_(bad, pc.match_substring(column, "\n"))
                if pc.any(bad).as_py():
                    raise ValueError(f"{name.filter(bad)[0]} is no record of four lines")
                gap, put = pc.if_else(pc.equal(comment, ""), "", " "), lambda *parts: pc.binary_join_element_wise(*(p if isinstance(p, pa.Array) else pa.scalar(p, pa.large_string()) for p in parts), pa.scalar("", pa.large_string()))
                records = put("@", name, gap.cast(pa.large_string()), comment, "\n", seq, "\n+\n", qual, "\n")
                yield "".join(records.to_pylist()).encode()

        with system.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for piece in compressed_blocks(text()) if self.blocks else text():
                out.write(piece)
        return Written(name)

    def commit(self, messages) -> None:
        system, inner = located(self.path)
        for m in messages:
            if m is not None:
                system.move(f"{inner}/_tmp-{self.run}/{m.name}", f"{inner}/{m.name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        system, inner = located(self.path)
        if system.get_file_info(f"{inner}/_tmp-{self.run}").type == pafs.FileType.Directory:
            system.delete_dir(f"{inner}/_tmp-{self.run}")


@dataclass
class Written(WriterCommitMessage):
    name: str


class ReadsSource(DataSource):
    """``spark.read.format("reads").option("split", bytes).load(path)``, and ``df.write.format("reads").option("blocks", "true")``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ReadsReader:
        return ReadsReader(self.options)

    def writer(self, schema, overwrite: bool) -> ReadsWriter:
        return ReadsWriter(self.options)


def read_reads(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(name, comment, seq, qual, file, at) of the records in a file or folder; ``at`` is where a record begins. A record that isn't whole fails the query and names its place."""
    spark.dataSource.register(ReadsSource)
    return spark.read.format(NAME).option("split", str(split)).load(path)


def write_reads(df: DataFrame, path: str, blocks: bool = True) -> None:
    """Add the records (name, comment, seq, qual) to the files of a folder, one a task, in compressed blocks or plain."""
    df.sparkSession.dataSource.register(ReadsSource)
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("name", "comment", "seq", "qual")]).write.format(NAME).mode("append").option("blocks", str(blocks).lower()).save(path)


def unaligned(first: DataFrame, second: DataFrame | None, sample: str, offset: int = 33) -> DataFrame:
    """(name, mate, seq, quals, sample): records of one file, or of two whose names (without /1 and /2) belong together, with qualities as numbers.

    A name of one file that the other hasn't fails the query.
    """

    def numbers(qual: str) -> Column:
        return F.when(F.length(qual) > 0, F.transform(F.split(qual, ""), lambda c: F.ascii(c) - offset)).otherwise(F.array().cast("array<int>"))

    if second is None:
        return first.select("name", F.lit(0).alias("mate"), "seq", numbers("qual").alias("quals"), F.lit(sample).alias("sample"))

    def rows(df: DataFrame, mate: int) -> DataFrame:
        own = df.select(F.regexp_replace("name", f"/{mate}$", "").alias("name"), "seq", "qual")
        return own.select("name", F.struct("seq", "qual").alias(f"_{mate}"), F.count(F.lit(1)).over(Window.partitionBy("name")).alias(f"_n{mate}"))

    both = rows(first, 1).join(rows(second, 2), "name", "full")
    sure = F.when((F.col("_n1") == 1) & (F.col("_n2") == 1), F.array(F.struct(F.lit(1).alias("mate"), "_1.seq", "_1.qual"), F.struct(F.lit(2).alias("mate"), "_2.seq", "_2.qual")))
    mates = both.select("name", F.explode(sure.otherwise(F.raise_error(F.concat(F.lit("not one pair: "), F.col("name"))))).alias("_m"))
    return mates.select("name", "_m.mate", "_m.seq", numbers("_m.qual").alias("quals"), F.lit(sample).alias("sample"))
