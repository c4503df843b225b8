"""Edit strings (``8M2I5M100N7M``): how a record's letters lie on its reference, as Columns.

An edit string is parsed into an array of (n, op) and placed: each op then knows its first reference position
(``at``), its first letter (``read``, from 0) and how many gaps stand before it (``segment``). Everything else (lengths, splits,
pileups, clips) is read off the placed array. ``M``, ``=`` and ``X`` align letters; ``I`` and ``S`` use letters only,
``D`` and ``N`` positions only, ``H`` and ``P`` neither.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.lineage import cut

ALIGNED = ["M", "=", "X"]
ON_READ, ON_REFERENCE = [*ALIGNED, "I", "S"], [*ALIGNED, "D", "N"]
OPS, PLACED = "array<struct<n:int,op:string>>", "array<struct<n:int,op:string,at:bigint,read:int,segment:int>>"


def let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse(edits: Column) -> Column:
    """Array of (n, op). Null and ``*``: none. Anything but numbers, each with an op, fails the query."""
    items = F.regexp_extract_all(edits, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    ops = F.transform(items, lambda t: F.struct(F.regexp_extract(t, "[0-9]+", 0).cast("int").alias("n"), F.right(t, F.lit(1)).alias("op")))
    none = F.array().cast(OPS)
    return F.when(edits.isNull() | (edits == "*"), none).when(edits.rlike(r"^([0-9]+[MIDNSHP=X])+\z"), ops).otherwise(F.raise_error(F.concat(F.lit("no edit string: "), edits)))


def text(ops: Column) -> Column:
    """The edit string of (n, op): neighbours of one op become one, those of no length go. No ops at all: null."""

    def add(acc: Column, o: Column) -> Column:
        last = F.element_at(acc, F.size(acc))
        joins = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["op"] == o["op"])
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct((last["n"] + o["n"]).alias("n"), o["op"].alias("op"))))
        return F.when(o["n"] == 0, acc).when(joins, grown).otherwise(F.concat(acc, F.array(F.struct(o["n"].alias("n"), o["op"].alias("op")))))

    joined = F.aggregate(ops, F.array().cast(OPS), add)
    return F.nullif(F.array_join(F.transform(joined, lambda o: F.concat(o["n"].cast("string"), o["op"])), ""), F.lit(""))


def length_on(ops: Column, kinds: list[str]) -> Column:
    return F.aggregate(ops, F.lit(0), lambda acc, o: acc + F.when(o["op"].isin(kinds), o["n"]).otherwise(F.lit(0)))


def read_length(ops: Column) -> Column:
    return length_on(ops, ON_READ)


def reference_length(ops: Column) -> Column:
    return length_on(ops, ON_REFERENCE)


def placed(pos: Column, ops: Column) -> Column:
    """(n, op, at, read, segment) of each op of a record whose first aligned letter lies on ``pos``."""

    def add(acc: Column, o: Column) -> Column:
        here = F.struct(o["n"].alias("n"), o["op"].alias("op"), acc["at"].alias("at"), acc["read"].alias("read"), acc["segment"].alias("segment"))
        return F.struct(
            (acc["at"] + F.when(o["op"].isin(ON_REFERENCE), o["n"]).otherwise(F.lit(0))).alias("at"),
            (acc["read"] + F.when(o["op"].isin(ON_READ), o["n"]).otherwise(F.lit(0))).alias("read"),
            (acc["segment"] + F.when(o["op"] == "N", F.lit(1)).otherwise(F.lit(0))).alias("segment"), F.concat(acc["ops"], F.array(here)).alias("ops"),
        )

    start = F.struct(pos.cast("long").alias("at"), F.lit(0).alias("read"), F.lit(0).alias("segment"), F.array().cast(PLACED).alias("ops"))
    return F.aggregate(ops, start, add)["ops"]


def _ops(*items: tuple[Column, str]) -> Column:
    return F.array(*[F.struct(n.cast("int").alias("n"), F.lit(op).alias("op")) for n, op in items])


def _bare(ops: Column) -> Column:
    return F.transform(ops, lambda o: F.struct(o["n"].alias("n"), o["op"].alias("op")))


#: Shapes of records (edit string and what is done to it) that are worked out once each, at most; beyond that each record is.
MOST_SHAPES = 1 << 18


def once_each(df: DataFrame, shape: dict[str, Column], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``compute(df with shape)``, worked out once for each distinct shape, as many records share one, and looked up; with too many shapes for a lookup, for each record."""
    rows = df.withColumns(shape)
    shapes = cut(rows.select(*shape).distinct().limit(MOST_SHAPES + 1))
    if shapes.count() > MOST_SHAPES:
        return compute(rows).drop(*shape)
    same = F.lit(True)
    for c in shape:
        same = same & F.col(c).eqNullSafe(F.col(f"_of{c}"))
    found = compute(shapes).withColumnsRenamed({c: f"_of{c}" for c in shape})
    return rows.join(F.broadcast(found), same).drop(*shape, *[f"_of{c}" for c in shape])


def split_at_gaps(df: DataFrame, pos: str = "pos", edits: str = "edits") -> DataFrame:
    """One row for each stretch between gaps (``N``): its ``segment``, own ``pos`` and ``edits``, the letters of other stretches soft-clipped.

    ``core`` is the stretch's own edit string and ``gap`` the length of the gap behind it (null at the end), by which
    ``join_at_gaps`` makes the record whole. Records that aren't aligned (null or ``*``) stay as they are, as segment 0.
    """
    ops = parse(F.col("_shape"))

    def stretch(k: Column) -> Column:
        own = F.filter("_placed", lambda o: (o["segment"] == k) & (o["op"] != "N"))
        gap = F.get(F.filter("_placed", lambda o: (o["segment"] == k) & (o["op"] == "N")), F.lit(0))["n"]

        def row(own: Column) -> Column:
            first, last = F.get(own, F.lit(0)), F.get(own, F.size(own) - 1)
            behind = F.col("_letters") - last["read"] - F.when(last["op"].isin(ON_READ), last["n"]).otherwise(F.lit(0))
            clipped = F.concat(_ops((F.coalesce(first["read"], F.lit(0)), "S")), _bare(own), _ops((F.coalesce(behind, F.lit(0)), "S")))
            return F.struct(k.alias("segment"), first["at"].alias("pos"), text(clipped).alias("edits"), text(_bare(own)).alias("core"), gap.alias("gap"))

        return let(own, row)

    gaps = F.size(F.filter("_placed", lambda o: o["op"] == "N"))
    pieces = F.transform(F.sequence(F.lit(0), gaps), stretch)
    known = lambda shapes: shapes.withColumn("_placed", placed(F.lit(0), ops)).withColumn("_letters", read_length(ops)).withColumn("_pieces", pieces).withColumn("_alone", F.size("_placed") == 0).drop("_placed", "_letters")
    alone = F.col("_alone")
    out = once_each(df, {"_shape": F.col(edits)}, known).withColumn("_piece", F.explode("_pieces")).where(alone | F.col("_piece.core").isNotNull() | F.col("_piece.gap").isNotNull())
    kept = [c for c in df.columns if c not in (pos, edits)]
    return out.select(
        *kept, F.when(alone, F.col(pos)).otherwise(F.col(pos) + F.col("_piece.pos")).alias(pos), F.when(alone, F.col(edits)).otherwise(F.col("_piece.edits")).alias(edits),
        F.col("_piece.segment").alias("segment"), F.col("_piece.core").alias("core"), F.col("_piece.gap").alias("gap"),
    ).where(F.col("core").isNotNull() | F.col(edits).isNull() | (F.col(edits) == "*"))


def join_at_gaps(pieces: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """(key, pos, edits) of the records that ``split_at_gaps`` split."""
    listed = pieces.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("segment", pos, "core", "gap"))).alias("_pieces"))
    each = F.transform("_pieces", lambda p: F.concat(p["core"], F.coalesce(F.concat(p["gap"].cast("string"), F.lit("N")), F.lit(""))))
    return listed.select(*key, F.col("_pieces")[0][pos].alias(pos), F.nullif(F.array_join(each, ""), F.lit("")).alias("edits"))


def _aligned(df: DataFrame, keep: list[str], pos: str, edits: str, seq: str, quals: str) -> DataFrame:
    """(keep, seq, quals, _op): one row for each placed op that aligns or deletes."""
    ops = parse(F.col(edits))
    fits = (F.length(seq) == read_length(ops)) & (F.size(quals) == F.length(seq))
    sure = F.when((F.size(ops) == 0) | fits, placed(F.col(pos), ops)).otherwise(F.raise_error(F.lit("letters, qualities and edit string have different lengths")))
    on = F.filter(sure, lambda o: o["op"].isin([*ALIGNED, "D"]) & (o["n"] > 0))
    return df.select(*keep, seq, quals, F.explode(on).alias("_op"))


def letters(df: DataFrame, keep: list[str], pos: str = "pos", edits: str = "edits", seq: str = "seq", quals: str = "quals") -> DataFrame:
    """(keep, pos, letter, qual): one row for each reference position that a record covers; a deleted one has the letter ``*`` and no quality.

    Letters and qualities must be as many as the edit string uses, else the query fails.
    """
    rows = _aligned(df, keep, pos, edits, seq, quals)
    deleted = F.col("_op.op") == "D"
    start, n = F.col("_op.read") + 1, F.col("_op.n")
    texts = F.when(deleted, F.array_repeat(F.lit("*"), n)).otherwise(F.slice(F.split(F.substring(seq, start, n), ""), F.lit(1), n))
    values = F.when(deleted, F.array_repeat(F.lit(None).cast("int"), n)).otherwise(F.slice(quals, start, n))
    each = rows.select(*keep, F.col("_op.at").alias("_at"), F.posexplode(F.arrays_zip(texts.alias("letter"), values.alias("qual"))).alias("_k", "_v"))
    return each.select(*keep, (F.col("_at") + F.col("_k")).alias(pos), F.col("_v.letter").alias("letter"), F.col("_v.qual").cast("int").alias("qual"))


#: Positions of a bin of a pileup, and the letter that doesn't count.
BIN, UNCOUNTED = 256, "\0"


def _changes(columns: list) -> np.ndarray:
    """The rows, but for the first, that differ from the one before; nulls are equal."""
    out = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        at = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out |= at[1:] != at[:-1]
    return np.flatnonzero(out) + 1


def whole_names(batches: Iterator[pa.RecordBatch], n_key: int) -> Iterator[pa.Table]:
    """Batches cut anew so that none ends within the rows of one key."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        if len(rows):
            ends = _changes(rows.columns[:n_key])
            stop = int(ends[-1]) if len(ends) else 0
            held = rows.slice(stop)
            if stop:
                yield rows.slice(0, stop)
    if held is not None:
        yield held


def add_letters(counts: np.ndarray, place: np.ndarray, name: np.ndarray, letter: np.ndarray, most: int) -> None:
    """Add letters, in order of their names, to the counts of a bin: (A, C, G, T, other, deleted, all met) by place. Beyond ``most`` a letter is only met."""
    order = np.argsort(place, kind="stable")
    if ((place[order][1:] == place[order][:-1]) & (name[order][1:] == name[order][:-1])).any():
        order = np.lexsort((letter, name, place))  # several records of one name
    place, letter = place[order], letter[order]
    begin = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    rank = np.arange(len(place)) - np.repeat(begin, np.diff(np.r_[begin, len(place)])) + counts[place, 6]
    upper = np.where((letter >= 97) & (letter <= 122), letter - 32, letter)
    kind = np.select([upper == ord(c) for c in "ACGT*"], [0, 1, 2, 3, 5], 4)
    counts[:, 6] += np.bincount(place, minlength=BIN)
    np.add.at(counts, (place[rank < most], kind[rank < most]), 1)


def piled(n_contig: int, n_key: int, most: int):
    """A function from sorted batches of (contig, bin, name, at, letters) to the counts of each position. Held are one bin's counts and the pieces of one name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts = None, np.zeros((BIN, 7), np.int64)

        def counted() -> pa.RecordBatch:
            place = np.flatnonzero(counts[:, 6])
            table = counts[place]
            contig = [c.combine_chunks().take(pa.array(np.zeros(len(place), np.int64))) for c in key.columns[:n_contig]]
            columns = [*contig, pa.array(key.column(n_contig)[0].as_py() * BIN + place), *[pa.array(table[:, i]) for i in range(6)], pa.array(np.minimum(table[:, 6], most)), pa.array(table[:, 6] > most)]
            return pa.record_batch(columns, [*key.column_names[:n_contig], "_pos", "n_a", "n_c", "n_g", "n_t", "n_other", "n_del", "depth", "capped"])

        for rows in whole_names(batches, n_key):
            names = np.zeros(len(rows), np.int64)
            names[_changes(rows.columns[:n_key])] = 1
            names = np.cumsum(names)
            texts, at = rows.column("_text").to_pylist(), rows.column("_at").to_numpy() % BIN
            cuts = [0, *_changes(rows.columns[: n_contig + 1]).tolist(), len(rows)]
            for lo, hi in zip(cuts, cuts[1:]):
                own = rows.slice(lo, 1).select(range(n_contig + 1))
                if key is None or own.to_pylist() != key.to_pylist():
                    if key is not None:
                        yield counted()
                    key, counts = own, np.zeros((BIN, 7), np.int64)
                n = np.array([len(t) for t in texts[lo:hi]])
                letter = np.frombuffer("".join(texts[lo:hi]).encode("utf-32-le"), np.uint32).astype(np.int64)
                place = np.arange(len(letter)) - np.repeat(np.cumsum(n) - n - at[lo:hi], n)
                some = letter != ord(UNCOUNTED)
                add_letters(counts, place[some], np.repeat(names[lo:hi], n)[some], letter[some], most)
        if key is not None:
            yield counted()

    return run


def pileup(df: DataFrame, name: list[str], contig: list[str] | None = None, max_depth: int = 5000, min_mapq: int = 1, min_qual: int = 13, mapq: str = "mapq", pos: str = "pos", edits: str = "edits", seq: str = "seq", quals: str = "quals") -> DataFrame:
    """(contig, pos, n_a, n_c, n_g, n_t, n_other, n_del, depth, capped): what the records say of each position.

    Records below ``min_mapq`` and letters below ``min_qual`` don't count. Where more than ``max_depth`` records cover a position, those
    of least ``name`` count. Stretches of letters are exchanged once, cut by bins of positions, and each bin reads them in order of their names, so that a letter's rank
    is the number of letters met before.
    """
    contig = contig or ["contig"]
    key = [*contig, "_bin", *[c for c in name if c not in (*contig, pos)]]
    counting = F.zip_with(F.slice(F.split(seq, ""), F.lit(1), F.length(seq)), F.col(quals), lambda c, q: F.when((c == "*") | (q >= min_qual), c).otherwise(F.lit(UNCOUNTED)))
    records = df.where(F.col(mapq) >= min_mapq).withColumn("_counting", F.array_join(counting, ""))
    ops = _aligned(records, [*[c for c in key if c != "_bin"], "_counting"], pos, edits, seq, quals).drop(seq, quals)
    at, n = F.col("_op.at"), F.col("_op.n")
    ops = ops.withColumn("_bin", F.explode(F.sequence(F.floor(at / BIN), F.floor((at + n - 1) / BIN))))
    lo, hi = F.greatest(at, F.col("_bin") * BIN), F.least(at + n, (F.col("_bin") + 1) * BIN)
    long = (hi - lo).cast("int")
    text = F.when(F.col("_op.op") == "D", F.repeat(F.lit("*"), long)).otherwise(F.substring("_counting", (F.col("_op.read") + 1 + lo - at).cast("int"), long))
    pieces = ops.select(*key, lo.alias("_at"), text.alias("_text")).repartition(*contig, "_bin").sortWithinPartitions(*key)
    types = [f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in contig]
    counts = ", ".join([*types, "_pos long", *[f"n_{c} long" for c in ("a", "c", "g", "t", "other", "del")], "depth long, capped boolean"])
    found = pieces.mapInArrow(piled(len(contig), len(key), max_depth), counts)
    return found.withColumn("_pos", F.col("_pos").cast(pieces.schema["_at"].dataType)).withColumnRenamed("_pos", pos)


def _soft(order: Column) -> Column:
    """Letters soft-clipped at the first end of ``order`` already."""
    first = F.get(F.filter(order, lambda o: o["op"] != "H"), F.lit(0))
    return F.when(first["op"] == "S", first["n"]).otherwise(F.lit(0))


def clip(pos: Column, ops: Column, lo: Column | None = None, hi: Column | None = None, skip: Column | None = None, leave: Column | None = None, hard: bool = False) -> Column:
    """(pos, edits, start, letters, n_clipped): the record cut down to reference positions ``lo`` to ``hi``, without its first ``skip`` and last ``leave`` letters.

    Letters cut off are soft-clipped, or with ``hard`` taken away together with all other unaligned letters of the end that is cut;
    ``letters`` of them stay from letter ``start`` (from 0) on, and ``n_clipped`` aligned ones are lost. Insertions and gaps that lose their aligned
    neighbour go too. A bound that is null doesn't cut. A record without aligned letters left has a null ``pos`` and ``edits``.
    """
    low, high = (F.coalesce(x, F.lit(d).cast("long")) if x is not None else F.lit(d).cast("long") for x, d in ((lo, -(1 << 62)), (hi, 1 << 62)))
    front, back = (F.coalesce(x, F.lit(0)) if x is not None else F.lit(0) for x in (skip, leave))

    # Each step binds what the next ones use more than once.
    def facts(ops: Column) -> Column:
        return F.struct(
            placed(pos, ops).alias("ops"), read_length(ops).alias("total"), length_on(ops, ALIGNED).alias("aligned"), _soft(ops).alias("soft_a"), _soft(F.reverse(ops)).alias("soft_z"),
            low.alias("low"), high.alias("high"), front.alias("front"), back.alias("back"),
        )

    def cut_down(f: Column) -> Column:
        def kept(o: Column) -> Column:
            first = F.greatest(F.lit(0).cast("long"), f["low"] - o["at"], (f["front"] - o["read"]).cast("long"))
            stop = F.least(o["n"].cast("long"), f["high"] - o["at"] + 1, (f["total"] - f["back"] - o["read"]).cast("long"))
            n = F.when(o["op"].isin(ALIGNED), F.greatest(F.lit(0).cast("long"), stop - first)).otherwise(o["n"].cast("long"))
            off = F.when(o["op"].isin(ALIGNED), first).otherwise(F.lit(0).cast("long"))
            return F.struct(n.cast("int").alias("n"), o["op"].alias("op"), (o["at"] + off).alias("at"), (o["read"] + off).cast("int").alias("read"))

        return F.struct(f.alias("f"), F.transform(f["ops"], kept).alias("core"))

    def ends(c: Column) -> Column:
        aligned = F.filter(c["core"], lambda o: o["op"].isin(ALIGNED) & (o["n"] > 0))
        return F.struct(c["f"].alias("f"), c["core"].alias("core"), F.get(aligned, F.lit(0)).alias("a"), F.get(aligned, F.size(aligned) - 1).alias("z"))

    def amounts(c: Column) -> Column:
        f, a, z = c["f"], c["a"], c["z"]
        before, behind = a["read"], f["total"] - z["read"] - z["n"]
        between = F.filter(c["core"], lambda o: ~o["op"].isin("S", "H", "P") & (o["n"] > 0) & (o["read"] >= a["read"]) & (o["read"] <= z["read"]) & (o["at"] >= a["at"]) & (o["at"] <= z["at"]))
        first, last = F.get(f["ops"], F.lit(0)), F.get(f["ops"], F.size(f["ops"]) - 1)
        old = lambda o: F.when(o["op"] == "H", o["n"]).otherwise(F.lit(0))
        gone = lambda n, was: F.when(F.lit(hard) & (n > was), n).otherwise(F.lit(0))
        return F.struct(
            f["total"].alias("total"), f["aligned"].alias("aligned"), a["at"].alias("at"), between.alias("between"), before.alias("before"), behind.alias("behind"),
            gone(before, f["soft_a"]).alias("gone_a"), gone(behind, f["soft_z"]).alias("gone_z"), old(first).alias("old_a"), old(last).alias("old_z"),
        )

    def result(v: Column) -> Column:
        lost = v["at"].isNull()
        edited = F.concat(_ops((v["old_a"] + v["gone_a"], "H"), (v["before"] - v["gone_a"], "S")), _bare(v["between"]), _ops((v["behind"] - v["gone_z"], "S"), (v["old_z"] + v["gone_z"], "H")))
        return F.struct(
            v["at"].alias("pos"), F.when(~lost, text(edited)).alias("edits"), F.when(lost, F.lit(0)).otherwise(v["gone_a"]).alias("start"),
            F.when(lost, v["total"]).otherwise(v["total"] - v["gone_a"] - v["gone_z"]).alias("letters"), (v["aligned"] - length_on(v["between"], ALIGNED)).alias("n_clipped"),
        )

    return let(let(let(let(let(ops, facts), cut_down), ends), amounts), result)


def clipped(df: DataFrame, bounds: dict[str, Column], hard: bool = False, pos: str = "pos", edits: str = "edits", seq: str = "seq", quals: str = "quals") -> DataFrame:
    """Records with ``clip`` applied to all their columns; ``n_clipped`` counts the aligned letters lost."""
    # Bounds count from the record's own place, so that records of one shape are cut alike.
    shape = {"_zero": F.when(F.col(pos).isNotNull(), F.lit(0).cast("long")), "_shape": F.col(edits)}
    shape.update({f"_{c}": b - F.col(pos) if c in ("lo", "hi") else b for c, b in bounds.items()})
    own = {c: F.col(f"_{c}") for c in bounds}
    out = once_each(df, shape, lambda shapes: shapes.withColumn("_clip", clip(F.col("_zero"), parse(F.col("_shape")), hard=hard, **own)))
    columns = {pos: F.col(pos) + F.col("_clip.pos"), edits: F.col("_clip.edits"), "n_clipped": F.col("_clip.n_clipped")}
    if seq in df.columns:
        columns[seq] = F.substring(seq, F.col("_clip.start") + 1, F.col("_clip.letters"))
    if quals in df.columns:
        columns[quals] = F.slice(quals, F.col("_clip.start") + 1, F.col("_clip.letters"))
    return out.withColumns(columns).drop("_clip")


def clip_ends(df: DataFrame, five: int = 0, three: int = 0, reverse: str = "reverse", at_least: bool = True, hard: bool = False) -> DataFrame:
    """Records without their first ``five`` and last ``three`` letters as read: a reverse record's first letter is its last on the reference.

    With ``at_least`` letters clipped before count; else as many aligned letters go besides.
    """
    ops = parse(F.col("edits"))
    own_front, own_back = (F.lit(0), F.lit(0)) if at_least else (_soft(ops), _soft(F.reverse(ops)))
    front = F.when(F.col(reverse), F.lit(three)).otherwise(F.lit(five))
    back = F.when(F.col(reverse), F.lit(five)).otherwise(F.lit(three))
    return clipped(df, {"skip": F.when(front > 0, front + own_front), "leave": F.when(back > 0, back + own_back)}, hard)


def trim_primers(df: DataFrame, primers: DataFrame, key: list[str], slop: int = 5, reverse: str = "reverse", hard: bool = False) -> DataFrame:
    """Records without the primer that they begin with.

    ``primers`` are (contig, lo, hi, reverse). A record belongs to the primer of its contig and strand whose outer end is nearest to where the record begins,
    within ``slop`` positions (ties: the least lo, then the longest), and is cut up to the primer's inner end. ``key`` identifies a record. Each primer is listed at
    the 2 ``slop`` + 1 positions that a record of it may begin at, of which the nearest primer stays, so records meet one row at most and are exchanged once.
    """
    ops = parse(F.col("edits"))
    begins = F.when(F.size(ops) > 0, F.when(F.col(reverse), F.col("pos") + reference_length(ops) - 1).otherwise(F.col("pos"))).cast("long")
    outer = F.when(F.col("reverse"), F.col("hi")).otherwise(F.col("lo"))
    known = primers.select("contig", F.col("reverse").alias("_reverse"), outer.cast("long").alias("_outer"), F.when(F.col("reverse"), F.col("lo")).otherwise(F.col("hi")).alias("_inner"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    known = known.withColumn("_begins", F.explode(F.sequence(F.col("_outer") - slop, F.col("_outer") + slop)))
    away = F.abs(F.col("_outer") - F.col("_begins"))
    best = known.groupBy("contig", "_reverse", "_begins").agg(F.min_by("_inner", F.struct(away, "_lo", -F.col("_hi"))).alias("_inner"))
    rows = df.withColumns({"_reverse": F.col(reverse), "_begins": begins}).join(best, ["contig", "_reverse", "_begins"], "left").select(*df.columns, "_inner")
    return clipped(rows, {"lo": F.when(~F.col(reverse), F.col("_inner") + 1), "hi": F.when(F.col(reverse), F.col("_inner") - 1)}, hard).drop("_inner")


def clip_overlaps(df: DataFrame, pair: list[str], reverse: str = "reverse", hard: bool = False) -> DataFrame:
    """Records of a pair (one forward, one reverse record of one contig) that overlap meet in the middle: the forward one keeps the positions up to it."""
    ops = parse(F.col("edits"))
    own = Window.partitionBy(*pair, "contig")
    spans = df.withColumn("_end", F.col("pos") + reference_length(ops) - 1)
    forward, back = F.when(~F.col(reverse), F.col("pos")), F.when(F.col(reverse), F.col("pos"))
    spans = spans.withColumns({"_fs": F.min(forward).over(own), "_fe": F.max(F.when(~F.col(reverse), F.col("_end"))).over(own), "_rs": F.min(back).over(own), "_re": F.max(F.when(F.col(reverse), F.col("_end"))).over(own)})
    overlap = (F.col("_fs") <= F.col("_rs")) & (F.col("_fe") >= F.col("_rs"))
    middle = F.when(overlap, F.floor((F.col("_rs") + F.least("_fe", "_re")) / 2))
    spans = spans.withColumn("_middle", middle)
    return clipped(spans, {"lo": F.when(F.col(reverse), F.col("_middle") + 1), "hi": F.when(~F.col(reverse), F.col("_middle"))}, hard).drop("_end", "_fs", "_fe", "_rs", "_re", "_middle")


def reverted(df: DataFrame, originals: dict[str, str] | None = None, placed: tuple[str, ...] = ("contig", "pos", "edits", "mapq"), reverse: str = "reverse", seq: str = "seq", quals: str = "quals") -> DataFrame:
    """Records as they were read: without their place, letters and qualities of reverse ones turned round again, and columns put back from where
    ``originals`` (column: the one that keeps what it was) isn't null. A hard-clipped letter is lost and doesn't come back."""
    back = {c: F.coalesce(F.col(kept), F.col(c)) for c, kept in (originals or {}).items()}
    rows = df.withColumns(back).drop(*(originals or {}).values(), *placed)
    turned = {seq: F.when(F.col(reverse), F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")).otherwise(F.col(seq)), quals: F.when(F.col(reverse), F.reverse(quals)).otherwise(F.col(quals))}
    return rows.withColumns({c: e for c, e in turned.items() if c in df.columns}).drop(reverse)
