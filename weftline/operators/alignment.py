"""Left alignment of insertions and deletions over a reference kept in chunks.

An insertion or deletion of a unit can move left over every letter that ends the unit as it turns: how far is the common
beginning of the reference read backwards and of the unit read backwards over and over. A record meets the chunk that holds its place once, and mostly
finds the letter beside its new place there too; only one that matches a chunk's whole beginning goes on to the chunk before, in a further round, which reads
the chunks of such records' contigs alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.lineage import written
from weftline.operators.alleles import trimmed
from weftline.operators.edits import let

#: Letters of a chunk, and letters compared before whole chunks are.
WIDTH, FIRST = 4096, 32


def chunked(df: DataFrame, contig: str, text: str, width: int = WIDTH) -> DataFrame:
    """(contig, chunk, letters): texts in chunks of ``width`` letters, from 0."""
    return df.select(F.col(contig).alias("contig"), F.posexplode(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))).alias("chunk", "letters"))


def common_start(a: Column, b: Column) -> Column:
    """The length of the longest common beginning of two texts of one length."""
    differs = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda p, q: p != q), F.lit(True)).cast("int")
    return F.when(F.left(a, F.lit(1)) != F.left(b, F.lit(1)), 0).otherwise(let(differs, lambda k: F.when(k == 0, F.length(a)).otherwise(k - 1)))


def turned(unit: Column, shift: Column, n: Column) -> Column:
    """``n`` letters of ``unit`` repeated, from the letter ``shift`` on."""
    k = F.length(unit)
    return F.substring(F.repeat(unit, (n / k).cast("int") + 2), (shift % k).cast("int") + 1, n)


def matching(letters: Column, until: Column, near: Column, unit: Column, shift: Column) -> Column:
    """How many letters of ``letters`` before and at place ``until``, read backwards, ``unit`` repeats from ``shift`` on. ``near``, the nearest ``FIRST`` of them, are compared first."""
    few = F.least(until, F.lit(FIRST))

    def compared(text: Column, n: Column) -> Column:
        pair = F.struct(F.reverse(text).alias("a"), turned(unit, shift, n).alias("b"))
        return let(pair, lambda p: F.when(p["a"] == p["b"], n).otherwise(common_start(p["a"], p["b"])))

    whole = F.when(few == until, few).otherwise(compared(F.left(letters, until), until))
    return F.when(F.right(near, F.lit(1)) != turned(unit, shift, F.lit(1)), 0).otherwise(let(compared(near, few), lambda m: F.when(m < few, m).otherwise(whole)))


def left_aligned(df: DataFrame, chunks: DataFrame, pos: str = "pos", ref: str = "ref", alt: str = "alt", contig: str = "contig", width: int = WIDTH, where: Column | None = None) -> DataFrame:
    """Records with the shortest statement of their change (``pos``, ``ref``, ``alt``) at its leftmost place.

    Changes of several letters for several others, and of one for one, are only trimmed. An insertion or deletion has the letter before it in front; at the
    beginning of a contig the letter behind it follows. Positions count from 1. A record of a contig that ``chunks`` hasn't stays where it is, and one for which ``where`` doesn't hold stays as it is.
    ``df`` is worked out once: all its records, those that can't move too, go through the join with the chunks.
    """
    meant = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    given = F.struct((F.col(pos) + F.lit(0)).alias("pos"), F.col(ref).alias("ref"), F.col(alt).alias("alt"))
    rows = df.withColumn("_t", F.when(meant, trimmed(F.col(pos), F.col(ref), F.col(alt))).otherwise(given))
    r, a = F.col("_t.ref"), F.col("_t.alt")
    longer, shorter = F.when(F.length(r) > F.length(a), r).otherwise(a), F.when(F.length(r) > F.length(a), a).otherwise(r)
    simple = meant & (F.length(r) != F.length(a)) & (F.length(shorter) == 1)
    behind = simple & (F.left(longer, F.lit(1)) == shorter)
    before = simple & ~behind & (F.right(longer, F.lit(1)) == shorter)
    n = F.length(longer) - 1
    rows = rows.withColumn("_back", F.reverse(F.when(behind, F.right(longer, n)).when(before, F.left(longer, n)))).withColumn("_p", F.when(before, F.col("_t.pos") - 1).otherwise(F.col("_t.pos")).cast("long"))
    rows = rows.withColumn("_deletion", F.length("_t.ref") > F.length("_t.alt")).withColumn("_shift", F.lit(0).cast("long"))
    known, own = chunks.select(F.col("contig").alias(contig), F.col("chunk").alias("_chunk"), "letters"), [*[c for c in df.columns if c not in (pos, ref, alt)], "_t", "_back", "_deletion"]
    k, chunk = F.length("_back"), lambda place: F.greatest(F.floor((place - 1) / width), F.lit(0)).cast("int")
    spot = lambda place: (place - F.col("_chunk").cast("long") * width).cast("int")
    until = spot(F.col("_p"))
    few = F.least(until, F.lit(FIRST))
    near = F.when(F.col("_back").isNotNull() & (F.col("_p") > 0), F.substring("letters", until - few + 1, few))
    held = F.length("_near") == few  # the chunk has this place
    moved = F.when(held, matching(F.col("letters"), until, F.col("_near"), F.col("_back"), F.col("_shift"))).otherwise(0)
    beside = F.when(F.col("_p") > F.col("_moved"), F.col("_p") - F.col("_moved")).otherwise(F.when(F.col("_deletion"), k + 1).otherwise(F.lit(1)))
    at_hand = F.when(F.col("_moved") < few, F.substring("_near", few - F.col("_moved"), F.lit(1))).otherwise(F.substring("letters", spot(F.col("_beside")), F.lit(1)))
    of = lambda texts, some: texts.join(some.select(contig).distinct(), contig, "left_semi")
    active, done, first = rows, [], known
    while True:
        looked = active.withColumn("_chunk", chunk(F.col("_p"))).join(known, [contig, "_chunk"], "left").withColumn("_near", near).withColumn("_moved", moved).withColumn("_beside", beside)
        on = F.coalesce((F.col("_chunk") > 0) & (F.col("_moved") == until), F.lit(False))
        away = F.when(F.col("_back").isNotNull() & ~on & (chunk(F.col("_beside")) != F.col("_chunk")), F.col("_beside").cast("long"))
        letter = F.when(F.col("_back").isNotNull() & ~on & away.isNull(), at_hand)
        step = written(looked.select(*own, (F.col("_p") - F.col("_moved")).alias("_p"), (F.col("_shift") + F.col("_moved")).alias("_shift"), on.alias("_on"), away.alias("_away"), letter.alias("_letter")))
        done.append(step.where("not _on and _away is null").drop("_on", "_away"))
        some = step.agg(F.bool_or("_on").alias("on"), F.count("_away").alias("away")).first()
        if some["away"]:
            far = step.where("_away is not null").withColumn("_chunk", chunk(F.col("_away")))
            found = far.join(of(known, far), [contig, "_chunk"], "left").withColumn("_letter", F.substring("letters", spot(F.col("_away")), F.lit(1)))
            done.append(found.select(done[0].columns))
        if not some["on"]:
            break
        active = written(step.where("_on").select(*own, "_p", "_shift"))
        known = known if known is not first else written(of(known, active))
    turn = (F.col("_shift") % k).cast("int")
    ahead = F.reverse("_back")
    unit = F.concat(F.right(ahead, turn), F.left(ahead, k - turn))
    out = reduce(DataFrame.unionByName, done).withColumn("_unit", unit)
    long = F.when(F.col("_p") > 0, F.concat("_letter", "_unit")).otherwise(F.concat("_unit", "_letter"))
    stated = F.struct(F.greatest("_p", F.lit(1)).alias("pos"), F.when(F.col("_deletion"), long).otherwise(F.col("_letter")).alias("ref"), F.when(F.col("_deletion"), F.col("_letter")).otherwise(long).alias("alt"))
    plain = F.struct(F.col("_t.pos").cast("long").alias("pos"), "_t.ref", "_t.alt")
    return _stated(out.withColumn("_t", F.when(F.col("_letter") != "", stated).otherwise(plain)), df, pos, ref, alt)


def _stated(out: DataFrame, df: DataFrame, pos: str, ref: str, alt: str) -> DataFrame:
    new = {pos: F.col("_t.pos").cast(df.schema[pos].dataType), ref: F.col("_t.ref"), alt: F.col("_t.alt")}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns])
