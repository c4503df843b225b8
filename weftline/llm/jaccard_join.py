"""N-gram Jaccard join: exact links between word-shingle sets, heavy and light sets joined differently.

A text is the set of its distinct shingles (runs of ``WIDTH`` words); two texts
link when their Jaccard similarity is at least ``PERCENT`` / 100. The join is
exact up to collisions of hashes: sets are made and told apart by 56 bits a
shingle and 64 a set, and compared with each other by 48 bits a shingle:

* Equal sets form one class; only classes are joined.
* Light sets (at most ``boundary`` shingles) enumerate subsets of one fixed size
  for each partner size; two of them that link share such a subset.
* Heavy sets are looked up in inverted lists of the shingles that occur in more
  than one class, rarest first, as far as the similarity leaves room for
  misses. Light sets near the boundary are in the lists too.
* The boundary is the one of least cost, in rows to be dealt out, from the
  histogram of set sizes.
* Classes that share a list make up candidate groups. Each group is verified in
  blocks of bounded size, over the whole group or list by list, whichever needs
  fewer comparisons; blocks return only the links that join something. A group of
  several blocks is first verified block by block, each beside the group's pivot, the
  class that most others share lists with. Only classes that this doesn't join with the
  pivot are then compared with all others, so a cluster of near copies costs a copy of each, and no link is missed.

Defined results: a null, empty or wordless text has no set, links with nothing
and is its own component. Repeated rows come back as often as they came. Equal
texts are one class. Only the named columns are read, so other columns may have
any name. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weftline.llm import common

WIDTH, PERCENT = 5, 80
#: Light sets have at most this many shingles, whatever the costs: up to here a pair of sets that link differs by one shingle at most.
MOST_LIGHT = 8
#: Classes per side of a verified block.
BLOCK = 256
#: A listed shingle is one long: its hash in the low bits, and above them how common it is (eighths of a power of two; the last value is for hot shingles).
SET_BITS, HASH_BITS, HOT = 56, 48, 127


def room(n: int) -> int:
    """How many of ``n`` shingles may be missing from a partner that still links."""
    return n - -(-PERCENT * n // 100)


def row_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, offsets in common.text_blocks(column):
        words, row, _, _ = common.word_hashes(data, offsets)
        grams = common.ngram_hashes(words, WIDTH)
        bounds = np.searchsorted(row, np.arange(len(offsets)))
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= WIDTH:
                yield np.unique(grams[a : b - WIDTH + 1] >> np.uint64(64 - SET_BITS))
            else:
                yield common.ngram_hashes(words[a:b], b - a) >> np.uint64(64 - SET_BITS) if b > a else words[:0]


def narrow(shingles: np.ndarray) -> np.ndarray:
    """A set's shingles by the ``HASH_BITS`` under which sets are compared; still sorted and distinct."""
    short = shingles >> np.uint64(SET_BITS - HASH_BITS)
    return short[np.flatnonzero(np.r_[True, short[1:] != short[:-1]])] if len(short) else short


def set_id(shingles: np.ndarray) -> int:
    total = common.mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(common.mix(np.array([total])).view(np.int64)[0])


def light_keys(shingles: np.ndarray) -> np.ndarray:
    """Subset keys of a light set: for each size ``a`` of a partner that is no larger, all subsets of the least overlap of two such sets."""
    n, keys = len(shingles), []
    for a in range(n - room(n), n + 1):
        size = -(-2 * PERCENT * a // (100 + PERCENT))
        for subset in combinations(range(n), min(size, n)):
            chosen = shingles[list(subset)]
            keys.append(common.mix(common.mix(chosen).sum(dtype=np.uint64) + np.array([1000 * a + size], np.uint64))[0])
    return np.unique(np.array(keys, np.uint64))


def light_cost(n: int) -> int:
    return sum(math.comb(n, min(n, -(-2 * PERCENT * a // (100 + PERCENT)))) for a in range(n - room(n), n + 1))


def best_boundary(histogram: dict[int, int]) -> int:
    """The boundary with the fewest rows: subsets of light sets and shingles of the sets that heavy ones may meet."""
    def rows(x: int) -> int:
        listed = (x + 1) - room(x + 1)
        return sum(c * ((light_cost(n) if n <= x else 0) + (n if n >= listed else 0)) for n, c in histogram.items() if n <= MOST_LIGHT)

    return min(range(MOST_LIGHT + 1), key=lambda x: (rows(x), x))


def _long(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: doc_id, set id (null: no shingles) and size. Besides, shingles met three times or more within a run of about a million: (hot, hot_n)."""
    held: list[np.ndarray] = []

    def hot() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keep = counts >= 3
        n = int(keep.sum())
        held.clear()
        return pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), _long(values[keep]), pa.array(counts[keep])], ["doc_id", "set_id", "n", "hot", "hot_n"])

    pending, seen = 0, set()
    for batch in batches:
        ids, sizes = [], []
        for shingles in row_sets(batch.column(1)):
            sizes.append(len(shingles))
            ids.append(set_id(shingles) if len(shingles) else None)
            if ids[-1] is not None and ids[-1] not in seen:
                seen.add(ids[-1])
                held.append(narrow(shingles))
                pending += len(shingles)
                if pending > 1_000_000:
                    yield hot()
                    pending = 0
        n = len(ids)
        yield pa.record_batch([batch.column(0), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], ["doc_id", "set_id", "n", "hot", "hot_n"])
    yield hot()


def keyed(hot: np.ndarray, boundary: int, wide: bool):
    """An Arrow function: each set once per task with its keys. ``wide``: the shingles to be listed; else the rest (hot shingles, and all of a light set)."""
    listed = (boundary + 1) - room(boundary + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows, waiting = [], 0
            for shingles in row_sets(batch.column(0)):
                if waiting > 1 << 18:
                    yield packed(rows)
                    rows, waiting = [], 0
                n = len(shingles)
                if not n or (key := set_id(shingles)) in seen:
                    continue
                seen.add(key)
                waiting += n
                shingles = narrow(shingles)
                n = len(shingles)
                is_hot = np.isin(shingles, hot) if len(hot) else np.zeros(n, bool)
                if wide:
                    if n >= listed and not is_hot.all():
                        rows.append((key, shingles[~is_hot].view(np.int64)))
                elif n <= boundary or is_hot.any():
                    rows.append((key, shingles[is_hot].view(np.int64) if n >= listed else [], shingles.view(np.int64) if n <= boundary else None, light_keys(shingles).view(np.int64) if n <= boundary else None))
            yield packed(rows)

    def packed(rows: list) -> pa.RecordBatch:
        names = ["set_id", "keys"] if wide else ["set_id", "hot", "light", "keys"]
        cols = list(zip(*rows)) if rows else [[]] * len(names)
        types = [pa.int64()] + [pa.list_(pa.int64())] * (len(names) - 1)
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, types)], names)

    return run


def linked(group: pd.DataFrame) -> pd.DataFrame:
    """Spanning links among the classes of one block or pair of blocks."""
    ids, sizes = group["set_id"].to_numpy(), group["n"].to_numpy()
    m = len(ids)
    values = np.concatenate([np.asarray(x, np.int64) for x in group["shared"]]) & ((1 << HASH_BITS) - 1)
    owner = np.repeat(np.arange(m), [len(x) for x in group["shared"]])
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    keep = counts[inverse] > 1
    column = np.cumsum(counts > 1)[inverse[keep]] - 1
    owner = owner[keep]
    common_n = np.zeros((m, m), np.float64)
    for lo in range(0, int(column.max()) + 1 if len(column) else 0, 8192):
        part = (column >= lo) & (column < lo + 8192)
        x = np.zeros((m, 8192), np.float32)
        x[owner[part], column[part] - lo] = 1
        common_n += x @ x.T
    a, b = np.nonzero(np.triu(100 * common_n >= PERCENT * (sizes[:, None] + sizes[None, :] - common_n), 1))
    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        if (p := find(i)) != (q := find(j)):
            root[max(p, q)] = min(p, q)
            out.append((ids[i], ids[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the component is the least doc_id reachable over links, per row of ``docs``."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = common.cut(docs.mapInArrow(summarise, "doc_id long, set_id long, n long, hot long, hot_n long"))
    rows = found.where("n is not null").select("doc_id", "set_id", "n")
    classes = rows.where("set_id is not null").groupBy("set_id").agg(F.first("n").alias("n"))
    sizes = classes.groupBy(F.least("n", F.lit(MOST_LIGHT + 1)).alias("n")).count().collect()
    histogram = {r["n"]: r["count"] for r in sizes}
    boundary = best_boundary(histogram)
    # A hot shingle has over one in 500 classes, so there are at most 500 times a mean set's size of them; they are the last to be looked up.
    floor = max(1000, sum(histogram.values()) // 500)
    hot = np.array([r[0] for r in found.where("hot is not null").groupBy("hot").agg(F.sum("hot_n").alias("c")).where(F.col("c") >= floor).select("hot").collect()], np.int64).view(np.uint64)

    texts = docs.select("text")
    listed = texts.mapInArrow(keyed(hot, boundary, True), "set_id long, keys array<long>").select("set_id", F.explode("keys").alias("key"))
    over = Window.partitionBy("key")
    graded = F.shiftleft(F.least(F.floor(8 * F.log2("df")), F.lit(HOT - 1)).cast("long"), HASH_BITS)
    shared = (
        listed.select("*", F.count(F.lit(1)).over(over).alias("df"), F.min("set_id").over(over).alias("lo"), F.max("set_id").over(over).alias("hi"))
        .where("lo <> hi")
        .select("set_id", graded.bitwiseOR(F.col("key")).alias("key"))
        .groupBy("set_id")
        .agg(F.collect_set("key").alias("rare"))
    )
    rest = common.cut(texts.mapInArrow(keyed(hot, boundary, False), "set_id long, hot array<long>, light array<long>, keys array<long>").dropDuplicates(["set_id"]))
    none = F.array().cast("array<long>")
    common_last = F.transform("hot", lambda x: x.bitwiseOR(F.lit(HOT << HASH_BITS)))
    both = shared.join(rest.where("size(hot) > 0").select("set_id", common_last.alias("hot")), "set_id", "full_outer")
    both = both.join(classes, "set_id").select("set_id", "n", F.concat(F.sort_array(F.coalesce("rare", none)), F.coalesce("hot", none)).alias("shared"))
    spare = (F.col("n") - F.ceil(F.col("n") * PERCENT / 100)).cast("int") - (F.col("n") - F.size("shared")).cast("int") + 1
    heavy = common.cut(both.select("set_id", "n", "shared", spare.alias("spare")).where("spare > 0"))

    light = rest.where("light is not null")
    lists = heavy.select("set_id", F.explode(F.slice("shared", F.lit(1), F.col("spare"))).alias("key")).union(light.select("set_id", F.explode("keys").alias("key")))
    sizes = lists.groupBy("key").agg(F.min("set_id").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1")
    lists = common.cut(lists.join(sizes, "key"))
    groups = common.connected_components(lists.where("set_id <> first").select("set_id", "first").distinct(), "set_id", "first")

    members = groups.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    by_list = lists.where("set_id = first").join(groups, lists["first"] == groups["node"]).groupBy("component").agg(F.sum(F.col("members") * F.col("members")).alias("by_list"))
    choice = members.join(by_list, "component").select("component", "members", (F.col("members") * F.col("members") <= F.greatest("by_list", F.lit(BLOCK * BLOCK))).alias("whole"))
    placed = groups.join(choice, "component")
    whole = placed.where("whole").select(F.lit(0).alias("kind"), F.col("component").alias("unit"), F.col("node").alias("set_id"), "members")
    single = lists.join(placed.where("not whole").select(F.col("node").alias("set_id")), "set_id").select(F.lit(1).alias("kind"), F.col("key").alias("unit"), "set_id", "members")
    dealt = whole.union(single).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    dealt = common.cut(dealt.withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")).drop("members"))
    arrays = heavy.where(F.col("n") > boundary).select("set_id", "n", "shared").union(light.select("set_id", F.size("light").cast("long").alias("n"), F.col("light").alias("shared")))
    parts = joined_classes(dealt, arrays, lists)

    # What a class's rows are called is found class by class; then only a key lookup meets the rows.
    least = rows.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("times"))
    least = common.cut(least.join(parts, least["set_id"] == parts["node"], "left").select("set_id", "least", "times", F.col("component").alias("part")))
    of_part = common.cut(least.where("part is not null").groupBy("part").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes")))
    named = common.keyed_join(least.where("part is not null"), of_part, "part", "classes").select("set_id", "times", "component_id")
    named = common.cut(named.union(least.where("part is null").select("set_id", "times", "least")))
    linked_rows = common.keyed_join(rows.where("set_id is not null"), named, "set_id", "times").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked_rows.union(rows.where("set_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def joined_classes(dealt: DataFrame, arrays: DataFrame, lists: DataFrame) -> DataFrame:
    """(node, component) of the classes that verified links join: ``dealt`` (kind, unit, set_id, blocks, own) names the candidates."""

    def verified(rows: DataFrame) -> DataFrame:
        return common.cut(rows.join(arrays, "set_id").groupBy("kind", "unit", "i", "j").applyInPandas(linked, "a long, b long"))

    own = dealt.select("kind", "unit", F.col("own").alias("i"), F.col("own").alias("j"), "set_id")
    large = common.cut(dealt.where("blocks > 1"))
    if large.isEmpty():
        return common.connected_components(verified(own), "a", "b")
    shared = lists.join(large.select("set_id").distinct(), "set_id").groupBy("set_id").agg(F.sum("members").alias("shared"))
    pivots = common.cut(large.join(shared, "set_id").groupBy("kind", "unit", "blocks").agg(F.max(F.struct("shared", "set_id", "own")).alias("pivot")).select("kind", "unit", "blocks", "pivot.set_id", "pivot.own"))
    beside = pivots.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("i <> own").select("kind", "unit", "i", F.col("i").alias("j"), "set_id")
    links = verified(own.union(beside))
    parts = common.connected_components(links, "a", "b")

    # (kind, unit) of the rest: the classes of another part than their unit's pivot.
    of = lambda rows: rows.join(parts, rows["set_id"] == parts["node"], "left").drop("node").withColumn("part", F.coalesce("component", "set_id")).drop("component")
    main = of(pivots.select("kind", "unit", "set_id")).select("kind", "unit", F.col("part").alias("main"))
    rest = common.cut(common.small_join(of(large), common.cut(main), ["kind", "unit"]).where("part <> main").select("kind", "unit", "set_id", "blocks"))
    if rest.isEmpty():
        return parts
    groups = common.cut(rest.groupBy("kind", "unit").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("sides")))
    side = common.small_join(rest, groups, ["kind", "unit"]).withColumn("i", F.pmod(F.xxhash64("set_id", F.lit("rest")), F.col("sides")).cast("int"))
    side = side.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("kind", "unit", "i", "j", "set_id")
    others = common.small_join(large, groups, ["kind", "unit"]).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).select("kind", "unit", "i", F.col("own").alias("j"), "set_id")
    return common.connected_components(links.union(verified(side.union(others).distinct())), "a", "b")


def op10_jaccard_components(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(common.documents(spark, sf_dir))
