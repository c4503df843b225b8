"""Merkle manifest of a dataset: a tree of digests a source, a tree over the sources, and each row's path.

Rows become leaves where they are read, so that no text is exchanged. The leaves are sorted into range
partitions, and each partition learns from counts where in its source it begins. A partition then runs
a mountain range: a stack of nodes that folds every ``BASE`` consecutive siblings into their parent, which may
fold in turn. What the partition can't fold, as siblings lie in its neighbours, are its peaks, a few a
level. These meet in rounds of ``NEAR`` neighbouring partitions each until no edge is left. A source's last run
may be short; its nodes are hashed as they are, without padding. For the paths, each partition gets the few nodes
beside and above its own, and folds its leaves again. The sources' roots are the leaves of one more tree.

Defined results: rows of one doc_id ascend by leaf; null ids come first and are never tampered with. A null
source is a source of its own, before all others. Any column may be null. Repeated rows are leaves each.
A dataset of one row has its leaf as root and an empty path. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftline.lineage import cut, written
from weftline.llm import common

BASE = 3
#: Leaves a partition, about, and partitions whose peaks meet at once.
LEAVES, NEAR = 50_000, 64

NODES = "part long, grp string, level int, idx long, digest string, n long, edge boolean, top boolean"
_POWERS = [BASE**k for k in range(39)]


def digest(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def widths(n: int) -> list[int]:
    """Nodes at each level of a tree of ``n`` leaves, up to its root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // BASE))
    return out


class Range:
    """The mountain range over consecutive leaves of one source of ``n``: ``add`` yields the parents that a node completes."""

    def __init__(self, n: int):
        self.peaks: dict[int, list[tuple[int, str]]] = {}
        self.widths = widths(n)

    def add(self, level: int, idx: int, value: str) -> Iterator[tuple[int, int, str]]:
        if level + 1 == len(self.widths):
            return
        row = self.peaks.setdefault(level, [])
        row.append((idx, value))
        first = idx - idx % BASE
        size = min(BASE, self.widths[level] - first)
        if idx - first + 1 == size and len(row) >= size and row[-size][0] == first:
            parent = digest(*[v for _, v in row[-size:]])
            del row[-size:]
            yield level + 1, idx // BASE, parent
            yield from self.add(level + 1, idx // BASE, parent)


def merge_peaks(peaks: list[tuple[int, int, str]], n: int) -> tuple[list, list]:
    """Parents that peaks (level, idx, digest) of neighbouring partitions complete, and the peaks that are left."""
    rows: list[dict[int, str]] = [{} for _ in widths(n)]
    for level, idx, value in peaks:
        rows[level][idx] = value
    made, left = [], []
    for level, count in enumerate(widths(n)[:-1]):
        for first in sorted({i - i % BASE for i in rows[level]}):
            run = [rows[level].get(i) for i in range(first, min(first + BASE, count))]
            if None in run:
                left += [(level, first + k, v) for k, v in enumerate(run) if v is not None]
            else:
                rows[level + 1][first // BASE] = digest(*run)
                made.append((level + 1, first // BASE, rows[level + 1][first // BASE]))
    return made, left


def indexed(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Leaves (grp, leaf, ..) in range partitions by (grp, order), with ``part`` and ``row`` within it; and one row for each partition:
    where the leaves of its first and last source begin, and how many it has of them and there are."""
    leaves = cut(leaves)
    parts = max(1, -(-leaves.count() // LEAVES))
    tied = [*order, "leaf", "_at"]  # equal leaves are told apart, so that they may lie in several partitions
    ranged = leaves.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(parts, "grp", *tied).sortWithinPartitions("grp", *tied)
    at = F.monotonically_increasing_id()
    rows = cut(ranged.drop("_at").withColumn("part", F.shiftright(at, 33)).withColumn("row", at.bitwiseAND((1 << 33) - 1)))
    counts = rows.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("rows"))
    own = Window.partitionBy("grp")
    placed = counts.withColumn("n", F.sum("rows").over(own)).withColumn("start", F.sum("rows").over(own.orderBy("part")) - F.col("rows"))
    end = F.struct("grp", "start", "rows", "n")
    return rows, cut(placed.groupBy("part").agg(F.min(end).alias("first"), F.max(end).alias("last")))


def placed_leaves(rows: DataFrame, ends: DataFrame, *columns: str) -> DataFrame:
    """Leaves with ``start`` and ``n`` of their source in their partition; ``n`` is null where the source lies within the partition."""
    start = F.when(F.col("grp") == F.col("first.grp"), F.col("first.start")).otherwise(F.lit(0))
    n = F.when(F.col("grp") == F.col("first.grp"), F.col("first.n")).when(F.col("grp") == F.col("last.grp"), F.col("last.n"))
    return rows.join(F.broadcast(ends), "part").select("part", "row", "grp", "leaf", start.alias("start"), n.alias("n"), *columns)  # ends: one row a partition


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def records(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def node_records(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """``NODES`` that the partitions complete by themselves, and their peaks (``edge``)."""
    schema = to_arrow_schema(StructType.fromDDL(NODES))

    def fold(batches):
        def nodes():
            for (part, grp), leaves in groupby(records(batches), key=lambda r: r[:2]):
                leaves = list(leaves)
                start, n = leaves[0][3], leaves[0][4]
                n = start + len(leaves) if n is None else n
                height, mountain = len(widths(n)) - 1, Range(n)
                if n == 1:
                    yield part, grp, 0, 0, leaves[0][2], n, False, True
                for i, leaf in enumerate(leaves, start):
                    for level, idx, value in mountain.add(0, i, leaf[2]):
                        yield part, grp, level, idx, value, n, False, level == height
                for level, row in mountain.peaks.items():
                    for idx, value in row:
                        yield part, grp, level, idx, value, n, True, False

        yield from batches_of(nodes(), schema, 20_000)

    return written(placed_leaves(rows, ends).drop("row").mapInArrow(fold, NODES))


def merged_nodes(edges: DataFrame) -> DataFrame | None:
    """``NODES`` whose leaves lie in several partitions: rounds in which the peaks of ``NEAR`` neighbours meet."""
    schema, found = to_arrow_schema(StructType.fromDDL(NODES)), None

    def merge(table: pa.Table) -> pa.Table:
        def nodes():
            ordered = sorted(records(table.to_batches()), key=lambda r: r[1])
            for (grp, n), peaks in groupby(ordered, key=lambda r: (r[1], r[5])):
                peaks = list(peaks)
                made, left = merge_peaks([r[2:5] for r in peaks], n)
                for level, idx, value in made:
                    yield peaks[0][0], grp, level, idx, value, n, False, level == len(widths(n)) - 1
                for level, idx, value in left:
                    yield peaks[0][0], grp, level, idx, value, n, True, False

        return pa.Table.from_batches(batches_of(nodes(), schema, 20_000), schema)

    while not edges.isEmpty():
        near = edges.withColumn("part", F.expr(f"part div {NEAR}"))
        made = written(near.groupBy("part").applyInArrow(merge, NODES))
        done = made.where("not edge")
        found, edges = done if found is None else found.unionByName(done), made.where("edge")
    return found


def frames(ends: DataFrame, across: DataFrame) -> DataFrame:
    """(part, frame): of the nodes ``across`` partitions those that stand beside or above a partition's own."""
    span = F.explode(F.array_distinct(F.array("first", "last")))
    spans = ends.select("part", span.alias("s")).select("part", "s.*", F.array(*[F.lit(p).cast("long") for p in _POWERS]).alias("powers"))
    height = F.size(F.filter("powers", lambda p: p < F.col("n")))
    at = spans.select("part", "grp", "start", "rows", "n", "powers", F.explode(F.sequence(F.lit(0), height)).alias("level"))
    at = at.withColumn("power", F.get("powers", F.col("level"))).selectExpr("part", "grp", "level", "start div power AS lo", "(start + rows - 1) div power AS hi", "(n + power - 1) div power AS width")
    asked = F.array_distinct(F.concat(F.sequence(F.expr(f"lo - lo % {BASE}"), F.col("lo")), F.sequence(F.col("hi"), F.least(F.expr(f"hi - hi % {BASE} + {BASE - 1}"), F.col("width") - 1))))
    asked = at.select("part", "grp", "level", F.explode(asked).alias("idx"))
    return asked.join(across.select("grp", "level", "idx", "digest"), ["grp", "level", "idx"]).groupBy("part").agg(F.collect_list(F.struct("grp", "level", "idx", "digest")).alias("frame"))


def own_nodes(leaves: list[str], start: int, n: int, frame: list[tuple[int, int, str]]) -> list[dict[int, str]]:
    """Nodes by level and place: those of the leaves from ``start`` on, and the frame's."""
    rows: list[dict[int, str]] = [{} for _ in widths(n)]
    for level, idx, value in frame:
        rows[level][idx] = value
    rows[0].update(enumerate(leaves, start))
    lo, hi = start, start + len(leaves) - 1
    for level, count in enumerate(widths(n)[:-1]):
        lo, hi = lo // BASE, hi // BASE
        for i in range(lo, hi + 1):
            if i not in rows[level + 1]:
                rows[level + 1][i] = digest(*[rows[level][k] for k in range(i * BASE, min(i * BASE + BASE, count))])
    return rows


def leaf_paths(rows: list[dict[int, str]], start: int, stop: int, n: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf, level by level, the siblings before and after it, each joined."""
    size, upper = widths(n), {0: []}
    for level in range(len(size) - 2, -1, -1):
        power = BASE**level

        def step(i: int) -> list[tuple[str, str]]:
            first = i - i % BASE
            row = rows[level]
            return [("".join([row[k] for k in range(first, i)]), "".join([row[k] for k in range(i + 1, min(first + BASE, size[level]))])), *upper[i // BASE]]

        if level:
            upper = {i: step(i) for i in range(start // power, (stop - 1) // power + 1)}
        else:
            for i in range(start, stop):
                yield step(i)
    if len(size) == 1:
        yield []


def with_paths(rows: DataFrame, ends: DataFrame, across: DataFrame | None, columns: list[str]) -> DataFrame:
    """(grp, leaf, *columns, subroot, path): ``path`` lists, level by level, the joined digests before and after the leaf's node."""
    leaves = placed_leaves(rows, ends, *columns)
    kinds = StructType([leaves.schema[c] for c in ("grp", "leaf", *columns)])
    out = StructType([*kinds.fields, *StructType.fromDDL("subroot string, path array<struct<before string, after string>>").fields])
    arrow = to_arrow_schema(out)
    if across is not None:
        parts = ends.agg(F.max("part")).first()[0] + 1
        leaves = leaves.unionByName(frames(ends, across).withColumn("row", F.lit(-1).cast("long")), allowMissingColumns=True)
        leaves = leaves.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "row")
    names = leaves.columns
    at = {c: names.index(c) for c in names}

    def trace(batches):
        def traced():
            frame: dict[str, list] = {}
            for (_, grp, framed), run in groupby(records(batches), key=lambda r: (r[at["part"]], r[at["grp"]], r[at["row"]] < 0)):
                run = list(run)
                if framed:
                    frame = {}
                    for node in run[0][at["frame"]]:
                        frame.setdefault(node["grp"], []).append((node["level"], node["idx"], node["digest"]))
                    continue
                start, n = run[0][at["start"]], run[0][at["n"]]
                n = start + len(run) if n is None else n
                values = [r[at["leaf"]] for r in run]
                nodes = own_nodes(values, start, n, frame.get(grp, []))
                for r, path in zip(run, leaf_paths(nodes, start, start + len(run), n), strict=True):
                    yield grp, r[at["leaf"]], *[r[at[c]] for c in columns], nodes[-1][0], [{"before": b, "after": a} for b, a in path]

        yield from batches_of(traced(), arrow, 2_000)

    return leaves.mapInArrow(trace, out)


def tree(leaves: DataFrame, order: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """For leaves (grp, leaf, *order, *columns): (grp, leaf, *columns, subroot, path) of each, and the node records (grp, level, idx, digest, n, top)."""
    rows, ends = indexed(leaves, order)
    nodes = node_records(rows, ends)
    peaks, made = nodes.where("edge"), nodes.where("not edge")
    merged = merged_nodes(peaks)
    across = None if merged is None else peaks.unionByName(merged)
    every = made if merged is None else made.unionByName(merged)
    return with_paths(rows, ends, across, columns), every.select("grp", "level", "idx", "digest", "n", "top")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def fold(leaf: Column, path: Column) -> Column:
    return F.aggregate(path, leaf, lambda value, step: F.sha2(F.concat(step["before"], value, step["after"]), 256))


def manifest(docs: DataFrame, columns: list[str] | None = None, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The proofs (doc_id, leaf, tampered, grp, subroot, root, path), and the node records of the sources' trees and (``grp`` null) of theirs.

    ``grp`` is ``=`` and the source, empty for null, so that sources sort by their bytes and null is first. ``tampered`` is the leaf
    without the text's line feeds where 2 divides the id's checksum.
    """
    columns = columns or ["doc_id", "source", "lang", "n_chars", "text"]
    if set((doc_id, source, text)) - set(columns):
        raise ValueError("the leaf holds the id, the source and the text")
    rows = docs.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(columns)])
    at = {c: F.col(f"_{k}") for k, c in enumerate(columns)}

    def leaf(words: Column) -> Column:
        return F.sha2(F.concat(*[field(words if c == text else at[c]) for c in columns]), 256)

    even = F.crc32(at[doc_id].cast("string").cast("binary")) % 2 == 0
    grp = F.coalesce(F.concat(F.lit("="), at[source].cast("string")), F.lit(""))
    words = at[text].cast("string")
    changed = even & words.contains("\n")
    leaves = rows.select(at[doc_id].alias("doc_id"), grp.alias("grp"), leaf(words).alias("leaf"), F.when(changed, leaf(F.replace(words, F.lit("\n"), F.lit("")))).alias("changed"))
    proofs, nodes = tree(leaves, ["doc_id"], ["doc_id", "changed"])
    tops = nodes.where("top").select(F.lit("").alias("grp"), F.col("digest").alias("leaf"), F.col("grp").alias("source"), F.col("n").alias("members"))
    upper, upper_nodes = tree(tops, ["source"], ["source", "members"])
    upper = cut(upper.select(F.col("source").alias("grp"), F.col("subroot").alias("root"), F.col("path").alias("upper"), "members"))
    out = common.keyed_join(proofs, upper, "grp", "members")
    out = out.select("doc_id", "leaf", F.coalesce("changed", "leaf").alias("tampered"), "grp", "subroot", "root", F.concat("path", "upper").alias("path"))
    return out, nodes.unionByName(upper_nodes.withColumn("grp", F.lit(None).cast("string")))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    proofs, _ = manifest(common.documents(spark, sf_dir))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.col("tampered"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE
d AS (SELECT doc_id, source, lang, n_chars, text, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM documents),
x AS (SELECT *, xor(crc, 4294967295) % 2 = 0 AS even,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
  replace(text, chr(10), '') AS flat FROM d),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN even THEN sha256(head || coalesce(strlen(flat) || ':' || flat, '-')) END AS changed FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM l),
tree AS (SELECT s, 0 AS level, i AS idx, n, leaf AS digest FROM r
  UNION ALL SELECT s, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY s, level, idx // 3, n),
sub AS (SELECT s, digest, (SELECT count(DISTINCT s) FROM tree) AS n FROM tree WHERE n = 1),
up AS (SELECT 0 AS level, s AS idx, n, digest FROM sub
  UNION ALL SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY level, idx // 3, n),
steps AS (SELECT r.s, r.i, t.level AS pos, string_agg(t.digest, '' ORDER BY t.idx) FILTER (t.idx < r.i // (3 ** t.level)::BIGINT) AS before, string_agg(t.digest, '' ORDER BY t.idx) FILTER (t.idx > r.i // (3 ** t.level)::BIGINT) AS after
  FROM r JOIN tree t ON t.s = r.s AND t.n > 1 AND t.idx // 3 = r.i // (3 ** (t.level + 1))::BIGINT GROUP BY ALL),
ups AS (SELECT sub.s, t.level + 1000 AS pos, string_agg(t.digest, '' ORDER BY t.idx) FILTER (t.idx < sub.s // (3 ** t.level)::BIGINT) AS before, string_agg(t.digest, '' ORDER BY t.idx) FILTER (t.idx > sub.s // (3 ** t.level)::BIGINT) AS after
  FROM sub JOIN up t ON t.n > 1 AND t.idx // 3 = sub.s // (3 ** (t.level + 1))::BIGINT GROUP BY ALL),
every AS (SELECT s, i, pos, coalesce(before, '') AS before, coalesce(after, '') AS after FROM steps UNION ALL SELECT r.s, r.i, pos, coalesce(before, ''), coalesce(after, '') FROM r JOIN ups USING (s)),
paths AS (SELECT s, i, list({'b': before, 'a': after} ORDER BY pos) AS path, string_agg(before || after, '' ORDER BY pos) AS siblings FROM every GROUP BY ALL),
folds AS (SELECT s, i, coalesce(changed, leaf) AS value, coalesce(path, []) AS path, 1 AS k FROM r LEFT JOIN paths USING (s, i)
  UNION ALL SELECT s, i, sha256(path[k].b || value || path[k].a), path, k + 1 FROM folds WHERE k <= len(path))
SELECT doc_id, leaf, sub.digest AS subroot, top.digest AS root, sha256(coalesce(siblings, '')) AS proof_sha256, f.value AS folded_root, f.value = top.digest AS verified
FROM r JOIN sub USING (s) JOIN (SELECT digest FROM up WHERE n = 1) top ON true LEFT JOIN paths USING (s, i) JOIN folds f ON f.s = r.s AND f.i = r.i AND f.k = len(f.path) + 1
"""
