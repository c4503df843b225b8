"""Line dedup with a log-template tree.

Lines are dealt to the leaves of a tree of fixed depth: first by their number of
tokens, then by their leading ``DEPTH`` tokens, where a token with a digit is a
variable field. A line whose tokens have their fields blanked is a form; within a
leaf, distinct forms in a fixed order (most rows first, then by key) join the
template that agrees with them most, if it does in at least ``ALIKE`` of the
places beyond the leading ones, and the template generalises where they don't
agree; else they start a template. Lines of no more than ``DEPTH`` tokens are
templates as they are. A template that recurs in ``least_docs`` documents or more
is dropped from all of them; with ``keep_first`` the document of least key (a
hash of id and text) keeps its lines, so one copy stays.

A leaf of more than ``FORMS`` forms (or ``CELLS`` tokens) is split into parts that can't share a template: two forms of one template's lines
agree in so many places that they have one of a few disjoint sets of places in common, so forms that no such set connects never meet.
Where so many places are constant that all forms agree, the leaf is one template. Both give the result of the whole leaf, at any size. A part is
grown in one task, form by form; the task holds its templates, not its forms. Only forms and keys are exchanged; texts are, only
when the documents that lose lines are too many for a broadcast.

Defined results: null and empty texts have no lines to drop. Blank lines, and
lines of fields alone (numbers), stay. Rows with the same id and text are one
document. A null doc_id is an id like others. Documents, lines and tokens are told
apart by 64, 64 and 31 bits of hashes. An empty table gives an empty result. Only the
named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common

DEPTH, ALIKE, LEAST_DOCS = 3, 0.6, 2
#: A leaf's forms and tokens beyond which it is split, and how often parts are split again.
FORMS, CELLS, DEEPER = 4096, 1 << 20, 8
#: Templates of a leaf are looked up by place and token up to so many places and entries; beyond that each is compared.
PLACES, ENTRIES = 256, 1 << 21
_PLACE = np.uint64(0x9E3779B97F4A7C15)


def line_forms(data: np.ndarray, offsets: np.ndarray):
    """Of a block's lines with a token that is no field: row, number in its text, leaf, key, number of tokens; and all these lines' tokens (0: a field)."""
    words, row, start, end = common.word_hashes(data, offsets, fold=False)
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, none.view(np.uint64), none.view(np.uint64), none, none.astype(np.int32)
    digits, breaks = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 48) & (data <= 57), out=digits[1:])
    np.cumsum(data == 10, out=breaks[1:])
    token = np.where(digits[end] > digits[start], np.uint64(0), words | np.uint64(1))
    line = breaks[start] + row
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    n = np.diff(np.r_[first, len(words)])
    place = np.arange(len(words)) - np.repeat(first, n)
    tagged = common.mix(token + (place + 1).astype(np.uint64) * _PLACE)
    key = common.mix(np.add.reduceat(tagged, first) + n.astype(np.uint64))
    lead = n.astype(np.uint64) * _PLACE
    for k in range(DEPTH):
        lead = lead + np.where(n > k, tagged[np.minimum(first + k, len(words) - 1)], np.uint64(k))
    keep = np.add.reduceat((token != 0).astype(np.int64), first) > 0
    in_kept = np.repeat(keep, n)
    at = breaks[start[first]] - breaks[offsets[row[first]]]
    return row[first][keep], at[keep], common.mix(lead)[keep], key[keep], n[keep], (token[in_kept] >> np.uint64(33)).astype(np.int32)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def line_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) to the distinct (doc, leaf, line) of each text."""
    for batch in batches:
        docs, at = batch.column(0).to_numpy(), 0
        for lo, data, offsets in common.text_blocks(batch.column(1)):
            row, _, leaf, key, _, _ = line_forms(data, offsets)
            order = np.lexsort((key, row))
            row, leaf, key = row[order], leaf[order], key[order]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            yield pa.record_batch([pa.array(docs[lo + row[fresh]]), _long(leaf[fresh]), _long(key[fresh])], ["doc", "leaf", "line"])


def line_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (line, tokens): each line that can generalise, once a block."""
    for batch in batches:
        for _, data, offsets in common.text_blocks(batch.column(0)):
            _, _, _, key, n, tokens = line_forms(data, offsets)
            keep = np.zeros(len(key), bool)
            keep[np.unique(key, return_index=True)[1]] = True
            keep &= n > DEPTH
            ends = np.cumsum(n[keep], dtype=np.int64)
            lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int64)), pa.array(tokens[np.repeat(keep, n)])).cast(pa.list_(pa.int32()))
            yield pa.record_batch([_long(key[keep]), lists], ["line", "tokens"])


class Leaf:
    """The templates of a leaf so far; its forms come in their order."""

    def __init__(self, width: int):
        self.width, self.least, self.owner, self.entries = width, math.ceil(ALIKE * (width - DEPTH)), [], 0
        self.known = np.empty((width - DEPTH, 4), np.int32)
        self.at = [{} for _ in range(width - DEPTH)] if width - DEPTH <= PLACES else None

    def _listed(self, place: int, token: int, template: int) -> None:
        if self.at is not None:
            self.at[place].setdefault(token, []).append(template)
            self.entries += 1
            if self.entries > ENTRIES:
                self.at = None

    def best(self, form: np.ndarray) -> int | None:
        """The first of the templates that agree most with a form, if they do enough."""
        k, near = len(self.owner), slice(0, len(self.owner))
        if self.at is not None and k > 16:
            # A template that agrees in ``least`` places is listed under one of the others and one more.
            lists = sorted((at.get(t, ()) for at, t in zip(self.at, form.tolist())), key=len)[: len(form) - self.least + 1]
            if sum(map(len, lists)) < k // 4:
                near = sorted(set().union(*lists))
                k = len(near)
        if not k:
            return None
        same = (self.known[:, near] == form[:, None]).sum(axis=0)
        first = int(same.argmax())
        return None if same[first] < self.least else first if isinstance(near, slice) else near[first]

    def template(self, line: int, tokens: np.ndarray) -> int:
        """The line that started the template that a line joins, or itself."""
        form = tokens[DEPTH:]
        best, k = self.best(form), len(self.owner)
        if best is not None:
            for place in np.flatnonzero((self.known[:, best] != form) & (self.known[:, best] != 0)).tolist():
                self.known[place, best] = 0
                self._listed(place, 0, best)
            return self.owner[best]
        if k == self.known.shape[1]:
            self.known = np.concatenate([self.known, np.empty_like(self.known)], axis=1)
        self.known[:, k] = form
        self.owner.append(line)
        for place, token in enumerate(form.tolist() if self.at is not None else []):
            self._listed(place, token, k)
        return line


def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, line, tokens), sorted by leaf, to (line, template): the line that started its template."""
    now, leaf = None, None
    for batch in batches:
        lists = batch.column(2)
        values, bounds = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
        lines, template = batch.column(1).to_numpy(), np.empty(len(batch), np.int64)
        for i, (name, line) in enumerate(zip(batch.column(0).to_numpy(), lines)):
            tokens = values[bounds[i] : bounds[i + 1]]
            if now != name or leaf.width != len(tokens):
                now, leaf = name, Leaf(len(tokens))
            template[i] = leaf.template(line, tokens)
        yield pa.record_batch([pa.array(lines), pa.array(template)], ["line", "template"])


def parted(forms: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(leaf, line, n, tokens, ..) with large leaves split into parts that can't share a template; and the (line, template) of large leaves that are one template."""
    single = None
    for _ in range(DEEPER):
        sizes = forms.groupBy("leaf").agg(F.count(F.lit(1)).alias("m"), F.max(F.size("tokens")).alias("width"))
        large = common.cut(sizes.where((F.col("m") > FORMS) | ((F.col("m") > 16) & (F.col("m") * F.col("width") > CELLS))))
        if large.isEmpty():
            break
        big = common.small_join(forms.select("leaf", "line", "n", "tokens"), large.select("leaf"), "leaf")
        counts = big.select("leaf", F.posexplode(F.slice("tokens", DEPTH + 1, F.greatest(F.size("tokens") - DEPTH, F.lit(0)))).alias("by", "token")).groupBy("leaf", "by", "token").agg(F.lit(1).alias("one"))
        places = counts.groupBy("leaf", "by").agg(F.count("one").alias("tokens"), F.min("token").alias("least"))
        varying = F.col("tokens") > 1
        free = F.when(varying & (F.col("least") != 0), F.struct((-F.col("tokens")).alias("rank"), (F.col("by") + DEPTH).alias("by")))  # fields may agree with any token
        leaves = places.groupBy("leaf").agg(F.count(F.lit(1)).alias("d"), F.count_if(varying).alias("varying"), F.sort_array(F.collect_list(free)).alias("free"))
        leaves = leaves.withColumn("most", (F.col("d") - F.ceil(F.lit(ALIKE) * F.col("d"))).cast("int"))
        pieces = F.transform(F.sequence(F.lit(0), F.col("most")), lambda k: F.transform(F.filter("free", lambda _, i: i % (F.col("most") + 1) == k), lambda p: p["by"]))
        leaves = common.cut(leaves.select("leaf", (F.col("varying") <= F.col("most")).alias("one"), F.when(F.size("free") > F.col("most"), pieces).alias("pieces")))
        alike = common.small_join(big.select("leaf", "line", "n"), leaves.where("one").select("leaf"), "leaf")
        first = alike.groupBy("leaf").agg(F.max_by("line", F.struct("n", -F.col("line").cast("decimal(20,0)"))).alias("template"))
        alike = common.cut(common.small_join(alike.select("leaf", "line"), common.cut(first), "leaf").select("line", "template"))
        single = alike if single is None else single.unionByName(alike)
        split = common.cut(leaves.where("not one and pieces is not null").select("leaf", "pieces"))
        block = F.explode(F.transform("pieces", lambda at: F.xxhash64("leaf", at, F.transform(at, lambda p: F.get("tokens", p))))).alias("block")
        blocks = common.cut(common.small_join(big.select("leaf", "line", "tokens"), split, "leaf").select("line", block))
        shared = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("k"), F.min("line").alias("first")).where("k > 1").drop("k")
        linked = common.connected_components(blocks.join(shared, "block").where("line <> first").select("line", "first"), "line", "first").withColumnRenamed("node", "line")
        parts = common.small_join(big.select("leaf", "line"), split.select("leaf"), "leaf").join(linked, "line", "left")
        parts = common.cut(parts.select("line", F.xxhash64("leaf", F.coalesce("component", "line")).alias("part")))
        rest = common.small_join(forms, leaves.where("one").select("leaf"), "leaf", "left_anti")
        forms = common.cut(rest.join(parts, "line", "left").withColumn("leaf", F.coalesce("part", "leaf")).drop("part"))
        if parts.select("part").distinct().count() <= split.count():
            break
    return forms, single


def recurring_lines(rows: DataFrame, lines: DataFrame, least_docs: int) -> DataFrame:
    """(line, n, first): the lines of templates in ``least_docs`` documents or more, their rows, and the least document of the template."""
    forms = common.cut(lines.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi")))
    met = forms.groupBy("leaf").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"), F.count(F.lit(1)).alias("forms")).where("_lo <> _hi").select("leaf", "forms")
    forms = common.cut(forms.join(met, "leaf"))
    several = common.cut(forms.where("forms > 1").drop("forms"))
    tokens = common.small_join(rows.select("text").mapInArrow(line_tokens, "line long, tokens array<int>"), several.select("line"), "line", max_rows=20_000)
    several = common.cut(several.join(tokens.dropDuplicates(["line"]), "line"))
    parts, single = parted(several)
    order = parts.repartition("leaf").sortWithinPartitions("leaf", F.desc("n"), "line").select("leaf", "line", "tokens")
    found = order.mapInArrow(grow, "line long, template long")
    grown = several.drop("tokens", "leaf").join(found if single is None else found.unionByName(single), "line")
    forms = common.cut(grown.unionByName(forms.where("forms = 1").select("line", "n", "lo", "hi", F.col("line").alias("template"))))
    if least_docs > 2:
        pairs = common.keyed_join(lines.select("doc", "line"), forms.select("line", "n", "template"), "line", "n").select("template", "doc").distinct()
        docs = pairs.groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("first")).where(F.col("docs") >= least_docs)
    else:
        docs = forms.groupBy("template").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).where(F.lit(least_docs < 2) | (F.col("first") != F.col("last")))
    return common.cut(forms.select("line", "n", "template").join(docs.select("template", "first"), "template").drop("template"))


def without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, drops) to (doc_id, text, n_lines, n_dropped): texts without the lines whose keys are in ``drops``."""
    for batch in batches:
        texts, drops = batch.column(1).cast(pa.large_string()), batch.column(2)
        counts = np.array([0 if t is None else t.count("\n") + 1 for t in (x.as_py() for x in texts)], np.int64)
        hit = np.flatnonzero(np.nan_to_num(drops.value_lengths().to_numpy(zero_copy_only=False).astype(float)) > 0)
        dropped, kept = np.zeros(len(counts), np.int64), {}
        chosen = texts.take(pa.array(hit))
        for lo, data, offsets in common.text_blocks(chosen):
            row, at, _, key, _, _ = line_forms(data, offsets)
            cuts = np.searchsorted(row, np.arange(len(offsets)))
            for r in range(len(offsets) - 1):
                i, part = int(hit[lo + r]), slice(cuts[r], cuts[r + 1])
                gone = set(at[part][np.isin(key[part].view(np.int64), drops[i].values.to_numpy())].tolist())
                dropped[i] = len(gone)
                kept[i] = "\n".join(line for k, line in enumerate(chosen[lo + r].as_py().split("\n")) if k not in gone)
        if kept:
            texts = pa.array([kept.get(i, t) for i, t in enumerate(texts.to_pylist())], pa.large_string())
        yield pa.record_batch([batch.column(0), texts.cast(pa.string()), pa.array(counts), pa.array(dropped)], ["doc_id", "text", "n_lines", "n_dropped"])


def drop_templates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_docs: int = LEAST_DOCS, keep_first: bool = False) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) per row: texts without the lines of recurring templates."""
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("doc"))
    lines = common.cut(rows.select("doc", "text").mapInArrow(line_keys, "doc long, leaf long, line long"))
    found = common.keyed_join(lines.select("doc", "line"), recurring_lines(rows, lines, least_docs), "line", "n")
    if keep_first:
        found = found.where("doc <> first")
    drops = common.cut(found.groupBy("doc").agg(F.collect_set("line").alias("drops")))
    most = drops.agg(F.sum(F.size("drops") + 4)).first()[0] or 0
    rows = rows.join(F.broadcast(drops) if most < 1 << 16 else drops, "doc", "left").select("doc_id", "text", "drops")
    return rows.mapInArrow(without_lines, f"doc_id {kind}, text string, n_lines long, n_dropped long")


def op5_line_templates(spark, sf_dir: str) -> DataFrame:
    out = drop_templates(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
