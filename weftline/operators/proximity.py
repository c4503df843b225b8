"""Clusters of points that lie close to each other, within groups.

Points within ``distance`` on both axes are linked, and so are those that links connect. A plane is cut into square cells of that width:
points of one cell are always linked, so cells are the nodes, and two neighbouring cells are linked if any two of their points are, which their outer
points tell. A group is spread over its cells; equal points meet once, so a cell holds a few numbers for each column of its own,
however many points fall into it.

``mark_optical`` needs no table of cells where a plane has at most ``COLUMNS`` columns of cells: the rows of a key are exchanged once, and a task links
the cells of one plane after the other by the one row of each column that may be the best of its cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans import graph

#: Columns of cells (a coordinate x in a row of cells) of a plane that a task links by itself, at most.
COLUMNS = 1 << 21


def clusters(df: DataFrame, group: list[str], x: str, y: str, distance: int, name: str = "cluster") -> DataFrame:
    """``df`` with ``cluster``, a number that the points of a cluster share within their group; null where a coordinate is. Coordinates are integers."""
    width = distance + 1  # so that the two ends of a cell are ``distance`` apart
    cell = F.struct(*group, F.floor(F.col(x) / width).alias("_cx"), F.floor(F.col(y) / width).alias("_cy"))
    placed = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    columns = placed.groupBy(cell.alias("cell"), F.col(x).alias("x")).agg(F.min(y).alias("lo"), F.max(y).alias("hi"))
    cells = columns.groupBy("cell").agg(F.collect_list(F.struct("x", "lo", "hi")).alias("columns"))  # ``width`` columns at most
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (0, 1), (1, 1), (1, -1))])
    near = cells.withColumn("_s", F.explode(steps))
    other = F.struct(*[F.col(f"cell.{c}").alias(c) for c in group], (F.col("cell._cx") + F.col("_s.dx")).alias("_cx"), (F.col("cell._cy") + F.col("_s.dy")).alias("_cy"))
    pairs = near.withColumn("other", other).alias("a").join(cells.select(F.col("cell").alias("other"), F.col("columns").alias("others")), "other")
    linked = F.exists("columns", lambda p: F.exists("others", lambda q: (F.abs(q["x"] - p["x"]) <= distance) & ((F.col("_s.dy") == 0) | ((F.col("_s.dy") > 0) & (q["lo"] - p["hi"] <= distance)) | ((F.col("_s.dy") < 0) & (p["lo"] - q["hi"] <= distance)))))
    edges = pairs.where(linked).select(F.col("cell").alias("src"), F.col("other").alias("dst"))
    found = graph.connected(edges).select(F.col("node").alias("_cell"), F.col("component").alias("_component"))
    rows = df.withColumn("_cell", F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), cell)).join(found, "_cell", "left")
    lowest = F.coalesce("_component", "_cell")
    return rows.withColumn(name, F.when(F.col("_cell").isNotNull(), F.xxhash64(lowest))).drop("_cell", "_component")


def linked_cells(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the cells 0 to n - 1 that links (a, b) connect each to."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, label[a], least)
        np.minimum.at(now, label[b], least)
        while (now[now] != now).any():
            now = now[now]
        if (now == label).all():
            return label
        label = now


def outranked(plane: np.ndarray, cx: np.ndarray, cy: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray, width: int) -> np.ndarray:
    """Of columns (plane, cell, x, least and greatest y), in this order, with the rank of their best row: whether another of their cluster has a better one."""
    fresh = np.r_[True, plane[1:] != plane[:-1]]
    side = int(np.ptp(cy)) + 3
    code = ((np.cumsum(fresh) - 1) * (int(np.ptp(cx)) + 2) + cx - cx.min()) * side + cy - cy.min() + 1
    start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    codes, of = code[start], np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(code)]))
    x, lo, hi = x - cx * width, lo - cy * width, hi - cy * width
    # Within a cell, the least and greatest y of the columns up to each one: a later cell's values lie beyond an earlier one's.
    low, high = np.minimum.accumulate(lo - of * width) + of * width, np.maximum.accumulate(hi + of * width) - of * width
    cell_low, cell_high = np.minimum.reduceat(lo, start), np.maximum.reduceat(hi, start)
    links = []
    for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1)):
        to = np.searchsorted(codes, codes + dx * side + dy)
        met = np.flatnonzero((to < len(codes)) & (codes[np.minimum(to, len(codes) - 1)] == codes + dx * side + dy))
        if not dx:
            links.append((met[cell_low[to[met]] < cell_high[met]], to[met[cell_low[to[met]] < cell_high[met]]]))
            continue
        mine = np.flatnonzero(np.isin(of, met))
        other = to[of[mine]]
        last = np.searchsorted(of * width + x, other * width + x[mine]) - 1  # the last column that is near enough in x
        near = last >= start[other]
        if dy:
            near &= low[last] < hi[mine] if dy > 0 else lo[mine] < high[last]
        links.append((of[mine][near], other[near]))
    cluster = linked_cells(len(codes), *(np.concatenate(part) for part in zip(*links)))[of]
    best = np.full(len(codes), np.iinfo(np.int64).max)
    np.minimum.at(best, cluster, rank)
    return rank != best[cluster]


def _marked_planes(df: DataFrame, key: list[str], tile: list[str], x: str, y: str, distance: int, best: list) -> DataFrame:
    width, names = distance + 1, df.columns
    placed = F.col(x).isNotNull() & F.col(y).isNotNull()
    cells = {"_x": F.when(placed, F.col(x)).cast("long"), "_y": F.when(placed, F.col(y)).cast("long")}
    rows = df.withColumns(cells).withColumns({"_cx": F.floor(F.col("_x") / width), "_cy": F.floor(F.col("_y") / width)})
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*best)).cast("long"))
    order = [*key, *tile, "_cx", "_cy", "_x"]
    column = Window.partitionBy(*order)
    rows = rows.withColumns({"_lo": F.min("_y").over(column), "_hi": F.max("_y").over(column), "_first": F.col("_x").isNotNull() & (F.min("_rank").over(column) == F.col("_rank"))})
    plane = F.xxhash64(*key, *tile, *[F.isnull(c) for c in (*key, *tile)])
    rows = rows.sortWithinPartitions(*order).select(*names, "_rank", plane.alias("_plane"), "_cx", "_cy", "_x", "_lo", "_hi", "_first")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(batch, optical):
            return pa.record_batch([*(batch.column(c) for c in names), pa.array(batch.column("_rank").to_numpy() > 1), pa.array(optical)], [*names, "is_dup", "is_optical"])

        def done(table: pa.Table):
            # A key's best row is no copy, so it is the best of its cluster too.
            args = [table.column(c).to_numpy() for c in ("_plane", "_cx", "_cy", "_x", "_lo", "_hi", "_rank")]
            optical, at = outranked(*args, width), 0
            for batch in table.to_batches():
                yield out(batch, optical[at : at + len(batch)])
                at += len(batch)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            first = batch.column("_first")
            rest = batch.filter(pa.compute.invert(first))
            if len(rest):
                yield out(rest, rest.column("_x").is_valid().to_numpy(zero_copy_only=False))
            batch = batch.filter(first)
            if not len(batch):
                continue
            planes = batch.column("_plane").to_numpy()
            others = np.flatnonzero(planes != planes[-1])
            cut = int(others[-1]) + 1 if len(others) else 0
            if held and (cut or held[-1].column("_plane")[-1].as_py() != planes[0]):
                yield from done(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from done(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from done(pa.Table.from_batches(held))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return rows.mapInArrow(marked, f"{kinds}, is_dup boolean, is_optical boolean")


def mark_optical(df: DataFrame, key: list[str], tile: list[str], x: str, y: str, distance: int, best: list) -> DataFrame:
    """``df`` with is_dup (all but the best row of a key) and is_optical: a duplicate within a cluster of its key and tile that holds a better row."""
    ends = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.min(x).alias("x"), F.max(x).alias("to_x"), F.min(y).alias("y"), F.max(y).alias("to_y")).first()
    if ends["x"] is None or (ends["to_x"] - ends["x"] + 1) * ((ends["to_y"] - ends["y"]) // (distance + 1) + 2) <= COLUMNS:
        return _marked_planes(df, key, tile, x, y, distance, best)
    rows = clusters(df, [*key, *tile], x, y, distance, "_cluster")
    own, near = Window.partitionBy(*key).orderBy(*best), Window.partitionBy(*key, *tile, "_cluster").orderBy(*best)
    rows = rows.withColumn("is_dup", F.row_number().over(own) > 1)
    return rows.withColumn("is_optical", F.col("is_dup") & F.col("_cluster").isNotNull() & (F.row_number().over(near) > 1)).drop("_cluster")
