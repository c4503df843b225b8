"""Dependencies between steps, and questions about them as Spark queries.

``a >> b`` runs b after a, ``a + b`` groups them (and binds tighter), ``EMPTY``
is the identity of both. ``edges`` gives the graph as rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.lineage import removed, written


class Dependable:
    def heads(self) -> list[Step]:
        return []

    def tails(self) -> list[Step]:
        return []

    def steps(self) -> list[Step]:
        return []

    def __rshift__(self, other: Dependable | None) -> Dependable:
        other = EMPTY if other is None else other
        if self is EMPTY or other is EMPTY:
            return other if self is EMPTY else self
        for a in self.tails():
            for b in other.heads():
                a.after.append(b)
        return Composite(self.heads(), other.tails(), [*self.steps(), *other.steps()])

    def __add__(self, other: Dependable | None) -> Dependable:
        other = EMPTY if other is None else other
        if self is EMPTY or other is EMPTY:
            return other if self is EMPTY else self
        return Composite([*self.heads(), *other.heads()], [*self.tails(), *other.tails()], [*self.steps(), *other.steps()])

    def cut_from(self, other: Dependable) -> bool:
        """Remove the edges from this one's tails to the other's heads (the first occurrence of each); whether there was any."""
        found = False
        for a in self.tails():
            for b in other.heads():
                if b in a.after:
                    a.after.remove(b)
                    found = True
        return found


@dataclass(eq=False)
class Step(Dependable):
    name: str
    after: list[Step] = field(default_factory=list)

    def heads(self) -> list[Step]:
        return [self]

    tails = steps = heads


class Composite(Dependable):
    def __init__(self, heads: list[Step], tails: list[Step], steps: list[Step]):
        self._heads, self._tails, self._steps = heads, tails, steps

    def heads(self) -> list[Step]:
        return self._heads

    def tails(self) -> list[Step]:
        return self._tails

    def steps(self) -> list[Step]:
        return self._steps


EMPTY = Dependable()


def named(name: Column, frames: list[tuple[str, str]]) -> Column:
    """A step's name within nested frames of (prefix, suffix), outermost first: all prefixes, the name, all suffixes."""
    return F.concat(F.lit("".join(p for p, _ in frames)), name, F.lit("".join(q for _, q in frames)))


def edges(spark: SparkSession, graph: Dependable) -> DataFrame:
    return spark.createDataFrame([(a.name, b.name) for a in dict.fromkeys(graph.steps()) for b in a.after], "src string, dst string")


def without(edges: DataFrame, cut: DataFrame) -> DataFrame:
    """The edges that ``cut`` hasn't; each stays once."""
    return edges.select("src", "dst").distinct().join(cut.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a path: paths are doubled until no pair is new, so cycles end too."""
    pairs = written(edges.select("src", "dst").distinct())
    count = pairs.count()
    while True:
        longer = pairs.alias("a").join(pairs.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        wider = written(pairs.union(longer).distinct())
        now = wider.count()
        removed(pairs)
        pairs = wider
        if now == count:
            return pairs
        count = now


def spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): the least label that reaches each node along the edges; nodes without a label take none on."""
    edges, labels = written(edges.select("src", "dst").distinct()), written(labels.select("node", "label"))
    while True:
        near = edges.join(labels, edges["src"] == labels["node"]).groupBy("dst").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["dst"], "left").select("node", "label", F.least("label", "near").alias("now"))
        step = written(step)
        removed(labels)
        labels = step.select("node", F.col("now").alias("label"))
        if step.where("now <> label").isEmpty():
            removed(edges)
            return labels


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that undirected edges connect each node of ``edges`` to.

    A round takes the least label of a node's neighbours, and then that label's own label, so a chain of n nodes takes about log n rounds. The
    table of a round is removed as the next one is written.
    """
    pairs = edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).where("x is not null and y is not null and x <> y")
    both = written(pairs.union(pairs.select("y", "x")).distinct())
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")))
    while True:
        near = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["node"] == near["x"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        moved = written(step.join(labels.select(F.col("node").alias("mid"), F.col("component").alias("far")), "mid").select("node", "old", F.least("mid", "far").alias("component")))
        done = moved.where("old <> component").isEmpty()
        removed(labels)
        labels = moved.drop("old")
        if done:
            removed(both)
            return labels


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Strongly connected components: (node, component), where the component is its least node.

    Round by round: nodes without a way in or out are by themselves; each other node takes the least
    label that reaches it, and what reaches the label's own node back within its label is that node's
    component. Labels are exchanged, never pairs of nodes.
    """
    edges = written(edges.where("src <> dst").select("src", "dst").distinct())
    left, done = written(nodes_of(edges)), []
    while not left.isEmpty():
        inner = written(left.join(edges.select(F.col("dst").alias("node")), "node", "left_semi").join(edges.select(F.col("src").alias("node")), "node", "left_semi"))
        done.append(left.join(inner, "node", "left_anti").select("node", F.col("node").alias("component")))
        if inner.count() == left.count():
            colour = spread(edges, inner.select("node", F.col("node").alias("label")))
            of = colour.select(F.col("node").alias("src"), F.col("label").alias("a"))
            to = colour.select(F.col("node").alias("dst"), F.col("label").alias("b"))
            back = edges.join(of, "src").join(to, "dst").where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            # Backwards from the labels' own nodes: 0 reaches, 1 doesn't.
            reached = spread(back, colour.select("node", F.when(F.col("node") == F.col("label"), 0).otherwise(1).alias("label"))).where("label = 0").select("node")
            found = written(colour.join(reached, "node").select("node", F.col("label").alias("component")))
            done.append(found)
            inner = inner.join(found, "node", "left_anti")
        left = written(inner)
        edges = written(edges.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(left.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
    out = left.select("node", F.col("node").alias("component"))
    for part in done:
        out = out.unionByName(part)
    return out


def cyclic(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves: those of components of two and more, and those with an edge to themselves."""
    parts = components(edges)
    many = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    return parts.join(many, "component").select("node").union(edges.where("src = dst").select("src")).distinct()


def levels(edges: DataFrame) -> DataFrame:
    """Longest-path level of each node of an acyclic graph."""
    edges = written(edges.select("src", "dst"))
    level = written(nodes_of(edges).select("node", F.lit(0).alias("level")))
    for _ in range(level.count()):
        above = edges.join(level, edges["src"] == level["node"]).groupBy("dst").agg((F.max("level") + 1).alias("up"))
        raised = written(level.join(above, level["node"] == above["dst"], "left").select("node", F.col("level").alias("old"), F.greatest("level", F.coalesce("up", "level")).alias("level")))
        removed(level)
        if raised.where("old <> level").isEmpty():
            return raised.select("node", "level")
        level = raised.drop("old")
    raise ValueError("the graph has a cycle")


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with a predecessor that isn't among ``nodes``."""
    missing = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_anti")
    return missing.select(F.col("dst").alias("node")).distinct()
