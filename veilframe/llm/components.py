"""Connected components of links, without bringing them to the driver or a large one to one task.

Links come as forests from tasks, each member linked to its tree's smallest. Members that are nobody's parent are set
aside with the smallest parent they have; what is left are links among parents, few where components are large. If those
are no more than a fixed number, one task joins them; else large-star and small-star rounds do, whose sums and joins
read written tables, so that Spark adds up a star's centre before the shuffle and splits its partition in the joins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

#: Links that one task may join.
ONE_TASK = 1 << 17


class Forest:
    """Union-find; roots are the smallest members."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    def add(self, pairs: Iterable[tuple]) -> "Forest":
        for a, b in pairs:
            a, b = self.root(a), self.root(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)
        return self

    def links(self) -> list[tuple]:
        """(member, root) of all members but roots."""
        return [(x, r) for x in list(self.up) if (r := self.root(x)) != x]

    def sent(self) -> Iterator[pa.RecordBatch]:
        got = self.links()
        for i in range(0, len(got), 20000):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got[i : i + 20000]], pa.int64()) for k in (0, 1)], ["a", "b"])


def forest(pairs: Iterable[tuple]) -> list[tuple]:
    return Forest().add(pairs).links()


def _joined(edges: DataFrame) -> DataFrame:
    """The components of a bounded number of links, in one task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Forest()
        for b in it:
            f.add(zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True))
        yield from f.sent()

    return edges.coalesce(1).mapInArrow(run, "a long, b long")


def _fold(edges: DataFrame) -> DataFrame:
    """Each member linked to the smallest of its parents, and its other parents to that."""
    with_least = edges.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return with_least.select("a", F.col("m").alias("b")).union(with_least.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over written edges (a > b)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = materialize(least.select("a", F.least("a", "m").alias("m")), "least")
    # large: larger neighbours to the smallest one; small: smaller neighbours and the node itself
    side = edges.select(F.col("b").alias("a"), F.col("a").alias("x")) if large else edges.select("a", F.col("b").alias("x"))
    moved = side.join(least, "a").select(F.col("x").alias("a"), F.col("m").alias("b"))
    out = materialize(moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    release(least)
    return out


def _rounds(edges: DataFrame) -> DataFrame:
    """a, b of the components of any number of links, by star rounds until nothing changes."""
    mark = None
    while True:
        wide = _star(edges, True)
        new = _star(wide, False)
        release(wide, edges)
        edges = new
        now = edges.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges
        mark = now


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """a (member) and b (smallest member) for every member of links (a, b: long) but the smallest; nulls and links of a member to itself count for nothing."""
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).toDF("a", "b", "ok").where("ok").drop("ok"), "links")
    if edges.count() <= one_task:
        out = materialize(_joined(edges), "components")
        release(edges)
        return out
    folded = materialize(_fold(edges), "folded")
    parents = materialize(folded.select(F.col("b").alias("p")).distinct(), "parents")
    marked = materialize(folded.join(parents, F.col("a") == F.col("p"), "left").select("a", "b", F.col("p").isNull().alias("outer")), "marked")
    least = F.min("b").over(Window.partitionBy("a"))
    outer = marked.where("outer").withColumn("m", least)
    core = materialize(marked.where("not outer").select("a", "b").union(outer.where("b <> m").select("b", "m")).distinct(), "core")
    leaves = materialize(outer.select("a", "m").distinct(), "leaves")
    release(edges, folded, parents)
    roots = materialize(_joined(core), "roots") if core.count() <= one_task else _rounds(core)
    up = roots.select(F.col("a").alias("_m"), F.col("b").alias("_r"))
    out = materialize(leaves.join(up, F.col("m") == F.col("_m"), "left").select("a", F.coalesce("_r", "m").alias("b")).union(roots), "components")
    release(marked, core, leaves, roots)
    return out
