"""Connected components of a graph of names, without gathering any of it in one place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.sizing import lookup, release, saved, saved_with

#: A parent is hot when it has at least this share of all links; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
#: Rounds after which the search gives up; stars halve chains, so this is far beyond any chain that fits in a table.
MAX_ROUNDS = 60


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task reduced to (node, smallest node of its part): at most one row per node."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > 500_000:  # keeps the task small; later rounds join the parts
            yield _links(parent, root)
            parent.clear()
    if parent:
        yield _links(parent, root)


def _links(parent: dict[str, str], root) -> pa.RecordBatch:
    pairs = [(x, top) for x in list(parent) if (top := root(x)) != x]
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["c", "p"])


def _jumped(links: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Every link led to the least parent of its parent; hot parents are looked up by broadcast."""
    table = least.select(F.col("c").alias("p"), F.col("m").alias("up"))
    in_links = links.groupBy("p").agg(F.count("*").alias("n"))
    hot = in_links.filter(F.col("n") >= max(1000, int(total * HOT_SHARE))).select("p")
    hot_up = table.join(F.broadcast(hot), "p", "left_semi").withColumn("is_hot", F.lit(True))
    # Proven bound: at most 1 / HOT_SHARE parents are hot.
    first = links.join(F.broadcast(hot.join(hot_up, "p", "left").select("p", "up", F.lit(True).alias("is_hot"))), "p", "left")
    warm = first.filter("is_hot").select("c", "p", "up")
    cold = first.filter("is_hot is null").select("c", "p").join(table, "p", "left").select("c", "p", "up")
    return warm.unionByName(cold).select("c", F.coalesce("up", "p").alias("p"), F.col("up").isNotNull().alias("moved"))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node of a link; the component is named by its smallest node.

    Each task first reduces its own links to a forest, so a hot node reaches the shuffle
    once per task. Rounds of large-star (a node moves to its parent's least parent) and
    small-star (a node's other parents move to the least one) then join the forests; each
    round is a written table. Links with a null end are ignored, loops keep their node out.
    An empty table gives an empty result.
    """
    links = edges.select(F.col(a).cast("string").alias("c"), F.col(b).cast("string").alias("p"))
    links = links.filter("c is not null and p is not null and c != p")
    links = links.mapInArrow(_forest, "c string, p string").groupBy("c", "p").agg(F.lit(1).alias("one")).drop("one")
    links, figures = saved_with(links, n=F.count("*"))
    for _ in range(MAX_ROUNDS):
        least = links.groupBy("c").agg(F.min("p").alias("m"))
        jumped = saved(_jumped(links, least, figures["n"]).groupBy("c", "p").agg(F.max("moved").alias("moved")))
        release(links)
        parents = jumped.groupBy("c").agg(F.min("p").alias("m"), F.count("*").alias("n"), F.max("moved").alias("moved"))
        parents, settled = saved_with(parents, many=F.max("n"), moved=F.max("moved"))
        if not settled["moved"] and (settled["many"] or 0) <= 1:
            return jumped.select(F.col("c").alias("node"), F.col("p").alias("component")).unionByName(
                jumped.select(F.col("p").alias("node"), F.col("p").alias("component")).distinct()
            )
        several = parents.filter("n > 1").select("c", "m")
        rest = lookup(jumped.select("c", "p"), several, ["c"]).filter("p != m").select(F.col("p").alias("c"), F.col("m").alias("p"))
        links, figures = saved_with(parents.select("c", F.col("m").alias("p")).unionByName(rest).distinct(), n=F.count("*"))
        release(jumped, parents)
    raise RuntimeError("components did not settle")
