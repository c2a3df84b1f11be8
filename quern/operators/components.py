"""Connected components by local union-find and contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut

#: Edges that one task resolves at once; a level with no more is the last.
LAST = 100_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition -> (node, root): every node with the smallest node of its local tree."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent[root]) != root:
            root = up
        while (up := parent[x]) != root:
            parent[x] = root
            x = up
        return root

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a = find(u) if u in parent else parent.setdefault(u, u)
            b = find(v) if v in parent else parent.setdefault(v, v)
            if a < b:
                parent[b] = a
            elif b < a:
                parent[a] = b
    nodes = list(parent)
    for lo in range(0, len(nodes), 20_000):
        part = nodes[lo : lo + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["node", "root"])


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", last: int = LAST) -> DataFrame:
    """(node, component): every node of the undirected ``edges`` (long ids) with the smallest node of its component.

    Each level runs union-find within the partitions and then merges the local trees: a node that is in several
    trees ties their roots together, and those ties are the edges of the next, smaller level.  A node meets at
    most one root per partition, so no group grows with a component; the components themselves are never
    gathered.  Edges with a null end are left out; self-loops and repeated edges do no harm.
    """
    level = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null")
    level = cut(level.distinct())
    maps: list[DataFrame] = []
    while True:
        count = level.count()
        if count <= last:
            final = level.repartition(1).mapInArrow(_forest, "node long, root long")
            break
        trees = level.mapInArrow(_forest, "node long, root long")
        met = cut(trees.groupBy("node").agg(F.min("root").alias("low"), F.collect_set("root").alias("roots")))
        maps.append(met.select("node", F.col("low").alias("root")))
        level = cut(met.where("size(roots) > 1").select(F.explode("roots").alias("u"), F.col("low").alias("v")).where("u != v").distinct())
    out = final
    for lower in reversed(maps):
        # roots that met nothing else are their own components
        out = lower.join(out.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return out.select("node", F.col("root").alias("component"))
