"""A property graph as two tables, nodes and edges, with merge semantics, expansion and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.components import connected_components

# The node labels and edge types of the graph schema, with the direction of each type.
NODE_LABELS = ["Technique", "SubTechnique", "Tactic", "Mitigation", "Group", "Malware", "Tool", "Campaign", "DetectionStrategy", "CAPECPattern", "CWE", "CVE", "Product", "Reference", "IDSLabel"]
EDGE_TYPES = ["HAS_TACTIC", "SUBTECHNIQUE_OF", "MITIGATED_BY", "DETECTED_BY", "USES_TECHNIQUE", "USES_TOOL", "USES_MALWARE", "ATTRIBUTED_TO", "CHILD_OF", "CAN_PRECEDE", "CAN_FOLLOW", "PEER_OF", "CAN_ALSO_BE", "RELATED_WEAKNESS", "MAPS_TO_ATTACK", "HAS_ATTACK_PATTERN", "HAS_WEAKNESS", "AFFECTS", "REFERENCES", "ASSOCIATED_CVE", "DETECTED_AS"]
TECHNIQUES = ["Technique", "SubTechnique"]


def merged(rows: DataFrame, keys: dict[str, Column], order: list[str], properties: list[str]) -> DataFrame:
    """One row for each key: of every property the last value that is not null, by ``order``.

    Rows with a null or blank key are left out.  Each property is one struct maximum, combined before the
    shuffle; equal orders are settled by the greater value.
    """
    keyed = rows.withColumns({f"_k_{n}": c for n, c in keys.items()})
    for n in keys:
        keyed = keyed.where((F.col(f"_k_{n}").isNotNull()) & (F.col(f"_k_{n}") != ""))
    last = [F.max(F.when(F.col(p).isNotNull(), F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(p).alias("v"))))["v"].alias(p) for p in properties if p not in keys]
    return keyed.groupBy(*[F.col(f"_k_{n}").alias(n) for n in keys]).agg(*last)


def matched(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The edges both of whose ends are nodes, with the ends' labels; others are dropped, as in a graph match."""
    ends = nodes.select(F.col("node_id"), F.col("label"))
    return edges.join(ends.withColumnsRenamed({"node_id": src, "label": "src_label"}), src).join(ends.withColumnsRenamed({"node_id": dst, "label": "dst_label"}), dst)


def counts_over(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """(value, n) for each value of a fixed list, 0 where there is none."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(v,) for v in values], "value string")
    found = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return dim.join(found, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def endpoints(edges: DataFrame) -> DataFrame:
    """(node_id, edge ends): one row for each end; a self-loop has one end."""
    return edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node_id"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, label, degree) of every node, 0 for isolated ones."""
    ends = endpoints(edges).groupBy("node_id").agg(F.count("*").alias("degree"))
    return nodes.select("node_id", "label").join(ends, "node_id", "left").select("node_id", "label", F.coalesce("degree", F.lit(0)).alias("degree"))


def top_degrees(nodes: DataFrame, edges: DataFrame, labels: list[str], k: int = 20) -> DataFrame:
    """(label, node_id, degree, rank): the k nodes of each label with the most edges, ties by id."""
    w = Window.partitionBy("label").orderBy(F.desc("degree"), "node_id")
    return degrees(nodes.where(F.col("label").isin(labels)), edges).withColumn("rank", F.row_number().over(w)).where(f"rank <= {int(k)}")


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density E / (N (N - 1)) and average degree 2 E / N; 0 for up to one node."""
    n, e = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    both = n.crossJoin(e)  # one row each
    return both.select("nodes", "edges", F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0).alias("density"), F.when(F.col("nodes") > 0, 2.0 * F.col("edges") / F.col("nodes")).otherwise(0.0).alias("average_degree"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges).distinct(), "node_id", "left_anti")


def component_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component): every node with the hash of its weakly connected component; isolated nodes are their own."""
    h = lambda c: F.xxhash64(F.col(c))
    comps = connected_components(edges.select(h("src").alias("u"), h("dst").alias("v")))
    return nodes.select("node_id", h("node_id").alias("node")).join(comps, "node", "left").select("node_id", F.coalesce("component", "node").alias("component"))


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(size, components): how many components there are of each size."""
    return component_of(nodes, edges).groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("components"))


def inverse(edges: DataFrame, kind: str, as_kind: str) -> DataFrame:
    """Inferred edges against the direction of those of ``kind``."""
    return edges.where(F.col("type") == kind).select(F.lit(as_kind).alias("type"), F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("inferred")).distinct()


def shared_bridge(left: DataFrame, right: DataFrame, as_kind: str) -> DataFrame:
    """Inferred edges between a of ``left`` (a, bridge) and b of ``right`` (b, bridge) that have a bridge in common.

    Both sides are made distinct first, and a pair that several bridges join comes out once.
    """
    pairs = left.distinct().join(right.distinct(), "bridge").where("a != b").select("a", "b").distinct()
    return pairs.select(F.lit(as_kind).alias("type"), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(True).alias("inferred"))


def neighbours(edges: DataFrame, nodes: DataFrame, kind: str, forward: bool = True, labels: list[str] | None = None) -> DataFrame:
    """(seed, node_id, label, name): one hop from every seed along, or against, the edges of a type."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    hop = edges.where(F.col("type") == kind).select(F.col(a).alias("seed"), F.col(b).alias("node_id"))
    far = nodes.where(F.col("label").isin(labels)) if labels else nodes
    return hop.join(far.select("node_id", "label", "name", "attack_id"), "node_id").select("seed", "node_id", "label", "name", "attack_id")


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; a self-loop counts once."""
    return edges.unionByName(edges.where("src != dst").withColumn("_s", F.col("src")).withColumn("src", F.col("dst")).withColumn("dst", F.col("_s")).drop("_s"))


def limited(df: DataFrame, by: list[str], order: list[Column | str], limit: Column | int) -> DataFrame:
    """The first rows of each group by an order that names every row; groups are cut before the shuffle where the limit is a number."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_n") <= limit).drop("_n")


def siblings(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seed, node_id): other techniques that share a tactic with a technique; each pair once."""
    tactic = edges.where("type = 'HAS_TACTIC'").select("src", F.col("dst").alias("tactic")).distinct()
    tech = nodes.where(F.col("label").isin(TECHNIQUES)).select(F.col("node_id").alias("src"))
    own = tactic.join(tech, "src", "left_semi")
    other = own.select(F.col("src").alias("node_id"), "tactic")
    return own.select(F.col("src").alias("seed"), "tactic").join(other, "tactic").where("seed != node_id").select("seed", "node_id").distinct()


def attack_chain(edges: DataFrame, nodes: DataFrame, limit: int = 5) -> DataFrame:
    """(seed, node_id, attack_id, rank, confidence): the next techniques of every technique, ``limit`` at most.

    Those that share a tactic come first into the list and keep rank 3 even if they are also sub-techniques or
    parents; sub-techniques and parents else have rank 1.  A technique id counts once; ordered by rank and id.
    """
    tech = nodes.where(F.col("label").isin(TECHNIQUES)).select("node_id", "attack_id").where("attack_id is not null")
    same = siblings(edges, nodes).withColumn("rank", F.lit(3))
    subs = undirected(edges.where("type = 'SUBTECHNIQUE_OF'").select("src", "dst")).select(F.col("src").alias("seed"), F.col("dst").alias("node_id")).distinct().where("seed != node_id").withColumn("rank", F.lit(1))
    both = same.unionByName(subs).groupBy("seed", "node_id").agg(F.max("rank").alias("rank"))
    named = both.join(tech, "node_id").join(tech.select(F.col("node_id").alias("seed"), F.col("attack_id").alias("seed_attack_id")), "seed").where("attack_id != seed_attack_id")
    once = named.groupBy("seed", "attack_id").agg(F.max("rank").alias("rank"), F.min("node_id").alias("node_id"))
    out = limited(once, ["seed"], ["rank", "attack_id"], limit)
    return out.select("seed", "node_id", "attack_id", "rank", F.when(F.col("rank") == 1, "medium").otherwise("low").alias("confidence"))


def expansion_counts(edges: DataFrame, nodes: DataFrame, branches: dict[str, tuple[str, bool, list[str]]]) -> DataFrame:
    """(node_id, one count for each branch): distinct neighbours of every technique.

    Every branch is counted by itself before the branches are joined, so they do not multiply each other.
    """
    out = nodes.where(F.col("label").isin(TECHNIQUES)).select("node_id")
    for name, (kind, forward, labels) in branches.items():
        one = neighbours(edges, nodes, kind, forward, labels).groupBy("seed").agg(F.countDistinct("node_id").alias(name))
        out = out.join(one.withColumnRenamed("seed", "node_id"), "node_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out
