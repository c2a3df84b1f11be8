"""Ranked multi-hop retrieval for all seeds at once: expansion, scores, limits, contexts with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.graph import TECHNIQUES, limited, neighbours

# Weights of the ranking, limits of expansion hops and of categories in a context.
SEVERITY_WEIGHT = {"CRITICAL": 1.0, "HIGH": 0.8, "MEDIUM": 0.5, "LOW": 0.2, "UNSCORED": 0.0}
QUALITATIVE_WEIGHT = {"Very High": 1.0, "High": 0.8, "Medium": 0.5, "Low": 0.2, "Very Low": 0.1, "": 0.0}
CONFIDENCE_WEIGHT = {"high": 1.0, "medium": 0.7, "low": 0.35, "source": 0.95}
UNKNOWN_CONFIDENCE = 0.5
DISTANCE_STEP, ALL_INFERRED, SOME_INFERRED = 0.12, -0.25, -0.1
HOP_LIMITS = {"mitigations": 10, "groups": 10, "tools": 10, "malware": 10, "detection_guidance": 10, "capec": 10, "cwes": 20, "cves": 20, "products": 20, "references": 20}
CATEGORY_LIMITS = {"tactics": 5, "mitigations": 8, "groups": 8, "tools": 8, "malware": 8, "detection_guidance": 5, "capec": 8, "cwes": 12, "cves": 10, "products": 10, "references": 10}
# Category -> (edge type, along the edge, label, order of the hop).
ONE_HOP = {
    "tactics": ("HAS_TACTIC", True, "Tactic", "attack_id"),
    "mitigations": ("MITIGATED_BY", True, "Mitigation", "attack_id"),
    "groups": ("USES_TECHNIQUE", False, "Group", "name"),
    "tools": ("USES_TECHNIQUE", False, "Tool", "name"),
    "malware": ("USES_TECHNIQUE", False, "Malware", "name"),
    "detection_guidance": ("DETECTED_BY", True, "DetectionStrategy", "name"),
}
# Category -> (category it starts from, edge type, label, distance), along the edges from a technique on.
CHAIN = {
    "capec": ("technique", "HAS_ATTACK_PATTERN", "CAPECPattern", 2),
    "cwes": ("capec", "RELATED_WEAKNESS", "CWE", 3),
    "cves": ("capec", "ASSOCIATED_CVE", "CVE", 4),
    "products": ("cves", "AFFECTS", "Product", 5),
    "references": ("cves", "REFERENCES", "Reference", 5),
}
#: What nodes may tell besides node_id, label, name and attack_id; null where a table has no such column.
TOLD = {"severity": "string", "likelihood": "string", "base_score": "double"}


def weight(table: dict[str, float], col: Column, other: float) -> Column:
    m = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(m, col), F.lit(other))


def relation_score(confidence: Column, inferred: Column, distance: Column) -> Column:
    """The score of an entity reached over one relation."""
    return F.round(F.greatest(F.lit(0.0), 1 - distance * DISTANCE_STEP) + weight(CONFIDENCE_WEIGHT, F.lower(F.coalesce(confidence, F.lit(""))), UNKNOWN_CONFIDENCE) + F.when(inferred, ALL_INFERRED).otherwise(0.0), 6)


def provenance_score(provenance: Column, distance: Column) -> Column:
    """The score of an entity from its provenance, an array of structs with confidence and inferred.

    The best confidence counts; that all entries are inferred costs more than that some are.  No provenance
    scores 0 for confidence.
    """
    best = F.array_max(F.transform(provenance, lambda p: weight(CONFIDENCE_WEIGHT, F.lower(F.coalesce(p["confidence"], F.lit(""))), UNKNOWN_CONFIDENCE)))
    inferred = lambda p: F.coalesce(p["inferred"], F.lit(False))
    penalty = F.when(F.size(provenance) < 1, 0.0).when(F.forall(provenance, inferred), ALL_INFERRED).when(F.exists(provenance, inferred), SOME_INFERRED).otherwise(0.0)
    return F.greatest(F.lit(0.0), 1 - distance * DISTANCE_STEP) + F.coalesce(best, F.lit(0.0)) + penalty


def vulnerability_score(severity: Column, base_score: Column) -> Column:
    return weight(SEVERITY_WEIGHT, severity, 0.0) + F.when(base_score.isNotNull(), F.least(base_score / 10.0, F.lit(1.0))).otherwise(0.0)


def pattern_score(likelihood: Column, severity: Column) -> Column:
    return weight(QUALITATIVE_WEIGHT, likelihood, 0.0) + weight(QUALITATIVE_WEIGHT, severity, 0.0)


def ranked(entities: DataFrame, by: list[str], limits: dict[str, int] | None = None) -> DataFrame:
    """Entities (.., category, entity_id, rank_score, distance) once each, best score first, cut by category.

    Of duplicates the best scored stays, with its own provenance; of equals the nearest.  Ordered by score,
    distance and id.
    """
    best = Window.partitionBy(*by, "category", "entity_id").orderBy(F.desc("rank_score"), "distance", "origin")
    once = entities.withColumn("_d", F.row_number().over(best)).where("_d = 1").drop("_d")
    order = Window.partitionBy(*by, "category").orderBy(F.desc("rank_score"), "distance", "entity_id")
    placed = once.withColumn("position", F.row_number().over(order))
    if limits:
        top = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
        placed = placed.where(F.col("position") <= F.coalesce(F.try_element_at(top, F.col("category")), F.lit(2**31 - 1)))
    return placed


def told(nodes: DataFrame) -> DataFrame:
    """``nodes`` with all columns of TOLD."""
    return nodes.select("node_id", "label", "name", "attack_id", *[(F.col(c) if c in nodes.columns else F.lit(None)).cast(kind).alias(c) for c, kind in TOLD.items()])


def label_seeds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(label, seed): for each IDS label the technique it is detected as, the first by its id where there are several."""
    labels = nodes.where("label = 'IDSLabel'").select(F.col("node_id").alias("src"), F.col("name").alias("prediction"))
    tech = nodes.where(F.col("label").isin(TECHNIQUES)).select(F.col("node_id").alias("dst"), F.struct("attack_id", "node_id").alias("_t"))
    found = edges.where("type = 'DETECTED_AS'").select("src", "dst").join(labels, "src").join(tech, "dst")
    return found.groupBy(F.coalesce("prediction", "src").alias("label")).agg(F.min("_t")["node_id"].alias("seed"))


def _columns(category, kind, distance) -> list:
    """The columns of an expansion; some kinds of nodes are known by their public ids."""
    entity = F.when(F.col("label").isin("Tactic", "Mitigation"), F.coalesce("attack_id", "node_id")).otherwise(F.col("node_id"))
    return ["seed", category.alias("category"), entity.alias("entity_id"), "name", distance.cast("int").alias("distance"), kind.alias("relationship_type"), "confidence", "inferred", F.col("edge_id").alias("origin"), *TOLD, "node_id"]


def _near(edges: DataFrame, nodes: DataFrame, limits: dict[str, int]) -> DataFrame:
    """All categories of ONE_HOP in one pass: edges meet their far ends once and are told apart by type and label."""
    tech = nodes.where(F.col("label").isin(TECHNIQUES)).select(F.col("node_id").alias("seed"))
    ahead, back = (sorted({v[0] for v in ONE_HOP.values() if v[1] == way}) for way in (True, False))
    ends = F.filter(F.array(F.when(F.col("type").isin(ahead), F.struct(F.col("src").alias("seed"), F.col("dst").alias("node_id"))), F.when(F.col("type").isin(back), F.struct(F.col("dst").alias("seed"), F.col("src").alias("node_id")))), lambda e: e.isNotNull())
    hop = edges.where(F.col("type").isin(ahead + back)).select(F.explode(ends).alias("e"), "type", "edge_id", "confidence", "inferred").select("e.*", "type", "edge_id", "confidence", "inferred").join(tech, "seed", "left_semi")
    far = hop.join(nodes, "node_id")
    category, order = F.lit(None).cast("string"), F.col("name")
    for name, (kind, _, label, by) in ONE_HOP.items():
        mine = (F.col("type") == kind) & (F.col("label") == label)
        category, order = F.when(mine, F.lit(name)).otherwise(category), F.when(mine, F.col(by)).otherwise(order)
    far = far.withColumns({"category": category, "_by": order}).where("category is not null")
    top = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    kept = limited(far, ["seed", "category"], ["_by", "node_id", "edge_id"], F.coalesce(F.try_element_at(top, F.col("category")), F.lit(2**31 - 1)))
    return kept.select(*_columns(F.col("category"), F.col("type"), F.lit(2)))


def chained(starts: DataFrame, category: str, edges: DataFrame, nodes: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """One hop of CHAIN from ``starts`` (seed, node_id), cut to the hop's limit for each seed.

    The rows cut are distinct (node, edge) rows: a node that two starts lead to counts twice.  CVEs come in the
    order of their base score, the highest first, a missing one as 0; all else by name or id.
    """
    _, kind, label, distance = CHAIN[category]
    hop = edges.where(F.col("type") == kind).select(F.col("src").alias("_start"), F.col("dst").alias("node_id"), "edge_id", "confidence", "inferred")
    far = starts.select("seed", F.col("node_id").alias("_start")).distinct().join(hop, "_start").join(nodes.where(F.col("label") == label), "node_id")
    order = [F.desc(F.coalesce("base_score", F.lit(0.0))), "node_id"] if category == "cves" else ["name", "node_id"] if category in ("products", "references") else ["node_id"]
    limit = (limits or HOP_LIMITS).get(category, 2**31 - 1)
    return limited(far, ["seed"], [*order, "_start", "edge_id"], limit).select(*_columns(F.lit(category), F.lit(kind), F.lit(distance)))


def expansion(edges: DataFrame, nodes: DataFrame, hop_limits: dict[str, int] | None = None) -> DataFrame:
    """(seed, category, entity_id, name, distance, relationship_type, confidence, inferred, origin, ..) for all techniques.

    First the neighbours of ONE_HOP, then the hops of CHAIN: patterns, from the patterns kept their weaknesses and
    vulnerabilities, from the vulnerabilities kept products and references.  Each hop's limit cuts the distinct
    (node, relation) rows in the hop's order, before duplicates of an entity are dropped, so duplicates use it up.
    ``edges`` have type, src, dst, edge_id, confidence and inferred; ``nodes`` see ``told``.  A seed without
    neighbours has no rows.
    """
    limits, nodes = hop_limits or HOP_LIMITS, told(nodes)
    reached = {"technique": nodes.where(F.col("label").isin(TECHNIQUES)).select(F.col("node_id").alias("seed"), "node_id")}
    out = _near(edges, nodes, limits)
    for category, (start, *_) in CHAIN.items():
        reached[category] = chained(reached[start], category, edges, nodes, limits)
        out = out.unionByName(reached[category])
    return out.drop("node_id")


def retrieved(edges: DataFrame, nodes: DataFrame, limits: dict[str, int] | None = None, raw: DataFrame | None = None) -> DataFrame:
    """The ranked entities of every technique, within hop and category limits.

    Vulnerabilities score by severity and base score besides, patterns by likelihood and severity.  ``raw`` is the
    ``expansion``, if it is at hand.
    """
    own = F.when(F.col("category") == "cves", vulnerability_score(F.col("severity"), F.col("base_score"))).when(F.col("category") == "capec", pattern_score(F.col("likelihood"), F.col("severity"))).otherwise(0.0)
    raw = expansion(edges, nodes) if raw is None else raw
    scored = raw.withColumn("rank_score", F.round(relation_score(F.col("confidence"), F.col("inferred"), F.col("distance")) + own, 6))
    return ranked(scored, ["seed"], limits or CATEGORY_LIMITS)


def contexts(entities: DataFrame, raw: DataFrame) -> DataFrame:
    """(seed, nodes, relationships, entities, provenance): one nested context for each seed.

    ``entities`` are the ranked ones; the provenance is flattened from all retrieved rows, before categories are
    cut.  Lists are as long as the limits allow.
    """
    kept = entities.groupBy("seed").agg(F.count("*").alias("nodes"), F.array_sort(F.collect_list(F.struct("category", "position", "entity_id", "name", "rank_score", "distance"))).alias("entities"))
    prov = raw.groupBy("seed").agg(F.count("*").alias("relationships"), F.array_sort(F.collect_list(F.struct("category", "entity_id", "relationship_type", "origin", F.coalesce("confidence", F.lit("")).alias("confidence"), "inferred"))).alias("provenance"))
    return kept.join(prov, "seed")


def context_problems(ctx: DataFrame, technique: str, lists: list[str]) -> DataFrame:
    """``ctx`` with ``problems``: no technique, no provenance, or an id twice in one of the entity lists."""
    twice = [F.when(F.size(F.transform(c, lambda x: x["id"])) != F.size(F.array_distinct(F.transform(c, lambda x: x["id"]))), F.lit(f"duplicate ids in {c}")) for c in lists]
    return ctx.withColumn("problems", F.array_compact(F.array(F.when(F.col(technique).isNull(), F.lit("missing technique")), F.when(F.size("provenance") < 1, F.lit("missing provenance")), *twice)))


__all__ = ["chained", "contexts", "expansion", "label_seeds", "neighbours", "ranked", "retrieved"]
