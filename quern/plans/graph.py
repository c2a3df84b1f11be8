"""Queries over the threat-intelligence graph: merge, expansion, retrieval, statistics, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import graph as G
from quern.operators import retrieval as R
from quern.operators.references import canonical_id
from quern.session import cut, table

LABELS = ["Technique", "SubTechnique", "Tactic", "Mitigation", "Group", "Malware", "Tool", "Campaign", "DetectionStrategy", "CWE", "CVE"]


def nodes_of(spark: SparkSession, d: str) -> DataFrame:
    return G.merged(table(spark, d, "graph_nodes"), {"node_id": canonical_id("node_id", "CWE")}, ["ingested_at", "source_file"], ["label", "name", "attack_id"])


def edges_of(spark: SparkSession, d: str) -> DataFrame:
    rel = table(spark, d, "attack_relationships").withColumn("type", F.col("relationship_type"))
    keys = {"type": F.col("type"), "src": canonical_id("source_id"), "dst": canonical_id("target_id")}
    return G.merged(rel, keys, ["ingested_at", "edge_id"], ["edge_id", "confidence", "inferred"]).withColumn("inferred", F.coalesce("inferred", F.lit(False)))


def graph_edges_of(spark: SparkSession, d: str) -> DataFrame:
    """The edges whose ends are nodes."""
    return G.matched(edges_of(spark, d), nodes_of(spark, d))


def graph_nodes_merged(spark, d):
    return nodes_of(spark, d)


def graph_edges_merged(spark, d):
    return graph_edges_of(spark, d).select("type", "src", "dst", "src_label", "dst_label", "edge_id", "confidence", "inferred")


def graph_node_counts(spark, d):
    return G.counts_over(nodes_of(spark, d), "label", G.NODE_LABELS)


def graph_edge_counts(spark, d):
    return G.counts_over(graph_edges_of(spark, d), "type", G.EDGE_TYPES)


def graph_top_degrees(spark, d):
    return G.top_degrees(nodes_of(spark, d), graph_edges_of(spark, d), ["Technique", "SubTechnique", "Group", "CWE"], 20)


def graph_density(spark, d):
    return G.density(nodes_of(spark, d), graph_edges_of(spark, d)).select("nodes", "edges", F.round("density", 9).alias("density"), F.round("average_degree", 6).alias("average_degree"))


def graph_isolated(spark, d):
    return G.isolated(nodes_of(spark, d), graph_edges_of(spark, d)).select("node_id", "label")


def graph_component_sizes(spark, d):
    return G.component_sizes(nodes_of(spark, d), graph_edges_of(spark, d))


def graph_neighbours(spark, d):
    """Mitigations of every technique."""
    return G.neighbours(graph_edges_of(spark, d).select("type", "src", "dst"), nodes_of(spark, d), "MITIGATED_BY", True, ["Mitigation"])


def graph_inverse_edges(spark, d):
    return G.inverse(graph_edges_of(spark, d), "USES_TECHNIQUE", "USED_BY")


def _weaknesses(spark, d):
    pairs = table(spark, d, "capec_related_weakness").select(canonical_id("source_id", "CAPEC").alias("a"), canonical_id("target_id", "CWE").alias("bridge"))
    return pairs.where("a is not null and bridge is not null")


def graph_shared_weakness(spark, d):
    """Patterns tied by a weakness: what relates to it by an edge, and what lists it in its own record."""
    own = table(spark, d, "capec_patterns").select(canonical_id("capec_id", "CAPEC").alias("b"), F.explode("cwe_ids").alias("c")).select("b", canonical_id("c", "CWE").alias("bridge")).where("b is not null and bridge is not null")
    return G.shared_bridge(_weaknesses(spark, d), own, "SHARES_WEAKNESS").select("type", "src", "dst", "inferred")


def graph_siblings(spark, d):
    return G.siblings(graph_edges_of(spark, d), nodes_of(spark, d))


def graph_attack_chain(spark, d):
    return G.attack_chain(graph_edges_of(spark, d), nodes_of(spark, d))


def graph_expansion_counts(spark, d):
    branches = {"tactics": ("HAS_TACTIC", True, ["Tactic"]), "mitigations": ("MITIGATED_BY", True, ["Mitigation"]), "users": ("USES_TECHNIQUE", False, ["Group", "Tool", "Malware"]), "detections": ("DETECTED_BY", True, ["DetectionStrategy"])}
    return G.expansion_counts(graph_edges_of(spark, d).select("type", "src", "dst"), nodes_of(spark, d), branches)


def graph_resolution(spark, d):
    """For every technique whether a mitigation is known (an existence join)."""
    nodes, edges = nodes_of(spark, d), graph_edges_of(spark, d)
    has = edges.where("type = 'MITIGATED_BY'").select(F.col("src").alias("node_id")).distinct().withColumn("hit", F.lit(True))
    return nodes.where(F.col("label").isin(G.TECHNIQUES)).join(has, "node_id", "left").select("node_id", F.coalesce("hit", F.lit(False)).alias("resolved"))


def retrieval_entities(spark, d):
    return R.retrieved(graph_edges_of(spark, d), nodes_of(spark, d)).select("seed", "category", "position", "entity_id", "name", "rank_score", "distance", "relationship_type")


def retrieval_contexts_built(spark, d):
    """Contexts assembled for every technique, summed up by their sizes."""
    e, n = graph_edges_of(spark, d), nodes_of(spark, d)
    raw = cut(R.expansion(e, n))
    c = R.contexts(R.retrieved(e, n, raw=raw), raw)
    return c.select("seed", "nodes", "relationships", F.element_at("entities", 1)["entity_id"].alias("first_entity"), F.size(F.array_distinct(F.transform("entities", lambda x: x["category"]))).alias("categories"))


def retrieval_pattern_weaknesses(spark, d):
    """The second hop of the chain for every attack pattern: its weaknesses, within the hop's limit."""
    patterns = G.merged(table(spark, d, "capec_patterns"), {"node_id": canonical_id("capec_id", "CAPEC")}, ["ingested_at", "pattern_id"], ["name"])
    rel = table(spark, d, "capec_related_weakness").withColumn("type", F.lit("RELATED_WEAKNESS"))
    edges = G.merged(rel, {"type": F.col("type"), "src": canonical_id("source_id", "CAPEC"), "dst": canonical_id("target_id", "CWE")}, ["ingested_at", "edge_id"], ["edge_id", "confidence", "inferred"])
    starts = patterns.select(F.col("node_id").alias("seed"), "node_id")
    hop = R.chained(starts, "cwes", edges, R.told(nodes_of(spark, d)))
    return hop.select("seed", "entity_id", "name", "distance", F.coalesce("confidence", F.lit("")).alias("confidence"), "origin")


def graph_label_summary(spark, d):
    """For every technique the ids of what one hop reaches, and whether any of the edges is inferred."""
    e = graph_edges_of(spark, d).where(F.col("src_label").isin(G.TECHNIQUES))
    per = e.groupBy(F.col("src").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("ids"), F.bool_or("inferred").alias("has_inferred_edges"))
    return per.withColumn("provenance_type", F.when(F.col("has_inferred_edges"), "inferred").otherwise("source"))


def retrieval_stats(spark, d):
    """Latency and size of stored contexts."""
    from quern.operators.nested import context_tables

    return context_tables(table(spark, d, "retrieval_contexts"))["contexts"].groupBy("prediction").agg(F.count("*").alias("contexts"), F.round(F.avg("latency_ms"), 3).alias("mean_latency_ms"), F.max("latency_ms").alias("max_latency_ms"), F.sum("relationships_traversed").alias("relationships"))


_RAW = r"regexp_replace({0}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"


def _id(col: str, family: str = "") -> str:
    raw = _RAW.format(col)
    number = f"when regexp_matches({raw}, '^[0-9]+$') then '{family}-' || {raw}" if family else ""
    return f"case when {raw} = '' then null {number} when regexp_matches(lower({raw}), '^(capec|cwe)-') then upper({raw}) else lower({raw}) end"


def _last(p: str, order: str) -> str:
    return f"arg_max({p}, {order}) filter ({p} is not null) {p}"


_N = f"""nodes as (select {_id("node_id", "CWE")} node_id, {", ".join(_last(p, "(ingested_at, source_file, " + p + ")") for p in ("label", "name", "attack_id"))} from graph_nodes group by 1 having {_id("node_id", "CWE")} is not null)"""
_E = f"""raw_edges as (select relationship_type "type", {_id("source_id")} src, {_id("target_id")} dst, {_last("edge_id", "(ingested_at, edge_id)")}, {_last("confidence", "(ingested_at, edge_id, confidence)")}, coalesce(arg_max(inferred, (ingested_at, edge_id, inferred)) filter (inferred is not null), false) inferred from attack_relationships group by 1, 2, 3),
edges as (select e.*, a.label src_label, b.label dst_label from raw_edges e join nodes a on a.node_id = e.src join nodes b on b.node_id = e.dst)"""
_G = f"with recursive {_N}, {_E} "
_TECH = "('Technique', 'SubTechnique')"


def _zero(values: list[str], rows: str) -> str:
    dim = ", ".join(f"('{v}')" for v in values)
    return f"select d.value, coalesce(c.n, 0) n from (values {dim}) d(value) left join ({rows}) c using (value)"


def _near(category: str, kind: str, forward: bool, label: str, order: str) -> str:
    a, b = ("src", "dst") if forward else ("dst", "src")
    limit = R.HOP_LIMITS.get(category, 10**9)
    entity = "coalesce(attack_id, node_id)" if category in ("tactics", "mitigations") else "node_id"
    return f"""select seed, '{category}' category, {entity} entity_id, name, 2 distance, '{kind}' relationship_type, confidence, inferred, edge_id origin from (
  select e.{a} seed, n.node_id, n.name, n.attack_id, e.confidence, e.inferred, e.edge_id, row_number() over (partition by e.{a} order by n.{order} nulls first, n.node_id, e.edge_id) k
  from edges e join nodes n on n.node_id = e.{b} where e."type" = '{kind}' and n.label = '{label}' and e.{a} in (select node_id from nodes where label in {_TECH})) where k <= {limit}"""


_RET = _G + ", raw_ as (" + " union all ".join(_near(c, *v) for c, v in R.ONE_HOP.items()) + f"""),
scored as (select *, round(1 - 0.24 + coalesce({{'high': 1.0, 'medium': 0.7, 'low': 0.35, 'source': 0.95}}[lower(coalesce(confidence, ''))], 0.5) + case when inferred then -0.25 else 0 end, 6)::double rank_score from raw_),
once as (select * from (select *, row_number() over (partition by seed, category, entity_id order by rank_score desc, distance, origin) k from scored) where k = 1),
placed as (select *, row_number() over (partition by seed, category order by rank_score desc, distance, entity_id) "position" from once),
kept as (select * from placed where "position" <= {{{", ".join(f"'{k}': {v}" for k, v in R.CATEGORY_LIMITS.items())}}}[category])
"""
_RET = _RET.replace("{'high'", "map {'high'").replace("{'tactics'", "map {'tactics'")
_SIB = "siblings as (select distinct a.src seed, b.src node_id from edges a join edges b on a.dst = b.dst where a.\"type\" = 'HAS_TACTIC' and b.\"type\" = 'HAS_TACTIC' and a.src <> b.src and a.src_label in " + _TECH + " and b.src_label in " + _TECH + ")"
QUERIES = {f.__name__: f for f in (graph_nodes_merged, graph_edges_merged, graph_node_counts, graph_edge_counts, graph_top_degrees, graph_density, graph_isolated, graph_component_sizes, graph_neighbours, graph_inverse_edges, graph_shared_weakness, graph_siblings, graph_attack_chain, graph_expansion_counts, graph_resolution, retrieval_entities, retrieval_contexts_built, retrieval_pattern_weaknesses, graph_label_summary, retrieval_stats)}
SQL = {
    "graph_nodes_merged": _G + "select node_id, label, name, attack_id from nodes",
    "graph_edges_merged": _G + 'select "type", src, dst, src_label, dst_label, edge_id, confidence, inferred from edges',
    "graph_node_counts": _G + _zero(G.NODE_LABELS, "select label as value, count(*) n from nodes group by 1"),
    "graph_edge_counts": _G + _zero(G.EDGE_TYPES, 'select "type" as value, count(*) n from edges group by 1'),
    "graph_top_degrees": _G + ", ends as (select src node_id from edges union all select dst from edges where src <> dst), deg as (select label, n.node_id, count(e.node_id) degree from nodes n left join ends e using (node_id) where label in ('Technique', 'SubTechnique', 'Group', 'CWE') group by 1, 2) select * from (select *, row_number() over (partition by label order by degree desc, node_id) as \"rank\" from deg) where \"rank\" <= 20",
    "graph_density": _G + "select n as nodes, e as edges, round(e / (n * (n - 1)), 9) density, round(2.0 * e / n, 6) average_degree from (select (select count(*) from nodes) n, (select count(*) from edges) e)",
    "graph_isolated": _G + "select node_id, label from nodes where node_id not in (select src from edges union select dst from edges)",
    "graph_component_sizes": _G + ", both_ as (select src u, dst v from edges union select dst, src from edges), reach as (select node_id node, node_id root from nodes union select b.v, r.root from reach r join both_ b on b.u = r.node), comp as (select node, min(root) root from reach group by 1), s as (select root, count(*) as \"size\" from comp group by 1) select \"size\", count(*) components from s group by 1",
    "graph_neighbours": _G + "select e.src seed, n.node_id, n.label, n.name, n.attack_id from edges e join nodes n on n.node_id = e.dst where \"type\" = 'MITIGATED_BY' and n.label = 'Mitigation'",
    "graph_inverse_edges": _G + "select distinct 'USED_BY' as \"type\", dst src, src dst, true inferred from edges where \"type\" = 'USES_TECHNIQUE'",
    "graph_shared_weakness": f"""with l as (select distinct {_id("source_id", "CAPEC")} a, {_id("target_id", "CWE")} bridge from capec_related_weakness), r as (select distinct {_id("capec_id", "CAPEC")} b, {_id("c", "CWE")} bridge from (select capec_id, unnest(cwe_ids) c from capec_patterns)) select distinct 'SHARES_WEAKNESS' as "type", a src, b dst, true inferred from l join r using (bridge) where a <> b""",
    "graph_siblings": _G + ", " + _SIB + " select * from siblings",
    "graph_attack_chain": _G + ", " + _SIB + f""", cand as (select seed, node_id, 3 as "rank" from siblings union all select src, dst, 1 from edges where "type" = 'SUBTECHNIQUE_OF' and src <> dst union all select dst, src, 1 from edges where "type" = 'SUBTECHNIQUE_OF' and src <> dst),
best as (select seed, node_id, max("rank") as "rank" from cand group by 1, 2),
named as (select b.seed, t.attack_id, max("rank") as "rank", min(b.node_id) node_id from best b join nodes t on t.node_id = b.node_id and t.label in {_TECH} join nodes s on s.node_id = b.seed and s.label in {_TECH} where t.attack_id <> s.attack_id group by 1, 2)
select seed, node_id, attack_id, "rank", case when "rank" = 1 then 'medium' else 'low' end confidence from (select *, row_number() over (partition by seed order by "rank", attack_id) k from named) where k <= 5""",
    "graph_expansion_counts": _G + f"""select n.node_id, (select count(distinct dst) from edges e where e.src = n.node_id and "type" = 'HAS_TACTIC' and dst_label = 'Tactic') tactics, (select count(distinct dst) from edges e where e.src = n.node_id and "type" = 'MITIGATED_BY' and dst_label = 'Mitigation') mitigations, (select count(distinct src) from edges e where e.dst = n.node_id and "type" = 'USES_TECHNIQUE' and src_label in ('Group', 'Tool', 'Malware')) users, (select count(distinct dst) from edges e where e.src = n.node_id and "type" = 'DETECTED_BY' and dst_label = 'DetectionStrategy') detections from nodes n where label in {_TECH}""",
    "graph_resolution": _G + f"""select node_id, exists (select 1 from edges e where e.src = n.node_id and "type" = 'MITIGATED_BY') resolved from nodes n where label in {_TECH}""",
    "retrieval_entities": _RET + 'select seed, category, "position", entity_id, name, rank_score, distance, relationship_type from kept',
    "retrieval_pattern_weaknesses": f"""with {_N}, p as (select distinct {_id("capec_id", "CAPEC")} src from capec_patterns),
e as (select {_id("source_id", "CAPEC")} src, {_id("target_id", "CWE")} dst, {_last("edge_id", "(ingested_at, edge_id)")}, {_last("confidence", "(ingested_at, edge_id, confidence)")} from capec_related_weakness group by 1, 2)
select seed, entity_id, name, distance, confidence, origin from (select src seed, node_id entity_id, name, 3 distance, coalesce(confidence, '') confidence, edge_id origin, row_number() over (partition by src order by node_id, edge_id) k from e join p using (src) join nodes on node_id = dst and label = 'CWE') where k <= 20""",
    "graph_label_summary": _G + f"""select src node_id, array_to_string(list_sort(list(distinct dst)), ',') ids, bool_or(inferred) has_inferred_edges, case when bool_or(inferred) then 'inferred' else 'source' end provenance_type from edges where src_label in {_TECH} group by 1""",
    "retrieval_contexts_built": _RET + """select seed, count(*) nodes, any_value(r.n) relationships, arg_min(entity_id, (category, "position")) first_entity, count(distinct category)::int categories from kept join (select seed, count(*) n from raw_ group by 1) r using (seed) group by 1""",
}
