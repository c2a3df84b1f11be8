"""Queries of problem 7: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.operators.references import Reference, canonical_id, lifetimes, orphan_counts, orphan_references
from quern.session import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references of the three referring tables."""
    patterns, weak, rel = (table(spark, sf_dir, t) for t in ("capec_patterns", "capec_related_weakness", "attack_relationships"))
    refs = [
        Reference("capec_related_weakness", weak, "edge_id", "source_id", "capec", "CAPEC"),
        Reference("capec_related_weakness", weak, "edge_id", "target_id", "node", "CWE"),
        Reference("attack_relationships", rel, "edge_id", "source_id", "node"),
        Reference("attack_relationships", rel, "edge_id", "target_id", "node"),
        Reference("capec_patterns", patterns, "pattern_id", "cwe_ids", "node", "CWE"),
    ]
    parents = {
        "capec": lifetimes(patterns, canonical_id("capec_id", "CAPEC")),
        "node": lifetimes(table(spark, sf_dir, "graph_nodes"), canonical_id("node_id", "CWE")),
    }
    return orphan_references(refs, parents)


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(p7_found(spark, sf_dir))


def _canonical(col: str, family: str = "") -> str:
    raw = rf"regexp_replace({col}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"
    number = f"when regexp_matches({raw}, '^[0-9]+$') then '{family}-' || {raw}" if family else ""
    return f"case when {raw} = '' then null {number} when regexp_matches(lower({raw}), '^(capec|cwe)-') then upper({raw}) else lower({raw}) end"


_FOUND = f"""
with refs as (
  select 'capec_related_weakness' tbl, edge_id row_key, 'source_id' field, {_canonical("source_id", "CAPEC")} ref_id, ingested_at seen_at, 'capec' parent from capec_related_weakness
  union all select 'capec_related_weakness', edge_id, 'target_id', {_canonical("target_id", "CWE")}, ingested_at, 'node' from capec_related_weakness
  union all select 'attack_relationships', edge_id, 'source_id', {_canonical("source_id")}, ingested_at, 'node' from attack_relationships
  union all select 'attack_relationships', edge_id, 'target_id', {_canonical("target_id")}, ingested_at, 'node' from attack_relationships
  union all select 'capec_patterns', pattern_id, 'cwe_ids', {_canonical("c", "CWE")}, ingested_at, 'node' from (select pattern_id, ingested_at, unnest(cwe_ids) c from capec_patterns)
), parents as (
  select 'capec' parent, {_canonical("capec_id", "CAPEC")} ref_id, min(ingested_at) born, min(revoked_at) ended from capec_patterns group by all
  union all select 'node', {_canonical("node_id", "CWE")}, min(ingested_at), min(revoked_at) from graph_nodes group by all
), found as (
  select distinct tbl, strftime(seen_at, '%Y-%m') as period, row_key, field, r.ref_id,
    case when p.ref_id is null then 'missing' when seen_at < born then 'late' when seen_at >= ended then 'deleted' end reason
  from refs r left join parents p using (parent, ref_id) where r.ref_id is not null
)
"""
SQL = {
    "p7_found": _FOUND + "select * from found where reason is not null",
    "p7_counts": _FOUND + "select tbl, period, field, reason, count(*) orphans, count(distinct ref_id) distinct_refs from found where reason is not null group by all",
}
QUERIES = {"p7_found": p7_found, "p7_counts": p7_counts}
