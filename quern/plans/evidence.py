"""Queries over evidence: completeness, depth, patterns, sources, rows that need a second look."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import cleaning as C
from quern.operators import evidence as E
from quern.operators.references import canonical_id
from quern.session import table

LIST_KEYS = ["support", "evidence", "queries", "detections"]
_CVE = r"CVE-\d{4}-\d{4,}"


def reasoning_depths(spark, d):
    t = table(spark, d, "corpus_records").select("record_id", "output").distinct()
    return t.groupBy(E.reasoning_depth(F.col("output"), LIST_KEYS).alias("depth")).agg(F.count("*").alias("records"))


def severity_levels(spark, d):
    """Lines as flows: a score from 0 to 10 and a confidence."""
    t = table(spark, d, "lineitem")
    return t.groupBy(E.severity_level(F.col("l_quantity") / 5, F.col("l_discount") * 10).alias("severity")).agg(F.count("*").alias("rows"))


def evidence_contexts(spark, d):
    """Every attack pattern with its own and its related weaknesses, and what is missing."""
    own = table(spark, d, "capec_patterns").select(canonical_id("capec_id", "CAPEC").alias("capec_id"), F.explode_outer("cwe_ids").alias("c")).where("capec_id is not null")
    own = own.groupBy("capec_id").agg(F.array_sort(F.collect_set(canonical_id("c", "CWE"))).alias("cwe_ids"))
    rel = table(spark, d, "capec_related_weakness").select(canonical_id("source_id", "CAPEC").alias("capec_id"), canonical_id("target_id", "CWE").alias("c"), F.coalesce("inferred", F.lit(False)).alias("inferred"))
    rel = rel.where("capec_id is not null").groupBy("capec_id").agg(F.array_sort(F.collect_set("c")).alias("related"), F.bool_or("inferred").alias("has_inferred_edges"))
    both = E.completeness(own.join(rel, "capec_id", "left"), {"has_cwe": "cwe_ids", "has_related": "related"})
    return both.select("capec_id", F.array_join("cwe_ids", ",").alias("cwe_ids"), F.coalesce(F.array_join("related", ","), F.lit("")).alias("related"), F.coalesce("has_inferred_edges", F.lit(False)).alias("has_inferred_edges"), "has_cwe", "has_related", F.array_join("gaps", ",").alias("gaps"))


def pattern_variety(spark, d):
    return E.distinct_patterns(table(spark, d, "capec_patterns"), ["severity"], "cwe_ids", 2)


def patterns_repeated(spark, d):
    return E.repeated_patterns(table(spark, d, "capec_patterns"), "cwe_ids", 1, 2)


def sources_concentrated(spark, d):
    return E.concentrated(table(spark, d, "documents"), "source", 0.2)


def risky_rows(spark, d):
    t = table(spark, d, "gold_records").select("record_id", "task_type", "model_confidence", "output").distinct()
    return t.where(E.risky(C.confidence_band("model_confidence", 0.9, 0.6), F.col("output").rlike(_CVE), F.col("task_type"))).select("record_id", "task_type")


def flat_rows(spark, d):
    """Records as flat rows with a summary and the number of their gaps."""
    t = table(spark, d, "gold_records").drop("loaded_at").distinct()
    parts = ["ids_label", "task_type", "difficulty", "source_file"]
    return t.select("record_id", F.concat_ws(" | ", *parts).alias("summary"), sum(F.col(c).isNull().cast("int") for c in parts).alias("gaps"), E.flat_cell(F.col("output"), 200).alias("output"))


def approved_splits(spark, d):
    """The records by split whose label has an approved record in the corpus (a semi-join)."""
    ok = table(spark, d, "corpus_records").where("lower(trim(review_status)) = 'approved'").select("ids_label").distinct()
    g = table(spark, d, "gold_records").drop("loaded_at").distinct().join(ok, "ids_label", "left_semi")
    return g.groupBy(F.lower(F.trim("split")).alias("split")).agg(F.count("*").alias("records"))


QUERIES = {f.__name__: f for f in (reasoning_depths, severity_levels, evidence_contexts, pattern_variety, patterns_repeated, sources_concentrated, risky_rows, flat_rows, approved_splits)}


def _id(col: str, family: str) -> str:
    raw = rf"regexp_replace({col}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"
    return f"case when {raw} = '' then null when regexp_matches({raw}, '^[0-9]+$') then '{family}-' || {raw} when regexp_matches(lower({raw}), '^(capec|cwe)-') then upper({raw}) else lower({raw}) end"


_DEPTH = ", ".join(f"case when json_valid(output) and json_type(output, '$.{k}') = 'ARRAY' then json_array_length(output, '$.{k}') end" for k in LIST_KEYS)
_MARKS = " + ".join(f"contains(lower(coalesce(output, '')), '{m}')::int" for m in E.MARKERS)
_RISKY = ", ".join(f"'{t}'" for t in E.RISKY_TASKS)
SQL = {
    "reasoning_depths": f"select coalesce({_DEPTH}, {_MARKS})::int depth, count(*) records from (select distinct record_id, output from corpus_records) group by 1",
    "severity_levels": "select case when l_quantity / 5 >= 9 then 'critical' when l_quantity / 5 >= 7 or l_discount * 10 >= 0.9 then 'high' when l_discount * 10 >= 0.6 then 'medium' else 'low' end severity, count(*) as \"rows\" from lineitem group by 1",
    "evidence_contexts": f"""with own as (select capec_id, coalesce(list_sort(list(distinct c) filter (c is not null)), []) cwe_ids from (select {_id("capec_id", "CAPEC")} capec_id, {_id("c", "CWE")} c from (select capec_id, c from capec_patterns left join unnest(cwe_ids) u(c) on true)) where capec_id is not null group by 1),
rel as (select {_id("source_id", "CAPEC")} capec_id, coalesce(list_sort(list(distinct {_id("target_id", "CWE")}) filter ({_id("target_id", "CWE")} is not null)), []) related, bool_or(coalesce(inferred, false)) i from capec_related_weakness group by 1)
select capec_id, array_to_string(cwe_ids, ',') cwe_ids, coalesce(array_to_string(related, ','), '') related, coalesce(i, false) has_inferred_edges, len(cwe_ids) > 0 has_cwe, coalesce(len(related), 0) > 0 has_related,
concat_ws(',', case when len(cwe_ids) = 0 then 'has_cwe' end, case when coalesce(len(related), 0) = 0 then 'has_related' end) gaps from own left join rel using (capec_id)""",
    "pattern_variety": 'select severity, count(*) as "rows", count(distinct cwe_ids[1:2]) patterns from capec_patterns group by 1',
    "patterns_repeated": "select coalesce(array_to_string(cwe_ids[1:1], ','), '') pattern, count(*) as \"rows\" from capec_patterns where cwe_ids is not null group by 1 having count(*) > 2",
    "sources_concentrated": 'select source, n as "rows", round(n / t * 100, 3) percentage from (select source, count(*) n, sum(count(*)) over () t from documents group by 1) where n / t > 0.2',
    "risky_rows": f"select record_id, task_type from (select distinct record_id, task_type, model_confidence, output from gold_records) where coalesce(model_confidence < 0.9, false) or coalesce(regexp_matches(output, 'CVE-\\d{{4}}-\\d{{4,}}'), false) or coalesce(task_type in ({_RISKY}), false)",
    "flat_rows": "select record_id, concat_ws(' | ', ids_label, task_type, difficulty, source_file) summary, (ids_label is null)::int + (task_type is null)::int + (difficulty is null)::int + (source_file is null)::int gaps, substring(coalesce(output, ''), 1, 200) as output from (select distinct * exclude (loaded_at) from gold_records)",
    "approved_splits": "select lower(trim(split)) split, count(*) records from (select distinct * exclude (loaded_at) from gold_records) where ids_label in (select ids_label from corpus_records where lower(trim(review_status)) = 'approved') group by 1",
}
