"""Queries over records: rules, decisions, agreement, splits, samples and training texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import identifiers as I
from quern.functions import texts as X
from quern.operators import quality as Q
from quern.operators import sampling as S
from quern.session import table


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold_records").drop("loaded_at").distinct()


def record_rules(spark, d):
    """Records with findings: fields, copies, provenance, identifiers that the instruction does not have, phrases."""
    t = table(spark, d, "corpus_records").drop("loaded_at").distinct().withColumn("output", F.concat_ws(" ", "output", F.when(F.col("source_file") == "corpus/topup.jsonl", F.lit("This is a training example."))))
    found = Q.record_findings(t, "output", I.all_extracted("instruction"), ["instruction", "output", "base_context_id"], ["record_id"], "provenance_type")
    return found.select("record_id", F.array_join("errors", "; ").alias("errors")).where("errors != ''")


def record_rule_counts(spark, d):
    return record_rules(spark, d).select(F.explode(F.split("errors", "; ")).alias("error")).groupBy("error").agg(F.count("*").alias("records"))


def decisions_applied(spark, d):
    """Records by the last decision on them; the decisions are the review states of later deliveries."""
    t = table(spark, d, "gold_records")
    dec = Q.last_decisions(t.where("review_status <> 'candidate_unreviewed'").select("example_id", F.col("review_status").alias("decision"), "loaded_at", "record_id"), "example_id", ["loaded_at", "record_id"]).select("example_id", "decision")
    rec = table(spark, d, "generations").drop("received_at").distinct().select("generation_id", "example_id", "task_type")
    return Q.with_decisions(rec, dec, "example_id", "decision").groupBy("task_type", "decision").agg(F.count("*").alias("records"))


def decisions_unmatched(spark, d):
    t = table(spark, d, "gold_records").select("example_id", "review_status").distinct()
    return Q.unmatched_decisions(table(spark, d, "generations"), t, "example_id")


def agreement_categories(spark, d):
    g = _gold(spark, d)
    pred = F.when(F.col("model_prediction") == "BENIGN", "BENIGN").otherwise("ATTACK")
    conf = F.when(~F.isnan("model_confidence"), F.col("model_confidence"))
    return g.groupBy(Q.agreement(pred, conf, F.col("output"), F.col("source_file").isNull()).alias("category"), "review_status").agg(F.count("*").alias("records"))


def stratified_splits(spark, d):
    return S.stratified_split(_gold(spark, d), "ids_label", "record_id").select("record_id", "ids_label", F.col("split").alias("new_split"))


def context_splits(spark, d):
    return S.group_split(_gold(spark, d).drop("split"), "base_context_id").select("record_id", "split")


def stratified_samples(spark, d):
    return S.stratified_sample(_gold(spark, d).select("record_id", "task_type", "difficulty"), ["task_type", "difficulty"], "record_id", 250, 2).select("record_id", "task_type", "difficulty")


def capped_samples(spark, d):
    return S.capped_sample(_gold(spark, d).select("record_id", "ids_label", "source_file"), "ids_label", "source_file", "record_id", 25)


def samples_per_label(spark, d):
    return S.per_label(_gold(spark, d).select("record_id", "ids_label"), "ids_label", "record_id", 5)


def disjoint_samples(spark, d):
    g = _gold(spark, d).select("record_id", "task_type", "difficulty")
    return S.disjoint_sets(g, "record_id", [("overall", F.lit(True), 20), ("hard", F.col("difficulty") == "hard", 5), ("mapping", F.col("task_type") == "attack_mapping", 5)])


def serial_numbers(spark, d):
    return S.round_robin(_gold(spark, d).select("record_id"), "record_id", ["easy", "medium", "hard", "expert"], "gold-").select("record_id", "serial", "value")


def even_orders(spark, d):
    """Ten customers at even distances."""
    c = table(spark, d, "customer").select((F.col("c_custkey") - 1).alias("place"), "c_custkey")
    return S.even_spaced(c, "place", 10).select("c_custkey")


def leaking_contexts(spark, d):
    g = _gold(spark, d).withColumn("s", F.lower(F.trim("split"))).where("s in ('train', 'validation', 'test')")
    return S.leaking_groups(g, "base_context_id", "s")


SYSTEM = "You are a careful security analyst."


def chat_texts(spark, d):
    """Training texts and the prompts and targets got back from them."""
    g = _gold(spark, d).select("record_id", "instruction", "output")
    text = Q.chat_text(SYSTEM, F.col("instruction"), F.col("output"))
    prompt, target = Q.prompt_and_target(F.col("t"))
    made = g.withColumn("t", text).select("record_id", F.length("t").alias("chars"), F.length(prompt).alias("prompt_chars"), (target == F.col("output")).alias("same"), F.md5("t").alias("digest"))
    return made


def chat_message_counts(spark, d):
    m = _gold(spark, d).select(F.explode(Q.chat_messages(SYSTEM, F.col("instruction"), F.col("output"))).alias("m"))
    return m.groupBy("m.role").agg(F.count("*").alias("messages"), F.sum(F.length("m.content")).alias("chars"))


TEMPLATES = [("a", "Explain {ids_label} on {base_context_id}."), ("b", "List gaps for {ids_label}."), ("c", "Map {ids_label} in {base_context_id} to a technique."), ("d", "Brief the board on {ids_label}.")]


def templated_instructions(spark, d):
    ctx = _gold(spark, d).where("base_context_id is not null").groupBy("base_context_id").agg(F.min("ids_label").alias("ids_label"))
    return Q.templated(ctx, spark.createDataFrame(TEMPLATES, "template_id string, pattern string"), "base_context_id", 2).select("base_context_id", "template_id", "instruction")


_GOLD = "gold as (select distinct * exclude (loaded_at) from gold_records)"
_R = "md5('{0}:' || {1})"


def _all(col: str) -> str:
    return "list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(coalesce({col}, ''), '{p}')" for p in I.PATTERNS.values()) + "))"


def _any(text: str, phrases: list[str]) -> str:
    return "(" + " or ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


_LOW = "lower(coalesce(output, ''))"
_QUOTE = lambda s: s.replace("'", "''")
_RULES = [
    ("missing field: instruction", "instruction is null"), ("missing field: output", "output is null"), ("missing field: base_context_id", "base_context_id is null"),
    ("duplicate example", "row_number() over (partition by instruction, output, base_context_id order by record_id) > 1"), ("missing provenance", "coalesce(provenance_type, '') = ''"),
    ("invented security identifiers", f"len(list_filter({_all('output')}, lambda i: not list_contains({_all('instruction')}, i))) > 0"),
    ("unsupported attribution phrasing", _any(_LOW, Q.ATTRIBUTION_PHRASES)), ("unsupported asset exposure claim", f"contains({_LOW}, 'confirmed exposure') and not contains({_LOW}, 'asset evidence')"),
    ("internal phrase", _any(_LOW, Q.INTERNAL_PHRASES)), ("visible role label", _any(_LOW, Q.ROLE_PHRASES)),
    ("graph taken for proof", f"regexp_matches({_LOW}, '{Q.PROOF}') and (not regexp_matches({_LOW}, '{_QUOTE(Q.NO_PROOF)}') or regexp_matches(regexp_replace({_LOW}, '{_QUOTE(Q.NO_PROOF)}', '', 'g'), '{Q.PROOF}'))"),
]
_FOUND = "with t as (select distinct * exclude (loaded_at) replace (concat_ws(' ', output, case when source_file = 'corpus/topup.jsonl' then 'This is a training example.' end) as output) from corpus_records), f as (select record_id, array_to_string(list_filter([" + ", ".join(f"case when {rule} then '{name}' end" for name, rule in _RULES) + "], lambda x: x is not null), '; ') errors from t) "
_AG = f"""case when source_file is null then 'evidence_gap' when model_prediction <> 'BENIGN' and regexp_matches({_LOW}, '{Q.BENIGN_READING}') then 'classifier_attack_llm_benign_or_uncertain'
 when model_prediction <> 'BENIGN' and c >= 0.9 and {_any(_LOW, Q.ATTACK_TERMS)} and not {_any(_LOW, Q.UNCERTAIN)} then 'agree_attack_high_confidence' when model_prediction <> 'BENIGN' and {_any(_LOW, Q.UNCERTAIN)} then 'llm_uncertain_classifier_attack'
 when model_prediction <> 'BENIGN' and c >= 0.9 then 'agree_attack_high_confidence' when model_prediction <> 'BENIGN' then 'agree_attack_low_confidence' else 'evidence_gap' end"""
_SPLIT = "case when r <= floor(0.7 * n) then 'train' when r <= floor(0.85 * n) then 'validation' else 'test' end"
_USER = f"'<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || '{SYSTEM}<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || instruction || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)"
_FILL = "replace(replace(pattern, '{ids_label}', coalesce(ids_label, '')), '{base_context_id}', base_context_id)"
QUERIES = {f.__name__: f for f in (record_rules, record_rule_counts, decisions_applied, decisions_unmatched, agreement_categories, stratified_splits, context_splits, stratified_samples, capped_samples, samples_per_label, disjoint_samples, serial_numbers, even_orders, leaking_contexts, chat_texts, chat_message_counts, templated_instructions)}
SQL = {
    "record_rules": _FOUND + "select * from f where errors <> ''",
    "record_rule_counts": _FOUND + "select error, count(*) records from (select unnest(string_split(errors, '; ')) error from f where errors <> '') group by 1",
    "decisions_applied": "with dec as (select example_id, arg_max(review_status, (loaded_at, record_id)) decision from gold_records where review_status <> 'candidate_unreviewed' group by 1), rec as (select distinct * exclude (received_at) from generations) select task_type, coalesce(decision, 'unreviewed') decision, count(*) records from rec left join dec using (example_id) group by all",
    "decisions_unmatched": "select distinct example_id, review_status from gold_records where example_id not in (select example_id from generations where example_id is not null) or example_id is null",
    "agreement_categories": f"with {_GOLD}, g as (select *, case when isnan(model_confidence) then 0 else coalesce(model_confidence, 0) end c from gold) select {_AG} category, review_status, count(*) records from g group by all",
    "stratified_splits": f"with {_GOLD}, r as (select record_id, ids_label, row_number() over (partition by ids_label order by {_R.format('42', 'record_id')}, record_id) r, count(*) over (partition by ids_label) n from gold) select record_id, ids_label, {_SPLIT} new_split from r",
    "context_splits": f"with {_GOLD}, g as (select distinct coalesce(base_context_id, '') c from gold), r as (select c, row_number() over (order by {_R.format('42', 'c')}, c) r, count(*) over () n from g) select record_id, {_SPLIT} split from gold join r on coalesce(base_context_id, '') = c",
    "stratified_samples": f"with {_GOLD}, r as (select record_id, task_type, difficulty, row_number() over (partition by task_type, difficulty order by {_R.format('42', 'record_id')}, record_id) r from gold), rest as (select *, row_number() over (order by {_R.format('42f', 'record_id')}, record_id) k from r where r > 2) select record_id, task_type, difficulty from r where r <= 2 union all select record_id, task_type, difficulty from rest where k <= 250 - (select count(*) from r where r <= 2)",
    "capped_samples": f"with {_GOLD}, r as (select record_id, ids_label, source_file, row_number() over (partition by ids_label, source_file order by {_R.format('42', 'record_id')}, record_id) > 8 late from gold), k as (select *, row_number() over (partition by ids_label order by late, {_R.format('42', 'record_id')}, record_id) k from r) select record_id, ids_label, source_file from k where k <= 25",
    "samples_per_label": f"with {_GOLD} select record_id, ids_label from (select *, row_number() over (partition by ids_label order by {_R.format('42', 'record_id')}, record_id) k from gold) where k <= 5",
    "disjoint_samples": f"with {_GOLD}, g as (select record_id, task_type, difficulty from gold), a as (select *, 'overall' set_name from g order by {_R.format('42overall', 'record_id')}, record_id limit 20), b as (select *, 'hard' set_name from g where difficulty = 'hard' and record_id not in (select record_id from a) order by {_R.format('42hard', 'record_id')}, record_id limit 5), c as (select *, 'mapping' set_name from g where task_type = 'attack_mapping' and record_id not in (select record_id from a union all select record_id from b) order by {_R.format('42mapping', 'record_id')}, record_id limit 5) select * from a union all select * from b union all select * from c",
    "serial_numbers": f"with {_GOLD}, r as (select record_id, row_number() over (order by {_R.format('42', 'record_id')}, record_id) r from gold) select record_id, 'gold-' || lpad(r::varchar, 5, '0') as serial, ['easy', 'medium', 'hard', 'expert'][1 + (r - 1) % 4] as value from r",
    "even_orders": "select c_custkey from customer where c_custkey - 1 in (select floor(i * (select count(*) from customer) / 10)::bigint from range(10) t(i))",
    "leaking_contexts": f"with {_GOLD} select base_context_id, array_to_string(list_sort(list(distinct lower(trim(split)))), ',') splits from gold where lower(trim(split)) in ('train', 'validation', 'test') and base_context_id is not null group by 1 having count(distinct lower(trim(split))) > 1",
    "chat_texts": f"with {_GOLD}, t as (select record_id, {_USER} p, {_USER} || output || '<|eot_id|>' t from gold) select record_id, length(t) chars, length(p) prompt_chars, case when t is not null then true end same, md5(t) digest from t",
    "chat_message_counts": f"with {_GOLD}, m as (select 'system' as role, '{SYSTEM}' content from gold union all select 'user', instruction from gold union all select 'assistant', output from gold) select role, count(*) messages, sum(length(content))::bigint chars from m group by 1",
    "templated_instructions": f"with {_GOLD}, c as (select base_context_id, min(ids_label) ids_label from gold where base_context_id is not null group by 1), t(template_id, pattern) as (values {', '.join(f'({chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for a, b in TEMPLATES)}) select base_context_id, template_id, {_FILL} instruction from (select *, row_number() over (partition by base_context_id order by md5('42:' || base_context_id || '/' || template_id)) k from c, t) where k <= 2",
}
