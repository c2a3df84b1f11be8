"""Queries over corpora: identifiers, diversity, metrics, quality, splits, reviews, training texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import identifiers as I
from quern.functions import texts as X
from quern.operators import metrics as M
from quern.operators import textstats as T
from quern.session import table


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """gold_records once each."""
    return table(spark, d, "gold_records").drop("loaded_at").distinct()


def identifier_coverage(spark, d):
    out = table(spark, d, "corpus_records").select("output")
    return T.coverage(out, {k: I.extracted("output", k) for k in I.PATTERNS})


def identifier_counts_any_case(spark, d):
    g = table(spark, d, "generations").select("raw_output")
    return g.agg(*[F.sum(F.size(I.extracted("raw_output", k, True))).alias(k) for k in ("capec", "cve", "cwe")], F.count_if(F.size(I.extracted("raw_output", "technique")) > 0).alias("with_technique"))


def ungrounded_identifiers(spark, d):
    """Identifiers of a generated answer that neither its instruction nor its reference answer has."""
    g = table(spark, d, "generations").drop("received_at").distinct()
    extra = F.array_except(I.all_extracted("raw_output"), F.array_union(I.all_extracted("instruction"), I.all_extracted("output")))
    return g.select("generation_id", F.array_sort(extra).alias("x")).where("size(x) > 0").select("generation_id", F.size("x").alias("ungrounded"), F.element_at("x", 1).alias("first_id"))


def vocabulary_by_task(spark, d):
    return T.vocabulary(_gold(spark, d), ["task_type"], "output")


def vocabulary_by_bucket(spark, d):
    return T.vocabulary(_gold(spark, d).withColumn("bucket", X.bucket_of("example_id")), ["bucket"], "instruction")


def sentence_repetition(spark, d):
    s = _gold(spark, d).where("split is not null").select("task_type", F.explode(X.sentences("instruction")).alias("sentence"))
    return T.repetition(s, ["task_type"], "sentence")


def opening_repetition(spark, d):
    return T.repetition(_gold(spark, d).select("task_type", X.opening("instruction", 20).alias("opening")), ["task_type"], "opening")


def top_openings(spark, d):
    return T.top_values(_gold(spark, d).select(X.opening("instruction", 12).alias("opening")), [], "opening", 15)


def top_four_grams(spark, d):
    return T.top_values(_gold(spark, d).select("task_type", F.explode(X.ngrams(X.tokens("instruction"), 4)).alias("gram")), ["task_type"], "gram", 5)


def value_counts(spark, d):
    return T.value_counts(_gold(spark, d), ["task_type", "difficulty", "review_status", "ids_label"])


def label_pivot(spark, d):
    """Confidence bands and tasks of every label, side by side."""
    g = _gold(spark, d)
    c = F.col("model_confidence")
    ok = c.isNotNull() & ~F.isnan(c)
    return g.groupBy("ids_label").agg(F.count("*").alias("records"), F.count_if(ok & (c >= 0.9)).alias("high"), F.count_if(ok & (c >= 0.6) & (c < 0.9)).alias("medium"), F.count_if(ok & (c < 0.6)).alias("low"), F.count_if(F.size(I.extracted("output", "cve")) > 0).alias("with_cve"), F.array_join(F.array_sort(F.collect_set("task_type")), ",").alias("tasks"))


def label_by_source(spark, d):
    return _gold(spark, d).groupBy("ids_label", "source_file").agg(F.count("*").alias("records"))


def source_concentration(spark, d):
    """Source files that hold over a sixth of all records."""
    from pyspark.sql import Window

    per = _gold(spark, d).groupBy("source_file").agg(F.count("*").alias("records"))
    return per.withColumn("share", F.round(F.col("records") / F.sum("records").over(Window.partitionBy()), 6)).where("share > 0.1666")


def classifier_confusion(spark, d):
    g = _gold(spark, d)
    return M.rates(M.confusion(g, ["source_file"], (F.col("ids_label") != "BENIGN").cast("int"), (F.col("model_prediction") != "BENIGN").cast("int")))


def classifier_auc(spark, d):
    e = table(spark, d, "lineitem")
    return M.roc_auc(e, (F.col("l_returnflag") == "R").cast("int"), F.col("l_extendedprice")).select(F.round("auc", 9).alias("auc"))


def run_deltas(spark, d):
    """Mean lengths by task of two model modes, and what became of them."""
    g = table(spark, d, "generations")
    one = lambda mode: g.where(F.col("model_mode") == mode).groupBy("task_type").agg(F.round(F.avg(F.length("raw_output")), 4).alias("v"))
    return M.deltas(one("base"), one("lora"), "task_type", "v").select("task_type", "before", "after", F.round("delta", 4).alias("delta"), M.interpretation(F.col("delta")).alias("reading"))


def token_length_audit(spark, d):
    return M.length_stats(table(spark, d, "generations"), ["model_mode"], F.col("prompt_tokens"), 700)


def text_length_audit(spark, d):
    return M.length_stats(table(spark, d, "documents"), ["lang"], F.length("text"), 4000)


def longest_prompts(spark, d):
    """The 20 longest prompts of each mode."""
    from pyspark.sql import Window

    g = table(spark, d, "generations").drop("received_at").distinct()
    w = Window.partitionBy("model_mode").orderBy(F.desc("prompt_tokens"), "generation_id")
    return g.withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("model_mode", "generation_id", "prompt_tokens", "rank")


def generation_evaluation(spark, d):
    """Rates of generated answers: readable JSON, caps hit, phrases, metadata; one pass over the table."""
    g = table(spark, d, "generations")
    t = F.coalesce("raw_output", F.lit(""))
    # Texts of failed runs, and of naming an actor.
    errors = r"(?i)traceback|exception|runtimeerror|cuda out of memory|error:"
    actors = r"(?i)\battributed to\b|\bAPT\d+\b|\bthreat actor\b|\bactor attribution\b"
    return g.groupBy("model_mode").agg(
        F.count("*").alias("generations"), F.count_if(X.parses_as_json(t)).alias("json_ok"), F.count_if(F.trim(t) == "").alias("empty"), F.count_if(t.rlike(errors)).alias("errors"), F.count_if(t.rlike(actors)).alias("attribution"),
        F.count_if(F.col("generated_tokens") >= F.col("max_new_tokens")).alias("cap_hits"), F.min("generated_tokens").alias("min_tokens"), F.max("generated_tokens").alias("max_tokens"), F.round(F.avg("generated_tokens"), 2).alias("mean_tokens"),
        F.round(F.median("generated_tokens"), 2).alias("median_tokens"), F.count_if(F.col("example_id").isNotNull() & (F.col("example_id") != "") & F.col("ids_label").isNotNull()).alias("covered"),
    )


def embedded_objects(spark, d):
    """The objects in braces within generated answers, and how many of them are JSON."""
    g = table(spark, d, "generations").select("model_mode", X.embedded_json("raw_output").alias("o"))
    return g.groupBy("model_mode").agg(F.count("o").alias("objects"), F.count_if(X.parses_as_json("o")).alias("readable"), F.sum(F.length("o")).alias("chars"))


def corpus_statistics(spark, d):
    """Distributions by three attributes and overall in one pass (grouping sets)."""
    g = _gold(spark, d).withColumn("chars", F.length("output"))
    return g.groupingSets([["task_type"], ["difficulty"], ["review_status"], []], "task_type", "difficulty", "review_status").agg(F.grouping_id().alias("level"), F.count("*").alias("records"), F.round(F.avg("chars"), 3).alias("mean_chars"))


def text_shapes(spark, d):
    """Compacted texts, slugs, short hashes and buckets of gold records."""
    g = _gold(spark, d)
    return g.select("record_id", X.compacted("instruction", 60).alias("compact"), X.cut_at_word("instruction", 60).alias("cut"), I.slug(F.col("ids_label")).alias("slug"), I.short_hash(F.coalesce("example_id", F.lit("")), 8).alias("hash"), X.bucket_of("example_id").alias("bucket"))


_WORDS = r"list_transform(regexp_extract_all(coalesce({0}, ''), '[a-zA-Z0-9_][a-zA-Z0-9_-]*'), lambda x: lower(x))"
_GOLD = "gold as (select distinct * exclude (loaded_at) from gold_records)"
_SENT = r"list_filter(list_transform(string_split(regexp_replace(replace(coalesce({0}, ''), chr(10), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"
_IDS = {k: v.replace("(?:", "(?:") for k, v in I.PATTERNS.items()}


def _found(col: str, kind: str) -> str:
    return f"list_distinct(regexp_extract_all(coalesce({col}, ''), '{I.PATTERNS[kind]}'))"


def _all(col: str) -> str:
    return "list_concat(" + ", ".join(_found(col, k) for k in I.PATTERNS) + ")"


_COVER = " union all ".join(f"select '{k}' kind, unnest({_found('output', k)}) id from corpus_records" for k in I.PATTERNS)


def _repeat(rows: str, by: str, value: str) -> str:
    return f"with {_GOLD}, v as ({rows}), c as (select {by}, {value}, count(*) n from v where {value} is not null group by all) select {by}, sum(n)::bigint occurrences, count(*) types, round(100.0 * count(*) filter (n > 1) / count(*), 4) repeated_types_percent, round(coalesce(sum(n) filter (n > 1), 0) / sum(n), 6) repeated_share from c group by {by}"


def _lengths(tbl: str, by: str, v: str, limit: int) -> str:
    pct = ", ".join(f"list_sort(list({v}))[1 + round_even({p} / 100.0 * (count({v}) - 1), 0)::int] p{p}" for p in (90, 95, 99))
    return f'select {by}, count({v}) as "count", min({v}) as "min", max({v}) as "max", round(avg({v}), 2) as "mean", floor(median({v}))::bigint as "median", {pct}, count(*) filter ({v} > {limit}) above, round(100.0 * count(*) filter ({v} > {limit}) / count({v}), 3) above_percent from {tbl} where {v} is not null group by {by}'


QUERIES = {f.__name__: f for f in (identifier_coverage, identifier_counts_any_case, ungrounded_identifiers, vocabulary_by_task, vocabulary_by_bucket, sentence_repetition, opening_repetition, top_openings, top_four_grams, value_counts, label_pivot, label_by_source, source_concentration, classifier_confusion, classifier_auc, run_deltas, token_length_audit, text_length_audit, longest_prompts, generation_evaluation, embedded_objects, corpus_statistics, text_shapes)}
_BUCKET = r"coalesce(try_cast(nullif(regexp_extract(coalesce(example_id, ''), '(\d{1,18})$', 1), '') as bigint), 0) % 8"


def _vocab(by: str, text: str) -> str:
    w = _WORDS.format(text)
    return f"with {_GOLD}, t as (select {by} g, list_filter({w}, lambda x: regexp_matches(x, '^[a-z]')) w from gold) select g as {by.split(' ')[-1] if ' as ' in by else by}, count(*) texts, sum(len(w))::bigint total_words, len(list_distinct(flatten(list(w))))::bigint unique_words, round(avg(len(list_distinct(w)) / nullif(len(w), 0)), 6) mean_ttr, round(avg(len(w)), 6) mean_words, round(len(list_distinct(flatten(list(w)))) / sum(len(w)), 6) group_diversity from t group by g"


SQL = {
    "identifier_coverage": f"select kind, id, count(*) n from ({_COVER}) group by all",
    "identifier_counts_any_case": "select " + ", ".join(f"sum(len(list_distinct(list_transform(regexp_extract_all(coalesce(raw_output, ''), '(?i){I.PATTERNS[k]}'), lambda x: upper(x)))))::bigint {k}" for k in ("capec", "cve", "cwe")) + f", count(*) filter (len({_found('raw_output', 'technique')}) > 0) with_technique from generations",
    "ungrounded_identifiers": f"with g as (select distinct * exclude (received_at) from generations), x as (select generation_id, list_sort(list_distinct(list_filter({_all('raw_output')}, lambda i: not list_contains(list_concat({_all('instruction')}, {_all('output')}), i)))) x from g) select generation_id, len(x)::int ungrounded, x[1] first_id from x where len(x) > 0",
    "vocabulary_by_task": _vocab("task_type", "output"),
    "vocabulary_by_bucket": _vocab("task_type", "instruction").replace("select task_type g,", f"select {_BUCKET} g,").replace("g as task_type", "g as bucket"),
    "sentence_repetition": _repeat(f"select task_type, unnest({_SENT.format('instruction')}) sentence from gold where split is not null", "task_type", "sentence"),
    "opening_repetition": _repeat(f"select task_type, left({_SENT.format('instruction')}[1], 20) opening from gold", "task_type", "opening"),
    "top_openings": f"with {_GOLD}, c as (select left({_SENT.format('instruction')}[1], 12) opening, count(*) n from gold group by 1) select * from (select *, row_number() over (order by n desc, opening) as \"rank\" from c where opening is not null) where \"rank\" <= 15",
    "top_four_grams": f"with {_GOLD}, t as (select task_type, list_filter({_WORDS.format('instruction')}, lambda x: regexp_matches(x, '^[a-z]')) w from gold), g as (select task_type, unnest(list_transform(range(1, greatest(len(w) - 2, 1)::bigint), lambda i: array_to_string(w[i:i+3], ' '))) gram from t), c as (select task_type, gram, count(*) n from g group by all) select * from (select *, row_number() over (partition by task_type order by n desc, gram) as \"rank\" from c) where \"rank\" <= 5",
    "value_counts": f"with {_GOLD} " + " union all ".join(f"select '{x}' as dimension, {x} as value, count(*) n from gold group by 2" for x in ("task_type", "difficulty", "review_status", "ids_label")),
    "label_pivot": f"with {_GOLD} select ids_label, count(*) records, count(*) filter (not isnan(model_confidence) and model_confidence >= 0.9) high, count(*) filter (not isnan(model_confidence) and model_confidence >= 0.6 and model_confidence < 0.9) medium, count(*) filter (not isnan(model_confidence) and model_confidence < 0.6) low, count(*) filter (len({_found('output', 'cve')}) > 0) with_cve, array_to_string(list_sort(list(distinct task_type) filter (task_type is not null)), ',') tasks from gold group by 1",
    "label_by_source": f"with {_GOLD} select ids_label, source_file, count(*) records from gold group by all",
    "source_concentration": f"with {_GOLD} select * from (select source_file, count(*) records, round(count(*) / sum(count(*)) over (), 6) as \"share\" from gold group by 1) where \"share\" > 0.1666",
    "classifier_confusion": f"""with {_GOLD}, m as (select source_file, count(*) filter (ids_label = 'BENIGN' and model_prediction = 'BENIGN') tn, count(*) filter (ids_label = 'BENIGN' and model_prediction <> 'BENIGN') fp, count(*) filter (ids_label <> 'BENIGN' and model_prediction = 'BENIGN') fn, count(*) filter (ids_label <> 'BENIGN' and model_prediction <> 'BENIGN') tp from gold group by 1)
select *, round(coalesce((tp + tn) / nullif(tn + fp + fn + tp, 0), 0), 6) accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) f1 from m""",
    "classifier_auc": "with r as (select (l_returnflag = 'R')::int y, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 r from lineitem) select round((sum(r) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 9) auc from r",
    "run_deltas": """with v as (select task_type, model_mode, round(avg(length(raw_output)), 4) v from generations group by all), j as (select task_type, coalesce(a.v, 0) "before", coalesce(b.v, 0) "after" from (select * from v where model_mode = 'base') a full join (select * from v where model_mode = 'lora') b using (task_type))
select task_type, "before", "after", round("after" - "before", 4) delta, case when "after" - "before" <= -0.05 then 'clear drop' when "after" - "before" <= -0.01 then 'slight drop' else 'stable' end reading from j where task_type is not null""",
    "token_length_audit": _lengths("generations", "model_mode", "prompt_tokens", 700),
    "text_length_audit": _lengths("(select lang, length(text) n from documents)", "lang", "n", 4000),
    "longest_prompts": 'with g as (select distinct * exclude (received_at) from generations) select model_mode, generation_id, prompt_tokens, k as "rank" from (select *, row_number() over (partition by model_mode order by prompt_tokens desc nulls last, generation_id) k from g) where k <= 20',
    "corpus_statistics": f"with {_GOLD} select task_type, difficulty, review_status, grouping(task_type, difficulty, review_status) as level, count(*) records, round(avg(length(output)), 3) mean_chars from gold group by grouping sets ((task_type), (difficulty), (review_status), ())",
    "text_shapes": r"with " + _GOLD + r""", t as (select *, trim(regexp_replace(coalesce(instruction, ''), '\s+', ' ', 'g')) q from gold)
select record_id, case when length(q) <= 60 then q else rtrim(left(q, 57)) || '...' end compact, case when length(q) <= 60 then q else regexp_replace(left(q, 60), '\s+\S*$', '') end cut, trim(regexp_replace(lower(ids_label), '[^a-z0-9]+', '_', 'g'), '_') slug, left(sha1(coalesce(example_id, '')), 8) hash, """ + _BUCKET + " bucket from t",
}
