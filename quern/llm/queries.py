"""Queries of the training-data problems, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.leakage import cleaned_corpus, leaked_items
from quern.llm.neardup import near_duplicate_groups, near_duplicate_pairs
from quern.llm.overlap import overlap_pairs, overlap_report
from quern.llm.pairs import broken_pairs
from quern.llm.sampling import allocation, matched_sample, shortfalls
from quern.llm.splits import assign_splits, torn_groups
from quern.llm.tokens import encode_corpus, split_oversized
from quern.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortfalls(table(spark, sf_dir, "corpus_records"), table(spark, sf_dir, "sample_targets")).select("task_type", "ids_label", "difficulty")


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_sample(table(spark, sf_dir, "corpus_records"), table(spark, sf_dir, "sample_targets"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every target what it wants, what its cell has, what is drawn and what is missing."""
    return allocation(table(spark, sf_dir, "corpus_records"), table(spark, sf_dir, "sample_targets")).select("task_type", "ids_label", "difficulty", "wanted", "available", "quota", "missing")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(table(spark, sf_dir, "generations"))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_found(spark, sf_dir).groupBy("field", "defect").agg(F.count("*").alias("answers"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_pairs(table(spark, sf_dir, "gold_records"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_report(table(spark, sf_dir, "gold_records"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return torn_groups(table(spark, sf_dir, "gold_records"))


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_splits(table(spark, sf_dir, "gold_records"))


def _corpus_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.lit("")
    return table(spark, sf_dir, "corpus_records").select("record_id", F.concat(F.coalesce("instruction", blank), F.lit(" "), F.coalesce("output", blank)).alias("text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(_corpus_texts(spark, sf_dir), "record_id", "text")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(_corpus_texts(spark, sf_dir), "record_id", "text")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked item with the number of documents that carry it and the most of it that one carries."""
    found = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max(F.col("carried") / F.col("item_words")).alias("most_carried"))


def p9_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that carry no test item."""
    return cleaned_corpus(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "source", "n_chars")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "documents")).where("piece = 0").select("doc_id").distinct()


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_sample": p1_sample,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_counts": p2_counts,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p5_splits": p5_splits,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_report": p9_report,
    "p9_cleaned": p9_cleaned,
    "p10_found": p10_found,
    "p10_pieces": p10_pieces,
}
_PLAIN = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_CELL = ", ".join(f"nullif({_PLAIN.format(c)}, '') c{i}" for i, c in enumerate(("task_type", "ids_label", "difficulty")))
_TIE = "case when lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')) not in ('', 'unknown', 'n/a', 'none', '-') then lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')) end"
# Words numbered by occurrence; pairs share one of the rarest words that a likeness of 0.85 cannot lose, and are then counted in full.
_ALIKE = """tok as (select id, side, w, row_number() over (partition by id, side, w) k from (select id, side, unnest(regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+')) w from txt)),
len_ as (select id, side, count(*) n from tok group by all), df as (select w, k, count(*) d from tok group by all),
ranked as (select id, side, w, k, row_number() over (partition by id, side order by d, w, k) r from tok join df using (w, k)),
pre as (select r.* from ranked r join len_ using (id, side) where r.r <= n - ceil(0.85 * n - 1e-9) + 1),
cand as (select distinct a.id a, b.id b, a.side sa, b.side sb from pre a join pre b using (w, k) where {pairs}),
both_ as (select c.a, c.b, any_value(x.n) n, any_value(y.n) m, count(*) o from cand c join len_ x on x.id = c.a and x.side = c.sa join len_ y on y.id = c.b and y.side = c.sb join tok s on s.id = c.a and s.side = c.sa join tok u on u.id = c.b and u.side = c.sb and u.w = s.w and u.k = s.k group by c.a, c.b, c.sa, c.sb)
select distinct least(a, b) record_id_a, greatest(a, b) record_id_b from both_ where o * 100 >= 85 * greatest(n, m)"""
_ACROSS = (
    "txt as (select distinct record_id id, lower(trim(split)) in ('train', 'training') side, coalesce(output, '') t from gold_records where lower(trim(split)) in ('train', 'training', 'validation', 'valid', 'val', 'dev', 'test', 'testing', 'holdout')), "
    + _ALIKE.replace("{pairs}", "a.side and not b.side and a.id <> b.id")
)
_WITHIN = "txt as (select distinct record_id id, 0 side, coalesce(instruction, '') || ' ' || coalesce(output, '') t from corpus_records), " + _ALIKE.replace("{pairs}", "a.id < b.id")
SQL: dict[str, str] = {
    "p4_found": "with " + _ACROSS,
    "p4_report": "with " + _ACROSS.replace("select distinct least(a, b) record_id_a, greatest(a, b) record_id_b from both_", "select distinct a, b from both_").replace("\nselect distinct a, b", ", leaks as (select distinct a, b").rstrip()
    + """), held as (select distinct record_id b, case when lower(trim(split)) in ('validation', 'valid', 'val', 'dev') then 'validation' when lower(trim(split)) in ('test', 'testing', 'holdout') then 'test' end split from gold_records where lower(trim(split)) not in ('train', 'training')),
ctx as (select record_id b, min(coalesce(lower(trim(base_context_id)), '')) base_context_id from gold_records group by 1)
select split, base_context_id, count(distinct b) leaking_records, count(*) pairs from leaks join held using (b) join ctx using (b) where split is not null group by 1, 2""",
    "p6_found": "with " + _WITHIN,
    "p6_groups": "with recursive "
    + _WITHIN.replace("\nselect distinct least(a, b) record_id_a", ", pairs as (select distinct least(a, b) record_id_a")
    + """), ends as (select record_id_a u, record_id_b v from pairs union select record_id_b, record_id_a from pairs),
reach as (select u node, u root from ends union select e.v, r.root from reach r join ends e on e.u = r.node),
grp as (select node record_id, min(root) group_id from reach group by 1),
bag as (select id, list_sort(regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+')) bag from txt),
many as (select bag, count(distinct id) class_rows from bag group by 1),
links as (select u record_id, count(distinct y.bag) links from ends join bag x on x.id = u join bag y on y.id = v where x.bag <> y.bag group by 1)
select record_id, group_id, class_rows, coalesce(links, 0) links from grp join bag on bag.id = record_id join many using (bag) left join links using (record_id)""",
    "p1_found": f"""
with have as (select c0, c1, c2, count(distinct record_id) n from (select record_id, {_CELL} from corpus_records) group by all),
want as (select *, {_CELL} from sample_targets)
select task_type, ids_label, difficulty from want left join have using (c0, c1, c2)
where round(greatest(min_rows, target_share * sample_size)) > coalesce(n, 0)""",
    "p5_found": f"""
with recursive rows_ as (
  select distinct record_id, {_TIE.format("base_context_id")} c, {_TIE.format("sample_id")} s,
    case when lower(trim(split)) in ('train', 'training') then 'train' when lower(trim(split)) in ('validation', 'valid', 'val', 'dev') then 'validation' when lower(trim(split)) in ('test', 'testing', 'holdout') then 'test' end sp
  from gold_records
), edges as (select distinct 'c' || c u, 's' || s v from rows_ where c is not null and s is not null),
both_ as (select u, v from edges union all select v, u from edges),
reach as (select u node, u root from both_ union select b.v, r.root from reach r join both_ b on b.u = r.node),
comp as (select node, min(root) root from reach group by node),
placed as (select record_id, sp, coalesce(x.root, coalesce('c' || c, 's' || s)) g from rows_ left join comp x on x.node = coalesce('c' || c, 's' || s)),
torn as (select g, min(record_id) group_id from placed where g is not null group by g having count(distinct sp) > 1)
select distinct record_id, group_id from placed join torn using (g)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
