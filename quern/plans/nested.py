"""Queries of problem 3: deeply nested records as related flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.nested import context_tables, provenance_rows
from quern.operators.retrieval import provenance_score
from quern.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance_rows(table(spark, sf_dir, "retrieval_contexts"))


def p3_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tables(table(spark, sf_dir, "retrieval_contexts"))["contexts"]


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tables(table(spark, sf_dir, "retrieval_contexts"))["entities"]


def p3_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tables(table(spark, sf_dir, "retrieval_contexts"))["provenance"]


def context_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(context_id, problems): contexts without a technique or provenance, or with an id twice in a category."""
    t = context_tables(table(spark, sf_dir, "retrieval_contexts"))
    twice = t["entities"].where("entity_id != ''").groupBy("context_id", "category", "entity_id").count().where("count > 1").select("context_id", F.concat(F.lit("duplicate ids in "), "category").alias("problem"))
    no_technique = t["contexts"].join(t["entities"].where("category = 'technique'"), "context_id", "left_anti").select("context_id", F.lit("missing technique").alias("problem"))
    no_provenance = t["contexts"].join(t["provenance"], "context_id", "left_anti").select("context_id", F.lit("missing provenance").alias("problem"))
    return twice.unionByName(no_technique).unionByName(no_provenance).groupBy("context_id").agg(F.array_join(F.array_sort(F.collect_set("problem")), "; ").alias("problems"))


def entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category, entities, mean_score, best_score): stored entities scored anew from their distance and provenance."""
    t = context_tables(table(spark, sf_dir, "retrieval_contexts"))
    prov = t["provenance"].groupBy("context_id", "entity_node").agg(F.collect_list(F.struct("confidence", "inferred")).alias("p"))
    e = t["entities"].join(prov, ["context_id", "entity_node"], "left")
    none = F.array().cast("array<struct<confidence:string,inferred:boolean>>")
    score = F.round(provenance_score(F.coalesce("p", none), F.coalesce("distance", F.lit(0))), 6)
    return e.groupBy("category").agg(F.count("*").alias("entities"), F.round(F.avg(score), 6).alias("mean_score"), F.max(score).alias("best_score"))


QUERIES = {"p3_found": p3_found, "p3_contexts": p3_contexts, "p3_entities": p3_entities, "p3_provenance": p3_provenance, "context_validation": context_validation, "entity_scores": entity_scores}
SQL: dict[str, str] = {}
