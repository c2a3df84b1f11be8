"""Diversity, repetition and coverage of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import texts as X


def vocabulary(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, texts, total_words, unique_words, mean_ttr, mean_words, group_diversity).

    mean_ttr is the mean of each text's distinct words over its words; group_diversity is the distinct words of
    the whole group over its words.  Words are counted by group and word before they are counted as distinct, so
    a group of any size is spread over the tasks.  Texts without words count only as texts.
    """
    toks = df.select(*by, X.tokens(text).alias("_t"))
    per = toks.groupBy(*by).agg(
        F.count("*").alias("texts"),
        F.avg(F.when(F.size("_t") > 0, F.size(F.array_distinct("_t")) / F.size("_t"))).alias("mean_ttr"),
        F.avg(F.size("_t")).alias("mean_words"),
    )
    words = toks.select(*by, F.explode("_t").alias("_w")).groupBy(*by, "_w").agg(F.count("*").alias("_n"))
    sums = words.groupBy(*by).agg(F.sum("_n").alias("total_words"), F.count("*").alias("unique_words"))
    same = None
    for b in by:
        c = per[b].eqNullSafe(sums[b])
        same = c if same is None else same & c
    joined = per.join(sums, same, "left") if by else per.crossJoin(sums)
    return joined.select(
        *[per[b] for b in by], "texts", F.coalesce("total_words", F.lit(0)).alias("total_words"), F.coalesce("unique_words", F.lit(0)).alias("unique_words"),
        F.round("mean_ttr", 6).alias("mean_ttr"), F.round("mean_words", 6).alias("mean_words"), F.round(F.coalesce(F.col("unique_words") / F.col("total_words"), F.lit(0.0)), 6).alias("group_diversity"),
    )


def repetition(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, occurrences, types, repeated_types_percent, repeated_share) of a column of sentences, openings or the like.

    repeated_types_percent: distinct values that occur more than once, of all distinct values; repeated_share:
    occurrences of such values, of all occurrences.  Nulls do not count.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    many = F.col("n") > 1
    return counted.groupBy(*by).agg(
        F.sum("n").alias("occurrences"), F.count("*").alias("types"),
        F.round(100.0 * F.count_if(many) / F.count("*"), 4).alias("repeated_types_percent"),
        F.round(F.sum(F.when(many, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("repeated_share"),
    )


def top_values(values: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """(by, value, n, rank): the k most frequent values, ties by value."""
    counted = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), value)
    return counted.withColumn("rank", F.row_number().over(w)).where(f"rank <= {int(k)}")


def coverage(df: DataFrame, arrays: dict[str, Column]) -> DataFrame:
    """(kind, id, n): how often each id occurs in columns of id arrays."""

    def tagged(kind: str, ids: Column) -> Column:
        return F.transform(ids, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("id")))

    flat = F.explode(F.concat(*[tagged(k, c) for k, c in arrays.items()]))
    return df.select(flat.alias("x")).groupBy("x.kind", "x.id").agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, dims: list[str]) -> DataFrame:
    """(dimension, value, n) of several columns in one pass; nulls are a value."""
    flat = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims]))
    return df.select(flat.alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
