"""What supports a statement: completeness of evidence, its depth, repeated patterns and concentrated sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that mark a step of reasoning; tasks whose answers need a second look; the longest cell of a flat row.
MARKERS = ["observation", "evidence", "reasoning", "conclusion", "limitation"]
RISKY_TASKS = ["vulnerability_context", "uncertainty_evidence_gap", "multi_turn_analyst_interaction"]
CELL = 26_000


def reasoning_depth(text: Column, keys: list[str]) -> Column:
    """The length of the first of ``keys`` that holds a list in a JSON text, else the number of MARKERS in the text; 0 for null."""
    found = [F.json_array_length(F.get_json_object(text, f"$.{k}")) for k in keys]
    low = F.lower(F.coalesce(text, F.lit("")))
    marks = reduce(lambda a, b: a + b, [F.contains(low, F.lit(m)).cast("int") for m in MARKERS])
    return F.coalesce(*found, marks)


def severity_level(score: Column, confidence: Column) -> Column:
    """critical from a score of 9 on, high from 7 or a confidence of 0.9 on, medium from a confidence of 0.6 on, else low; nulls count as 0."""
    s, c = F.coalesce(score, F.lit(0.0)), F.coalesce(confidence, F.lit(0.0))
    return F.when(s >= 9, "critical").when((s >= 7) | (c >= 0.9), "high").when(c >= 0.6, "medium").otherwise("low")


def completeness(df: DataFrame, lists: dict[str, str]) -> DataFrame:
    """``df`` with a flag for each list column that is neither null nor empty, and ``gaps``, the names of the others."""
    out = df.withColumns({flag: F.coalesce(F.size(c), F.lit(0)) > 0 for flag, c in lists.items()})
    return out.withColumn("gaps", F.array_compact(F.array(*[F.when(~F.col(flag), F.lit(flag)) for flag in lists])))


def distinct_patterns(df: DataFrame, by: list[str], items: str, k: int = 4) -> DataFrame:
    """(by, rows, patterns): how many different beginnings of ``k`` items the lists of each group have; null lists count as none."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.countDistinct(F.slice(items, 1, k)).alias("patterns"))


def repeated_patterns(df: DataFrame, items: str, k: int = 5, more_than: int = 5) -> DataFrame:
    """(pattern, rows): beginnings of ``k`` items that more than so many rows have, as one text."""
    pattern = F.array_join(F.slice(items, 1, k), ",")
    return df.where(F.col(items).isNotNull()).groupBy(pattern.alias("pattern")).agg(F.count("*").alias("rows")).where(F.col("rows") > more_than)


def concentrated(df: DataFrame, source: str, over: float = 0.35) -> DataFrame:
    """(source, rows, percentage): sources of more than the share ``over`` of all rows."""
    per = df.groupBy(source).agg(F.count("*").alias("rows"))
    total = F.sum("rows").over(Window.partitionBy())  # one row a source by now
    return per.withColumn("_share", F.col("rows") / total).where(F.col("_share") > over).select(source, "rows", F.round(F.col("_share") * 100, 3).alias("percentage"))


def risky(band: Column, has_vulnerability: Column, task: Column) -> Column:
    """Whether an answer needs a second look: low or medium confidence, a vulnerability, or a risky task."""
    return F.coalesce(band.isin("low", "medium"), F.lit(False)) | F.coalesce(has_vulnerability, F.lit(False)) | F.coalesce(task.isin(RISKY_TASKS), F.lit(False))


def flat_cell(text: Column, limit: int = CELL) -> Column:
    """A text cut to what a cell holds; null gives ''."""
    return F.substring(F.coalesce(text, F.lit("")), 1, limit)
