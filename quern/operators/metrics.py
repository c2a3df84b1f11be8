"""Metrics of classifiers, runs and lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut


def confusion(df: DataFrame, by: list[str], truth: Column, predicted: Column) -> DataFrame:
    """(by, tn, fp, fn, tp) of 0/1 columns; rows with a null in either do not count."""
    hit = lambda t, p: F.count_if((truth == t) & (predicted == p))
    return df.groupBy(*by).agg(hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp"))


def rates(matrix: DataFrame, digits: int = 6) -> DataFrame:
    """``matrix`` with accuracy, precision, recall and f1; 0 where a denominator is 0."""
    part = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), digits)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return matrix.withColumns({"accuracy": part(tp + tn, tn + fp + fn + tp), "precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "f1": part(2 * tp, 2 * tp + fp + fn)})


def roc_auc(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """One row: the area under the ROC curve by ranks, equal scores sharing their mean rank; null without both classes.

    Scores are counted by value and spread over range partitions, equal ones together; a score's rank is its
    place within its partition plus all scores of lower partitions.  So no task orders all scores.
    """
    per = df.select(truth.cast("long").alias("y"), score.alias("s")).where("y is not null and s is not null").groupBy("s").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    ranged = cut(per.repartitionByRange("s").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("n").alias("rows"))
    before = sums.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = ranged.withColumn("upto", upto).join(F.broadcast(before), "part")  # one row a partition
    rank = placed.select("n", "p", (F.col("before") + F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0).alias("r"))
    total = rank.agg(F.sum(F.col("r") * F.col("p")).alias("rs"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    neg = F.col("n") - F.col("p")
    return total.select(F.try_divide(F.col("rs") - F.col("p") * (F.col("p") + 1) / 2.0, F.nullif(F.col("p") * neg, F.lit(0))).alias("auc"))


def deltas(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, delta) over the union of both runs' metrics; a missing metric is 0."""
    x, y = a.select(key, F.col(value).alias("before")), b.select(key, F.col(value).alias("after"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double").alias(c)
    return x.join(y, key, "full").select(key, zero("before"), zero("after")).withColumn("delta", F.col("after") - F.col("before"))


def interpretation(delta: Column, clear: float = -0.05, slight: float = -0.01) -> Column:
    return F.when(delta <= clear, "clear drop").when(delta <= slight, "slight drop").otherwise("stable")


def length_stats(df: DataFrame, by: list[str], length: Column, limit: int, at: tuple[int, ...] = (90, 95, 99)) -> DataFrame:
    """(by, count, min, max, mean, median, p90.., above, above_percent) of integer lengths.

    Percentiles are by nearest rank: the value at the index p / 100 * (count - 1), rounded half to even.  Lengths
    are counted by value before they are ranked.  Null lengths do not count.
    """
    per = df.select(*by, length.cast("long").alias("v")).where("v is not null").groupBy(*by, "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    run = per.withColumn("upto", F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("n", F.sum("c").over(w))
    index = lambda i: F.min(F.when(F.col("upto") > i, F.col("v")))
    n1 = F.col("n") - 1
    cols = [F.max("n").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"), F.round(F.sum(F.col("v") * F.col("c")) / F.max("n"), 2).alias("mean"), F.floor((index(F.floor(n1 / 2)) + index(F.ceil(n1 / 2))) / 2).alias("median")]
    cols += [index(F.bround(n1 * p / 100.0)).alias(f"p{p}") for p in at]
    above = F.sum(F.when(F.col("v") > limit, F.col("c")).otherwise(0))
    return run.groupBy(*by).agg(*cols, above.alias("above"), F.round(100.0 * above / F.max("n"), 3).alias("above_percent"))
