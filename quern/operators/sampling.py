"""Ranks, splits and samples that depend only on keys and a seed, without ordering a whole group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(key: Column | str, seed: str = "42") -> Column:
    """A reproducible random order: the MD5 of seed and key."""
    return F.md5(F.concat(F.lit(seed + ":"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def spread_rank(df: DataFrame, by: list[str], key: str, seed: str = "42") -> DataFrame:
    """``df`` with ``rank`` and ``group_rows``: the place of each row in its group in random order, and the group's size.

    Rows are counted by the first three digits of their random key; a row's rank is its place within its digits
    plus the rows with lower ones.  So a group of any size is ranked by 4096 tasks' shares, never by one.
    ``key`` must tell rows apart; nulls in ``by`` form a group.
    """
    marked = df.withColumns({"_r": shuffled(F.coalesce(F.col(key).cast("string"), F.lit("")), seed)}).withColumn("_b", F.substring("_r", 1, 3))
    groups = [F.coalesce(F.col(b).cast("string"), F.lit("\0")).alias(f"_g{i}") for i, b in enumerate(by)]
    names = [f"_g{i}" for i in range(len(by))]
    marked = marked.select("*", *groups)
    per = marked.groupBy(*names, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*names)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("group_rows", F.sum("_n").over(w))
    own = F.row_number().over(Window.partitionBy(*names, "_b").orderBy("_r", key))
    out = marked.join(per.drop("_n"), [*names, "_b"]).withColumn("rank", (F.col("_before") + own).cast("long"))
    return out.drop(*names, "_b", "_before", "_r")


def by_shares(rank: Column, rows: Column, shares: dict[str, float]) -> Column:
    """The split of a rank: the first floor(share * rows) ranks go to the first split, and so on; the last takes the rest."""
    names = list(shares)
    upto, bounds = 0.0, []
    for n in names[:-1]:
        upto += shares[n]
        bounds.append((n, F.floor(F.lit(round(upto, 9)) * rows)))
    out = F.lit(names[-1])
    for n, bound in reversed(bounds):
        out = F.when(rank <= bound, F.lit(n)).otherwise(out)
    return out


SHARES = {"train": 0.7, "validation": 0.15, "test": 0.15}


def stratified_split(df: DataFrame, label: str, key: str, shares: dict[str, float] | None = None, seed: str = "42") -> DataFrame:
    """``df`` with ``split``: exact shares within every label."""
    return spread_rank(df, [label], key, seed).withColumn("split", by_shares(F.col("rank"), F.col("group_rows"), shares or SHARES)).drop("rank", "group_rows")


def group_split(df: DataFrame, group: str, shares: dict[str, float] | None = None, seed: str = "42") -> DataFrame:
    """``df`` with ``split``: exact shares of groups, all rows of a group in one split; a null group is a group."""
    groups = df.select(F.coalesce(F.col(group), F.lit("")).alias("_group")).distinct()
    placed = spread_rank(groups, [], "_group", seed).select("_group", by_shares(F.col("rank"), F.col("group_rows"), shares or SHARES).alias("split"))
    return df.withColumn("_group", F.coalesce(F.col(group), F.lit(""))).join(placed, "_group").drop("_group")


def stratified_sample(df: DataFrame, strata: list[str], key: str, size: int, least: int = 1, seed: str = "42") -> DataFrame:
    """At least ``least`` rows of each stratum (as far as there are), filled up to ``size`` rows at random."""
    ranked = spread_rank(df, strata, key, seed).withColumn("_first", F.col("rank") <= least)
    floor = ranked.where("_first").select(*df.columns)
    count = floor.agg(F.count("*").alias("_have"))
    rest = spread_rank(ranked.where("not _first").select(*df.columns), [], key, seed + "f").crossJoin(F.broadcast(count))
    return floor.unionByName(rest.where(F.col("rank") <= size - F.col("_have")).select(*df.columns))


def capped_sample(df: DataFrame, label: str, source: str, key: str, per_label: int, seed: str = "42") -> DataFrame:
    """Up to ``per_label`` rows of each label: first a third of that from every source, then whatever is left."""
    inner = spread_rank(df, [label, source], key, seed).withColumn("_late", (F.col("rank") > per_label // 3).cast("int")).drop("rank", "group_rows")
    w = Window.partitionBy(label).orderBy("_late", shuffled(key, seed), key)
    return inner.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_label).drop("_n", "_late")


def per_label(df: DataFrame, label: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """``n`` rows of each label; each task keeps ``n`` of a label before the shuffle."""
    w = Window.partitionBy(label).orderBy(shuffled(key, seed), key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def disjoint_sets(df: DataFrame, key: str, sets: list[tuple[str, Column, int]], seed: str = "42") -> DataFrame:
    """(.., set_name): for each (name, predicate, n) in turn ``n`` rows that satisfy it and are in no earlier set."""
    left, out = df, []
    for name, predicate, n in sets:
        part = left.where(predicate).orderBy(shuffled(key, seed + name), key).limit(n)
        out.append(part.withColumn("set_name", F.lit(name)))
        left = left.join(part.select(key), key, "left_anti")
    return reduce(DataFrame.unionByName, out)


def round_robin(df: DataFrame, key: str, values: list[str], prefix: str, seed: str = "42") -> DataFrame:
    """``df`` with a running number, an id made of it, and ``values`` in turn."""
    ranked = spread_rank(df, [], key, seed)
    pick = F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col("rank") - 1, F.lit(len(values))) + 1).cast("int"))
    return ranked.withColumn("value", pick).withColumn("serial", F.concat(F.lit(prefix), F.lpad(F.col("rank").cast("string"), 5, "0"))).drop("group_rows")


def even_spaced(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows at even distances in the order of a dense integer ``key`` starting at 0."""
    total = df.agg(F.count("*").alias("_total"))
    picks = df.sparkSession.range(n).crossJoin(total).select(F.floor(F.col("id") * F.col("_total") / n).cast("long").alias(key)).distinct()
    return df.join(picks, key)


def leaking_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    """(group, splits): groups whose rows stand in more than one split."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.countDistinct(split).alias("_n")).where("_n > 1").drop("_n")
