"""A sample whose shares by category are those of given targets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut

#: Buckets of the random keys of a category, by which the boundary of its sample is found.
BUCKETS = 4096


def category(col: Column | str) -> Column:
    """A category value without case and everything but letters and digits; null if nothing is left."""
    plain = F.regexp_replace(F.lower(F.col(col) if isinstance(col, str) else col), r"[^\p{L}\p{N}]+", "")
    return F.when(plain != "", plain)


def availability(records: DataFrame, targets: DataFrame, key: str, dims: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cells, rows): the targets with the number of distinct keys in their cell, and the distinct (key, cell)."""
    joined = F.concat_ws("|", *[category(d) for d in dims])
    whole = None
    for d in dims:
        ok = category(d).isNotNull()
        whole = ok if whole is None else whole & ok
    targets = targets.select(*dims, "target_share", "min_rows", "sample_size")
    cells = targets.withColumn("cell", F.when(whole, joined))
    rows = records.where(whole).select(F.col(key).cast("long").alias("key"), joined.alias("cell")).where("key is not null")
    rows = rows.join(targets.where(whole).select(joined.alias("cell")).distinct(), "cell", "left_semi").distinct()
    counts = rows.groupBy("cell").agg(F.count("*").alias("available"))
    return cells.join(counts, "cell", "left").withColumn("available", F.coalesce("available", F.lit(0).cast("long"))), rows


def quotas(cells: list[tuple[str, float, int, int]], size: int) -> dict[str, int]:
    """Integer quotas by cell from (cell, share, min_rows, available), summing to ``size`` where that can be.

    Each cell gets between its floor (min_rows, as far as available) and what is available.  Between these the
    quotas are in proportion to the shares (the common factor is found by bisection), and the rows left by
    rounding down go to the largest remainders, ties to the cell named first.
    """
    low = {c: min(m, a) for c, _, m, a in cells}
    high = {c: a for c, _, _, a in cells}
    share = {c: max(0.0, s) for c, s, _, _ in cells}
    goal = max(sum(low.values()), min(size, sum(high.values())))

    def level(f: float) -> dict[str, float]:
        return {c: min(high[c], max(low[c], f * share[c])) for c in share}

    lo, hi = 0.0, 1.0
    while sum(level(hi).values()) < goal and hi < 1e18:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(level(mid).values()) < goal else (lo, mid)
    exact = level(hi)
    out = {c: math.floor(v + 1e-9) for c, v in exact.items()}
    for c in sorted(out, key=lambda c: (-(exact[c] - out[c]), c)):
        if sum(out.values()) >= goal:
            break
        if out[c] < high[c]:
            out[c] += 1
    for c in sorted(out):  # cells without a share, if the others cannot fill the sample
        spare = min(goal - sum(out.values()), high[c] - out[c])
        if spare > 0:
            out[c] += spare
    return out


def allocated(cells: DataFrame) -> DataFrame:
    """``cells`` of ``availability`` with wanted, the greater of min_rows and share of the sample, and quota.

    The driver gets one row for each target, allocates the quotas and sends them back.  Targets of one cell share
    its quota.
    """
    spark = cells.sparkSession
    cells = cut(cells)  # one row a target; else the records would be counted again
    found = cells.where("cell is not null").groupBy("cell").agg(F.sum("target_share").alias("share"), F.max("min_rows").alias("least"), F.max("available").alias("available"), F.max("sample_size").alias("size")).collect()
    size = max([int(r["size"] or 0) for r in found], default=0)
    plan = quotas([(r.cell, float(r.share or 0), int(r.least or 0), int(r.available)) for r in found], size)
    quota = spark.createDataFrame(list(plan.items()), "cell string, quota long")
    wanted = F.round(F.greatest(F.coalesce("min_rows", F.lit(0)).cast("double"), F.coalesce(F.col("target_share") * F.col("sample_size"), F.lit(0.0)))).cast("long")
    return cells.withColumn("wanted", wanted).join(quota, "cell", "left").withColumn("quota", F.coalesce("quota", F.lit(0).cast("long")))


def allocation(records: DataFrame, targets: DataFrame, key: str = "record_id", dims: tuple[str, ...] = ("task_type", "ids_label", "difficulty")) -> DataFrame:
    """(dims, target_share, min_rows, sample_size, wanted, quota, available, missing) of every target.

    quota is what ``matched_sample`` draws from the target's cell, missing what the cell lacks of wanted.
    Categories agree once case and everything but letters and digits are dropped; records with a null or blank
    category are in no cell, repeated records count once, and a target with a null or blank category has nothing
    available.  Nulls among a target's numbers count as 0.  Further columns of either table are ignored.
    """
    cells, _ = availability(records, targets, key, list(dims))
    return allocated(cells).withColumn("missing", F.greatest(F.lit(0).cast("long"), F.col("wanted") - F.col("available"))).drop("cell")


def shortfalls(records: DataFrame, targets: DataFrame, key: str = "record_id", dims: tuple[str, ...] = ("task_type", "ids_label", "difficulty")) -> DataFrame:
    """The rows of ``allocation`` that miss something: the cells that cannot be filled."""
    return allocation(records, targets, key, dims).where("missing > 0")


def matched_sample(records: DataFrame, targets: DataFrame, key: str = "record_id", dims: tuple[str, ...] = ("task_type", "ids_label", "difficulty"), seed: int = 42) -> DataFrame:
    """(key, the categories as the targets spell them): a sample of sample_size records with the targets' shares.

    The driver gets one row for each target: quotas are allocated there.  Of each cell the records with the
    smallest random keys are taken: whole buckets of keys below the boundary, and of the boundary's bucket, a
    4096th of the cell, the smallest.  So no task ranks a whole cell, and the choice is the same whatever the
    partitioning.  Repeated records count once; records in no cell are never drawn; further columns are ignored.
    Empty tables give an empty sample.
    """
    cells, rows = availability(records, targets, key, list(dims))
    quota = allocated(cells).where("cell is not null").select("cell", "quota").distinct()
    keyed = rows.withColumn("rnd", F.xxhash64(F.col("key"), F.lit(seed))).withColumn("bucket", F.shiftrightunsigned("rnd", 52).cast("int"))
    per = keyed.groupBy("cell", "bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("cell").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = per.withColumn("before", before).join(quota, "cell").where("before < quota and before + count >= quota").select("cell", F.col("bucket").alias("edge"), (F.col("quota") - F.col("before")).alias("need"))
    joined = keyed.join(edge, "cell")
    inner = joined.where("bucket < edge").select("cell", "key")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.shiftleft("rnd", 12), "key"))
    border = joined.where("bucket = edge").withColumn("rank", rank).where("rank <= need").select("cell", "key")
    spelled = cells.where("cell is not null").groupBy("cell").agg(*[F.min(d).alias(d) for d in dims])
    return inner.unionByName(border).join(spelled, "cell").select(F.col("key").alias(key), *dims)
