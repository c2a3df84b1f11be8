"""Splits that keep related records together."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.overlap import split_name
from quern.operators.components import connected_components
from quern.operators.sampling import spread_rank
from quern.session import cut

# Ids that tie nothing.
NO_TIE = ["", "unknown", "n/a", "none", "-"]


def tie(col: Column | str) -> Column:
    """An id as it ties records: case and blanks around it ignored, stand-ins null."""
    low = F.lower(F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"(?U)^\s+|\s+$", ""))
    return F.when(~low.isin(NO_TIE), low)


def grouped(records: DataFrame, key: str, ties: list[str], split: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, groups).  records: (record_id, vertex, mask) without repeated deliveries; vertex is null if nothing
    ties the record.  groups: (vertex, group_id, size, mask, whole_mask): each vertex with its group.

    A vertex is one value of one tying column; records that carry several values tie them together.  mask has a
    bit for each split.
    """
    mask = F.lit(0)
    if split:
        name = split_name(split)
        mask = F.when(name == "train", 1).when(name == "validation", 2).when(name == "test", 4).otherwise(0)
    vertices = [F.xxhash64(F.lit(c), tie(c)) for c in ties]
    found = F.array_compact(F.array(*[F.when(tie(c).isNotNull(), v) for c, v in zip(ties, vertices)]))
    rows = records.select(F.col(key).cast("long").alias("record_id"), found.alias("v"), mask.cast("int").alias("mask")).where("record_id is not null").distinct()
    edges = rows.where("size(v) > 1").select(F.col("v")[0].alias("u"), F.explode(F.slice("v", 2, len(ties))).alias("w")).distinct()
    comps = connected_components(edges, "u", "w")
    flat = rows.select("record_id", F.get("v", F.lit(0)).alias("vertex"), "mask")
    per_vertex = flat.where("vertex is not null").groupBy("vertex").agg(F.min("record_id").alias("low"), F.countDistinct("record_id").alias("n"), F.bit_or("mask").alias("m"))
    placed = per_vertex.join(comps.select(F.col("node").alias("vertex"), "component"), "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    groups = placed.groupBy("component").agg(F.min("low").alias("group_id"), F.sum("n").alias("size"), F.bit_or("m").alias("mask"))
    return flat, placed.select("vertex", "component").join(groups, "component").select("vertex", "group_id", "size", "mask")


def torn_groups(records: DataFrame, key: str = "record_id", ties: tuple[str, ...] = ("base_context_id", "sample_id"), split: str = "split") -> DataFrame:
    """(record_id, group_id): all records of each group that holds more than one split.

    group_id is the smallest record_id of the group.  Records without a split are listed with their group;
    records that nothing ties are groups of their own and never torn.  Repeated rows count once.
    """
    flat, groups = grouped(records, key, list(ties), split)
    torn = groups.where(F.bit_count("mask") > 1).select("vertex", "group_id")
    return flat.join(torn, "vertex").select("record_id", "group_id").distinct()


def turns(left: dict[str, Fraction], n: int, groups: int) -> list[tuple[int, list[str]]]:
    """How ``groups`` groups of ``n`` records are assigned in turn, each to the split of which most is left.

    The result is (rank from 0, splits): from that rank on the splits take turns.  ``left`` is reduced by what is
    assigned; ties go to the split named first.  There are at most as many entries as splits.
    """
    names, out, at = list(left), [], 0
    while at < groups:
        top = max(names, key=lambda s: left[s])
        rounds = {}
        for s in names:
            # whole rounds that ``top`` is ahead of s
            rounds[s] = (left[top] - left[s]) // n
            if rounds[s] and left[top] - left[s] == rounds[s] * n and names.index(s) < names.index(top):
                rounds[s] -= 1
        cycle = sorted((s for s in names if not rounds[s]), key=lambda s: (-left[s], names.index(s)))
        take = min([groups - at, *(r * len(cycle) for r in rounds.values() if r)])
        out.append((at, cycle))
        for i, s in enumerate(cycle):
            left[s] -= n * (take // len(cycle) + (i < take % len(cycle)))
        at += take
    return out


def assign_splits(records: DataFrame, key: str = "record_id", ties: tuple[str, ...] = ("base_context_id", "sample_id"), shares: dict[str, float] | None = None) -> DataFrame:
    """(record_id, group_id, split): every record with a split of the given shares, tied records together.

    All groups are assigned largest first, each to the split furthest below its target; ties go to the split named
    first.  Groups of one size come in a random order that depends on their group_id alone, so that only their
    number is needed to know whose turn it is: the driver receives one row for each size that occurs.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    flat, groups = grouped(records, key, list(ties))
    # a record counts once, however often it was delivered and with whichever split
    named = cut(flat.select("record_id", "vertex").distinct().join(groups.select("vertex", "group_id", "size"), "vertex", "left").select("record_id", F.coalesce("group_id", "record_id").alias("group_id")))
    sizes = named.groupBy("group_id").agg(F.count("*").alias("n"))
    classes = sorted(((r.n, r.many) for r in sizes.groupBy("n").agg(F.count("*").alias("many")).collect()), reverse=True)
    parts = {name: Fraction(str(share)) for name, share in shares.items()}
    total = sum(n * many for n, many in classes)
    left = {name: part * total / sum(parts.values()) for name, part in parts.items()}
    order = records.sparkSession.createDataFrame([(n, turns(left, n, many)) for n, many in classes], "n long, turns array<struct<start: long, cycle: array<string>>>")
    placed = spread_rank(sizes, ["n"], "group_id").join(F.broadcast(order), "n").withColumn("at", F.col("rank") - 1)
    turn = F.element_at(F.filter("turns", lambda t: t["start"] <= F.col("at")), -1)
    split = placed.withColumn("turn", turn).select("group_id", F.get("turn.cycle", ((F.col("at") - F.col("turn.start")) % F.size("turn.cycle")).cast("int")).alias("split"))
    return named.join(split, "group_id").select("record_id", "group_id", "split")
