"""References to records that do not exist: orphan keys by table and period."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import cut


@dataclass(frozen=True)
class Reference:
    """One referring field: a column of keys, or an array of them, of ``table``."""

    table: str
    frame: DataFrame
    row_key: str
    field: str
    parent: str
    family: str = ""
    at: str = "ingested_at"


def canonical_id(col: Column | str, family: str = "") -> Column:
    """The id in its one spelling: blanks around dropped, CAPEC and CWE ids upper case, others lower case.

    A bare number gets the prefix of ``family``; null and blank give null.
    """
    raw = F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"(?U)^\s+|\s+$", "")
    low = F.lower(raw)
    named = F.when(low.rlike(r"^(capec|cwe)-"), F.upper(raw)).otherwise(low)
    if family:
        named = F.when(raw.rlike(r"^[0-9]+$"), F.concat(F.lit(f"{family}-"), raw)).otherwise(named)
    return F.when(raw != "", named)


def lifetimes(parent: DataFrame, key: Column, born: str = "ingested_at", ended: str = "revoked_at") -> DataFrame:
    """(ref_id, born, ended): a key exists from its earliest ``born`` on, up to its earliest ``ended`` if any row has one."""
    return parent.select(key.alias("ref_id"), F.col(born).alias("_b"), F.col(ended).alias("_e")).where("ref_id is not null").groupBy("ref_id").agg(F.min("_b").alias("born"), F.min("_e").alias("ended"))


def _tagged(ref: Reference) -> Callable[[Column], Column]:
    """A value of a referring field as (field, ref_id, parent)."""

    def tagged(value: Column) -> Column:
        return F.struct(F.lit(ref.field).alias("field"), canonical_id(value, ref.family).alias("ref_id"), F.lit(ref.parent).alias("parent"))

    return tagged


def referring_rows(refs: list[Reference]) -> DataFrame:
    """(tbl, row_key, field, ref_id, at, parent) of every non-null reference; a table is scanned once for all its fields."""
    scans: dict[tuple, list[Reference]] = {}
    for r in refs:
        scans.setdefault((id(r.frame), r.table, r.row_key, r.at), []).append(r)
    parts = []
    for same in scans.values():
        frame, one = same[0].frame, same[0]
        flat = []
        for r in same:
            listed = frame.schema[r.field].dataType.typeName() == "array"
            flat.append(F.coalesce(F.transform(r.field, _tagged(r)), F.array()) if listed else F.array(_tagged(r)(F.col(r.field))))
        rows = frame.select(F.col(one.row_key).cast("long").alias("row_key"), F.col(one.at).alias("at"), F.explode(F.concat(*flat)).alias("r"))
        parts.append(rows.select(F.lit(one.table).alias("tbl"), "row_key", "r.field", "r.ref_id", "at", "r.parent").where("ref_id is not null"))
    return reduce(DataFrame.unionByName, parts)


def orphan_references(refs: list[Reference], parents: dict[str, DataFrame]) -> DataFrame:
    """(tbl, period, row_key, field, ref_id, reason) of every reference to a record that is not there.

    The distinct keys are first held against the parents by a left anti-join (those that never exist) and an
    inner join (those that exist for a time only); the few keys with a bounded or late life are then joined back
    to the rows.  reason is ``missing`` (no such key at any time), ``late`` (the row is older than the key) or
    ``deleted`` (the row is as old as the end of the key, or younger).  A key that is born after its end counts
    as ``late`` before its birth and as ``deleted`` from then on.  Rows with a null time are held only against
    ``missing``, with a null period.  Null and blank keys are no references.
    """
    rows = referring_rows(refs)
    born = reduce(DataFrame.unionByName, [p.withColumn("parent", F.lit(name)) for name, p in parents.items()])
    # Partial aggregation leaves one row per key and task before the shuffle, however often a key is referred to.
    keys = cut(rows.groupBy("parent", "ref_id").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at")))
    never = keys.join(born, ["parent", "ref_id"], "left_anti").select("parent", "ref_id", F.lit(None).cast("timestamp_ntz").alias("born"), F.lit(None).cast("timestamp_ntz").alias("ended"), F.lit(True).alias("never"))
    partly = keys.join(born, ["parent", "ref_id"]).where("first_at < born or last_at >= ended").select("parent", "ref_id", F.col("born").cast("timestamp_ntz").alias("born"), F.col("ended").cast("timestamp_ntz").alias("ended"), F.lit(False).alias("never"))
    at = F.col("at").cast("timestamp_ntz")
    reason = F.when(F.col("never"), "missing").when(at < F.col("born"), "late").when(at >= F.col("ended"), "deleted")
    return (
        rows.join(never.unionByName(partly), ["parent", "ref_id"])
        .select("tbl", F.date_format("at", "yyyy-MM").alias("period"), "row_key", "field", "ref_id", reason.alias("reason"))
        .where("reason is not null")
        .distinct()
    )


def orphan_counts(found: DataFrame) -> DataFrame:
    """(tbl, period, field, reason, orphans, distinct_refs): orphan references counted by table and month."""
    return found.groupBy("tbl", "period", "field", "reason").agg(F.count("*").alias("orphans"), F.countDistinct("ref_id").alias("distinct_refs"))
