"""Near-duplicate records with small edits, by inverted lists of their rarest words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.prefixes import alike
from quern.operators.components import connected_components
from quern.session import cut


def near_duplicate_classes(records: DataFrame, key: str, text: str, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes, members) of the near-duplicates of ``records``; see ``prefixes.alike``.

    A class is the rows of one multiset of words.  Rows with a null key are left out; null texts count as empty
    and texts without a word resemble nothing.  Repeated rows count once; further columns are ignored.
    """
    texts = records.select(F.col(key).cast("long").alias("row"), F.lit(0).cast("byte").alias("side"), F.col(text).alias("text")).where("row is not null")
    return alike(texts, percent)


def near_duplicate_pairs(records: DataFrame, key: str, text: str, percent: int = 85) -> DataFrame:
    """(record_id_a, record_id_b; the smaller first): the pairs of rows whose likeness is at least ``percent`` / 100."""
    pairs, members = near_duplicate_classes(records, key, text, percent)
    m = members.select("row", "id").distinct()
    a, b = m.select(F.col("row").alias("x"), F.col("id").alias("a")), m.select(F.col("row").alias("y"), F.col("id").alias("b"))
    between = pairs.select("a", "b").join(a, "a").join(b, "b").where("x != y")
    copies = a.join(b, F.col("a") == F.col("b")).where("x < y")
    return between.select("x", "y").unionByName(copies.select("x", "y")).select(F.least("x", "y").alias("record_id_a"), F.greatest("x", "y").alias("record_id_b")).distinct()


def near_duplicate_groups(records: DataFrame, key: str, text: str, percent: int = 85) -> DataFrame:
    """(record_id, group_id, class_rows, links): one row for each record that resembles another.

    group_id is the smallest record_id that links lead to; class_rows counts the records with the same multiset
    of words (exact copies are never paired with each other here), links the other classes that resemble it.
    Records without a copy or a link are left out.
    """
    pairs, members = near_duplicate_classes(records, key, text, percent)
    pairs = cut(pairs.select("a", "b"))
    rows = members.select("row", "id").distinct()
    comps = connected_components(pairs, "a", "b")
    links = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    classes = rows.groupBy("id").agg(F.min("row").alias("low"), F.count("*").alias("class_rows")).join(comps.select(F.col("node").alias("id"), "component"), "id", "left").join(links, "id", "left")
    classes = classes.select("id", "low", "class_rows", F.coalesce("component", "id").alias("component"), F.coalesce("links", F.lit(0).cast("long")).alias("links")).where("class_rows > 1 or links > 0")
    groups = classes.groupBy("component").agg(F.min("low").alias("group_id"))
    return rows.join(classes.join(groups, "component").select("id", "group_id", "class_rows", "links"), "id").select(F.col("row").alias("record_id"), "group_id", "class_rows", "links")
