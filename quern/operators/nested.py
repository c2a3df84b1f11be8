"""Deeply nested records as related flat tables, by adjacency-table shredding.

Every JSON text becomes rows of one adjacency table: a node has its parent, its label, its ordinal among the
parent's children of that label and, if it is a scalar, its value.  Object nodes are then joined with their
scalar children and pivoted into flat tables; since an object and its scalars leave the shredder side by side,
the join is a grouping on the owning object that is nearly finished before anything is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import ensure_importable


def _value(x: object) -> object:
    """JSON kept as a string counts as what it holds."""
    while isinstance(x, str) and x.lstrip()[:1] in ("{", "["):
        try:
            x = json.loads(x)
        except (ValueError, RecursionError):
            return x
    return x


def _text(x: object) -> str:
    s = x if isinstance(x, str) else json.dumps(x)
    return s.encode("utf-8", "replace").decode("utf-8")


def parse(text: str | None) -> object:
    """The value of a JSON text; None if it is null, empty or unreadable.  A byte order mark does not matter."""
    if text is None:
        return None
    text = text.lstrip("\ufeff \t\r\n\0")
    while True:  # a string holds less than its JSON text, so this ends
        try:
            x = json.loads(text)
        except (ValueError, RecursionError):
            return None
        if not isinstance(x, str):
            return x
        text = x.lstrip("\ufeff \t\r\n")


def unwrapped(x: object, wrappers: Iterable[str], known: Iterable[str]) -> object:
    """``x`` without objects around the whole record: those that have a wrapper's name but none of the known fields."""
    wrappers, known = list(wrappers), set(known)
    while isinstance(x, dict) and not known & x.keys():
        inner = next((v for w in wrappers if isinstance(v := _value(x.get(w)), dict)), None)
        if inner is None:
            return x
        x = inner
    return x


def adjacency(x: object, scalars: set[str] | None = None) -> Iterator[tuple[int, int, str, int, str, str | None]]:
    """(node, parent, label, ordinal, path, scalar) of each node of an object; the root is node 0 with parent -1.

    ``path`` holds the labels from the root on, joined by points.  The elements of a list are children of the
    list's owner with the list's label; a lone value is the element 0 of its label; a list in a list is one
    node of label ``item``.  Nulls give no node, but count as places of their list.  Objects have no scalar.
    ``scalars``: keep only scalars of these labels.
    """
    if not isinstance(x, dict):
        return
    number = 0
    yield 0, -1, "", 0, "", None
    stack: list[tuple[int, dict, str]] = [(0, x, "")]
    while stack:
        owner, obj, path = stack.pop()
        for label, raw in obj.items():
            value = _value(raw)
            for i, v in enumerate(value if isinstance(value, list) else [value]):
                v = _value(v)
                if v is None:
                    continue
                if isinstance(v, list):
                    v = {"item": v}
                if isinstance(v, dict):
                    number += 1
                    here = f"{path}.{label}" if path else label
                    yield number, owner, label, i, here, None
                    stack.append((number, v, here))
                elif scalars is None or label in scalars:
                    number += 1
                    yield number, owner, label, i, f"{path}.{label}" if path else label, _text(v)


def newest(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The newest row of each key by ``time``, nulls last; of rows as new the one with the greatest ``tie``."""
    w = Window.partitionBy(key).orderBy(F.col(time).desc_nulls_last(), F.col(tie).desc_nulls_last())
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def shredded(records: DataFrame, key: str, text: str, scalars: list[str] | None = None, wrappers: Iterable[str] = (), known: Iterable[str] = ()) -> DataFrame:
    """The adjacency table (key, node, parent, label, ordinal, path, scalar, is_object) of the JSON texts.

    Null, empty and unreadable texts, and texts that hold no object, give no rows.
    """
    ensure_importable(records.sparkSession)
    keep, wrap, fields = set(scalars) if scalars is not None else None, list(wrappers), list(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(keys), 200):
                rows: list[tuple] = []
                owner: list[int] = []
                for i in range(lo, min(lo + 200, len(keys))):
                    before = len(rows)
                    rows.extend(adjacency(unwrapped(parse(texts[i].as_py()), wrap, fields), keep))
                    owner += [i] * (len(rows) - before)
                if rows:
                    node, parent, label, ordinal, path, scalar = zip(*rows)
                    values = pa.array(scalar, pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(owner)), pa.array(node, pa.int32()), pa.array(parent, pa.int32()), pa.array(label, pa.string()), pa.array(ordinal, pa.int32()), pa.array(path, pa.string()), values, values.is_null()],
                        names=[key, "node", "parent", "label", "ordinal", "path", "scalar", "is_object"],
                    )

    kind = dict(records.dtypes)[key]
    return records.select(key, text).mapInArrow(run, f"`{key}` {kind}, node int, parent int, label string, ordinal int, path string, scalar string, is_object boolean")


def objects(nodes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, node, parent, label, ordinal, path, one column for each scalar label) of every object node.

    Of a list of scalars the first is taken; a missing scalar is null.
    """
    owner = F.when(F.col("is_object"), F.col("node")).otherwise(F.col("parent"))
    own = lambda c: F.max(F.when(F.col("is_object"), F.col(c))).alias(c)
    pivot = [F.min(F.when(~F.col("is_object") & (F.col("label") == c), F.struct("ordinal", "scalar")))["scalar"].alias(f"s_{c}") for c in columns]
    return nodes.groupBy(F.col(key), owner.alias("owner")).agg(own("parent"), own("label"), own("ordinal"), own("path"), *pivot).withColumnRenamed("owner", "node")


# The fields of a retrieval context that are no entity lists.
CONTEXT_FIELDS = ["prediction", "classifier", "classifier_confidence", "retrieval", "attack", "provenance", "entities", "latency_ms", "relationships_traversed", "confidence"]
_KNOWN = ["prediction", "classifier", "attack", "entities", "retrieval", "provenance"]


def context_objects(contexts: DataFrame, columns: list[str]) -> DataFrame:
    """The objects of the newest delivery of each retrieval context, wrappers aside."""
    last = newest(contexts.select("context_id", "context_json", "loaded_at").where("context_id is not null"), "context_id", "loaded_at", "context_json")
    return objects(shredded(last, "context_id", "context_json", columns, ["context", "data"], _KNOWN), "context_id", columns)


def _is_entity() -> Column:
    steps = F.split("path", r"\.")
    root = (F.size(steps) == 1) & ~F.col("path").isin(CONTEXT_FIELDS) & (F.col("path") != "")
    return root | ((F.size(steps) == 2) & steps[0].isin("attack", "entities"))


def entities_of(objs: DataFrame) -> DataFrame:
    """The entity objects with their category, whether they stand under ``entities``, ``attack`` or in the root."""
    return objs.where(_is_entity()).withColumn("category", F.col("label"))


def context_tables(contexts: DataFrame) -> dict[str, DataFrame]:
    """The flat tables contexts, entities and provenance; each row of the latter two points to its parent."""
    objs = context_objects(contexts, ["prediction", "latency_ms", "relationships_traversed", "confidence", "classifier_confidence", "id", "entity_id", "name", "rank_score", "distance", "attack_id", "source", "relationship_type", "inferred", "origin_node", "target_node", "method"])
    sub = lambda name, *cols: objs.where(F.col("path") == name).select("context_id", *[F.col(f"s_{c}").alias(f"{name}_{c}") for c in cols])
    heads = (
        objs.where("node = 0")
        .join(sub("classifier", "confidence"), "context_id", "left")
        .join(sub("retrieval", "latency_ms", "relationships_traversed"), "context_id", "left")
        .select(
            "context_id", F.col("s_prediction").alias("prediction"), F.coalesce("classifier_confidence", "s_classifier_confidence", "s_confidence").try_cast("double").alias("confidence"),
            F.coalesce("retrieval_latency_ms", "s_latency_ms").try_cast("double").alias("latency_ms"), F.coalesce("retrieval_relationships_traversed", "s_relationships_traversed").try_cast("int").alias("relationships_traversed"),
        )
    )
    entities = entities_of(objs)
    props = objs.where("label = 'properties' and ordinal = 0").select("context_id", F.col("parent").alias("node"), F.col("s_attack_id").alias("p_attack_id"))
    flat = entities.join(props, ["context_id", "node"], "left").select(
        "context_id", F.col("node").alias("entity_node"), "category", F.col("ordinal").alias("entity_pos"), F.coalesce("s_id", "s_entity_id", F.lit("")).alias("entity_id"),
        F.col("s_name").alias("name"), F.col("s_rank_score").try_cast("double").alias("rank_score"), F.col("s_distance").try_cast("int").alias("distance"), F.coalesce("p_attack_id", F.lit("")).alias("attack_id"),
    )
    prov = objs.where("label = 'provenance'").join(entities.select("context_id", F.col("node").alias("parent")), ["context_id", "parent"], "left_semi").select(
        "context_id", F.col("parent").alias("entity_node"), F.col("ordinal").alias("prov_pos"), F.col("s_source").alias("source"), F.coalesce("s_relationship_type", F.lit("")).alias("relationship_type"),
        F.col("s_confidence").alias("confidence"), F.col("s_inferred").try_cast("boolean").alias("inferred"), F.col("s_origin_node").alias("origin_node"), F.col("s_target_node").alias("target_node"),
    )
    return {"contexts": heads, "entities": flat, "provenance": prov}


def provenance_rows(contexts: DataFrame) -> DataFrame:
    """(context_id, category, entity_pos, prov_pos, entity_id, relationship_type, attack_id): one row for each
    provenance entry of each entity; an entity without one gives a row with prov_pos -1.
    """
    objs = context_objects(contexts, ["id", "entity_id", "attack_id", "relationship_type"])
    # An entity, its properties and its provenance entries meet in one window by the entity's node: no table is
    # read or joined twice, and no list is built.  A window is what one entity of one text holds.
    role = F.when(_is_entity(), "entity").when((F.col("label") == "properties") & (F.col("ordinal") == 0), "properties").when(F.col("label") == "provenance", "provenance")
    parts = objs.withColumn("role", role).where("role is not null").withColumn("entity", F.expr("case when role = 'entity' then node else parent end"))
    when = lambda name, col: F.when(F.col("role") == name, col)
    own = Window.partitionBy("context_id", "entity")
    return (
        parts.select(
            "context_id", "role", F.col("ordinal").alias("prov_pos"), F.col("s_relationship_type").alias("relationship_type"),
            F.max(when("entity", F.struct("label", "ordinal", F.coalesce("s_id", "s_entity_id", F.lit("")).alias("entity_id")))).over(own).alias("e"),
            F.max(when("properties", F.col("s_attack_id"))).over(own).alias("attack_id"),
            F.count(when("provenance", F.lit(1))).over(own).alias("entries"),
        )
        .where("e is not null and (role = 'provenance' or role = 'entity' and entries = 0)")
        .select(
            "context_id", F.col("e.label").alias("category"), F.col("e.ordinal").alias("entity_pos"), F.when(F.col("role") == "provenance", F.col("prov_pos")).otherwise(-1).alias("prov_pos"),
            "e.entity_id", F.when(F.col("role") == "provenance", F.coalesce("relationship_type", F.lit(""))).otherwise("").alias("relationship_type"), F.coalesce("attack_id", F.lit("")).alias("attack_id"),
        )
    )
