"""Cleaning and profiling of wide numeric flow tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The known labels of flows, and the spellings that mean them.
BENIGN = "BENIGN"
LABELS = [
    "BENIGN", "DDoS", "PortScan", "Bot", "Infiltration", "FTP-Patator", "SSH-Patator", "DoS GoldenEye", "DoS Hulk",
    "DoS Slowhttptest", "DoS slowloris", "Heartbleed", "Web Attack - Brute Force", "Web Attack - XSS", "Web Attack - Sql Injection",
]
_WEB = {kind: f"Web Attack - {kind}" for kind in ("Brute Force", "XSS", "Sql Injection")}
LABEL_SPELLINGS = {x: x for x in LABELS} | {f"Web Attack{mark}{kind}": name for kind, name in _WEB.items() for mark in (" ", " � ")}
# Texts that count as missing numbers, of which some name an infinity.
NON_FINITE_TEXTS = ["Infinity", "Inf", "-Infinity", "-Inf"]
MISSING_TEXTS = ["", "NaN", "nan", "null", "NULL", "NA", "N/A", "n/a", "#N/A", "None", "<NA>"]


def quoted(name: str) -> Column:
    """A column whose name may hold points or slashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def normalised_names(names: list[str]) -> list[str]:
    """Names without blanks around them; repeated ones get .1, .2 and so on."""
    seen: dict[str, int] = {}
    out = []
    for raw in names:
        name = raw.strip().lstrip("\ufeff").strip()
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normalised_names(df.columns))


def normalise_label(col: Column | str, spellings: dict[str, str] | None = None) -> Column:
    """A label in its known spelling: blanks around dropped and runs of blanks collapsed; unknown ones pass through."""
    raw = F.trim(F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"(?U)\s+", " "))
    table = F.create_map(*[F.lit(x) for pair in (spellings or LABEL_SPELLINGS).items() for x in pair])
    return F.coalesce(F.try_element_at(table, raw), raw)


def coerced(col: Column | str) -> Column:
    """A number, or null for what is none; texts for missing values and infinities are null before the cast."""
    text = F.trim((F.col(col) if isinstance(col, str) else col).cast("string"))
    return F.when(~text.isin(NON_FINITE_TEXTS + MISSING_TEXTS), text).try_cast("double")


def is_non_finite(col: Column) -> Column:
    return F.coalesce(F.abs(col) == F.lit(math.inf), F.lit(False))


def finite(col: Column) -> Column:
    """The number, or null if it is NaN or infinite."""
    return F.when(~F.isnan(col) & (F.abs(col) != F.lit(math.inf)), col)


def binary_label(col: Column | str, benign: str = BENIGN) -> Column:
    return ((F.col(col) if isinstance(col, str) else col) != benign).cast("int")


def clean_numbers(df: DataFrame, features: list[str]) -> DataFrame:
    """All features coerced and made finite in one projection, so that the stage stays one piece of generated code."""
    feature = set(features)
    return df.select(*[finite(coerced(quoted(c))).alias(c) if c in feature else quoted(c) for c in df.columns])


def profile(df: DataFrame, features: list[str]) -> DataFrame:
    """(column_name, missing_count, non_finite_count) of every feature, in one pass over the table.

    Infinities count as missing, too; texts that name an infinity count only as missing.  An empty table gives
    zero counts.
    """
    counts = []
    for i, c in enumerate(features):
        raw = quoted(c)
        numeric = raw.cast("double") if dict(df.dtypes)[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") else coerced(raw)
        counts += [F.count_if(finite(numeric).isNull()).alias(f"m{i}"), F.count_if(is_non_finite(numeric)).alias(f"n{i}")]
    one = df.agg(*counts)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing_count"), F.col(f"n{i}").alias("non_finite_count")) for i, c in enumerate(features)]))
    return one.select(rows.alias("r")).select("r.*")


def distribution(df: DataFrame, label: str, digits: int = 6) -> DataFrame:
    """(label, rows, percent) of each value, nulls included."""
    counted = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("rows"))
    return counted.withColumn("percent", F.round(100.0 * F.col("rows") / F.sum("rows").over(Window.partitionBy()), digits))


def invalid_reasons(df: DataFrame, features: list[str], label: str, known: list[str] | None = None) -> DataFrame:
    """One row: rows in all, with a missing feature, with an unknown label, and with either."""
    missing = reduce(lambda a, b: a | b, [quoted(c).isNull() for c in features], F.lit(False))
    unknown = ~F.coalesce(F.col(label).isin(known or LABELS), F.lit(False))
    return df.agg(F.count("*").alias("rows"), F.count_if(missing).alias("missing_feature"), F.count_if(unknown).alias("unknown_label"), F.count_if(missing | unknown).alias("invalid"))


def valid_rows(df: DataFrame, features: list[str], label: str, known: list[str] | None = None) -> DataFrame:
    missing = reduce(lambda a, b: a | b, [quoted(c).isNull() for c in features], F.lit(False))
    return df.where(~missing & F.coalesce(F.col(label).isin(known or LABELS), F.lit(False)))


def unknown_labels(df: DataFrame, label: str, known: list[str] | None = None) -> DataFrame:
    return df.where(~F.coalesce(F.col(label).isin(known or LABELS), F.lit(False))).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("rows"))


def canonical_zero(col: Column, kind: str) -> Column:
    """-0.0 and 0.0 are one number."""
    return F.when(col == 0, F.lit(0).cast(kind)).otherwise(col) if kind in ("double", "float") else col


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row by ``order`` of each set of equal ``keys``; nulls are equal, and 0.0 equals -0.0.

    The group is one struct minimum, combined before the shuffle, so copies that fill a third of the table cost
    one row per task.
    """
    kinds = dict(df.dtypes)
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*[canonical_zero(quoted(k), kinds[k]).alias(k) for k in keys]).agg(F.min(F.struct(*[quoted(o).alias(f"_o{i}") for i, o in enumerate(order)], *[quoted(c).alias(f"_r{i}") for i, c in enumerate(rest)])).alias("_first"))
    place = {c: i for i, c in enumerate(rest)}
    return grouped.select(*[F.col(f"_first._r{place[c]}").alias(c) if c in place else quoted(c) for c in df.columns])


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows repeat the keys of another, all but the first counted."""
    kinds = dict(df.dtypes)
    return df.groupBy(*[canonical_zero(quoted(k), kinds[k]).alias(f"k{i}") for i, k in enumerate(keys)]).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"))


def cleaning_summary(df: DataFrame, features: list[str], label: str, known: list[str] | None = None) -> DataFrame:
    """One row of rows in, invalid, repeated, and out; the table is read once."""
    missing = reduce(lambda a, b: a | b, [quoted(c).isNull() for c in features], F.lit(False))
    ok = ~missing & F.coalesce(F.col(label).isin(known or LABELS), F.lit(False))
    kinds = dict(df.dtypes)
    keys = [*features, label]
    per = df.groupBy(ok.alias("ok"), *[F.when(ok, canonical_zero(quoted(k), kinds[k])).alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("n"))
    one = per.agg(F.sum("n").alias("rows_in"), F.sum(F.when(~F.col("ok"), F.col("n")).otherwise(0)).alias("invalid_rows"), F.sum(F.when(F.col("ok"), F.col("n") - 1).otherwise(0)).alias("duplicate_rows"), F.count_if("ok").alias("rows_out"))
    return one.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in one.columns])


def feature_frame(df: DataFrame, order: list[str], overrides: dict[str, float] | None = None) -> DataFrame:
    """Exactly the features of ``order``: coerced, 0 where missing or absent, with overridden values."""
    overrides = overrides or {}
    if strange := set(overrides) - set(order):
        raise ValueError(f"overrides of unknown features: {sorted(strange)}")
    have = set(df.columns)
    return df.select(*[F.lit(float(overrides[c])).alias(c) if c in overrides else F.coalesce(finite(coerced(quoted(c))), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c) for c in order])


def feature_gaps(columns: list[str], order: list[str]) -> tuple[list[str], list[str]]:
    """(missing, extra) features of a table against the order of a model."""
    return [c for c in order if c not in columns], [c for c in columns if c not in order]


def confidence_band(col: Column | str, high: float = 0.9, medium: float = 0.6, missing: str = "unavailable") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNull() | F.isnan(c), missing).when(c >= high, "high").when(c >= medium, "medium").otherwise("low")


def prediction_label(col: Column | str) -> Column:
    return F.when((F.col(col) if isinstance(col, str) else col) == 1, "ATTACK").otherwise(BENIGN)


def ground_truth(binary: Column, label: Column) -> Column:
    """The binary label where it is readable, else by the label; null if neither says."""
    return F.coalesce(binary.try_cast("int"), F.when(label.isNotNull() & (F.trim(label) != ""), (F.upper(F.trim(label)) != BENIGN).cast("int")))


def contribution_direction(col: Column) -> Column:
    return F.when(col >= 0, "supports_attack").otherwise("supports_benign")


def contribution_strength(col: Column, high: float = 0.05, moderate: float = 0.02) -> Column:
    size = F.abs(col)
    return F.when(size >= high, "high").when(size >= moderate, "moderate").otherwise("low")
