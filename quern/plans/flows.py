"""Queries over flow-like tables: cleaning, profiles, distributions.  lineitem stands for a wide flow table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import cleaning as C
from quern.session import table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "rate"]
KNOWN = ["A", "N"]


def _flows(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with a rate that is infinite or NaN where the discount is 0, as flow rates are for empty flows."""
    rate = F.when(F.col("l_discount") != 0, F.col("l_extendedprice") / F.col("l_discount")).when(F.col("l_tax") != 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", rate.alias("rate"))


_F = """with flows as (select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
  case when l_discount <> 0 then l_extendedprice / l_discount when l_tax <> 0 then 'inf'::double else 'nan'::double end rate from lineitem),
clean as (select * replace (case when isfinite(rate) then rate end as rate) from flows) """
_PROFILE = " union all ".join(f"select '{c}' column_name, count(*) filter ({c} is null or not isfinite({c})) missing_count, count(*) filter (isinf({c})) non_finite_count from flows" for c in FEATURES)
_ANY = " or ".join(f"{c} is null" for c in FEATURES)


def flow_profile(spark, d):
    return C.profile(_flows(spark, d), FEATURES)


def flow_label_distribution(spark, d):
    return C.distribution(table(spark, d, "lineitem"), "l_returnflag")


def flow_invalid_rows(spark, d):
    return C.invalid_reasons(C.clean_numbers(_flows(spark, d), FEATURES), FEATURES, "l_returnflag", KNOWN)


def flow_unknown_labels(spark, d):
    return C.unknown_labels(_flows(spark, d), "l_returnflag", KNOWN)


def flow_cleaning_summary(spark, d):
    return C.cleaning_summary(C.clean_numbers(_flows(spark, d), FEATURES), FEATURES, "l_returnflag", KNOWN)


def flow_clean_by_label(spark, d):
    """The cleaned table itself, summed up by its binary label."""
    clean = C.valid_rows(C.clean_numbers(_flows(spark, d), FEATURES), FEATURES, "l_returnflag", KNOWN)
    first = C.keep_first(clean, [*FEATURES, "l_returnflag"], ["l_orderkey", "l_linenumber"])
    return first.groupBy(C.binary_label("l_returnflag", "N").alias("binary_label")).agg(F.count("*").alias("rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.min("l_orderkey").alias("first_order"))


def flow_keep_first(spark, d):
    """Events once per user, type and value: the first by time."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    return C.keep_first(e, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


def flow_duplicate_rows(spark, d):
    return C.duplicate_rows(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])


def label_normalisation(spark, d):
    t = table(spark, d, "corpus_records")
    return t.groupBy(C.normalise_label("ids_label").alias("label")).agg(F.count("*").alias("rows"), F.count_if(C.normalise_label("ids_label").isin(C.LABELS)).alias("known"))


def number_coercion(spark, d):
    t = table(spark, d, "generations").select(C.coerced("raw_output").alias("a"), C.coerced(F.regexp_extract("output", r"score ([0-9.]+[0-9])", 1)).alias("b"), C.coerced(F.col("prompt_tokens")).alias("c"))
    return t.agg(F.count("a").alias("numeric_outputs"), F.count("b").alias("scores"), F.round(F.avg("b"), 6).alias("mean_score"), F.sum("c").cast("long").alias("prompt_tokens"))


def confidence_bands(spark, d):
    """Bands under each of the three pairs of thresholds."""
    t = table(spark, d, "gold_records")
    pairs = [("a", 0.9, 0.6), ("b", 0.85, 0.6), ("c", 0.9, 0.5)]
    bands = F.explode(F.array(*[F.struct(F.lit(n).alias("thresholds"), C.confidence_band("model_confidence", h, m).alias("band")) for n, h, m in pairs]))
    return t.select(bands.alias("x")).groupBy("x.thresholds", "x.band").agg(F.count("*").alias("rows"))


def feature_frames(spark, d):
    """The feature frame of a model with a missing, an extra and an overridden feature."""
    f = C.feature_frame(_flows(spark, d), ["l_quantity", "rate", "absent", "l_tax"], {"l_tax": 0.5})
    return f.agg(F.count("*").alias("rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("rate"), 2).alias("rate"), F.sum("absent").alias("absent"), F.sum("l_tax").alias("tax"))


def binary_truth(spark, d):
    t = table(spark, d, "gold_records").select(C.ground_truth(F.regexp_extract("source_file", "([01])[.]csv", 1), F.col("ids_label")).alias("truth"), F.col("model_prediction"))
    return t.groupBy("truth", C.prediction_label(C.binary_label("model_prediction")).alias("predicted")).agg(F.count("*").alias("rows"))


_BANDS = " union all ".join(f"select '{n}' thresholds, case when model_confidence is null or isnan(model_confidence) then 'unavailable' when model_confidence >= {h} then 'high' when model_confidence >= {m} then 'medium' else 'low' end band from gold_records" for n, h, m in (("a", 0.9, 0.6), ("b", 0.85, 0.6), ("c", 0.9, 0.5)))
_LAB = "trim(regexp_replace(ids_label, '[\\s\\x{00A0}\\x{0085}]+', ' ', 'g'))"
_KNOWN15 = ", ".join(f"'{x}'" for x in C.LABELS)
QUERIES = {f.__name__: f for f in (flow_profile, flow_label_distribution, flow_invalid_rows, flow_unknown_labels, flow_cleaning_summary, flow_clean_by_label, flow_keep_first, flow_duplicate_rows, label_normalisation, number_coercion, confidence_bands, feature_frames, binary_truth)}
SQL = {
    "flow_profile": _F + _PROFILE,
    "flow_label_distribution": 'select l_returnflag as label, count(*) as "rows", round(100.0 * count(*) / sum(count(*)) over (), 6) as percent from lineitem group by 1',
    "flow_invalid_rows": _F + f"select count(*) as \"rows\", count(*) filter ({_ANY}) missing_feature, count(*) filter (l_returnflag not in ('A','N')) unknown_label, count(*) filter ({_ANY} or l_returnflag not in ('A','N')) invalid from clean",
    "flow_unknown_labels": "select l_returnflag as label, count(*) as \"rows\" from lineitem where l_returnflag not in ('A','N') group by 1",
    "flow_cleaning_summary": _F + f", ok as (select * from clean where not ({_ANY}) and l_returnflag in ('A','N')), d as (select distinct {', '.join(FEATURES)}, l_returnflag from ok) select (select count(*) from clean) rows_in, (select count(*) from clean) - (select count(*) from ok) invalid_rows, (select count(*) from ok) - (select count(*) from d) duplicate_rows, (select count(*) from d) rows_out",
    "flow_clean_by_label": _F + f", ok as (select *, row_number() over (partition by {', '.join(FEATURES)}, l_returnflag order by l_orderkey, l_linenumber) n from clean where not ({_ANY}) and l_returnflag in ('A','N')) select (l_returnflag <> 'N')::int binary_label, count(*) as \"rows\", round(sum(l_quantity), 2) quantity, min(l_orderkey) first_order from ok where n = 1 group by 1",
    "flow_keep_first": "select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) n from events) where n = 1",
    "flow_duplicate_rows": "select sum(n - 1)::bigint duplicate_rows from (select count(*) n from lineitem group by l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)",
    "label_normalisation": f"select {_LAB} as label, count(*) as \"rows\", count(*) filter ({_LAB} in ({_KNOWN15})) known from corpus_records group by 1",
    "number_coercion": r"select count(try_cast(nullif(trim(raw_output), '') as double)) filter (not regexp_matches(trim(raw_output), '^[+-]?(?i:nan|inf(inity)?)$')) numeric_outputs, count(nullif(regexp_extract(output, 'score ([0-9.]+[0-9])', 1), '')) scores, round(avg(try_cast(nullif(regexp_extract(output, 'score ([0-9.]+[0-9])', 1), '') as double)), 6) mean_score, sum(prompt_tokens)::bigint prompt_tokens from generations",
    "confidence_bands": f'select thresholds, band, count(*) as "rows" from ({_BANDS}) group by all',
    "feature_frames": _F + "select count(*) as \"rows\", round(sum(l_quantity), 2) quantity, round(sum(coalesce(rate, 0)), 2) rate, 0.0::double absent, 0.5 * count(*)::double tax from clean",
    "binary_truth": "select coalesce(try_cast(regexp_extract(source_file, '([01])[.]csv', 1) as int), case when trim(ids_label) <> '' then (upper(trim(ids_label)) <> 'BENIGN')::int end) truth, case when model_prediction <> 'BENIGN' then 'ATTACK' else 'BENIGN' end predicted, count(*) as \"rows\" from gold_records group by all",
}
