"""Queries over events and flows with time windows and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import learning as L
from quern.operators import metrics as M
from quern.session import cut, table
from quern.streaming import events as E


def event_windows(spark, d):
    return E.windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def event_sliding_windows(spark, d):
    return E.windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day", "12 hours").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def event_sessions(spark, d):
    return E.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "4 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _labelled(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *FEATURES, (F.col("l_extendedprice") > 1400 * F.col("l_quantity")).cast("int").alias("truth"))


def positive_weights(spark, d):
    return L.positive_weight(_labelled(spark, d), "truth").select(F.round("scale_pos_weight", 9).alias("scale_pos_weight"))


def linear_model_metrics(spark, d):
    """A linear model of a made label, its metrics on all rows."""
    df = cut(_labelled(spark, d))  # every round of fitting reads it
    scored = L.predict(L.train(df, FEATURES, "truth", "linear", maxIter=20), df)
    return M.rates(M.confusion(scored, [], F.col("truth"), F.col("prediction")))


def _tree_metrics(spark, d, kind, **params):
    df = cut(_labelled(spark, d))
    scored = L.predict(L.train(df, FEATURES, "truth", kind, **params), df)
    return M.rates(M.confusion(scored, [], F.col("truth"), F.col("prediction")))


def forest_model_metrics(spark, d):
    """A random forest of the same label, its metrics on all rows."""
    return _tree_metrics(spark, d, "forest", numTrees=20, maxDepth=5)


def boosted_model_metrics(spark, d):
    """Boosted trees of the same label, their metrics on all rows."""
    return _tree_metrics(spark, d, "boosted", maxIter=10, maxDepth=4)


def linear_model_attributions(spark, d):
    df = _labelled(spark, d)
    model = L.train(df, FEATURES, "truth", "linear", maxIter=20)
    return L.mean_attributions(L.linear_attributions(model, df, FEATURES))


QUERIES = {f.__name__: f for f in (event_windows, event_sliding_windows, event_sessions, positive_weights, linear_model_metrics, linear_model_attributions, forest_model_metrics, boosted_model_metrics)}
_FMT = "strftime({}, '%Y-%m-%d %H:%M:%S')"
SQL = {
    "event_windows": f"select {_FMT.format('time_bucket(interval 6 hours, ts)')} window_start, event_type, count(*) events, round(sum(value), 4) total from events group by all",
    "event_sliding_windows": f"select {_FMT.format('time_bucket(interval 12 hours, ts) - i * interval 12 hours')} window_start, event_type, count(*) events, round(sum(value), 4) total from events, (values (0), (1)) t(i) group by all",
    "event_sessions": "with e as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 4 hours or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end s from events), g as (select user_id, sum(s) over (partition by user_id order by ts rows unbounded preceding) k from e), n as (select user_id, k, count(*) n from g group by all) select user_id, count(*) as sessions, max(n) longest from n group by 1",
    "positive_weights": "select round(count(*) filter (l_extendedprice <= 1400 * l_quantity) / count(*) filter (l_extendedprice > 1400 * l_quantity), 9) scale_pos_weight from lineitem",
}
