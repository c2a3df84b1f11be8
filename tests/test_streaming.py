import datetime as d

from pyspark.sql import functions as F

from quern.streaming import events as E


def made(spark):
    t0 = d.datetime(2024, 1, 1, tzinfo=d.timezone.utc)
    rows = [(i, t0 + d.timedelta(minutes=7 * i), i % 3, "click" if i % 2 else "view", float(i), None) for i in range(200)]
    return spark.createDataFrame(rows + rows[:10], E.EVENTS)


def test_stream_equals_batch(spark, tmp_path):
    made(spark).repartition(5).write.parquet(str(tmp_path / "in"))
    stream = E.windowed_counts(E.event_stream(spark, str(tmp_path / "in")), "1 hour", late="30 days")
    got = E.run_to_table(stream, "windows", str(tmp_path / "cp"))
    want = E.windowed_counts(spark.read.parquet(str(tmp_path / "in")), "1 hour")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_drops_repeated_events(spark, tmp_path):
    made(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = E.run_to_table(E.once_per_event(E.event_stream(spark, str(tmp_path / "in")), "30 days"), "once", str(tmp_path / "cp"), "append")
    assert got.count() == 200 == E.once_per_event(made(spark)).count()


def test_sessions(spark):
    got = E.sessions(made(spark).dropDuplicates(["event_id"]), "20 minutes").groupBy("user_id").agg(F.count("*").alias("n")).collect()
    assert {r.user_id: r.n for r in got} == {0: 67, 1: 67, 2: 66}
    assert {r.n for r in E.sessions(made(spark), "30 minutes").groupBy("user_id").agg(F.count("*").alias("n")).collect()} == {1}
