from pyspark.sql import functions as F

from quern.operators import evidence as E


def test_depth_and_levels(spark):
    texts = [(1, '{"steps": ["a", "b"]}'), (2, '{"steps": "x"}'), (3, "Evidence first, then a Conclusion."), (4, None), (5, '{"steps": []}'), (6, "")]
    df = spark.createDataFrame(texts, "id int, t string")
    assert {r.id: r.n for r in df.select("id", E.reasoning_depth(F.col("t"), ["none", "steps"]).alias("n")).collect()} == {1: 2, 2: 0, 3: 2, 4: 0, 5: 0, 6: 0}
    rows = [(9.0, None, "critical"), (7.0, 0.1, "high"), (None, 0.9, "high"), (1.0, 0.6, "medium"), (None, None, "low")]
    df = spark.createDataFrame(rows, "s double, c double, want string")
    assert all(r.want == r.got for r in df.select("want", E.severity_level(F.col("s"), F.col("c")).alias("got")).collect())


def test_patterns_sources_and_gaps(spark):
    rows = [("x", ["a", "b"]), ("x", ["a", "b", "c"]), ("x", ["a"]), ("y", None), ("y", []), (None, ["a", "b"])]
    df = spark.createDataFrame(rows, "g string, items array<string>").withColumn("rows", F.lit("clash"))
    assert {r.g: (r["rows"], r.patterns) for r in E.distinct_patterns(df, ["g"], "items", 2).collect()} == {"x": (3, 2), "y": (2, 1), None: (1, 1)}
    assert [tuple(r) for r in E.repeated_patterns(df, "items", 2, 2).collect()] == [("a,b", 3)]
    assert [tuple(r) for r in E.concentrated(df, "g", 0.35).collect()] == [("x", 3, 50.0)]
    gaps = E.completeness(df, {"has_items": "items"})
    assert sorted((r.g or "", r.has_items, tuple(r.gaps)) for r in gaps.collect())[-1] == ("y", False, ("has_items",))
    none = df.limit(0)
    assert E.distinct_patterns(none, ["g"], "items").count() == E.concentrated(none, "g").count() == E.repeated_patterns(none, "items").count() == 0
