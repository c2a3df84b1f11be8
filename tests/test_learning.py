import random

import pytest
from pyspark.sql import functions as F

from quern.operators import learning as L

FEATURES = ["a", "b/s", "noise"]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        a, b, n = rng.gauss(0, 1), rng.gauss(0, 2), rng.gauss(0, 1)
        rows.append((i, a, b, n, int(2 * a - b + rng.gauss(0, 0.3) > 1)))
    return spark.createDataFrame(rows, "id int, a double, `b/s` double, noise double, y int")


@pytest.mark.parametrize("kind, params", [("forest", {"numTrees": 10, "maxDepth": 4}), ("boosted", {"maxIter": 5, "maxDepth": 3}), ("linear", {})])
def test_models_learn(data, kind, params):
    scored = L.predict(L.train(data, FEATURES, "y", kind, **params), data)
    right = scored.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert right > 0.85 and scored.agg(F.min("confidence")).first()[0] >= 0.5


def test_attributions_add_up(data, tmp_path):
    model = L.train(data, FEATURES, "y", "linear")
    out = L.linear_attributions(model, L.predict(model, data), FEATURES)
    lr = model.stages[-1]
    for r in out.limit(20).collect():
        assert abs(sum(f.contribution for f in r.top_features) + lr.intercept - r.rawPrediction[1]) < 1e-6
        assert [abs(f.contribution) for f in r.top_features] == sorted((abs(f.contribution) for f in r.top_features), reverse=True)
    ranks = {r.feature: r["rank"] for r in L.mean_attributions(out).collect()}
    assert ranks["noise"] == 3
    assert L.explained_samples(out, "y", "id", 10).count() == 20
    model.write().overwrite().save(str(tmp_path / "m"))
    again = L.PipelineModel.load(str(tmp_path / "m"))
    assert L.predict(again, data).where("prediction = y").count() == out.where("prediction = y").count()


def test_weights(data):
    w = {r.y: r.weight for r in L.class_weights(data, "y").select("y", "weight").distinct().collect()}
    n = {r.y: r["count"] for r in data.groupBy("y").count().collect()}
    assert abs(w[0] * n[0] - w[1] * n[1]) < 1e-6
    assert L.positive_weight(data.limit(0), "y").first()[0] is None


def test_unknown_kind(data):
    with pytest.raises(ValueError):
        L.train(data, FEATURES, "y", "odd")
