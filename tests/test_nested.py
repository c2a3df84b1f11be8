import json

from quern.operators.nested import adjacency, context_tables, parse, provenance_rows, unwrapped

SCHEMA = "context_id long, context_json string, loaded_at timestamp_ntz, node string, label string"


def test_parse():
    assert parse(None) is None and parse("") is None and parse("{bad") is None and parse('\ufeff{"a": 1}') == {"a": 1}
    assert parse(json.dumps(json.dumps({"a": 1}))) == {"a": 1} and parse('"just text"') is None
    assert parse("[" * 100_000) is None
    assert unwrapped({"context": {"data": '{"attack": 1}'}}, ["context", "data"], ["attack"]) == {"attack": 1}
    assert unwrapped({"context": 5}, ["context"], ["attack"]) == {"context": 5}


def test_adjacency():
    rows = list(adjacency({"a": {"b": [1, None, {"c": "x"}]}, "d": '{"e": true}', "f": None, "g": [[1]]}))
    by = {(r[4], r[3]): r for r in rows}
    assert by[("", 0)][:2] == (0, -1) and by[("a.b", 0)][5] == "1" and ("a.b", 1) not in by and by[("a.b", 2)][5] is None
    assert by[("a.b.c", 0)][1] == by[("a.b", 2)][0] and by[("d.e", 0)][5] == "true" and by[("g.item", 0)][5] == "1"
    assert list(adjacency(None)) == [] and list(adjacency([1])) == []
    deep: dict = {"x": 1}
    for _ in range(300):
        deep = {"n": deep}
    assert len(list(adjacency(deep))) == 302  # no level is left out


def row(i, x, day=1):
    import datetime as d

    return (i, x if isinstance(x, str) or x is None else json.dumps(x), d.datetime(2020, 1, day), "clash", "clash")


def test_provenance(spark):
    full = {
        "prediction": "P",
        "attack": {"technique": {"id": "T1", "properties": {"attack_id": "T1"}, "provenance": [{"relationship_type": "A"}, None, {"relationship_type": None}]}, "tactics": None, "mitigations": [None, {"id": "M1", "provenance": '{"relationship_type": "B"}'}]},
        "cwes": {"entity_id": 7, "properties": '{"attack_id": "X"}', "provenance": []},
        "provenance": [{"relationship_type": "Z"}],
        "retrieval": {"latency_ms": 1.5, "relationships_traversed": 3},
        "classifier": {"confidence": 0.5},
    }
    raw = {"prediction": "Q", "classifier_confidence": 0.25, "entities": {"technique": [{"entity_id": "T2"}], "odd": ["no object"]}}
    rows = [row(1, {"old": 1}), row(1, full, 2), row(1, full, 2), row(2, {"data": raw}), row(3, None), row(4, ""), row(5, "[1]"), row(6, raw), row(6, "broken {", 3), (None, json.dumps(raw), None, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in provenance_rows(df).collect())
    assert got == sorted([
        (1, "technique", 0, 0, "T1", "A", "T1"), (1, "technique", 0, 2, "T1", "", "T1"), (1, "mitigations", 1, 0, "M1", "B", ""), (1, "cwes", 0, -1, "7", "", "X"), (2, "technique", 0, -1, "T2", "", ""),
    ])
    tables = context_tables(df)
    assert sorted((r.context_id, r.prediction, r.confidence) for r in tables["contexts"].collect()) == [(1, "P", 0.5), (2, "Q", 0.25)]
    ents, prov = tables["entities"].collect(), tables["provenance"].collect()
    assert len(ents) == 4 and {(p.context_id, p.entity_node) for p in prov} <= {(e.context_id, e.entity_node) for e in ents}
    assert provenance_rows(df.limit(0)).count() == 0
