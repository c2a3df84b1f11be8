import datetime as d

from quern.operators.references import Reference, canonical_id, lifetimes, orphan_counts, orphan_references

DAY = lambda n: d.datetime(2020, 1, 1) + d.timedelta(days=n)


def test_orphans(spark):
    parents = spark.createDataFrame([("CWE-1", DAY(10), None, "x"), (" cwe-1", DAY(5), DAY(20), "x"), ("node-a", DAY(0), None, "x"), (None, DAY(0), None, "x"), ("", DAY(0), None, "x")], "node_id string, ingested_at timestamp_ntz, revoked_at timestamp_ntz, ref_id string")
    edges = [(1, "1", DAY(6)), (2, "Cwe-1 ", DAY(4)), (3, "CWE-1", DAY(20)), (4, "CWE-2", DAY(40)), (4, "CWE-2", DAY(40)), (5, None, DAY(1)), (6, "  ", DAY(1)), (7, "NODE-A", DAY(1)), (8, "Node-B", DAY(1)), (9, "CWE-1", None), (10, "CWE-9", None)]
    frame = spark.createDataFrame([(*e, "clash") for e in edges], "edge_id long, target_id string, ingested_at timestamp_ntz, ref_id string")
    lists = spark.createDataFrame([(1, ["1", None, "", "CWE-7"], DAY(6)), (2, [], DAY(6)), (3, None, DAY(6))], "pattern_id long, cwe_ids array<string>, ingested_at timestamp_ntz")
    refs = [Reference("e", frame, "edge_id", "target_id", "node", "CWE"), Reference("p", lists, "pattern_id", "cwe_ids", "node", "CWE")]
    got = orphan_references(refs, {"node": lifetimes(parents, canonical_id("node_id", "CWE"))})
    assert {tuple(r) for r in got.collect()} == {
        ("e", "2020-01", 2, "target_id", "CWE-1", "late"), ("e", "2020-01", 3, "target_id", "CWE-1", "deleted"), ("e", "2020-02", 4, "target_id", "CWE-2", "missing"), ("e", "2020-01", 8, "target_id", "node-b", "missing"),
        ("e", None, 10, "target_id", "CWE-9", "missing"), ("p", "2020-01", 1, "cwe_ids", "CWE-7", "missing"),
    }
    assert sum(r.orphans for r in orphan_counts(got).collect()) == 6
    none = orphan_references([Reference("e", frame.limit(0), "edge_id", "target_id", "node")], {"node": lifetimes(parents.limit(0), canonical_id("node_id"))})
    assert none.count() == 0
