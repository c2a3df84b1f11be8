"""The chained hops of the retrieval, against a plain walk."""

from quern.operators import retrieval as R

EDGE = "type string, src string, dst string, edge_id long, confidence string, inferred boolean"
NODE = "node_id string, label string, name string, attack_id string, severity string, likelihood string, base_score double"


def graph(spark):
    nodes = [
        ("L", "IDSLabel", "DDoS", None, None, None, None), ("t1", "Technique", "flood", "T1", None, None, None), ("t2", "SubTechnique", "burst", "T0", None, None, None), ("t3", "Technique", "alone", "T3", None, None, None),
        ("ta", "Tactic", "impact", "TA1", None, None, None), ("m", "Mitigation", "filter", "M1", None, None, None), ("g", "Group", "g", None, None, None, None), ("o", "Tool", "o", None, None, None, None), ("w", "Malware", "w", None, None, None, None), ("d", "DetectionStrategy", "d", None, None, None, None),
        ("p", "Product", "box", None, None, None, None), ("r", "Reference", "url", None, None, None, None),
    ]
    nodes += [(f"CAPEC-{i:02}", "CAPECPattern", f"c{i}", None, "High" if i == 3 else None, "Low" if i == 3 else None, None) for i in range(13)]
    nodes += [(f"CWE-{i:02}", "CWE", f"w{i}", None, None, None, None) for i in range(25)] + [(f"CVE-{i:02}", "CVE", f"v{i}", None, "CRITICAL" if i == 7 else None, None, None if i == 5 else float(i % 11)) for i in range(25)]
    edges = [("DETECTED_AS", "L", "t1"), ("DETECTED_AS", "L", "t2"), ("HAS_TACTIC", "t1", "ta"), ("MITIGATED_BY", "t1", "m"), ("USES_TECHNIQUE", "g", "t1"), ("USES_TECHNIQUE", "o", "t1"), ("USES_TECHNIQUE", "w", "t1"), ("DETECTED_BY", "t1", "d")]
    edges += [("HAS_ATTACK_PATTERN", "t1", f"CAPEC-{i:02}") for i in range(13)] + [("HAS_ATTACK_PATTERN", "t2", "CAPEC-12")]
    edges += [("RELATED_WEAKNESS", f"CAPEC-{i % 12:02}", f"CWE-{i:02}") for i in range(25)] + [("ASSOCIATED_CVE", f"CAPEC-{i % 5:02}", f"CVE-{i:02}") for i in range(25)]
    edges += [("AFFECTS", f"CVE-{i:02}", "p") for i in range(25)] + [("REFERENCES", "CVE-10", "r"), ("REFERENCES", "CVE-11", "r")]
    rows = [(*e, i, "high" if i % 2 else None, i % 5 == 0) for i, e in enumerate(edges)]
    return spark.createDataFrame(rows, EDGE), spark.createDataFrame(nodes, NODE)


def test_all_categories_are_reached_within_their_limits(spark):
    edges, nodes = graph(spark)
    got = R.expansion(edges, nodes).where("seed = 't1'").collect()
    by = {}
    for r in got:
        by.setdefault(r.category, []).append(r.entity_id)
    assert set(by) == set(R.CATEGORY_LIMITS)
    assert sorted(by["capec"]) == [f"CAPEC-{i:02}" for i in range(10)]
    kept = {int(c[-2:]) for c in by["capec"]}
    assert sorted(by["cwes"]) == [f"CWE-{i:02}" for i in range(25) if i % 12 in kept][:20]
    score = lambda i: 0.0 if i == 5 else float(i % 11)
    cves = [f"CVE-{i:02}" for i in sorted(range(25), key=lambda i: (-score(i), f"CVE-{i:02}"))][:20]
    assert sorted(by["cves"]) == sorted(cves)
    assert by["products"] == ["p"] * 20 and set(by["references"]) == {"r"}  # duplicates use up the limit


def test_scores_of_patterns_and_vulnerabilities(spark):
    edges, nodes = graph(spark)
    got = {(r.category, r.entity_id): r for r in R.retrieved(edges, nodes).where("seed = 't1'").collect()}
    worst = got["cves", "CVE-07"]
    plain = {r.edge_id: r for r in edges.collect()}[worst.origin]
    assert worst.rank_score == round(1 - 4 * 0.12 + (1.0 if plain.confidence else 0.5) - (0.25 if plain.inferred else 0) + 1.0 + 0.7, 6) and worst.position == 1
    assert got["capec", "CAPEC-03"].rank_score > 1.5 and len([k for k in got if k[0] == "cwes"]) == 12 and got["products", "p"].distance == 5


def test_seeds_of_labels_and_lone_techniques(spark):
    edges, nodes = graph(spark)
    assert [tuple(r) for r in R.label_seeds(edges, nodes).collect()] == [("DDoS", "t2")]
    assert R.expansion(edges, nodes).where("seed = 't3'").count() == 0
    assert {r.category for r in R.expansion(edges, nodes).where("seed = 't2'").collect()} == {"capec"}
    assert R.expansion(edges.limit(0), nodes).count() == 0 and R.expansion(edges, nodes.limit(0).select("node_id", "label", "name", "attack_id")).count() == 0
