import json

from quern.sources import feeds, files


def test_flow_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Flow Bytes/s, Fwd Header Length, Fwd Header Length, Label\n1,2,3, BENIGN \nInfinity,,4,DDoS\n")
    (tmp_path / "b.csv").write_text("Flow Bytes/s,Fwd Header Length,Fwd Header Length,Label\n5,6,7,Bot\n")
    info = {r.file: r for r in files.inspect_flows(spark, str(tmp_path)).collect()}
    assert info["a.csv"].rows == 2 and info["a.csv"].repeated_columns == ["Fwd Header Length"] and info["b.csv"].has_label
    df = files.read_flows(spark, str(tmp_path))
    assert df.columns == ["Flow Bytes/s", "Fwd Header Length", "Fwd Header Length.1", "Label", "source_file"]
    assert df.count() == 3 and {r.source_file for r in df.collect()} == {"a.csv", "b.csv"}
    (tmp_path / "c.csv").write_text("x,Label\n1,2\n")
    try:
        files.read_flows(spark, str(tmp_path))
        raise AssertionError("other columns must not pass")
    except ValueError as e:
        assert "c.csv" in str(e)


def test_missing_folder(tmp_path):
    for bad in (tmp_path / "none", tmp_path):
        try:
            files.csv_files(str(bad))
            raise AssertionError("must fail")
        except FileNotFoundError:
            pass


def test_json_lines_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "b int, a string")
    files.write_json_lines(df, str(tmp_path / "o"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "o")).collect()) == ['{"a":"x","b":1}', '{"b":2}']
    assert files.read_json_lines(spark, str(tmp_path / "o"), "a string, b int").count() == 2
    assert files.markdown_table(spark.createDataFrame([("p|q",)], "c string")) == "| c |\n| --- |\n| p\\|q |"
    (tmp_path / "d.csv").write_text("example_id, decision\ne1, approve\n,x\ne1,reject\n")
    assert [(r.example_id, r.decision) for r in files.read_decisions(spark, str(tmp_path / "d.csv")).collect()] == [("e1", "reject")]


def test_contexts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"prediction": "DDoS"}')
    (tmp_path / "b.json").write_text("{}")
    (tmp_path / "validation_summary.json").write_text('{"prediction": "x"}')
    assert [r.prediction for r in files.read_contexts(spark, str(tmp_path)).collect()] == ["DDoS"]


def test_stix(spark, tmp_path):
    ref = lambda i: [{"source_name": "s", "external_id": i, "url": "u"}]
    objects = [
        {"type": "attack-pattern", "id": "ap1", "name": "A", "external_references": [{"source_name": "x", "external_id": ""}, *ref("T1")], "kill_chain_phases": [{"kill_chain_name": "k", "phase_name": "one"}, {"kill_chain_name": "k", "phase_name": "gone"}]},
        {"type": "attack-pattern", "id": "ap2", "name": "B", "x_mitre_is_subtechnique": True, "external_references": ref("T1.001")},
        {"type": "x-mitre-tactic", "id": "t1", "name": "T", "x_mitre_shortname": "one", "external_references": ref("TA1")},
        {"type": "course-of-action", "id": "m1", "name": "M"}, {"type": "tool", "id": "tool1"}, {"type": "tool", "id": "tool2"}, {"type": "intrusion-set", "id": "g1"}, {"type": "identity", "id": "i1"},
        *[{"type": "relationship", "id": f"r{i}", "relationship_type": k, "source_ref": a, "target_ref": b} for i, (k, a, b) in enumerate([("mitigates", "m1", "ap1"), ("uses", "g1", "ap1"), ("uses", "g1", "tool1"), ("uses", "tool1", "tool2"), ("subtechnique-of", "ap2", "ap1"), ("odd", "g1", "ap1"), ("uses", "g1", "missing")])],
    ]
    (tmp_path / "s.json").write_text(json.dumps({"objects": objects}))
    nodes, edges, warnings = feeds.stix_graph(feeds.read_stix(spark, str(tmp_path / "s.json")))
    assert {(r.node_id, r.label, r.attack_id) for r in nodes.where("label like '%echnique'").collect()} == {("ap1", "Technique", "T1"), ("ap2", "SubTechnique", "T1.001")}
    assert {(r.type, r.src, r.dst) for r in edges.collect()} == {("MITIGATED_BY", "ap1", "m1"), ("USES_TECHNIQUE", "g1", "ap1"), ("USES_TOOL", "g1", "tool1"), ("SUBTECHNIQUE_OF", "ap2", "ap1"), ("HAS_TACTIC", "ap1", "t1")}
    assert [r.warning for r in warnings.collect()] == ["no tactic for phase gone"]


def test_capec(spark, tmp_path):
    head = "\ufeff'ID,Name,Description,Abstraction,Status,Likelihood Of Attack,Typical Severity,Related Attack Patterns,Related Weaknesses,Taxonomy Mappings\n"
    (tmp_path / "c.csv").write_text(head + '1,N,"d, ""q""",Meta,Draft,High,Low,::NATURE:ChildOf:CAPEC ID:100::NATURE:Odd:CAPEC ID:7::,::276::285::434::721::,::TAXONOMY NAME:ATTACK:ENTRY ID:1046:ENTRY NAME:x::\n,blank,,,,,,,,\n')
    rows = feeds.read_capec(spark, str(tmp_path / "c.csv"))
    patterns, edges, warnings = feeds.capec_graph(rows)
    assert [(r.capec_id, r.description) for r in patterns.collect()] == [("CAPEC-1", 'd, "q"')]
    assert {(r.type, r.dst) for r in edges.collect()} == {("CHILD_OF", "CAPEC-100"), ("RELATED_WEAKNESS", "CWE-276"), ("RELATED_WEAKNESS", "CWE-434"), ("MAPS_TO_ATTACK", "T1046")}
    assert feeds.capec_graph(rows, True)[1].where("type = 'RELATED_WEAKNESS'").count() == 4
    assert {r.warning for r in warnings.collect()} == {"row without id", "unsupported nature Odd"}


def test_nvd(spark, tmp_path):
    def cve(i, when, status="Analyzed", **more):
        return {"cve": {"id": i, "lastModified": when, "vulnStatus": status, **more}}

    v2 = {"metrics": {"cvssMetricV2": [{"baseSeverity": "HIGH", "cvssData": {"version": "2.0", "baseScore": 7.5}}]}}
    conf = {"configurations": [{"nodes": [{"cpeMatch": [{"criteria": "cpe:2.3:a:v:p:1:*"}], "nodes": [{"cpeMatch": [{"cpe23Uri": "cpe:2.3:o:w"}]}]}]}]}
    a = [cve("CVE-1", "2024-01-01", descriptions=[{"lang": "es", "value": "hola"}], **v2), cve("CVE-2", "2024-01-01"), cve("CVE-3", "2024-05-01", "Rejected")]
    b = [cve("CVE-1", "2024-01-01", descriptions=[{"lang": "fr", "value": "f"}, {"lang": "en", "value": "e"}], weaknesses=[{"description": [{"lang": "en", "value": "CWE-79"}, {"lang": "en", "value": "NVD-CWE-noinfo"}]}], references=[{"url": "u", "source": "s"}], **conf), cve("CVE-2", "2023-01-01", "Rejected"), cve("CVE-3", "2024-01-01")]
    for n, x in (("a", a), ("b", b)):
        (tmp_path / f"{n}.json").write_text(json.dumps({"vulnerabilities": x}))
    kept, rejected = feeds.latest_cves(feeds.read_nvd(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")]))
    assert {r.id for r in kept.collect()} == {"CVE-1", "CVE-2"} and [r.id for r in rejected.collect()] == ["CVE-3"]
    g = feeds.nvd_graph(kept)
    assert {r.cve_id: (r.description, r.severity) for r in g["cves"].collect()} == {"CVE-1": ("e", "UNSCORED"), "CVE-2": ("", "UNSCORED")}
    assert {(r.cpe_uri, r.vendor, r.product) for r in g["products"].collect()} == {("cpe:2.3:a:v:p:1:*", "v", "p"), ("cpe:2.3:o:w", "w", "")}
    assert {(r.type, r.dst) for r in g["edges"].collect()} == {("HAS_WEAKNESS", "CWE-79"), ("AFFECTS", "cpe:2.3:a:v:p:1:*"), ("AFFECTS", "cpe:2.3:o:w"), ("REFERENCES", "u")}
    assert [r.severity for r in feeds.nvd_graph(feeds.latest_cves(feeds.read_nvd(spark, [str(tmp_path / "a.json")]))[0])["cves"].where("cve_id = 'CVE-1'").collect()] == ["HIGH"]


def test_label_mapping(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"DDoS": {"attack_id": "1498", "confidence": "High"}, "Odd": {"attack_id": "T9", "confidence": "low"}}))
    nodes = spark.createDataFrame([("n1", "Technique", "T1498")], "node_id string, label string, attack_id string")
    edges, lost = feeds.detected_as(feeds.read_label_mapping(spark, str(tmp_path / "m.json")), nodes)
    assert [(r.src, r.dst, r.confidence) for r in edges.collect()] == [("DDoS", "n1", "high")] and [r.label for r in lost.collect()] == ["Odd"]


def test_graph_tables(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "Tool"), ("b", "Group")], "node_id string, label string")
    edges = spark.createDataFrame([("USES_TOOL", "b", "a")], "type string, src string, dst string")
    files.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = files.read_graph(spark, str(tmp_path / "g"))
    assert n.count() == 2 and e.where("type = 'USES_TOOL'").count() == 1
    files.write_manifest(nodes, str(tmp_path / "m"), ["label", "gone"])
    assert spark.read.csv(str(tmp_path / "m"), header=True).columns == ["label", "gone"]
    assert files.first_existing([str(tmp_path / "x"), str(tmp_path / "g")]) == str(tmp_path / "g")
