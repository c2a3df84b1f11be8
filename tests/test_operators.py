import math

from pyspark.sql import functions as F

from quern.functions import identifiers as I
from quern.functions import texts as X
from quern.operators import cleaning as C
from quern.operators import graph as G
from quern.operators import metrics as M
from quern.operators import quality as Q
from quern.operators import retrieval as R
from quern.operators import sampling as S


def one(df):
    return tuple(df.first())


def test_names_and_labels(spark):
    assert C.normalised_names([" a", "b ", "a", "a"]) == ["a", "b", "a.1", "a.2"]
    df = spark.createDataFrame([("  BENIGN ",), ("Web Attack � XSS",), ("Foo",), (None,)], "x string")
    assert [r[0] for r in df.select(C.normalise_label("x")).collect()] == ["BENIGN", "Web Attack - XSS", "Foo", None]


def test_infinities_as_texts_and_numbers(spark):
    df = spark.createDataFrame([("Infinity", math.inf), ("1.5", math.nan), ("", 1.0), ("x", None)], "t string, n double")
    got = {r.column_name: (r.missing_count, r.non_finite_count) for r in C.profile(df, ["t", "n"]).collect()}
    assert got == {"t": (3, 0), "n": (3, 1)}
    assert {r.missing_count for r in C.profile(df.limit(0), ["t"]).collect()} == {0}


def test_keep_first(spark):
    df = spark.createDataFrame([(0.0, "b", 2), (-0.0, "a", 1), (None, "c", 3), (None, "d", 4)], "k double, source_file string, o int")
    assert sorted(r.source_file for r in C.keep_first(df, ["k"], ["o"]).collect()) == ["a", "c"]
    assert one(C.duplicate_rows(df, ["k"])) == (2,)
    assert one(C.duplicate_rows(df.limit(0), ["k"])) == (0,)


def test_feature_frame(spark):
    df = spark.createDataFrame([("1", "Inf"), ("z", "2")], "a string, b string")
    assert [tuple(r) for r in C.feature_frame(df, ["b", "gone", "a"], {"a": 9}).collect()] == [(0.0, 0.0, 9.0), (2.0, 0.0, 9.0)]
    assert C.feature_gaps(["a", "x"], ["a", "b"]) == (["b"], ["x"])


def test_merge_keeps_the_last_value_of_each_property(spark):
    df = spark.createDataFrame([("k", "x", None, 1), ("k", None, "y", 2), (None, "z", "z", 3), ("", "z", "z", 3)], "id string, a string, b string, o int")
    assert [tuple(r) for r in G.merged(df, {"id": F.col("id")}, ["o"], ["a", "b"]).collect()] == [("k", "x", "y")]


def graph(spark):
    nodes = spark.createDataFrame([("t1", "Technique", "T1", "a"), ("t2", "Technique", "T2", "b"), ("s1", "SubTechnique", "T1.1", "c"), ("ta", "Tactic", "TA1", "d"), ("alone", "Tool", None, "e")], "node_id string, label string, attack_id string, name string")
    edges = spark.createDataFrame([("HAS_TACTIC", "t1", "ta"), ("HAS_TACTIC", "t2", "ta"), ("HAS_TACTIC", "s1", "ta"), ("SUBTECHNIQUE_OF", "s1", "t1"), ("HAS_TACTIC", "t1", "missing")], "type string, src string, dst string")
    return nodes, G.matched(edges, nodes)


def test_graph_statistics(spark):
    nodes, edges = graph(spark)
    assert edges.count() == 4
    assert {r.node_id for r in G.isolated(nodes, edges).collect()} == {"alone"}
    assert {r.node_id: r.degree for r in G.degrees(nodes, edges).collect()} == {"t1": 2, "t2": 1, "s1": 2, "ta": 3, "alone": 0}
    assert one(G.density(nodes, edges)) == (5, 4, 0.2, 1.6)
    assert one(G.density(nodes.limit(1), edges.limit(0)))[2:] == (0.0, 0.0)
    assert {(r["size"], r.components) for r in G.component_sizes(nodes, edges).collect()} == {(4, 1), (1, 1)}
    assert {r.value: r.n for r in G.counts_over(nodes, "label", ["Technique", "CVE"]).collect()} == {"Technique": 2, "CVE": 0}


def test_a_subtechnique_of_the_same_tactic_keeps_rank_3(spark):
    nodes, edges = graph(spark)
    got = {(r.seed, r.attack_id): r["rank"] for r in G.attack_chain(edges, nodes).collect()}
    assert got[("t1", "T1.1")] == 3 and got[("t1", "T2")] == 3
    alone = edges.where("not (type = 'HAS_TACTIC' and src = 's1')")
    assert {(r.seed, r.attack_id): r["rank"] for r in G.attack_chain(alone, nodes).collect()}[("t1", "T1.1")] == 1


def test_scores(spark):
    p = "array<struct<confidence:string,inferred:boolean>>"
    df = spark.createDataFrame([([("source", False)], 2), ([("", True), ("low", True)], 1), ([("high", True), (None, False)], 20), ([], 0)], f"p {p}, d int")
    got = [round(r[0], 6) for r in df.select(R.provenance_score(F.col("p"), F.col("d"))).collect()]
    assert got == [1.71, 1.13, 0.9, 1.0]
    v = spark.createDataFrame([("HIGH", 25.0), (None, None)], "s string, b double").select(R.vulnerability_score(F.col("s"), F.col("b")))
    assert [r[0] for r in v.collect()] == [1.8, 0.0]


def test_ranking_keeps_the_best_duplicate(spark):
    df = spark.createDataFrame([("s", "capec", "x", 0.5, 2, 1), ("s", "capec", "x", 0.9, 3, 2), ("s", "capec", "y", 0.9, 2, 3), ("s", "capec", "z", 0.1, 2, 4)], "seed string, category string, entity_id string, rank_score double, distance int, origin int")
    assert [(r.entity_id, r.position) for r in R.ranked(df, ["seed"], {"capec": 2}).orderBy("position").collect()] == [("y", 1), ("x", 2)]


def test_texts(spark):
    df = spark.createDataFrame([("One two. Three!\nFour five six seven",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(X.sentences("t")).collect()] == [["One two.", "Three!", "Four five six seven"], [], []]
    assert [r[0] for r in df.select(X.ngrams(X.tokens("t"), 6)).collect()] == [["one two three four five six", "two three four five six seven"], [], []]
    assert [tuple(r) for r in df.select(X.opening("t", 5), X.closing("t", 4)).collect()] == [("One t", "Four"), (None, None), (None, None)]
    assert one(spark.sql("select 'graph proves it' t").select(X.claimed("t", Q.PROOF, Q.NO_PROOF))) == (True,)
    assert one(spark.sql("select 'this is not proof of compromise' t").select(X.claimed("t", Q.PROOF, Q.NO_PROOF))) == (False,)
    j = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), ("{bad",), ("plain",), (None,)], "t string")
    assert [r[0] for r in j.select(X.parses_as_json("t")).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(X.bucket_of(F.lit("x-0019"))).collect()][0] == 3


def test_identifiers(spark):
    df = spark.sql("select '::276::285::434::721::' w, '1046' t, 'cwe-79' c, 'cpe:2.3:a:v' p, 'Saw cve-2020-12345 and T1046.001, T1046.001' x")
    got = df.select(I.delimited(F.col("w")), I.delimited_all(F.col("w")), I.technique_id(F.col("t")), I.weakness_id(F.col("c")), I.cpe_part(F.col("p"), 4), I.extracted("x", "cve", True), I.extracted("x", "technique")).first()
    assert tuple(got) == (["276", "434"], ["276", "285", "434", "721"], "T1046", "CWE-79", "", ["CVE-2020-12345"], ["T1046.001"])


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 0, 0.1), (None, 1, 0.3)], "y int, p int, s double")
    m = M.rates(M.confusion(df, [], F.col("y"), F.col("p"))).first()
    assert (m.tn, m.fp, m.fn, m.tp, m.accuracy, m.precision, m.recall) == (2, 0, 1, 1, 0.75, 1.0, 0.5)
    assert one(M.roc_auc(df, F.col("y"), F.col("s"))) == (0.875,)
    assert one(M.roc_auc(df.limit(0), F.col("y"), F.col("s"))) == (None,)
    lengths = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, None)], "n int")
    r = M.length_stats(lengths, [], F.col("n"), 4, (50, 90)).first()
    assert (r["count"], r["min"], r["max"], r["median"], r.p50, r.p90, r.above) == (6, 1, 6, 3, 3, 5, 2)


def test_ranks_are_a_permutation_whatever_the_partitions(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(2000)], "id int, g string")
    a = {(r.id): (r["rank"], r.group_rows) for r in S.spread_rank(df.repartition(7), ["g"], "id").collect()}
    assert a == {(r.id): (r["rank"], r.group_rows) for r in S.spread_rank(df.repartition(2), ["g"], "id").collect()}
    assert sorted(a[i][0] for i in range(2000) if i % 3) == list(range(1, sum(1 for i in range(2000) if i % 3) + 1))


def test_splits(spark):
    df = spark.createDataFrame([(i, f"g{i % 40}", "ab"[i % 2]) for i in range(400)], "id int, g string, label string")
    got = S.stratified_split(df, "label", "id").groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in got} == {(x, s): n for x in "ab" for s, n in (("train", 140), ("validation", 30), ("test", 30))}
    g = S.group_split(df, "g")
    assert g.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0 and g.count() == 400
    assert S.leaking_groups(g, "g", "split").count() == 0


def test_samples(spark):
    df = spark.createDataFrame([(i, "rare" if i < 2 else "often", f"f{i % 3}") for i in range(300)], "id int, s string, f string")
    got = S.stratified_sample(df, ["s"], "id", 50, 3).collect()
    assert len(got) == 50 and sum(r.s == "rare" for r in got) >= 2
    assert S.capped_sample(df, "s", "f", "id", 9).groupBy("s").count().where("s = 'often'").first()["count"] == 9
    sets = S.disjoint_sets(df, "id", [("a", F.lit(True), 20), ("b", F.col("s") == "often", 30)]).collect()
    assert len({r.id for r in sets}) == 50
    assert [r.value for r in S.round_robin(df, "id", ["x", "y"], "n-").orderBy("rank").limit(3).collect()] == ["x", "y", "x"]


def test_findings_and_agreement(spark):
    df = spark.createDataFrame([(1, "see T1", "T1 and T1046 were attributed to them", "p"), (2, "see T1", "T1 and T1046 were attributed to them", None), (3, None, "confirmed exposure", "p")], "id int, ask string, ans string, prov string")
    got = {r.id: r.errors for r in Q.record_findings(df, "ans", I.all_extracted("ask"), ["ask", "ans"], ["id"], "prov").collect()}
    assert got[1] == ["invented security identifiers", "unsupported attribution phrasing"] and "duplicate example" in got[2] and "missing provenance" in got[2]
    assert got[3] == ["missing field: ask", "unsupported asset exposure claim"]
    a = spark.createDataFrame([("ATTACK", 0.95, "a likely benign case", False), ("ATTACK", 0.95, "an attack", False), ("ATTACK", 0.5, "uncertain", False), ("ATTACK", None, "x", False), ("BENIGN", 1.0, "x", False), ("ATTACK", 1.0, "x", True)], "p string, c double, t string, s boolean")
    assert [r[0] for r in a.select(Q.agreement(F.col("p"), F.col("c"), F.col("t"), F.col("s"))).collect()] == ["classifier_attack_llm_benign_or_uncertain", "agree_attack_high_confidence", "llm_uncertain_classifier_attack", "agree_attack_low_confidence", "evidence_gap", "evidence_gap"]


def test_decisions_and_chat(spark):
    rec = spark.createDataFrame([("a",), ("b",)], "example_id string")
    dec = spark.createDataFrame([("a", "approve", 1), ("a", "reject", 2), ("z", "approve", 1)], "example_id string, decision string, n int")
    last = Q.last_decisions(dec, "example_id", ["n"])
    assert {(r.example_id, r.decision) for r in Q.with_decisions(rec, last, "example_id", "decision").collect()} == {("a", "reject"), ("b", "unreviewed")}
    assert [r.example_id for r in Q.unmatched_decisions(rec, last, "example_id").collect()] == ["z"]
    t = spark.sql("select 'ask' u, 'answer' a").select(Q.chat_text("sys", F.col("u"), F.col("a")).alias("t"))
    p, target = Q.prompt_and_target(F.col("t"))
    got = t.select("t", p.alias("p"), target.alias("x")).first()
    assert got.x == "answer" and got.t.startswith(got.p) and got.p.endswith("assistant<|end_header_id|>\n\n")


def test_properties_and_embedded_objects(spark):
    m = spark.sql("select map('name', 'x', 'raw_id', 'r', 'e', '', 'description', repeat('word ', 200)) m")
    got = m.select(X.compact_properties(X.clean_properties(F.col("m")))).first()[0]
    assert set(got) == {"name", "description"} and len(got["description"]) <= 420 and got["description"].endswith("...")
    t = spark.createDataFrame([('say {"a": {"b": 1}} and {x}',), ("{open",), ("none",), (None,)], "t string")
    assert [r[0] for r in t.select(X.embedded_json("t")).collect()] == ['{"a": {"b": 1}}', None, None, None]
