"""Threat-intelligence feeds as node and edge tables: STIX bundles, CAPEC CSV, NVD JSON, label mappings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import identifiers as I
from quern.operators.cleaning import normalised_names

REFS = "array<struct<source_name:string,external_id:string,url:string>>"
STIX = f"""objects array<struct<type:string,id:string,name:string,description:string,created:string,modified:string,revoked:boolean,x_mitre_deprecated:boolean,
external_references:{REFS},x_mitre_is_subtechnique:boolean,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>,x_mitre_platforms:array<string>,x_mitre_shortname:string,
aliases:array<string>,first_seen:string,last_seen:string,relationship_type:string,source_ref:string,target_ref:string>>"""
# STIX types and the node labels they become, and relationships with their edge type and whether they turn round.
STIX_LABELS = {"x-mitre-tactic": "Tactic", "course-of-action": "Mitigation", "intrusion-set": "Group", "malware": "Malware", "tool": "Tool", "campaign": "Campaign", "x-mitre-detection-strategy": "DetectionStrategy"}
STIX_EDGES = {"subtechnique-of": ("SUBTECHNIQUE_OF", False), "mitigates": ("MITIGATED_BY", True), "detects": ("DETECTED_BY", True), "attributed-to": ("ATTRIBUTED_TO", False)}
USERS, USED = ["Group", "Malware", "Tool", "Campaign"], {"Technique": "USES_TECHNIQUE", "SubTechnique": "USES_TECHNIQUE", "Tool": "USES_TOOL", "Malware": "USES_MALWARE"}
CAPEC_EDGES = {"ChildOf": "CHILD_OF", "CanPrecede": "CAN_PRECEDE", "CanFollow": "CAN_FOLLOW", "PeerOf": "PEER_OF", "CanAlsoBe": "CAN_ALSO_BE"}
NVD_FEEDS = ["nvdcve-2.0-2023.json", "nvdcve-2.0-2024.json", "nvdcve-2.0-2025.json", "nvdcve-2.0-2026.json", "nvdcve-2.0-modified.json", "nvdcve-2.0-recent.json"]


def read_stix(spark: SparkSession, *paths: str) -> DataFrame:
    """One row for each object of STIX bundles, with its file."""
    raw = spark.read.schema(STIX).option("multiLine", True).json(list(paths))
    return raw.select(F.url_decode("_metadata.file_name").alias("source_file"), F.posexplode("objects").alias("pos", "o")).select("source_file", "pos", "o.*")


def stix_graph(objects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, warnings) of STIX objects.

    Techniques are told from sub-techniques by their flag; phases become HAS_TACTIC edges over the tactic's short
    name, and a phase without a tactic a warning.  "mitigates" and "detects" turn round; "uses" gets its type from
    the labels of its ends and is dropped where these allow none; unknown types and ends that are no node are dropped.
    """
    table = F.create_map(*[F.lit(x) for pair in STIX_LABELS.items() for x in pair])
    label = F.when(F.col("type") == "attack-pattern", F.when(F.coalesce("x_mitre_is_subtechnique", F.lit(False)), "SubTechnique").otherwise("Technique")).otherwise(F.try_element_at(table, F.col("type")))
    nodes = objects.withColumn("label", label).where("label is not null and id is not null").select(
        F.col("id").alias("node_id"), "label", "name", F.coalesce("description", F.lit("")).alias("description"), I.first_external(F.col("external_references"), "external_id").alias("attack_id"), I.first_external(F.col("external_references"), "url").alias("url"),
        "created", "modified", F.coalesce("revoked", F.lit(False)).alias("revoked"), F.coalesce("x_mitre_deprecated", F.lit(False)).alias("deprecated"), F.col("x_mitre_shortname").alias("short_name"), F.col("x_mitre_platforms").alias("platforms"), "aliases", "first_seen", "last_seen", "source_file", "pos",
    )
    labels = nodes.select("node_id", "label").distinct()
    rel = objects.where("type = 'relationship'").select("relationship_type", F.col("source_ref").alias("src"), F.col("target_ref").alias("dst"), F.col("id").alias("edge_id"))
    ends = rel.join(labels.withColumnsRenamed({"node_id": "src", "label": "src_label"}), "src").join(labels.withColumnsRenamed({"node_id": "dst", "label": "dst_label"}), "dst")
    kinds = F.create_map(*[F.lit(x) for k, (v, _) in STIX_EDGES.items() for x in (k, v)])
    turned = F.col("relationship_type").isin([k for k, (_, t) in STIX_EDGES.items() if t])
    used = F.try_element_at(F.create_map(*[F.lit(x) for pair in USED.items() for x in pair]), F.col("dst_label"))
    ok = F.col("src_label").isin(USERS) & ~((F.col("src_label") == "Tool") & (F.col("dst_label") == "Tool"))
    kind = F.when(F.col("relationship_type") == "uses", F.when(ok, used)).otherwise(F.try_element_at(kinds, F.col("relationship_type")))
    edges = ends.select(kind.alias("type"), F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst"), "edge_id").where("type is not null")
    phases = objects.where("type = 'attack-pattern'").select(F.col("id").alias("src"), F.explode("kill_chain_phases.phase_name").alias("short_name"))
    tactics = nodes.where("label = 'Tactic' and short_name is not null").select(F.col("node_id").alias("dst"), "short_name").distinct()
    has = phases.join(tactics, "short_name").select(F.lit("HAS_TACTIC").alias("type"), "src", "dst", F.concat_ws(":", "src", F.lit("HAS_TACTIC"), "dst").alias("edge_id"))
    lost = phases.join(tactics, "short_name", "left_anti").select("src", F.concat(F.lit("no tactic for phase "), "short_name").alias("warning"))
    return nodes, edges.unionByName(has).distinct(), lost


def read_capec(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a CAPEC dictionary; a byte order mark and quotes in the header do not matter."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.toDF(*normalised_names([c.strip().lstrip("\ufeff").strip("'\" ") for c in rows.columns]))


def capec_graph(rows: DataFrame, all_weaknesses: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(patterns, edges, warnings) of a CAPEC dictionary.

    As in the dictionary's usual reading, adjacent entries of a ::1::2:: list share no delimiter, so every second
    one is skipped; ``all_weaknesses`` reads them all.
    """
    named = rows.withColumn("capec_id", I.pattern_id(F.col("ID")))
    ok = named.where("capec_id is not null")
    patterns = ok.select("capec_id", F.col("Name").alias("name"), F.coalesce("Description", F.lit("")).alias("description"), F.col("Abstraction").alias("abstraction"), F.col("Status").alias("status"), F.col("`Likelihood Of Attack`").alias("likelihood"), F.col("`Typical Severity`").alias("severity"))
    related = ok.select("capec_id", F.explode(I.related_patterns(F.col("`Related Attack Patterns`"))).alias("r"))
    natures = F.create_map(*[F.lit(x) for pair in CAPEC_EDGES.items() for x in pair])
    typed = related.select(F.try_element_at(natures, F.trim(F.col("r.nature"))).alias("type"), F.col("capec_id").alias("src"), I.pattern_id(F.col("r.capec_id")).alias("dst"), F.col("r.nature").alias("nature"))
    fields = I.delimited_all if all_weaknesses else I.delimited
    weak = ok.select(F.lit("RELATED_WEAKNESS").alias("type"), F.col("capec_id").alias("src"), F.explode(F.transform(fields(F.col("`Related Weaknesses`")), I.weakness_id)).alias("dst")).where("dst != ''")
    mapped = ok.select(F.lit("MAPS_TO_ATTACK").alias("type"), F.col("capec_id").alias("src"), F.explode(I.mapped_techniques(F.col("`Taxonomy Mappings`"))).alias("dst"))
    edges = reduce(DataFrame.unionByName, [typed.where("type is not null").drop("nature"), weak, mapped]).distinct()
    warnings = named.where("capec_id is null").select(F.lit(None).cast("string").alias("src"), F.lit("row without id").alias("warning")).unionByName(typed.where("type is null").select("src", F.concat(F.lit("unsupported nature "), "nature").alias("warning")))
    return patterns, edges, warnings


_METRIC = "array<struct<baseSeverity:string,cvssData:struct<version:string,baseSeverity:string,baseScore:double,vectorString:string,attackVector:string>>>"
_MATCH = "cpeMatch:array<struct<criteria:string,cpe23Uri:string,vulnerable:boolean,versionStartIncluding:string,versionEndExcluding:string>>"
NVD = f"""vulnerabilities array<struct<cve:struct<id:string,sourceIdentifier:string,published:string,lastModified:string,vulnStatus:string,descriptions:array<struct<lang:string,value:string>>,
metrics:struct<cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>,weaknesses:array<struct<description:array<struct<lang:string,value:string>>>>,
configurations:array<struct<nodes:array<struct<{_MATCH},nodes:array<struct<{_MATCH},nodes:array<struct<{_MATCH}>>>>>>>>,`references`:array<struct<url:string,source:string,tags:array<string>>>>>>"""


def read_nvd(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row for each vulnerability of NVD 2.0 feeds, with the feed's place in ``paths`` and its own in the feed."""
    parts = [spark.read.schema(NVD).option("multiLine", True).json(p).select(F.lit(i).alias("file_ord"), F.posexplode("vulnerabilities").alias("pos", "v")).select("file_ord", "pos", "v.cve.*") for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, parts)


def latest_cves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): the row of each CVE with the greatest lastModified as a text, of equals the later; rejected ones apart.

    A newer rejected row drops an older good one, since rejection is looked at afterwards.
    """
    w = Window.partitionBy("id").orderBy(F.desc(F.coalesce("lastModified", F.lit(""))), F.desc("file_ord"), F.desc("pos"))
    last = rows.where("id is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    bad = F.coalesce(F.col("vulnStatus"), F.lit("")) == "Rejected"
    return last.where(~bad), last.where(bad)


def nvd_graph(kept: DataFrame) -> dict[str, DataFrame]:
    """Tables cves, products, references and edges of the kept CVEs; the best metric is 3.1, then 3.0, then 2."""
    best = F.coalesce(*[F.when(F.size(f"metrics.{m}") > 0, F.struct(F.lit(m).alias("metric"), F.get(F.col(f"metrics.{m}"), F.lit(0)).alias("m"))) for m in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")])
    c = kept.withColumn("_b", best)
    cves = c.select(
        F.col("id").alias("cve_id"), I.first_text(F.col("descriptions")).alias("description"), "published", "lastModified", F.coalesce("_b.m.cvssData.version", "_b.metric").alias("cvss_version"),
        F.coalesce("_b.m.cvssData.baseSeverity", "_b.m.baseSeverity", F.lit("UNSCORED")).alias("severity"), F.col("_b.m.cvssData.baseScore").alias("base_score"), F.col("_b.m.cvssData.vectorString").alias("vector_string"), F.col("_b.m.cvssData.attackVector").alias("attack_vector"),
    )
    weak = kept.select(F.lit("HAS_WEAKNESS").alias("type"), F.col("id").alias("src"), F.explode(F.flatten("weaknesses.description")).alias("d")).select("type", "src", I.weakness_id(F.col("d.value")).alias("dst")).where("dst rlike '^CWE-[0-9]+$'").distinct()
    empty = F.array()
    level1 = F.flatten("configurations.nodes")
    with1 = kept.select("id", F.explode_outer(level1).alias("n1"))
    with2 = with1.select("id", "n1", F.explode_outer("n1.nodes").alias("n2"))
    matches = F.concat(F.coalesce("n1.cpeMatch", empty), F.coalesce("n2.cpeMatch", empty), F.coalesce(F.flatten("n2.nodes.cpeMatch"), empty))
    hits = with2.select("id", F.explode(matches).alias("x")).select("id", F.coalesce(F.nullif("x.criteria", F.lit("")), "x.cpe23Uri").alias("cpe_uri"), F.coalesce("x.vulnerable", F.lit(True)).alias("vulnerable"), "x.versionStartIncluding", "x.versionEndExcluding").where("cpe_uri is not null").distinct()
    products = hits.select("cpe_uri").distinct().select("cpe_uri", *[I.cpe_part(F.col("cpe_uri"), i).alias(n) for i, n in ((2, "part"), (3, "vendor"), (4, "product"), (5, "version"))])
    refs = kept.select("id", "file_ord", "pos", F.posexplode("references").alias("rp", "r")).where("r.url is not null")
    urls = refs.groupBy(F.col("r.url").alias("url")).agg(F.max_by(F.struct("r.source", "r.tags"), F.struct("file_ord", "pos", "rp")).alias("x")).select("url", "x.source", "x.tags")
    edges = reduce(DataFrame.unionByName, [weak, hits.select(F.lit("AFFECTS").alias("type"), F.col("id").alias("src"), F.col("cpe_uri").alias("dst")).distinct(), refs.select(F.lit("REFERENCES").alias("type"), F.col("id").alias("src"), F.col("r.url").alias("dst")).distinct()])
    return {"cves": cves, "products": products, "references": urls, "edges": edges}


def read_label_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(label, attack_id, attack_name, confidence, rationale) of a JSON object of objects."""
    raw = spark.read.option("wholetext", True).text(path)
    m = F.from_json("value", "map<string,struct<attack_id:string,attack_name:string,confidence:string,rationale:string>>")
    return raw.select(F.explode(m).alias("label", "v")).select("label", I.technique_id(F.col("v.attack_id")).alias("attack_id"), "v.attack_name", F.lower("v.confidence").alias("confidence"), "v.rationale")


def detected_as(mapping: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved labels): labels tied to the techniques that their mapping names."""
    tech = nodes.where("label in ('Technique', 'SubTechnique')").select("attack_id", F.col("node_id").alias("dst"))
    edges = mapping.join(tech, "attack_id").select(F.lit("DETECTED_AS").alias("type"), F.col("label").alias("src"), "dst", "confidence")
    return edges, mapping.join(tech, "attack_id", "left_anti").select("label", "attack_id")


def weakness_nodes(*edges: DataFrame) -> DataFrame:
    """The distinct weaknesses that edges point to, as nodes."""
    ids = reduce(DataFrame.unionByName, [e.where("type in ('RELATED_WEAKNESS', 'HAS_WEAKNESS')").select(F.col("dst").alias("cwe_id")) for e in edges])
    return ids.where("cwe_id != ''").distinct()
