"""Rules over records as one column of findings, joins with decisions, agreement, training texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import identifiers as I
from quern.functions import texts as X

# Phrases that betray how a text was made, and names of readers' roles.
INTERNAL_PHRASES = ["this example prepares future agreement analysis", "no agreement module is executed", "this is a training example", "difficulty level", "generation pipeline", "corpus generator", "dataset generator", "future module"]
ROLE_PHRASES = ["tier-1 soc analyst", "tier-2 soc analyst", "tier-3 soc analyst", "threat hunter", "incident responder", "blue team engineer", "executive briefing analyst", "security assurance analyst"]
ATTRIBUTION_PHRASES = ["attributed to", "responsible for this incident"]
# A graph taken for proof, and its denials.
PROOF = r"graph(?:rag)? (?:proves|confirms)|retrieved graph (?:proves|confirms)|proof of compromise"
NO_PROOF = r"not (?:a )?proof(?: of compromise)?|not evidence of attribution|does not (?:prove|confirm)|isn't (?:proof|evidence)|cannot (?:prove|confirm)|should not be treated as proof"
# Terms of the agreement reading.
UNCERTAIN = ["uncertain", "insufficient", "evidence gap", "missing evidence", "cannot determine"]
BENIGN_READING = r"\bfalse positive\b|\bnot an? attack\b|\bno attack\b|\bclassified as benign\b|\bassess(?:ed)? as benign\b|\blikely benign\b"
ATTACK_TERMS = ["attack", "exploit", "technique", "compromise", "mitigation", "detection", "malicious"]


def findings(**rules: Column) -> Column:
    """The names of the rules that hold, in order; a rule that is null does not hold."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def record_findings(df: DataFrame, output: str, allowed: Column, required: list[str], order: list[str], provenance: str | None = None) -> DataFrame:
    """``df`` with ``errors``: missing fields, repeated records, missing provenance, invented identifiers, phrases.

    Of equal records, told by the hash of the required fields, all but the first by ``order`` (which tells records
    apart) are repeated; the first is found by a minimum combined before the shuffle, not by ranking the copies.
    """
    text = F.lower(F.coalesce(F.col(output), F.lit("")))
    hashed = df.withColumn("_hash", I.record_hash(*required))
    place = F.struct(*order)
    first = hashed.groupBy("_hash").agg(F.min(place).alias("_first"))
    again = place != F.col("_first")
    rules = {f"missing field: {c}": F.col(c).isNull() for c in required}
    rules["duplicate example"] = again
    if provenance:
        rules["missing provenance"] = F.coalesce(F.col(provenance), F.lit("")) == ""
    rules["invented security identifiers"] = F.size(F.array_except(I.all_extracted(output), allowed)) > 0
    rules["unsupported attribution phrasing"] = F.size(X.contains_any(text, ATTRIBUTION_PHRASES)) > 0
    rules["unsupported asset exposure claim"] = text.contains("confirmed exposure") & ~text.contains("asset evidence")
    rules["internal phrase"] = F.size(X.contains_any(text, INTERNAL_PHRASES)) > 0
    rules["visible role label"] = F.size(X.contains_any(text, ROLE_PHRASES)) > 0
    rules["graph taken for proof"] = X.claimed(output, PROOF, NO_PROOF)
    return hashed.join(first, "_hash").withColumn("errors", findings(**rules)).drop("_hash", "_first")


def last_decisions(decisions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last decision of each key, in the given order."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return decisions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_decisions(records: DataFrame, decisions: DataFrame, key: str, decision: str) -> DataFrame:
    """Records with their decision; ``unreviewed`` where there is none."""
    return records.join(decisions, key, "left").withColumn(decision, F.coalesce(F.col(decision), F.lit("unreviewed")))


def unmatched_decisions(records: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    return decisions.join(records.select(key).distinct(), key, "left_anti")


def agreement(prediction: Column, confidence: Column, text: Column, sparse: Column) -> Column:
    """How a classifier and a written assessment agree; the first branch that holds decides."""
    low = F.lower(F.coalesce(text, F.lit("")))
    attack = F.upper(prediction) == "ATTACK"
    sure = F.coalesce(confidence, F.lit(0.0)) >= 0.9
    uncertain = F.size(X.contains_any(low, UNCERTAIN)) > 0
    relevant = F.size(X.contains_any(low, ATTACK_TERMS)) > 0
    return (
        F.when(sparse, "evidence_gap")
        .when(attack & low.rlike(BENIGN_READING), "classifier_attack_llm_benign_or_uncertain")
        .when(attack & sure & relevant & ~uncertain, "agree_attack_high_confidence")
        .when(attack & uncertain, "llm_uncertain_classifier_attack")
        .when(attack & sure, "agree_attack_high_confidence")
        .when(attack, "agree_attack_low_confidence")
        .otherwise("evidence_gap")
    )


def chat_text(system: str, user: Column, assistant: Column) -> Column:
    """A chat in one text with header and end-of-turn marks."""
    turn = lambda role, text: F.concat(F.lit(f"<|start_header_id|>{role}<|end_header_id|>\n\n"), text, F.lit("<|eot_id|>"))
    return F.concat(F.lit("<|begin_of_text|>"), turn("system", F.lit(system)), turn("user", user), turn("assistant", assistant))


def chat_messages(system: str, user: Column, assistant: Column) -> Column:
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(one("system", F.lit(system)), one("user", user), one("assistant", assistant))


def prompt_and_target(text: Column) -> tuple[Column, Column]:
    """A chat text cut after the last assistant header: what is asked, and what is to be answered."""
    mark = "<|start_header_id|>assistant<|end_header_id|>\n\n"
    parts = F.split(text, r"\Q" + mark + r"\E")
    target = F.regexp_replace(F.element_at(parts, -1), r"<\|eot_id\|>\s*$", "")
    prompt = F.concat(F.array_join(F.slice(parts, 1, F.size(parts) - 1), mark), F.lit(mark))
    return prompt, target


def templated(contexts: DataFrame, templates: DataFrame, key: str, per_context: int, seed: str = "42") -> DataFrame:
    """Each context with ``per_context`` of a few templates, chosen at random for it; {field} is filled in.

    ``templates`` (template_id, pattern) is a handful of rows and is joined to every context.
    """
    from quern.operators.sampling import shuffled

    listed = templates.agg(F.array_sort(F.collect_list(F.struct("template_id", "pattern"))).alias("all_"))
    each = contexts.crossJoin(F.broadcast(listed))
    order = F.array_sort(F.transform("all_", lambda t: F.struct(shuffled(F.concat(F.col(key).cast("string"), F.lit("/"), t["template_id"].cast("string")), seed).alias("r"), t["template_id"].alias("template_id"), t["pattern"].alias("pattern"))))
    picked = each.select(*contexts.columns, F.explode(F.slice(order, 1, per_context)).alias("t"))
    text = F.col("t.pattern")
    for c in contexts.columns:
        text = F.replace(text, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return picked.select(*contexts.columns, F.col("t.template_id").alias("template_id"), text.alias("instruction"))
