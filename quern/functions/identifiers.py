"""Security identifiers in texts and feeds: extraction, normal forms, small parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of identifiers.
PATTERNS = {
    "technique": r"\bT\d{4}(?:\.\d{3})?\b",
    "tactic": r"\bTA\d{4}\b",
    "mitigation": r"\bM\d{4}\b",
    "capec": r"\bCAPEC-\d+\b",
    "cwe": r"\bCWE-\d+\b",
    "cve": r"\bCVE-\d{4}-\d{4,}\b",
}


def extracted(col: Column | str, kind: str, any_case: bool = False) -> Column:
    """The distinct identifiers of a kind in order of first use; with ``any_case`` in upper case."""
    text = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(("(?i)" if any_case else "") + PATTERNS[kind]), 0)
    return F.array_distinct(F.transform(found, F.upper) if any_case else found)


def all_extracted(col: Column | str) -> Column:
    return F.array_distinct(F.concat(*[extracted(col, k) for k in PATTERNS]))


def technique_id(col: Column) -> Column:
    """An ATT&CK id: a leading digit gets its T."""
    c = F.trim(col)
    return F.when(c.rlike("^[0-9]"), F.concat(F.lit("T"), c)).otherwise(c)


def weakness_id(col: Column) -> Column:
    """CWE-n from CWE-n in any case or a bare number; NVD-CWE-* stays; null and blank give ''."""
    c = F.upper(F.trim(F.coalesce(col, F.lit(""))))
    return F.when(c == "", "").when(c.startswith("NVD-CWE-"), F.trim(col)).when(c.startswith("CWE-"), c).when(c.rlike("^[0-9]+$"), F.concat(F.lit("CWE-"), c)).otherwise(c)


def pattern_id(col: Column) -> Column:
    c = F.trim(F.coalesce(col, F.lit("")))
    return F.when(c == "", F.lit(None)).when(F.upper(c).startswith("CAPEC-"), F.upper(c)).otherwise(F.concat(F.lit("CAPEC-"), c))


def first_external(refs: Column, field: str) -> Column:
    """The first non-empty field of an array of external references."""
    return F.get(F.filter(refs, lambda r: r[field].isNotNull() & (r[field] != "")), F.lit(0))[field]


def first_text(texts: Column, lang: str = "en") -> Column:
    """The description in a language, else the first one, else ''."""
    hit = F.get(F.filter(texts, lambda d: d["lang"] == lang), F.lit(0))["value"]
    own = F.exists(texts, lambda d: d["lang"] == lang)
    return F.coalesce(F.when(own, F.coalesce(hit, F.lit(""))), F.get(texts, F.lit(0))["value"], F.lit(""))


def cpe_part(col: Column, place: int) -> Column:
    """A field of a CPE 2.3 name, '' if the name is too short: 2 part, 3 vendor, 4 product, 5 version."""
    return F.coalesce(F.get(F.split(col, ":"), F.lit(place)), F.lit(""))


def delimited(col: Column, first: int = 1) -> Column:
    """The fields of a ::a::b:: list.  As matches share no delimiter, every second field of a run is skipped."""
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit("::([^:]+)::"), first)


def delimited_all(col: Column) -> Column:
    """All fields of a ::a::b:: list."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), "::"), lambda x: F.trim(x) != "")


def related_patterns(col: Column) -> Column:
    """(nature, capec_id) of each NATURE:x:CAPEC ID:y entry."""
    text, pattern = F.coalesce(col, F.lit("")), F.lit(r"NATURE:([^:]+):CAPEC ID:([^:]+)")
    return F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("nature"), F.regexp_extract_all(text, pattern, 2).alias("capec_id"))


def mapped_techniques(col: Column) -> Column:
    """Technique ids of TAXONOMY NAME:ATTACK:ENTRY ID:x entries."""
    found = F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(r"TAXONOMY NAME:ATTACK:ENTRY ID:([^:]+)"), 1)
    return F.array_distinct(F.transform(found, technique_id))


def slug(col: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "_"), F.lit("_"))


def short_hash(col: Column, size: int = 8) -> Column:
    return F.substring(F.sha1(col), 1, size)


def record_hash(*cols: str) -> Column:
    """SHA-256 of the JSON of the columns in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(cols))), 256)
