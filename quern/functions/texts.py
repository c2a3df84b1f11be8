"""Texts as columns: words, sentences, n-grams, cuts, JSON checks; all but ``embedded_json`` run in the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BRACE = re.compile("[{}]")
WORD = r"\b[a-zA-Z][a-zA-Z0-9_-]*\b"


def _c(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def tokens(col: Column | str) -> Column:
    """Lower-case words that begin with a letter."""
    return F.transform(F.regexp_extract_all(_c(col), F.lit(WORD), 0), F.lower)


def squeezed(col: Column | str) -> Column:
    """Runs of blanks as one blank, none around."""
    return F.trim(F.regexp_replace(_c(col), r"\s+", " "))


def sentences(col: Column | str) -> Column:
    parts = F.split(F.regexp_replace(_c(col), "\n", " "), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, squeezed), lambda s: s != "")


def ngrams(toks: Column, n: int) -> Column:
    """The n-grams of an array of words, joined by blanks; none if it is shorter."""
    return F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), lambda i: F.array_join(F.slice(toks, i, n), " "))).otherwise(F.array().cast("array<string>"))


def opening(col: Column | str, size: int = 140) -> Column:
    return F.left(F.get(sentences(col), F.lit(0)), F.lit(size))


def closing(col: Column | str, size: int = 140) -> Column:
    s = sentences(col)
    return F.left(F.get(s, F.size(s) - 1), F.lit(size))


def compacted(col: Column | str, limit: int) -> Column:
    """Squeezed, and if longer than ``limit`` cut and ended with three points."""
    t = squeezed(col)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("...")))


def cut_at_word(col: Column | str, limit: int) -> Column:
    """Squeezed, and if longer than ``limit`` cut after its last whole word."""
    t = squeezed(col)
    head = F.substring(t, 1, limit)
    return F.when(F.length(t) <= limit, t).otherwise(F.regexp_replace(head, r"\s+\S*$", ""))


def unfenced(col: Column | str) -> Column:
    """A text without the fence around it."""
    t = F.trim(_c(col))
    open_ = F.regexp_replace(t, r"(?i)^```(?:json)?\s*", "")
    return F.when(t.startswith("```"), F.trim(F.regexp_replace(open_, r"\s*```$", ""))).otherwise(t)


def parses_as_json(col: Column | str) -> Column:
    """Whether a text, fences aside, is a JSON object or array."""
    t = unfenced(col)
    return t.rlike(r"^\s*[\[{]") & F.try_parse_json(t).isNotNull()


def contains_any(col: Column | str, phrases: list[str]) -> Column:
    """The phrases that a text contains, case ignored."""
    low = F.lower(_c(col))
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p))


def claimed(col: Column | str, claim: str, denial: str) -> Column:
    """Whether a text makes a claim other than in denying it."""
    t, says, denies = _c(col), f"(?i){claim}", f"(?i){denial}"
    return t.rlike(says) & (~t.rlike(denies) | F.regexp_replace(t, denies, "").rlike(says))


def bucket_of(col: Column | str, n: int = 8) -> Column:
    """The number at the end of an id, modulo n; 0 without one."""
    return F.pmod(F.coalesce(F.regexp_extract(_c(col), r"(\d{1,18})$", 1).try_cast("long"), F.lit(0)), F.lit(n))


def json_texts(col: Column | str) -> Column:
    """The string values of a flat JSON object with strings and lists of strings, in order, or the text itself."""
    t = unfenced(col)
    values = F.map_values(F.from_json(t, "map<string,string>"))
    return F.coalesce(F.array_join(F.transform(values, lambda v: F.regexp_replace(v, r'^\["|"\]$|","', " ")), " "), t)


def clean_properties(col: Column, drop: tuple[str, ...] = ("raw_id", "source_file", "ingested_at", "stix_id", "tactic_short_names")) -> Column:
    """A map of properties without internal keys and without empty values."""
    return F.map_filter(col, lambda k, v: ~k.isin(*drop) & v.isNotNull() & ~v.isin("", "[]"))


def compact_properties(col: Column, verbose: tuple[str, ...] = ("description", "detection", "execution_flow"), short: int = 420, long: int = 800) -> Column:
    """A map of properties with its verbose values cut to ``short`` characters and all others to ``long``."""
    return F.transform_values(col, lambda k, v: F.when(k.isin(*verbose), compacted(v, short)).otherwise(compacted(v, long)))


def _first_objects(texts: pd.Series) -> pd.Series:
    def first(text: str | None) -> str | None:
        if text is None or (start := text.find("{")) < 0:
            return None
        depth = 0
        for m in _BRACE.finditer(text, start):
            depth += 1 if m.group() == "{" else -1
            if not depth:
                return text[start : m.end()]
        return None

    return texts.map(first, na_action=None)


def embedded_json(col: Column | str) -> Column:
    """The first object in braces that stands in a text, with its braces balanced; null if there is none.

    Braces count wherever they stand, in strings, too.  Batches come by Arrow; no built-in function counts depth.
    """
    return F.pandas_udf(_first_objects, "string")(col)
