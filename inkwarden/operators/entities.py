"""Detection of sensitive entities: patterns, dictionaries, person names, and the choice among overlaps.

All detectors are column expressions over one text, so a table of texts is scanned in one narrow stage.
A detector yields ``array<struct<text, start, end>>`` with code-point offsets. Categories that are not
active are left out of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rx, values
from ..functions.strings import bind
from .persons import hyphenated, person_names

_MONTHS = rx.any_of(values.MONTHS.split() + values.SHORT_MONTHS.split())

# Category, pattern, ignoring case. ``\b`` and ``\s`` are translated for Spark.
PATTERNS = [
    ("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", False),
    ("PHONE", r"(?:\+|00)\d[\d\s().\-]{6,}\d|\b\d{3,4}[\s.\-]\d{3,4}[\s.\-]\d{3,4}\b", False),
    ("REFCOM", r"\bRefcom\s*(?:no\.?|number|num\.?|#|:)?\s*:?\s*\d{3,10}\b", True),
    ("REFCOM", r"\bRefcom\s*[/\-]\s*\d{3,10}\b", True),
    ("REFCOM", r"\bRefcom\b[^\n\r]{0,30}?(?:\d{4,10})\b", True),
    ("REFCOM", r"\b[A-Z]{2,4}[/\-]\d{4}[/\-]\d{3,8}\b", False),
    ("REFCOM", r"\bIPAT\s+(?:reference|ref\.?)\s*[:\-]?\s*\S+", True),
    ("CASE_ID", r"\b(?:Case|File|Ref|Reference)\s*(?:No\.?|Number|Num\.?|#)?\s*[:\-]?\s*[A-Z0-9]{2,}[/\-]?\d{2,}\b", True),
    ("CASE_ID", r"\b[A-Z]{1,4}[/\-]\d{4}[/\-]\d{2,6}\b", False),
    ("PASSPORT_OR_ID", r"\b(?:Passport|ID|Identity(?:\s+Card)?|Document)\s*(?:No\.?|Number)?\s*[:\-]?\s*[A-Z0-9]{5,20}\b", True),
    ("ADDRESS", r"\b\d{1,4}\s+[A-Z][A-Za-z0-9'.\-]+(?:\s+[A-Z][A-Za-z0-9'.\-]+){0,4}\s+(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Lane|Ln\.?|Way|Place|Pl\.?|Drive|Dr\.?|Court|Ct\.?)\b", True),
    ("DATE_EXACT", rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_MONTHS})\s+\d{{4}}\b", True),
    ("DATE_EXACT", rf"\b(?:{_MONTHS})\s+\d{{4}}\b", True),
    ("DATE_EXACT", r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b", False),
    ("FACILITY", r"\b(?:Reception\s+(?:Centre|Center)|Closed\s+Controlled\s+Access\s+(?:Centre|Center)|CCAC|Detention\s+(?:Centre|Center)|Open\s+Centre|Camp)\s+[A-Z][\w\s\-]{0,30}\b", True),
    ("ROUTE", r"\b(?:route\s+(?:via|through|from)\s+[A-Z][A-Za-z\-]+(?:\s*[–\-]\s*[A-Z][A-Za-z\-]+)*)\b", True),
]
LOCATION = r"\b((?:in|at|from|to|arrived\s+in|departed\s+from|fled\s+from|left)\s+)([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,}){0,2})\b"
CATEGORIES = ("EMAIL", "PHONE", "CASE_ID", "PASSPORT_OR_ID", "ADDRESS", "DATE_EXACT", "FACILITY", "ROUTE", "COUNTRY", "LOCATION", "FAMILY_TERM", "PERSON")
# End of fixed values.

#: What switches a pattern's category on.
_SWITCH = {"REFCOM": "CASE_ID"}
LEVELS = ("light", "standard", "demo-safe")
ENTITY = "array<struct<start:int,neg_length:int,ord:int,cat:string,text:string,end:int>>"


def pattern_spans(text: Column, category: str) -> list[tuple[int, Column]]:
    """(emission order, spans) of each pattern of a category."""
    return [(k, rx.spans(text, rx.java(p, i))) for k, (c, p, i) in enumerate(PATTERNS) if c == category]


def dictionary_spans(text: Column, words: list[str]) -> Column:
    """Case-sensitive whole-word hits; no entry of these dictionaries lies within another."""
    return rx.spans(text, rx.java(rf"\b(?:{rx.any_of(words)})\b"))


def location_spans(text: Column) -> Column:
    return rx.spans(text, rx.java(LOCATION), before=True)


def family_spans(text: Column) -> Column:
    return rx.spans(text, rx.java(rf"\b(?:{rx.any_of(values.FAMILY_TERMS.split())})\b", True))


def _labelled(found: Column, category: str, order: int) -> Column:
    """Sortable entities: start, longer first, then emission order."""
    return F.transform(
        found, lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("neg_length"), F.lit(order).alias("ord"), F.lit(category).alias("cat"), s["text"].alias("text"), s["end"].alias("end"))
    )


def candidates(text: Column, level: str = "demo-safe", active: tuple[str, ...] = CATEGORIES) -> Column:
    """All candidates of the active categories, before overlaps are resolved."""
    parts = [_labelled(rx.spans(text, rx.java(p, i)), c, k) for k, (c, p, i) in enumerate(PATTERNS) if _SWITCH.get(c, c) in active]
    if "COUNTRY" in active:
        parts.append(_labelled(dictionary_spans(text, values.listed(values.COUNTRIES)), "COUNTRY", 100))
        parts.append(_labelled(dictionary_spans(text, list(values.DETECT_DEMONYMS)), "NATIONALITY", 101))
    if level != "light" and "LOCATION" in active:
        parts.append(_labelled(location_spans(text), "LOCATION", 102))
    if level != "light" and "FAMILY_TERM" in active:
        parts.append(_labelled(family_spans(text), "FAMILY_TERM", 103))
    if "PERSON" in active:
        parts.append(_labelled(person_names(text), "PERSON", 104))
    found = F.concat(*parts) if parts else F.array().cast(ENTITY)
    if "PERSON" not in active:
        return found

    def with_hyphenated(all_found: Column) -> Column:
        free = F.filter(hyphenated(text), lambda h: ~F.exists(all_found, lambda e: (h["start"] >= e["start"]) & (h["start"] < e["end"])))
        return F.concat(all_found, _labelled(free, "PERSON", 105))

    return bind(found, with_hyphenated)


def resolve(found: Column) -> Column:
    """Sorts by start, longer first, emission order; keeps from left to right what begins at or after the last end."""

    def step(last: Column, e: Column) -> tuple[Column, Column]:
        hidden = e["start"] < last
        return F.when(hidden, last).otherwise(e["end"]), F.when(hidden, F.array().cast(ENTITY)).otherwise(F.array(e))

    return rx.sweep(F.array_sort(found), F.lit(-1), ENTITY, step)


def detect(texts: DataFrame, text_col: str = "text", level: str = "demo-safe", active: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Adds ``entities`` (disjoint, sorted) to each row; null texts have none."""
    if level not in LEVELS:
        raise ValueError(f"level is one of {LEVELS}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return texts.withColumn("entities", resolve(candidates(text, level, active)))


def exploded(detected: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each entity: keys, ``seq``, ``cat``, ``text``, ``start``, ``end``."""
    # not the bare column: Spark would put a filter on its size below the detection, which would then run three times
    rows = detected.select(*keys, F.posexplode(F.transform("entities", lambda e: e)).alias("seq", "e"))
    return rows.select(*keys, "seq", "e.cat", "e.text", "e.start", "e.end")


def spans_of(texts: DataFrame, keys: list[str], text_col: str, found: Column) -> DataFrame:
    """A row for each span of one detector."""
    rows = texts.select(*keys, F.posexplode(found).alias("seq", "s"))
    return rows.select(*keys, "seq", F.col("s.text").alias("text"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def redact(detected: DataFrame, text_col: str = "text", token: str = "[REDACTED]") -> Column:
    """The text with each entity replaced by a fixed token."""
    return rewrite(F.coalesce(F.col(text_col), F.lit("")), F.col("entities"), lambda e: F.lit(token))


def rewrite(text: Column, entities: Column, replacement) -> Column:
    """The text with disjoint sorted entities replaced by ``replacement(entity)``."""

    def done(es: Column) -> Column:
        last = lambda i: F.coalesce(F.get(es, i - 1)["end"], F.lit(0))
        parts = F.transform(es, lambda e, i: F.concat(F.substring(text, last(i) + 1, e["start"] - last(i)), replacement(e)))
        return F.concat(F.array_join(parts, ""), F.substring(text, last(F.size(es)) + 1, F.char_length(text)))

    return F.when(F.size(entities) == 0, text).otherwise(bind(entities, done))
