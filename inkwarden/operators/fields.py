"""Structured personal data from page text, with fixed confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rx, values
from ..functions.strings import mrz_date, passport_check, validate_date

_EN = rx.any_of(values.MONTHS.split() + values.SHORT_MONTHS.split())
_FR = rx.any_of(values.FRENCH_MONTHS.split())

# Patterns (ignoring case or not) and confidences.
PASSPORT = r"\b([A-Z]{1,2}\d{6,9}|[A-Z0-9]{9})\b"
NATIONAL_ID = r"\b([A-Z]{0,3}\s?-?\s?\d{5,12}[A-Z]?)\b"
CASE = r"\b(?:Refcom|Case|Ref|File|Application|IPAT|INIS|ORAC|IPO)\s*(?:No\.?|Number|#|:)?\s*[:\-]?\s*([A-Z0-9/\-]{4,20})\b"
DATES = [
    (rf"\b(\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_EN})\s+\d{{4}})\b", True),
    (rf"\b(\d{{1,2}}\s+(?:{_FR})\s+\d{{4}})\b", True),
    (r"\b(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4})\b", False),
    (r"\b(\d{4}[/\-]\d{2}[/\-]\d{2})\b", False),
]
EMAIL = r"\b([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})\b"
PHONE = r"(?:\+|00)\d[\d\s().\-]{6,}\d|\b\d{3,4}[\s.\-]\d{3,4}[\s.\-]\d{3,4}\b"
MRZ = r"[A-Z0-9<]{30,44}"
BIRTHPLACE = r"\b(?:born\s+in|place\s+of\s+birth\s*[:=]|birthplace\s*[:=]|né\s+à|née\s+à)\s+([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,}){0,2})\b"
CONFIDENCE = {"passportNumbers": 85, "caseNumbers": 90, "datesOfBirth": 82, "placesOfBirth": 75, "nationalities": 88, "emails": 97, "phones": 80, "mrz": 92}
FIELDS = ("passportNumbers", "caseNumbers", "datesOfBirth", "placesOfBirth", "nationalities", "emails", "phones")
# End of fixed values.


def _simple(text: Column, pattern: str, ignore_case: bool, group: int) -> Column:
    return F.array_distinct(rx.matches(text, rx.java(pattern, ignore_case), group))


def passport_numbers(text: Column) -> Column:
    return _simple(text, PASSPORT, False, 1)


def national_ids(text: Column) -> Column:
    """Not part of ``extract``; for callers who want them."""
    return _simple(text, NATIONAL_ID, False, 1)


def case_numbers(text: Column) -> Column:
    return _simple(text, CASE, True, 0)


def emails(text: Column) -> Column:
    return _simple(text, EMAIL, False, 1)


def phones(text: Column) -> Column:
    return F.array_distinct(F.transform(rx.matches(text, rx.java(PHONE)), lambda x: F.trim(x)))


def birthplaces(text: Column) -> Column:
    return _simple(text, BIRTHPLACE, True, 1)


def dates(text: Column, max_year: int, faithful: bool = False) -> Column:
    """array<struct<value, normalised>> of the dates that are valid, in pattern order."""
    raw = F.array_distinct(F.concat(*(rx.matches(text, rx.java(p, i), 1) for p, i in DATES)))
    both = F.transform(raw, lambda x: F.struct(x.alias("value"), validate_date(x, max_year, faithful).alias("normalised")))
    return F.filter(both, lambda x: x["normalised"].isNotNull())


def nationalities(text: Column) -> Column:
    """array<struct<value, country>> in dictionary order, whatever the case in the text.

    One scan finds all words (none lies within another); each distinct one is looked up and sorted by its place.
    """
    pattern = rx.java(rf"\b(?:{rx.any_of(list(values.EXTRACT_DEMONYMS))})\b", True)
    known = F.create_map(*(x for i, (w, c) in enumerate(values.EXTRACT_DEMONYMS.items()) for x in (F.lit(w.lower()), F.struct(F.lit(i).alias("ord"), F.lit(w).alias("value"), F.lit(c).alias("country")))))
    found = F.array_distinct(F.transform(rx.matches(text, pattern), lambda w: F.lower(w)))
    listed = F.array_sort(F.transform(found, lambda w: F.element_at(known, w)))
    return F.transform(listed, lambda x: F.struct(x["value"].alias("value"), x["country"].alias("country")))


def mrz_lines(text: Column) -> Column:
    return rx.matches(text, MRZ)


def parse_mrz(lines: Column) -> Column:
    """struct of the first two machine-readable lines, null unless there are two and the first is a passport's."""
    good = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, rx.java(r"\s"), "")), lambda x: x.rlike("^[A-Z0-9<]{29,44}$"))
    first, second = F.rpad(F.get(good, F.lit(0)), 44, "<"), F.rpad(F.get(good, F.lit(1)), 44, "<")
    names = F.split(F.substring(first, 6, 39), "<<")
    spaced = lambda x: F.trim(F.translate(F.coalesce(x, F.lit("")), "<", " "))
    bare = lambda a, n: F.replace(F.substring(second, a, n), F.lit("<"), F.lit(""))
    parsed = F.struct(
        spaced(F.get(names, F.lit(0))).alias("surname"),
        spaced(F.get(names, F.lit(1))).alias("given_names"),
        bare(1, 9).alias("passport_no"),
        bare(11, 3).alias("nationality"),
        mrz_date(F.substring(second, 14, 6)).alias("dob"),
        F.lit(CONFIDENCE["mrz"]).alias("confidence"),
    )
    return F.when((F.size(good) >= 2) & first.startswith("P"), parsed)


def extract(pages: DataFrame, max_year: int, text_col: str = "text", faithful: bool = False) -> DataFrame:
    """Adds an array column for each kind of field and ``mrz``; kinds without a find are null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = lambda a: F.transform(a, lambda x: F.struct(x.alias("value"), F.lit(None).cast("string").alias("normalised"), F.lit(None).cast("string").alias("country")))
    found = {
        "passportNumbers": plain(passport_numbers(text)),
        "caseNumbers": plain(case_numbers(text)),
        "datesOfBirth": F.transform(dates(text, max_year, faithful), lambda x: F.struct(x["value"].alias("value"), x["normalised"].alias("normalised"), F.lit(None).cast("string").alias("country"))),
        "placesOfBirth": plain(birthplaces(text)),
        "nationalities": F.transform(nationalities(text), lambda x: F.struct(x["value"].alias("value"), F.lit(None).cast("string").alias("normalised"), x["country"].alias("country"))),
        "emails": plain(emails(text)),
        "phones": plain(phones(text)),
    }
    out = pages.withColumns({k: rx.bind(v, lambda a: F.when(F.size(a) > 0, a)) for k, v in found.items()})
    return out.withColumn("mrz", parse_mrz(mrz_lines(text)))


def long_form(extracted: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each value: keys, ``field``, ``seq``, ``value``, ``normalised``, ``country``, ``confidence``."""
    kinds = F.create_map(*(x for f in FIELDS for x in (F.lit(f), F.coalesce(F.col(f), F.array().cast("array<struct<value:string,normalised:string,country:string>>")))))
    rows = extracted.select(*keys, F.explode(kinds).alias("field", "found")).select(*keys, "field", F.posexplode("found").alias("seq", "v"))
    confidence = F.element_at(F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv)), F.col("field"))
    return rows.select(*keys, "field", "seq", "v.value", "v.normalised", "v.country", confidence.alias("confidence"), F.lit("regex").alias("source"))


def roll_up(fields: DataFrame, doc: str, page: str) -> DataFrame:
    """Values of a document by field, in page order."""
    ordered = F.array_sort(F.collect_list(F.struct(page, "seq", "value")))
    return fields.groupBy(doc, "field").agg(F.transform(ordered, lambda x: x["value"]).alias("items"))


def first_only(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def passport_issues(fields: DataFrame) -> DataFrame:
    """Passport numbers with their check."""
    return fields.where("field = 'passportNumbers'").withColumn("check", passport_check(F.col("value")))
