"""Scalar functions of the document rules as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import values
from .rx import any_of, bind, java


def to_alpha(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, and so on for any number; nothing for others."""
    start = F.struct(n.cast("long").alias("n"), F.lit("").alias("out"))

    def step(s: Column, _: Column) -> Column:
        letter = F.chr(F.lit(65) + F.pmod(s["n"] - 1, F.lit(26)))
        further = F.struct(F.call_function("div", s["n"] - 1, F.lit(26)).alias("n"), F.concat(letter, s["out"]).alias("out"))
        return F.when(s["n"] > 0, further).otherwise(s)

    # 14 letters hold every long
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda s: s["out"])


def phonetic(s: Column) -> Column:
    """Folds spelling variants: digraphs, vowel runs, doubled letters; keeps a-z only."""
    out = F.lower(s)
    for found, put in (("ph", "f"), ("ck", "k"), ("ae", "a"), ("oe", "u"), ("ou", "u"), ("oo", "u"), ("ee|ei", "i"), ("gh", "g"), ("kh", "k"), ("dh", "d"), ("th", "t"), ("ch", "sh")):
        out = F.regexp_replace(out, found, put)
    out = F.regexp_replace(out, "([aeiou])[aeiou]+", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"(.)\1+", "$1"), "[^a-z]", "")


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity; half of the mismatched matches count as transpositions, unrounded."""

    def matched(x: Column, y: Column) -> Column:
        reach = F.greatest(F.floor(F.greatest(F.size(x), F.size(y)) / 2).cast("int") - 1, F.lit(0))
        start = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast("array<string>").alias("own"))

        def step(s: Column, i: Column) -> Column:
            near = F.filter(F.sequence(F.lit(0), F.size(y) - 1), lambda j: (j >= i - reach) & (j <= i + reach) & (F.get(x, i) == F.get(y, j)) & ~F.array_contains(s["taken"], j))
            j = F.get(near, F.lit(0))
            return F.when(j.isNull(), s).otherwise(F.struct(F.concat(s["taken"], F.array(j)).alias("taken"), F.concat(s["own"], F.array(F.get(x, i))).alias("own")))

        def score(s: Column) -> Column:
            m = F.size(s["taken"])
            theirs = F.transform(F.array_sort(s["taken"]), lambda j: F.get(y, j))
            off = F.size(F.filter(F.zip_with(s["own"], theirs, lambda p, q: p != q), lambda z: z))
            return F.when(m == 0, 0.0).otherwise((m / F.size(x) + m / F.size(y) + (m - off / 2) / m) / 3)

        return F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), start, step, score)

    full = bind(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda s: matched(s["x"], s["y"]))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(full)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro plus a tenth of the rest for each of up to four common first letters."""
    prefix = F.lit(0)
    for k in (4, 3, 2, 1):
        same = (F.substring(a, 1, k) == F.substring(b, 1, k)) & (F.char_length(a) >= k) & (F.char_length(b) >= k)
        prefix = F.when(same, F.greatest(prefix, F.lit(k))).otherwise(prefix)
    return bind(jaro(a, b), lambda j: j + prefix * 0.1 * (1 - j))


_MONTH = any_of(values.listed(values.MONTHS))


def generalise_date(raw: Column) -> Column:
    """Month and year of a date with a full month name, ``Year y`` of a numeric one, else ``Date Redacted``."""
    full = java(rf"\d{{1,2}}(?:st|nd|rd|th)?\s+({_MONTH})\s+(\d{{4}})", True)
    month = java(rf"({_MONTH})\s+(\d{{4}})", True)
    numeric = r"^(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})$"
    named = lambda p: F.concat_ws(" ", F.regexp_extract(raw, p, 1), F.regexp_extract(raw, p, 2))
    year = F.regexp_extract(raw, numeric, 3)
    return (
        F.when(raw.rlike(full), named(full))
        .when(raw.rlike(month), named(month))
        .when(raw.rlike(numeric), F.concat(F.lit("Year "), F.when(F.char_length(year) == 2, F.lit("20")).otherwise(F.lit("")), year))
        .otherwise(F.lit("Date Redacted"))
    )


def _rolled(y: Column, m: Column, d: Column) -> Column:
    """Day d of a month; days past its end roll over, days above 31 and months above 12 are null."""
    good = (m >= 1) & (m <= 12) & (d >= 1) & (d <= 31)
    return F.when(good, F.date_add(F.make_date(F.when(good, y), F.when(good, m), F.lit(1)), d - 1))


def validate_date(raw: Column, max_year: int, faithful: bool = False) -> Column:
    """Dates in figures (day first, or ISO) or with an English or French month as yyyy-MM-dd; else null.

    ``faithful`` leaves out ISO dates, ordinals and French months, as the plain rule does.
    """
    figure = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})$"
    iso = r"^(\d{4})[/\-](\d{2})[/\-](\d{2})$"
    number = lambda p, g: F.regexp_extract(raw, p, g).try_cast("int")
    years = number(figure, 3)
    year = F.when(F.char_length(F.regexp_extract(raw, figure, 3)) == 2, F.when(years > 30, years + 1900).otherwise(years + 2000)).otherwise(years)
    named = java(r"^(\d{1,2})" + ("" if faithful else "(?:st|nd|rd|th)?") + r"\s+(\p{L}+)\s+(\d{4})$", True)
    word = F.lower(F.regexp_extract(raw, named, 2))
    names: dict[str, int] = {}
    for months in (values.MONTHS, values.SHORT_MONTHS) + (() if faithful else (values.FRENCH_MONTHS,)):
        names |= {m.lower(): i + 1 for i, m in enumerate(months.split())}
    if faithful:  # months known by an English month's first three letters
        names |= {m: names[m[:3]] for m in values.FRENCH_MONTHS.split() if m[:3] in names}
    month = F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), word)
    found = F.when(raw.rlike(figure), _rolled(year, number(figure, 2), number(figure, 1))).when(raw.rlike(named), _rolled(number(named, 3), month, number(named, 1)))
    if not faithful:
        found = F.coalesce(found, F.when(raw.rlike(iso), _rolled(number(iso, 1), number(iso, 2), number(iso, 3))))
    return F.when((F.year(found) >= 1900) & (F.year(found) <= max_year), F.date_format(found, "yyyy-MM-dd"))


def mrz_date(s: Column) -> Column:
    """yymmdd -> yyyy-mm-dd as a string; years above 30 are of the last century."""
    yy = F.substring(s, 1, 2)
    century = F.when(yy > "30", F.lit("19")).otherwise(F.lit("20"))
    return F.when(s.rlike(r"^\d{6}$"), F.concat(century, yy, F.lit("-"), F.substring(s, 3, 2), F.lit("-"), F.substring(s, 5, 2)))


def passport_check(no: Column) -> Column:
    """struct<valid, clean, note, issue> of a passport number."""
    clean = F.upper(F.regexp_replace(no, java(r"\s"), ""))
    standard, odd = clean.rlike(r"^[A-Z]{1,2}\d{6,9}$"), clean.rlike("^[A-Z0-9]{8,9}$")
    return F.struct(
        (standard | odd).alias("valid"),
        clean.alias("clean"),
        F.when(~standard & odd, F.lit("Non-standard format")).alias("note"),
        F.when(~standard & ~odd, F.lit("Unexpected passport number format")).alias("issue"),
    )


def confidence_band(c: Column) -> Column:
    return F.when(c >= 80, "high").when(c >= 55, "med").otherwise("low")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def file_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1048576, F.format_string("%.1f KB", n / 1024))
        .otherwise(F.format_string("%.1f MB", n / 1048576))
    )


def escape_html(s: Column) -> Column:
    for found, put in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(found), F.lit(put))
    return s


def script_of(text: Column) -> Column:
    """The script with most characters, first listed on ties; latin for texts of none."""
    counts = [F.struct(F.regexp_count(text, F.lit(f"[{r}]")).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, r) in enumerate(values.SCRIPTS.items())]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["name"]).otherwise(F.lit("latin"))


def languages_of(script: Column) -> Column:
    out = F.lit("eng")
    for name, languages in values.SCRIPT_LANGUAGES.items():
        out = F.when(script == name, languages).otherwise(out)
    return out


def register(spark: SparkSession) -> None:
    """Makes the plain string functions callable from SQL."""
    sql = {
        "ink_confidence_band(c DOUBLE) RETURNS STRING": "CASE WHEN c >= 80 THEN 'high' WHEN c >= 55 THEN 'med' ELSE 'low' END",
        "ink_escape_html(s STRING) RETURNS STRING": "replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')",
        "ink_half_up(x DOUBLE) RETURNS BIGINT": "CAST(floor(x + 0.5) AS BIGINT)",
        "ink_mrz_date(s STRING) RETURNS STRING": "CASE WHEN s RLIKE '^[0-9]{6}$' THEN concat(if(substr(s, 1, 2) > '30', '19', '20'), substr(s, 1, 2), '-', substr(s, 3, 2), '-', substr(s, 5, 2)) END",
    }
    for signature, body in sql.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
