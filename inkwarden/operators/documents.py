"""Document types, consistency across pages, and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values
from .fields import MRZ, passport_issues

#: Score of a machine-readable zone; confidence at score 0, its floor, step and ceiling.
ZONE, FLOOR, STEP, CEILING = 3, 50, 15, 95


def classify(text: Column, unknown_on_zero: bool = False) -> Column:
    """struct<id, label, score, confidence>: most keywords contained, first listed on ties.

    A text without any hit is the first type with confidence 0 (``unknown_on_zero``: UNKNOWN); an empty text is
    UNKNOWN with 0.
    """
    low = F.lower(text)
    scores = []
    for order, (kind, (label, words)) in enumerate(values.DOCUMENT_TYPES.items()):
        score = F.lit(0)
        for w in filter(None, words.split("; ")):
            score = score + F.contains(low, F.lit(w.lower())).cast("int")
        if kind == "PASSPORT":
            score = score + F.when(text.rlike(MRZ), ZONE).otherwise(0)
        scores.append(F.struct(score.alias("score"), F.lit(-order).alias("back"), F.lit(kind).alias("id"), F.lit(label).alias("label")))
    best = F.array_max(F.array(*scores))
    unknown = F.struct(F.lit("UNKNOWN").alias("id"), F.lit(values.DOCUMENT_TYPES["UNKNOWN"][0]).alias("label"), F.lit(0).alias("score"), F.lit(0).alias("confidence"))
    confidence = F.when(best["score"] == 0, 0).otherwise(F.least(F.lit(CEILING), FLOOR + STEP * best["score"]))
    found = F.struct(best["id"].alias("id"), best["label"].alias("label"), best["score"].alias("score"), confidence.alias("confidence"))
    if unknown_on_zero:
        found = F.when(best["score"] == 0, unknown).otherwise(found)
    return F.when(F.coalesce(text, F.lit("")) == "", unknown).otherwise(found)


def conflicting_dates(fields: DataFrame, doc: str, page: str) -> DataFrame:
    """Documents with more than one distinct date."""
    dates = fields.where("field = 'datesOfBirth'")
    each = dates.groupBy(doc, "normalised").agg(F.min(F.struct(page, "seq")).alias("first"), F.count(F.lit(1)).alias("n"))
    docs = each.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("first", "normalised"))).alias("all"), F.sum("n").alias("occurrences")).where(F.size("all") > 1)
    message = F.concat(F.lit("Conflicting dates of birth found: "), F.array_join(F.transform("all", lambda x: x["normalised"]), ", "))
    return docs.select(doc, F.lit("CONFLICTING_DOB").alias("type"), F.lit("error").alias("severity"), message.alias("message"), "occurrences")


def invalid_passports(fields: DataFrame, doc: str, page: str) -> DataFrame:
    bad = passport_issues(fields).where("not check.valid")
    message = F.concat(F.lit('Possible OCR error in passport number "'), F.col("value"), F.lit('" (page '), F.col(page).cast("string"), F.lit("): "), F.col("check.issue"))
    return bad.select(doc, F.lit("INVALID_PASSPORT_NO").alias("type"), F.lit("warn").alias("severity"), message.alias("message"), F.lit(1).cast("long").alias("occurrences"))


def suggestion(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in values.SUGGESTIONS.items() for x in kv)), kind), F.lit(values.NO_SUGGESTION))


def flags(fields: DataFrame, crossed: DataFrame | None, doc: str, page: str) -> DataFrame:
    """All flags of documents with their suggestions; ``origin`` tells page checks from name checks."""
    out = conflicting_dates(fields, doc, page).unionByName(invalid_passports(fields, doc, page)).withColumn("origin", F.lit("consistency"))
    if crossed is not None:
        out = out.unionByName(crossed.drop("name").withColumn("origin", F.lit("names")))
    return out.withColumn("suggestion", suggestion(F.col("type")))
