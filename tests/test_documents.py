"""Flags, roll-ups and summaries of documents."""

from pyspark.sql import functions as F

from inkwarden.operators import documents, fields, names, ocr, summary

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_cross_reference(spark):
    spans = [(1, 1, 0, "Mohamed Ali", "Mohamed"), (1, 2, 0, "Muhammad Ali", "Mohamed"), (1, 2, 1, "Jo Doe", None), (1, 3, 0, "JO DOE", None), (2, 1, 0, "Omar Ali", "Omar")]
    df = spark.createDataFrame(spans, "doc int, page int, seq int, text string, canonical string")
    rows = names.cross_reference(df, "doc", "page").collect()
    assert [(r.doc, r.name, r.occurrences) for r in rows] == [(1, "Mohamed", 2)]
    assert rows[0].message == 'Name "Mohamed" appears with different spellings: mohamed ali, muhammad ali'


def test_flags_and_roll_up(spark):
    pages = spark.createDataFrame([(1, 1, "on 1/2/1990 AB1234567"), (1, 2, "on 3 May 1991 and 1/2/1990"), (2, 1, "on 1/2/1990"), (3, 1, None)], "doc int, page int, text string")
    found = fields.long_form(fields.extract(pages, 2025), ["doc", "page"])
    flags = documents.flags(found, None, "doc", "page").collect()
    assert [(r.doc, r.type, r.severity) for r in flags] == [(1, "CONFLICTING_DOB", "error")]
    assert flags[0].message.endswith("1990-02-01, 1991-05-03") and "correct date of birth" in flags[0].suggestion
    rolled = {(r.doc, r.field): r["items"] for r in fields.roll_up(found, "doc", "page").collect()}
    assert rolled[1, "datesOfBirth"] == ["1/2/1990", "3 May 1991", "1/2/1990"] and rolled[1, "passportNumbers"] == ["AB1234567"]
    bad = found.limit(1).withColumn("field", F.lit("passportNumbers")).withColumn("value", F.lit("12"))
    assert documents.invalid_passports(bad, "doc", "page").first().message == 'Possible OCR error in passport number "12" (page 1): Unexpected passport number format'


def test_session(spark):
    df = spark.createDataFrame([(False, 3, 2, 1, 0, 80.0), (True, None, None, None, None, None), (False, 1, 1, 1, 1, 71.0)], "error boolean, pages int, bars int, names int, flags int, avg_confidence double")
    r = summary.session(df).first()
    assert (r.n_pages, r.n_bars, r.n_names, r.n_flags, r.confidence, r.n_ok, r.n_failed) == (4, 3, 2, 1, 50, 2, 1)
    assert summary.session(df.limit(0)).first().confidence == 0
    shown = spark.createDataFrame([("v", "c", None), ("v", None, "n"), ("v", None, "v")], "a string, b string, n string")
    assert [r[0] for r in shown.select(summary.displayed(F.col("a"), F.col("b"), F.col("n"))).collect()] == ["v (c)", "v → n", "v"]


def test_merge_follows_the_rules(spark):
    box = lambda x: (float(x), 0.0, x + 10.0, 10.0)
    words = [
        (1, 0, 0, "best", 50.0, box(0)), (1, 0, 1, "keep", 90.0, box(40)),
        (1, 1, 0, "better", 56.0, box(1)), (1, 1, 1, "worse", 94.0, box(40)), (1, 1, 2, "new", 60.0, box(80)),
        (1, 2, 0, "notyet", 60.0, box(1)), (1, 2, 1, "low", 59.0, box(120)),
    ]
    df = spark.createDataFrame(words, f"page int, pass_id int, seq int, text string, confidence double, bbox {BOX}")
    passes = spark.createDataFrame([(1, 0, 99.0), (1, 1, 80.0), (1, 2, 70.0)], "page int, pass_id int, confidence double")
    merged = ocr.merge(df, passes, ["page"])
    assert [r.text for r in merged.orderBy("place").collect()] == ["better", "keep", "new"]
    assert ocr.page_text(merged, ["page"]).first().text == "better keep new"
