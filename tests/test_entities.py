"""Detectors, overlaps and names against plain Python models."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwarden.functions import values
from inkwarden.operators import entities, names, persons, pseudonyms

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"


def model_persons(text):
    """One pass from left to right over tokens."""
    tokens = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    strip = lambda t: re.sub(f"^[^{LETTER}]+|[^{LETTER}]+$", "", t)
    name = lambda t: bool(re.fullmatch(rf"[A-ZÀ-ÖØ-Þ][{LETTER}'\-]*", strip(t)))
    particle = lambda t: strip(t).lower() in values.PERSON_PARTICLES.split()
    opens = lambda t: name(t) or bool(re.match(r"(?i)(Al|El|Abd|Abu|Bin|Bint|Ibn|Um|Umm|Ould|Ben)-", strip(t)))
    months = "|".join(values.MONTHS.split() + values.SHORT_MONTHS.split())
    listed = set(values.listed(values.LEGAL_PHRASES))

    def legal(s):
        return s in listed or re.match(rf"(?i)({months})\b", s, re.A | re.I) or re.match(r"[A-Z]{2,}(\s|$)", s) or re.fullmatch(r"[A-Z\s\-]+", s) or re.search(rf"\s({'|'.join(values.LEGAL_ENDINGS.split())})$", s)

    out, i = [], 0
    while i < len(tokens):
        j = i
        if opens(tokens[i][0]):
            while j < min(len(tokens), i + 5) and (name(tokens[j][0]) or particle(tokens[j][0])):
                j += 1
        taken = 0
        for k in range(j, i + 1, -1):
            span = text[tokens[i][1] : tokens[k - 1][2]]
            if name(tokens[k - 1][0]) and not legal(span):
                out.append((span, tokens[i][1], tokens[k - 1][2]))
                taken = k
                break
        i = taken or i + 1
    return out


WORDS = ["John", "Smith,", "al", "Al-Hassan", "bin", "Supreme", "Court", "March", "JOHN", "the", "Élodie", "(Omar)", "x1", "Review", "van", "al-hassan", "\n", "Mc", "de"]


def test_persons_follow_the_model(spark):
    import random

    rng = random.Random(7)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(4)
    got = {r.id: [tuple(x) for x in r.p] for r in df.select("id", persons.person_names(F.col("text")).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == model_persons(t), t


def test_golden_entities(spark):
    cases = {
        "met John Smith,": [("PERSON", "John Smith,")],
        "Supreme Court": [],
        "Al-Hassan": [("PERSON", "Al-Hassan")],
        "in Syria": [("COUNTRY", "Syria")],
        "éSyrian Syrian": [("NATIONALITY", "Syrian"), ("NATIONALITY", "Syrian")],
        "a@x.com b@y.org": [("EMAIL", "a@x.com"), ("EMAIL", "b@y.org")],
        "IPAT ref: 77/b MTL/2024/12345": [("REFCOM", "IPAT ref: 77/b"), ("REFCOM", "MTL/2024/12345")],
        "": [],
    }
    df = spark.createDataFrame([(t,) for t in cases] + [(None,)], "text string")
    for r in entities.detect(df).collect():
        assert [(e.cat, e.text) for e in r.entities] == cases.get(r.text, []), r.text
    light = entities.detect(spark.createDataFrame([("in Paris with his wife",)], "text string"), level="light").first()
    assert light.entities == []


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 8)), max_size=12))
def test_resolution_is_greedy_and_disjoint(spark, pairs):
    rows = [(s, -n, k, "X", "t", s + n) for k, (s, n) in enumerate(pairs)]
    df = spark.createDataFrame([(rows,)], f"e {entities.ENTITY}")
    got = [(e.start, e.end) for e in df.select(entities.resolve(F.col("e")).alias("r")).first().r]
    want, last = [], -1
    for s, neg, *_ in sorted(rows):
        if s >= last:
            last = s - neg
            want.append((s, last))
    assert got == want


def test_pseudonyms_count_from_the_right(spark):
    df = spark.createDataFrame([(1, 1, "a@x.com b@y.org"), (1, 2, "Syrian then Syria, b@y.org"), (2, 1, None)], "s int, p int, text string")
    got = {(r.s, r.p): r.anonymized for r in pseudonyms.anonymize(df, ["s"], ["p"]).collect()}
    assert got[(1, 1)] == "email-002@example.invalid email-001@example.invalid"
    assert got[(1, 2)] == "Country A national then Country A, email-001@example.invalid"
    assert got[(2, 1)] == ""


def model_spans(words):
    name = lambda w: (lambda b: len(b) >= 2 and w[:1].isascii() and w[:1].isupper() and b.lower() not in values.NOT_NAMES.split() and not (re.fullmatch(r"[A-Z\s\-]+", w) and len(b) > 4))(re.sub(r"[^A-Za-z'\-]", "", w))
    part = lambda w: name(w) or re.sub(r"[^A-Za-z'\-]", "", w).lower() in values.SPAN_PARTICLES.split()
    out, i = [], 0
    while i < len(words):
        j = i
        while j < min(len(words), i + 6) and part(words[j]):
            j += 1
        if j > i + 1 and name(words[j - 1]):
            out.append(" ".join(words[i:j]))
            i = j
        else:
            i += 1
    return out


def test_name_spans_follow_the_model(spark):
    import random

    rng = random.Random(3)
    vocabulary = ["Mohamed", "ibn", "Omar", "the", "Court", "WARSAME", "ALI", "x", "Al-Hassan", "van", "Page"]
    pages = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 20))] for _ in range(80)]
    rows = [(p, k, w, 90.0, (1.0 * k, 0.0, k + 1.0, 1.0)) for p, ws in enumerate(pages) for k, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "page int, seq int, text string, confidence double, bbox struct<x0:double,y0:double,x1:double,y1:double>").repartition(4)
    got = {}
    for r in names.name_spans(df, ["page"], names.variants(spark)).orderBy("page", "seq").collect():
        got.setdefault(r.page, []).append(r.text)
        assert (r.canonical is None) == (r.score is None)
    for p, ws in enumerate(pages):
        assert got.get(p, []) == model_spans(ws)


def test_marks_in_texts_leak_nothing(spark):
    """Signs that the span machinery uses itself may stand in a text."""
    text = "x\u0001\u0001\u0001 mail bob@site.com\u0001 and \u0002John \u0001Smith\u0001 in Syria"
    df = spark.createDataFrame([(text,)], "text string")
    row = entities.detect(df).withColumn("r", entities.redact(df)).first()
    for e in row.entities:
        assert text[e.start : e.end] == e.text
    assert "bob@site.com" not in row.r and "Syria" not in row.r and row.r.startswith("x\u0001\u0001\u0001 mail [REDACTED]\u0001 and")
    got = pseudonyms.anonymize(df.selectExpr("1 AS s", "1 AS p", "text"), ["s"], ["p"]).first()
    assert "bob@site.com" not in got.anonymized and "email-001@example.invalid" in got.anonymized


def test_boundaries_are_only_made_simpler(spark):
    """Patterns with simplified boundaries find what those with full ones find, in odd texts."""
    import random

    from inkwarden.functions import rx
    from inkwarden.operators import fields

    rng = random.Random(11)
    pieces = ["Refcom", "no:", "12345", "AB1234567", "Case", "File", "IRL/2019/441", "-", "é", "3rd", "March", "2020", "01/02/2020", "x", "_", "IPAT ref 7", "12 Long", "Lane", "Camp A", "route via Rome", "in", "Paris", "born in Lyon", "née à Nice", "wife", "b@x.org", "+353 1 555 1234", " "]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", " ", ".", "é"]) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    patterns = [(p, i) for _, p, i in entities.PATTERNS] + [(fields.PASSPORT, False), (fields.CASE, True), (fields.BIRTHPLACE, True), (entities.LOCATION, False), (rf"\b(?:{rx.any_of(values.FAMILY_TERMS.split())})\b", True)]
    full = lambda p, i: rx.java(p.replace(r"\b", "@@"), i).replace("@@", rx.B)
    cols = [(F.regexp_extract_all("text", F.lit(rx.java(p, i)), F.lit(0)) == F.regexp_extract_all("text", F.lit(full(p, i)), F.lit(0))).alias(f"c{k}") for k, (p, i) in enumerate(patterns)]
    assert all(all(r) for r in df.select(*cols).collect())
    assert any(rx.java(p, i) != full(p, i) for p, i in patterns)


def test_sweep_over_many_items(spark):
    """Long arrays are folded in chunks, with the same outcome."""
    text = " ".join(f"a{k}@x.org" for k in range(1500))
    row = entities.detect(spark.createDataFrame([(text,)], "text string"), active=("EMAIL",)).first()
    assert [e.text for e in row.entities] == text.split() and [e.start for e in row.entities][:3] == [0, 9, 18]


def test_texts_are_searched_once_for_all_entities(spark):
    pages = spark.createDataFrame([(1, "Mail a@b.org"), (2, None), (3, "none")], "page int, text string").repartition(2)
    found = entities.exploded(entities.detect(pages, active=("EMAIL",)), ["page"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan and [(r.page, r.seq, r.text) for r in found.collect()] == [(1, 0, "a@b.org")]
