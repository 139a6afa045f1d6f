import pytest
from pyspark.sql import functions as F

from inkwarden.functions import strings, values
from inkwarden.operators import documents, fields, geometry, names


def one(spark, column, *args):
    cols = ", ".join(f"c{i} {'string' if isinstance(a, str) or a is None else 'double' if isinstance(a, float) else 'int'}" for i, a in enumerate(args))
    return spark.createDataFrame([args], cols).select(column(*(F.col(f"c{i}") for i in range(len(args)))).alias("x")).first().x


@pytest.mark.parametrize(("n", "want"), [(1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (703, "AAA")])
def test_letters(spark, n, want):
    assert one(spark, strings.to_alpha, n) == want


@pytest.mark.parametrize(("raw", "want"), [("3rd March 2021", "March 2021"), ("Mar 2021", "Date Redacted"), ("03/04/21", "Year 2021"), ("may 2020", "may 2020")])
def test_general_dates(spark, raw, want):
    assert one(spark, strings.generalise_date, raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("31/02/1990", "1990-03-03"), ("01/13/1990", None), ("5.6.31", "1931-06-05"), ("5.6.30", None), ("1990-03-12", "1990-03-12"), ("12th March 1990", "1990-03-12"), ("3 août 1985", "1985-08-03"), ("00/01/1990", None), ("1/1/1899", None)],
)
def test_valid_dates(spark, raw, want):
    assert one(spark, lambda c: strings.validate_date(c, 2025), raw) == want


def test_faithful_dates(spark):
    assert one(spark, lambda c: strings.validate_date(c, 2025, True), "1990-03-12") is None
    assert one(spark, lambda c: strings.validate_date(c, 2025, True), "12th March 1990") is None
    assert one(spark, lambda c: strings.validate_date(c, 2025, True), "3 mars 1985") == "1985-03-03"


@pytest.mark.parametrize(("s", "want"), [("310101", "1931-01-01"), ("300101", "2030-01-01"), ("31010", None)])
def test_mrz_dates(spark, s, want):
    assert one(spark, strings.mrz_date, s) == want


def model_jaro(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, taken, own = max(max(len(a), len(b)) // 2 - 1, 0), [], []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if b[j] == x and j not in taken:
                taken.append(j)
                own.append(x)
                break
    m = len(taken)
    off = sum(x != b[j] for x, j in zip(own, sorted(taken)))
    return (m / len(a) + m / len(b) + (m - off / 2) / m) / 3 if m else 0.0


def test_jaro(spark):
    words = ["abcdef", "bcadef", "martha", "marhta", "", "dixon", "dicksonx", "aa", "a", "xyz", "aab"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in df.select("a", "b", strings.jaro(F.col("a"), F.col("b")).alias("j"), strings.jaro_winkler(F.col("a"), F.col("b")).alias("w")).collect():
        assert r.j == pytest.approx(model_jaro(r.a, r.b)), (r.a, r.b)
        assert 0 <= r.w <= 1
    assert one(spark, strings.jaro, "abcdef", "bcadef") == pytest.approx(0.916667, abs=1e-6)
    assert one(spark, strings.jaro_winkler, "abxxxx", "abyyyy") == pytest.approx(0.644444, abs=1e-6)


@pytest.mark.parametrize(("s", "want"), [("Khadeeja", "kadija"), ("Yousef", "yusef")])
def test_phonetic(spark, s, want):
    assert one(spark, strings.phonetic, s) == want


def test_canonical_names(spark):
    families = {"Fatima": "fatima", "Fatema": "fatema fatima", "Nadiia": "nadia nadiia"}
    table = names.variants(spark, families)
    words = spark.createDataFrame([("Fatima",), ("NADIA",), ("Nadya",), ("Qqqq",), (None,), ("",)], "w string")
    got = {r.word: (r.canonical, r.method) for r in names.canonical_names(words, "w", table).collect()}
    assert got == {"Fatima": ("Fatema", "direct"), "NADIA": ("Nadiia", "direct"), "Nadya": ("Nadiia", "fuzzy")}


def test_default_names_are_the_whole_table(spark):
    rows = values.name_rows()
    assert len({e for *_, e, _ in rows}) <= len(values.NAME_FAMILIES) == 195 and len(rows) == len({v for v, *_ in rows}) == 1051
    known = {v: c for v, c, *_ in rows}
    assert [known[v] for v in ("mohamed", "hussein", "fatima", "fatimah", "nadia", "tanya")] == ["Muhammad", "Hassan", "Fatema", "Fatema", "Nadiia", "Tania"]
    words = spark.createDataFrame([(w,) for w in ("Khaled", "ZAINAB", "Yusra", "Mustafaah", "Qqqq")], "w string")
    got = {r.word: (r.canonical, r.method) for r in names.canonical_names(words, "w", names.variants(spark)).collect()}
    assert got == {"Khaled": ("Khalid", "direct"), "ZAINAB": (known["zainab"], "direct"), "Yusra": (known["yusra"], "direct"), "Mustafaah": ("Mustafa", "fuzzy")}


@pytest.mark.parametrize(("text", "kind", "confidence"), [("hello", "PASSPORT", 0), ("passport", "PASSPORT", 65), ("passport " + "A" * 30, "PASSPORT", 95), ("", "UNKNOWN", 0), (None, "UNKNOWN", 0), ("Tribunal ruling", "COURT_DECISION", 80)])
def test_document_types(spark, text, kind, confidence):
    k = one(spark, documents.classify, text)
    assert (k.id, k.confidence) == (kind, confidence)


@pytest.mark.parametrize(("no", "valid", "note", "issue"), [("ab 123456", True, None, None), ("A1B2C3D4", True, "Non-standard format", None), ("12", False, None, "Unexpected passport number format")])
def test_passports(spark, no, valid, note, issue):
    c = one(spark, strings.passport_check, no)
    assert (c.valid, c.note, c.issue) == (valid, note, issue)


def test_scripts(spark):
    assert one(spark, strings.script_of, "") == "latin"
    assert one(spark, strings.script_of, "Привет a") == "cyrillic"
    assert one(spark, strings.script_of, "م a") == "arabic"
    assert one(spark, strings.languages_of, "bengali") == "ben+eng"


def test_bands_and_sizes(spark):
    assert [one(spark, strings.confidence_band, x) for x in (80.0, 79.9, 55.0, 54.9)] == ["high", "med", "med", "low"]
    assert [one(spark, strings.file_size, n) for n in (10, 2048, 3145728)] == ["10 B", "2.0 KB", "3.0 MB"]
    assert one(spark, strings.escape_html, '<a href="x">&') == "&lt;a href=&quot;x&quot;&gt;&amp;"
    assert one(spark, geometry.parse_terms, "a, b;\n c") == ["a", "b", "c"]
    strings.register(spark)
    assert spark.sql("SELECT ink_confidence_band(60.0), ink_mrz_date('310101'), ink_half_up(2.5)").first()[:] == ("med", "1931-01-01", 3)


def test_lists():
    assert len(values.listed(values.COUNTRIES)) == 60
    assert len(values.DETECT_DEMONYMS) == 61 and len(values.EXTRACT_DEMONYMS) == 67
    assert len(values.PERSON_PARTICLES.split()) == 26 and len(values.SPAN_PARTICLES.split()) == 27
    assert len(values.listed(values.LEGAL_PHRASES)) == 61 and len(set(values.LEGAL_SINGLES.split())) == 63
    assert len(values.FAMILY_TERMS.split()) == 22 and len(values.NOT_NAMES.split()) == 73 and len(values.DOCUMENT_TYPES) == 12


def test_birthplace_and_mrz(spark):
    row = spark.createDataFrame([("née à Lyon. P<SYRAL<HASSAN<<MO<ALI<<<<<<<<<<<<<<<<<<<<<<<< AB12345670SYR9003120M3001019<<<<<<<<<<<<<<<<",)], "text string")
    got = fields.extract(row, 2025).first()
    assert got.placesOfBirth[0].value == "Lyon" and got.mrz.surname == "AL HASSAN" and got.mrz.given_names == "MO ALI" and got.mrz.dob == "1990-03-12"


@pytest.mark.parametrize(("n", "want"), [(475254, "ZZZZ"), (475255, "AAAAA"), (12356631, "AAAAAA"), (0, ""), (18279, "AAAA")])
def test_letters_of_large_numbers(spark, n, want):
    assert one(spark, strings.to_alpha, n) == want


def test_letters_compared_at_once_score_as_one_by_one(spark):
    words = ["mohamed", "muhammad", "ab", "a", "", "aab", "xyz", "marhta", "dicksonx", "éa", "ahmadu", "abdurahman"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    want = {(r.a, r.b): r.w for r in df.select("a", "b", strings.jaro_winkler(F.col("a"), F.col("b")).alias("w")).collect()}
    letters = names.Letters(words)
    assert all(want[a, b] == w for a in words for b, w in zip(words, letters.jaro_winkler(a)))


def test_large_name_tables_meet_words_block_by_block(spark, monkeypatch):
    words = spark.createDataFrame([(w,) for w in ("Khaledd", "Zaynabb", "Mustafaah", "Qqqq", "Omar")], "w string")
    table = names.variants(spark)
    whole = sorted(names.canonical_names(words, "w", table).collect())
    monkeypatch.setattr(names, "BLOCK", 100)
    assert sorted(names.canonical_names(words, "w", table).collect()) == whole and len(whole) >= 3


def test_ranks_of_split_groups(spark):
    from inkwarden.operators import pseudonyms

    rows = spark.createDataFrame([(k % 2, (k * 37) % 500) for k in range(500)], "g int, v int").repartition(5)
    got = {}
    for r in pseudonyms.ranked(rows, ["g"], ["v"]).collect():
        got.setdefault(r.g, {})[r.v] = r.n
    assert all([vs[v] for v in sorted(vs)] == list(range(1, 251)) for vs in got.values())


def test_words_that_differ_in_numbers_are_compared_once_and_score_as_one_by_one(spark):
    words = [f"{w}{k}" for w in ("Muhamad", "AB", "Khaledd-", "[Fatmah]", "é^Yusuff\\", "Zainabb\n") for k in range(40)]
    df, table = spark.createDataFrame([(w,) for w in words], "w string"), names.variants(spark)
    low = F.lower(F.trim("w"))
    score = strings.jaro_winkler(low, F.col("variant")) * 0.6 + strings.jaro_winkler(strings.phonetic(low), F.col("phon")) * 0.4
    best = df.crossJoin(table).withColumn("s", score).groupBy("w").agg(F.max_by(F.struct("canonical", "s"), F.struct("s", -F.col("key_ord"))).alias("b")).where("b.s >= 0.82")
    want = {r.w: (r.b.canonical, r.b.s) for r in best.collect()}
    assert {r.word: (r.canonical, r.score) for r in names.canonical_names(df, "w", table).collect()} == want and len(want) >= 80
    letters = "".join({c for r in table.collect() for c in r.variant})
    assert df.select(names._shape(low, letters)).distinct().count() == 12  # numbers of one and of two figures


def test_no_bound_is_below_the_score():
    words = ["mohamed", "muhammad", "ab", "a", "", "aab", "xyz", "marhta", "dicksonx", "éa", "ahmadu", "abdurahman"]
    letters = names.Letters(words)
    assert all((letters.bound(a) >= letters.jaro_winkler(a) - 1e-9).all() for a in [*words, "qq", "mohamed1", "abba"])


def test_name_spans_are_not_broadcast(spark):
    page = "named_struct('x0', 0D, 'y0', 0D, 'x1', 0D, 'y1', 0D) AS bbox"
    df = spark.createDataFrame([(1, 0, "Mohamed"), (1, 1, "Ali")], "page int, seq int, text string").selectExpr("*", "95D AS confidence", page)
    found = names.name_spans(df, ["page"], names.variants(spark))
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 1  # known words
    assert [(r.text, r.canonical) for r in found.collect()] == [("Mohamed Ali", "Muhammad")]


def test_trees_and_first_letters_keep_what_patterns_find():
    import random
    import re

    from inkwarden.functions import rx
    from inkwarden.operators import entities

    rng = random.Random(3)
    for _ in range(200):
        words = ["".join(rng.choice("aAb") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(4, 9))]
        text = "".join(rng.choice("aAb ") for _ in range(60))
        for flag in (0, re.I):
            plain, written = (re.findall(rf"(?:{p})(?![ab])", text, flag) for p in ("|".join(words), rx.tree([list(w) for w in words], bool(flag))))
            assert plain == written
    assert rx.java(r"\b(?:Mali|Malta|Mexico|Malian)\b").startswith(r"(?=[MMMM])(?<!\w)(?:M(?:al(?:i(?:|an)|ta)|exico))")
    assert [rx.first_letters(p) for _, p, _ in entities.PATTERNS[:4]] == [r"A-Za-z0-9._%+\-", r"\+0\d", "R", "R"]
    assert [rx.first_letters(p) for p in (r"\b(?:a|b)?c", r"\ba*b", r"[^a]b", r".a", r"\b(a(?:b|c)|\d)x")] == [None, None, None, None, r"a\d"]


def test_places_of_few_and_of_many_matches(spark):
    import re

    from inkwarden.functions import rx

    texts = ["é1 " * n + "\U0001f600x" + tail for n in (0, 1, 31, 32, 33, 300) for tail in ("", " 2", "\u00013")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", rx.spans(F.col("t"), rx.java(r"\b\d\b")).alias("s")).collect():
        assert [tuple(x) for x in r.s] == [(m.group(), m.start(), m.end()) for m in re.finditer(r"(?<![0-9A-Za-z_])\d", r.t)]
