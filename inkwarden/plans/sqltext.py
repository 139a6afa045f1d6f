"""DuckDB SQL for the document queries, written in set terms of its own."""

from __future__ import annotations

from ..functions import values
from ..operators import entities, fields
from .corpus import CASES_SQL, WORDS_SQL

KEYS = "doc_id, page_num"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def inline(pattern: str, ignore_case: bool) -> str:
    return quoted(("(?i)" if ignore_case else "") + pattern)


def from_cases(body: str) -> str:
    return f"WITH cases AS ({CASES_SQL}) {body}"


def spans(pattern: str, ignore_case: bool, group: int = 0, table: str = "cases", keys: str = KEYS) -> str:
    """Matches with places: lengths of the pieces between matches and of the matches before."""
    p = inline(pattern, ignore_case)
    text = (
        f"SELECT {keys}, CAST(i AS INT) AS seq, m[i + 1] AS text, "
        "CAST(list_sum(list_transform(pieces[1:i + 1], lambda q: length(q))) + coalesce(list_sum(list_transform(whole[1:i], lambda q: length(q))), 0) "
        "+ length(whole[i + 1]) - length(m[i + 1]) AS INT) AS start "
        f"FROM (SELECT {keys}, regexp_extract_all(coalesce(text, ''), {p}, {group}) AS m, regexp_extract_all(coalesce(text, ''), {p}) AS whole, "
        f"string_split_regex(coalesce(text, ''), {p}) AS pieces FROM {table}) x, unnest(range(len(m))) t(i)"
    )
    return text


def category(name: str) -> str:
    """All patterns of a category, each with its number."""
    parts = [f"SELECT CAST({k} AS INT) AS pattern, * FROM ({spans(p, i)}) s{k}" for k, (c, p, i) in enumerate(entities.PATTERNS) if c == name]
    return from_cases(" UNION ALL ".join(parts))


def words_any(words: list[str], ignore_case: bool = False) -> str:
    return from_cases(spans(rf"\b(?:{'|'.join(words)})\b", ignore_case))


def distinct_values(pattern: str, ignore_case: bool, group: int, trim: bool = False) -> str:
    """First places of the distinct matches of a page, numbered from 0."""
    value = "trim(text)" if trim else "text"
    return f"SELECT {KEYS}, value, CAST(row_number() OVER (PARTITION BY {KEYS} ORDER BY first) - 1 AS INT) AS seq FROM (SELECT {KEYS}, {value} AS value, min(seq) AS first FROM ({spans(pattern, ignore_case, group)}) s GROUP BY ALL) d"


_MONTH_NUMBERS = {m.lower(): i + 1 for ms in (values.MONTHS, values.SHORT_MONTHS, values.FRENCH_MONTHS) for i, m in enumerate(ms.split())}


def valid_date(raw: str, max_year: int) -> str:
    """The date rules as a CASE over a raw string."""
    roll = lambda y, m, d: f"CASE WHEN {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 THEN make_date({y}, {m}, 1) + CAST({d} - 1 AS INTEGER) END"
    g = lambda p, k: f"TRY_CAST(regexp_extract({raw}, '{p}', {k}) AS BIGINT)"
    fig, iso, named = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})$", r"^(\d{4})[/\-](\d{2})[/\-](\d{2})$", r"(?i)^(\d{1,2})(?:st|nd|rd|th)?\s+(\p{L}+)\s+(\d{4})$"
    year = f"CASE WHEN length(regexp_extract({raw}, '{fig}', 3)) = 2 THEN {g(fig, 3)} + CASE WHEN {g(fig, 3)} > 30 THEN 1900 ELSE 2000 END ELSE {g(fig, 3)} END"
    months = "MAP {" + ", ".join(f"{quoted(k)}: {v}" for k, v in _MONTH_NUMBERS.items()) + "}"
    month = f"CAST({months}[lower(regexp_extract({raw}, '{named}', 2))] AS BIGINT)"
    found = f"CASE WHEN regexp_matches({raw}, '{fig}') THEN {roll(f'({year})', g(fig, 2), g(fig, 1))} WHEN regexp_matches({raw}, '{named}') THEN {roll(g(named, 3), month, g(named, 1))} WHEN regexp_matches({raw}, '{iso}') THEN {roll(g(iso, 1), g(iso, 2), g(iso, 3))} END"
    return f"(SELECT CASE WHEN year(f) BETWEEN 1900 AND {max_year} THEN strftime(f, '%Y-%m-%d') END FROM (SELECT {found} AS f))"


def dates(max_year: int) -> str:
    parts = [f"SELECT {k} AS pattern, {KEYS}, seq, text AS value FROM ({spans(p, i, 1)}) s{k}" for k, (p, i) in enumerate(fields.DATES)]
    every = f"SELECT {KEYS}, value, min(pattern * 1000 + seq) AS first FROM ({' UNION ALL '.join(parts)}) u GROUP BY ALL"
    valid = f"SELECT * FROM (SELECT *, {valid_date('value', max_year)} AS normalised FROM ({every}) e) v WHERE normalised IS NOT NULL"
    return f"SELECT {KEYS}, value, normalised, CAST(row_number() OVER (PARTITION BY {KEYS} ORDER BY first) - 1 AS INT) AS seq FROM ({valid}) w"


def nationalities() -> str:
    rows = ", ".join(f"({i}, {quoted(w)}, {quoted(c)})" for i, (w, c) in enumerate(values.EXTRACT_DEMONYMS.items()))
    return (
        f"SELECT {KEYS}, value, country, CAST(row_number() OVER (PARTITION BY {KEYS} ORDER BY ord) - 1 AS INT) AS seq "
        f"FROM cases, (VALUES {rows}) n(ord, value, country) WHERE regexp_matches(text, '(?i)\\b' || value || '\\b')"
    )


def mrz() -> str:
    return (
        "SELECT doc_id, page_num, trim(replace(string_split(substring(l1, 6), '<<')[1], '<', ' ')) AS surname, trim(replace(coalesce(string_split(substring(l1, 6), '<<')[2], ''), '<', ' ')) AS given_names, "
        "replace(substring(l2, 1, 9), '<', '') AS passport_no, replace(substring(l2, 11, 3), '<', '') AS nationality, "
        "CASE WHEN regexp_matches(substring(l2, 14, 6), '^\\d{6}$') THEN CASE WHEN substring(l2, 14, 2) > '30' THEN '19' ELSE '20' END || substring(l2, 14, 2) || '-' || substring(l2, 16, 2) || '-' || substring(l2, 18, 2) END AS dob "
        "FROM (SELECT doc_id, page_num, rpad(m[1], 44, '<') AS l1, rpad(m[2], 44, '<') AS l2 FROM (SELECT doc_id, page_num, regexp_extract_all(text, '[A-Z0-9<]{30,44}') AS m FROM cases) a WHERE len(m) >= 2) b WHERE l1 LIKE 'P%'"
    )


def document_types(text: str = "text") -> str:
    scores = []
    for order, (kind, (label, words)) in enumerate(values.DOCUMENT_TYPES.items()):
        hits = [f"CAST(contains(lower({text}), {quoted(w.lower())}) AS INT)" for w in words.split("; ") if w]
        zone = [f"CASE WHEN regexp_matches({text}, '[A-Z0-9<]{{30,44}}') THEN 3 ELSE 0 END"] if kind == "PASSPORT" else []
        scores.append(f"{{'score': {' + '.join(hits + zone) or '0'}, 'back': -{order}, 'id': {quoted(kind)}, 'label': {quoted(label)}}}")
    return f"list_max([{', '.join(scores)}])"


def phonetic(word: str) -> str:
    out = f"lower({word})"
    for found, put in (("ph", "f"), ("ck", "k"), ("ae", "a"), ("oe", "u"), ("ou", "u"), ("oo", "u"), ("ee|ei", "i"), ("gh", "g"), ("kh", "k"), ("dh", "d"), ("th", "t"), ("ch", "sh")):
        out = f"regexp_replace({out}, '{found}', '{put}', 'g')"
    out = f"regexp_replace({out}, '([aeiou])[aeiou]+', '\\1', 'g')"
    for letter in "abcdefghijklmnopqrstuvwxyz":
        out = f"regexp_replace({out}, '{letter}+', '{letter}', 'g')"
    return f"regexp_replace({out}, '[^a-z]', '', 'g')"


def alpha(n: str) -> str:
    """Letters of a number, six at most: what the test tables need."""
    places = [f"({n} - 1)"]
    while len(places) < 6:
        places.append(f"({places[-1]} // 26 - 1)")
    return "(" + " || ".join(f"CASE WHEN {p} >= 0 THEN chr(CAST(65 + ({p}) % 26 AS INT)) ELSE '' END" for p in reversed(places)) + ")"


def words(body: str) -> str:
    return f"WITH words AS ({WORDS_SQL}) {body}"


_AREA = "({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0)"
_W, _H = "(least(a.x1, b.x1) - greatest(a.x0, b.x0))", "(least(a.y1, b.y1) - greatest(a.y0, b.y0))"
RANKED = (
    "passes AS (SELECT doc_id, page_num, pass_id, avg(confidence) AS c FROM words GROUP BY ALL), "
    "ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page_num ORDER BY c DESC, pass_id) - 1 AS INT) AS pass_rank FROM passes), "
    "w AS (SELECT words.*, pass_rank FROM words JOIN ranks USING (doc_id, page_num, pass_id))"
)
OVERLAPS = (
    f"met AS (SELECT a.doc_id, a.page_num, a.seq, a.pass_rank AS own_rank, b.pass_rank, b.seq AS alt_seq, b.text AS alt_text, b.confidence AS alt_confidence, b.x0 AS bx, b.y0 AS by0, "
    f"{_W} * {_H} / ({_AREA.format('a')} + {_AREA.format('b')} - {_W} * {_H}) AS iou FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.page_num = b.page_num WHERE {_W} > 0 AND {_H} > 0)"
)


def overlaps() -> str:
    return words(
        f", {RANKED}, {OVERLAPS} SELECT doc_id, page_num, seq, pass_rank, alt_seq, alt_text, round(iou, 6) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num, seq, pass_rank ORDER BY iou DESC, alt_seq) AS n FROM met WHERE own_rank = 0 AND pass_rank > 0 AND iou > 0.4) x WHERE n = 1"
    )


def merged() -> str:
    """Four passes: the three alternatives are looked at one after the other."""
    best = "CASE WHEN {a} IS NOT NULL AND {a}.c > {b}.c + 5 THEN {a} ELSE {b} END"
    return words(
        f", {RANKED}, {OVERLAPS}, alts AS (SELECT doc_id, page_num, seq, max(CASE WHEN pass_rank = 1 THEN s END) AS a1, max(CASE WHEN pass_rank = 2 THEN s END) AS a2, max(CASE WHEN pass_rank = 3 THEN s END) AS a3 FROM "
        "(SELECT *, {'t': alt_text, 'c': alt_confidence, 'x': bx, 'y': by0} AS s, row_number() OVER (PARTITION BY doc_id, page_num, seq, pass_rank ORDER BY iou DESC, alt_seq) AS n FROM met WHERE own_rank = 0 AND pass_rank > 0 AND iou > 0.4) x WHERE n = 1 GROUP BY ALL), "
        "p AS (SELECT w.doc_id, w.page_num, w.seq, w.pass_rank, {'t': text, 'c': confidence, 'x': x0, 'y': y0} AS b0, a1, a2, a3 FROM w LEFT JOIN alts USING (doc_id, page_num, seq) WHERE w.pass_rank = 0), "
        f"p1 AS (SELECT *, {best.format(a='a1', b='b0')} AS b1 FROM p), p2 AS (SELECT *, {best.format(a='a2', b='b1')} AS b2 FROM p1), p3 AS (SELECT *, {best.format(a='a3', b='b2')} AS b3 FROM p2), "
        "added AS (SELECT w.doc_id, w.page_num, w.seq, w.pass_rank, {'t': text, 'c': confidence, 'x': x0, 'y': y0} AS b3 FROM w WHERE pass_rank > 0 AND confidence >= 60 AND NOT EXISTS (SELECT 1 FROM met WHERE met.doc_id = w.doc_id AND met.page_num = w.page_num AND met.seq = w.seq AND met.own_rank = w.pass_rank AND met.pass_rank = 0 AND met.iou > 0.4)), "
        "u AS (SELECT doc_id, page_num, pass_rank, seq, b3 FROM p3 UNION ALL SELECT doc_id, page_num, pass_rank, seq, b3 FROM added), "
        "n AS (SELECT *, CASE WHEN b3.y - lag(b3.y) OVER o > 10 THEN 1 ELSE 0 END AS fresh FROM u WINDOW o AS (PARTITION BY doc_id, page_num ORDER BY b3.y, b3.x, pass_rank, seq)), "
        "l AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc_id, page_num ORDER BY b3.y, b3.x, pass_rank, seq) AS BIGINT) AS line FROM n) "
        "SELECT doc_id, page_num, CAST(row_number() OVER (PARTITION BY doc_id, page_num ORDER BY line, b3.x, b3.y, pass_rank, seq) AS INT) AS place, line, b3.t AS text, b3.c AS confidence FROM l"
    )
