"""Regular expressions with ASCII word boundaries, and spans with offsets, in Catalyst expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word boundary (Java's own isn't ASCII only), and what it comes to before and behind a word character.
B = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
BEFORE, BEHIND = r"(?<!\w)", r"(?!\w)"
#: White space as browsers see it.
SPACE = r"[\t\n\x0B\f\r    -     　﻿]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
#: A sign between pieces, and the one that stands in for it where a text holds it; no pattern tells them apart.
_MARK, _STAND_IN = "\u0001", "\u0002"
#: Elements that one inner fold of ``sweep`` takes.
CHUNK = 128
#: Matches of a text that are placed one by one.
FEW = 32
SPAN = "array<struct<text:string,start:int,end:int>>"

_ATOM = r"(?:[A-Za-z0-9]|\\d|\[(?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9]|\\d)+\])"
_OPENS_WORD, _CLOSES_WORD = re.compile(rf"{_ATOM}(?![*?]|\{{0)"), re.compile(rf"{_ATOM}(?:\{{[1-9][0-9,]*\}}|\+)?\)*\Z")
_TOKEN = re.compile(r"\\.|\[(?:[^\]\\]|\\.)*\]|.", re.S)


def opens_word(pattern: str) -> bool:
    """Whether all matches of a pattern surely begin with a word character."""
    start = 3 if pattern.startswith("(?:") else 1 if pattern.startswith("(") and not pattern.startswith("(?") else 0
    if not start:
        return bool(_OPENS_WORD.match(pattern))
    depth, alternatives, at = 0, [""], start
    for m in _TOKEN.finditer(pattern, start):
        at, t = m.end(), m.group()
        if t == ")" and depth == 0:
            break
        depth += (t == "(") - (t == ")")
        if t == "|" and depth == 0:
            alternatives.append("")
        else:
            alternatives[-1] += t
    return not re.match(r"[*?]|\{0", pattern[at:]) and all(map(opens_word, alternatives))


def _boundary(before: str, behind: str) -> str:
    """A boundary between the parts of a pattern: simpler where a word character surely begins or has just ended."""
    if opens_word(behind):
        return BEFORE
    return BEHIND if "|" not in before and _CLOSES_WORD.search(before) else B


#: A group of plain words, and a run of signs before one that it can't hold.
_WORD = r"(?:[^()\[\]{}|*+?.^$\\]|\\[^A-Za-z0-9])+"
_WORDS = re.compile(rf"\((\?:)?({_WORD}(?:\|{_WORD}){{3,}})\)")
_RUN = re.compile(r"(\[(?:[A-Za-z0-9._%+]|[A-Za-z0-9]-[A-Za-z0-9]|\\-)+\])\+(?=@)")


def tree(words: list[list[str]], ignore_case: bool) -> str:
    """Alternatives in their order, with common beginnings written once: at a place a search tries few of them."""
    out: list[str] = []
    groups: dict[str, list[list[str]]] = {}

    def flush() -> None:  # words of different groups never fit the same place, so only the order within a group counts
        out.extend(ws[0][0] + tree([w[1:] for w in ws], ignore_case) for ws in groups.values())
        groups.clear()

    for w in words:
        if w:
            groups.setdefault(w[0].lower() if ignore_case else w[0], []).append(w)
        else:
            flush()
            out.append("")
    flush()
    return out[0] if len(out) == 1 else f"(?:{'|'.join(out)})"


def _alternatives(pattern: str, at: int = 0) -> tuple[list[str], int]:
    """What ``|`` parts from a place on, and where the group ends."""
    depth, out, end = 0, [""], len(pattern)
    for m in _TOKEN.finditer(pattern, at):
        t = m.group()
        if t == ")" and depth == 0:
            return out, m.end()
        depth += (t == "(") - (t == ")")
        if t == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += t
    return out, end


def first_letters(pattern: str) -> str | None:
    """Inside of a class of all that a match can begin with; None if that isn't plain."""
    out = ""
    for part in _alternatives(pattern)[0]:
        part = part.removeprefix(r"\b")
        if part.startswith("("):
            start = 3 if part.startswith("(?:") else 1
            if start == 1 and part.startswith("(?"):
                return None
            inner, end = _alternatives(part, start)
            found, rest = first_letters("|".join(inner)), part[end:]
        else:
            m = re.match(r"\\d|\\[^A-Za-z0-9]|\[(?:[A-Za-z0-9._%+]|[A-Za-z0-9]-[A-Za-z0-9]|\\-)+\]|[A-Za-z0-9À-ÿ]", part)
            if not m:
                return None
            found, rest = m.group().strip("[]") if len(m.group()) > 2 else m.group(), part[m.end() :]
        if found is None or re.match(r"[*?]|\{0", rest):
            return None
        out += found
    return out


def java(pattern: str, ignore_case: bool = False) -> str:
    """A pattern written with ``\\b``, ``\\s`` and ``\\S`` for Spark: ASCII boundaries, full white space.

    Places where no match can begin are left at the first test, lists of words are written as trees.
    """
    flag = ("(?i)" if pattern.isascii() else "(?iu)") if ignore_case else ""
    parts = pattern.split(r"\b")
    out = parts[0]
    for before, behind in zip(parts, parts[1:]):
        out += _boundary(before, behind) + behind
    out = _WORDS.sub(lambda m: f"({m[1] or ''}{tree([re.findall(r'\\.|[^\\]', w) for w in m[2].split('|')], ignore_case)})", out)
    out = _RUN.sub(r"\1++", out)
    out = re.sub(r"\[((?:[^\]\\]|\\.)*)\\s((?:[^\]\\]|\\.)*)\]", lambda m: f"[{m[1]}{SPACE[1:-1]}{m[2]}]", out)
    out = out.replace(r"\s", SPACE).replace(r"\S", NOT_SPACE)
    first = first_letters(pattern)
    if not first or r"\b" not in pattern:
        return flag + out
    return flag + f"(?=[{first}])" + (f"(?:{out})" if len(_alternatives(pattern)[0]) > 1 else out)


def any_of(words: list[str]) -> str:
    return "|".join(re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", w) for w in words)


def bind(expression: Column, body) -> Column:
    """``body`` of an expression that is evaluated once."""
    return F.transform(F.array(expression), body)[0]


def sweep(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step`` gives out, in order, on its way over ``items`` from left to right.

    ``step(state, item)`` gives the next state and an array of what it gives out (``kind``). Items are folded in
    chunks, so that no array is copied once for every item.
    """
    none = F.array().cast(kind)

    def inner(s: Column, x: Column) -> Column:
        after, out = step(s["state"], x)
        return F.struct(after.alias("state"), F.concat(s["out"], out).alias("out"))

    def outer(s: Column, chunk: Column) -> Column:
        done = F.aggregate(chunk, F.struct(s["state"].alias("state"), none.alias("out")), inner)
        return bind(done, lambda d: F.struct(d["state"].alias("state"), F.concat(s["out"], F.array(d["out"])).alias("out")))

    def folded(a: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.greatest((F.size(a) - 1) / CHUNK, F.lit(0)).cast("int")), lambda i: F.slice(a, i * CHUNK + 1, CHUNK))
        return F.when(F.size(a) > 0, F.aggregate(chunks, F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), outer, lambda s: F.flatten(s["out"]))).otherwise(none)

    return bind(items, folded)


def spans(text: Column, pattern: str, before: bool = False) -> Column:
    """array<struct<text, start, end>> of all matches (of group 2 after group 1 with ``before``), left to right;
    offsets in code points of ``text``."""
    marks = f"$1{_MARK}$2{_MARK}" if before else f"{_MARK}$0{_MARK}"

    none = F.array().cast(SPAN)

    def step(s: Column, piece: Column) -> tuple[Column, Column]:
        end = s["at"] + F.char_length(piece)
        one = F.struct(piece.alias("text"), s["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), (~s["odd"]).alias("odd")), F.when(s["odd"], F.array(one)).otherwise(none)

    def placed(pieces: Column) -> Column:  # few matches are placed one by one, as a fold costs more; many in one fold
        def one(k: Column) -> Column:
            piece = F.get(pieces, 2 * k - 1)
            return bind(F.char_length(F.array_join(F.slice(pieces, F.lit(1), 2 * k - 1), "")), lambda at: F.struct(piece.alias("text"), at.alias("start"), (at + F.char_length(piece)).alias("end")))

        each = F.transform(F.sequence(F.lit(1), (F.size(pieces) / 2).cast("int")), one)
        swept = sweep(pieces, F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd")), SPAN, step)
        return F.when(F.size(pieces) <= 2 * FEW + 1, each).otherwise(swept)

    def found(t: Column) -> Column:
        def parted(marked: Column) -> Column:  # pieces at odd places are matches; without a match nothing is longer
            return F.when(F.octet_length(marked) == F.octet_length(t), none).otherwise(bind(F.split(marked, _MARK, -1), placed))

        return bind(F.regexp_replace(t, F.lit(pattern), F.lit(marks)), parted)

    def own(s: Column) -> Column:
        return F.struct(F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text"), s["start"].alias("start"), s["end"].alias("end"))

    # one search for each pattern, whether it is found or not
    held = F.transform(found(F.translate(text, _MARK, _STAND_IN)), own)
    return F.when(F.contains(text, F.lit(_MARK)), held).otherwise(found(text))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
