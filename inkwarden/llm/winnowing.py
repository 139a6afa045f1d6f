"""Document fingerprints by winnowing, in DataFrame expressions only.

A text is cut into units of up to ``UNIT`` characters between white space; every run of ``GRAM`` units is
hashed as the window of units rolls over the text; of every ``WINDOW`` neighbouring hashes the smallest is
chosen, the rightmost on ties. Any passage of ``GRAM + WINDOW - 1`` units that two texts share (from the
beginning of a word on) therefore leaves a common hash. A chosen gram is kept as one long: 32 bits of hash
above 31 bits that fall with its position, so that a plain minimum picks the rightmost.

Results: null texts count as empty; a text without units has an empty fingerprint (two empty ones are
alike by 1, an empty and another by 0); shorter texts have the hash of all their units; repeated rows are
neighbours of each other; rows without an id come first; the successor of the last row is the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT, GRAM, WINDOW = 4, 5, 6
_POSITION = (1 << 31) - 1


def grams(text: Column, unit: int = UNIT, gram: int = GRAM) -> Column:
    """Hash and position, as one long, of every run of ``gram`` units."""
    units = F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{unit}}}"), F.lit(0))
    hashes = F.transform(units, lambda u: F.xxhash64(u))

    def rolled(h: Column) -> Column:
        def packed(i: Column) -> Column:
            x = F.xxhash64(*(F.get(h, i + j if j else i) for j in range(gram)))  # what lies past the end is null and left out
            return F.shiftleft(F.shiftrightunsigned(x, 32), 31).bitwiseOR(F.lit(_POSITION) - i)

        return F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - gram, F.lit(0))), packed)).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(hashes), rolled)[0]


def winnow(packed: Column, window: int = WINDOW) -> Column:
    """The smallest of every ``window`` neighbours, rightmost on ties, each once and in order."""

    def chosen(p: Column) -> Column:
        least = lambda i: F.least(*(F.get(p, i + j if j else i) for j in range(window)))
        return F.when(F.size(p) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - window, F.lit(0))), least)).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.transform(F.array(packed), chosen)[0])


def hashes(chosen: Column) -> Column:
    return F.transform(chosen, lambda x: F.shiftrightunsigned(x, 31))


def positions(chosen: Column) -> Column:
    """Unit positions of the chosen grams."""
    return F.transform(chosen, lambda x: (F.lit(_POSITION) - x.bitwiseAND(F.lit(_POSITION))).cast("int"))


def as_string(chosen: Column) -> Column:
    """Eight hex digits for each chosen gram, in order of position."""
    return F.lower(F.array_join(F.transform(chosen, lambda x: F.lpad(F.hex(F.shiftrightunsigned(x, 31)), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprints(docs: DataFrame, text_col: str, **sizes) -> DataFrame:
    """Adds ``chosen`` (packed grams), ``fingerprint`` and ``positions`` to the rows."""
    out = docs.withColumn("chosen", winnow(grams(F.coalesce(F.col(text_col), F.lit("")))))
    return out.withColumns({"fingerprint": as_string(F.col("chosen")), "positions": positions(F.col("chosen"))})


def ranges(docs: DataFrame, key: str, rows: int = 1500, most: int = 65536) -> tuple[list[int], bool]:
    """Lower bounds of key ranges of about ``rows`` rows, at most ``most`` of them; whether a key is null.

    All bounds are keys that occur, the first is the smallest; they are what a range partitioner samples.
    """
    n, least, nulls = docs.agg(F.count(F.lit(1)), F.min(key), F.count_if(F.col(key).isNull())).first()
    if least is None:
        return [], bool(nulls)
    k = max(1, min(most, n // rows))
    cuts = docs.agg(F.percentile_approx(key, [i / k for i in range(1, k)] or [0.5], max(10_000, 4 * k))).first()[0] if k > 1 else []
    return sorted({least, *cuts}), bool(nulls)


def with_next(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, Window]:
    """Adds to rows, dealt by range of ``key``, copies (``guest`` > 0) of the row that follows each range; and
    the window within which ``lead`` is the next row of the whole table."""
    bounds, nulls = ranges(docs, key)
    steps = [1 << b for b in reversed(range(len(bounds).bit_length()))]
    known = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get(known, at + s - 1) <= F.col(key), at + s).otherwise(at))
    own = F.coalesce(F.greatest(below - 1, F.lit(0)), F.lit(0)) if bounds else F.lit(0)
    first = F.col(key).isNull() if nulls else F.col(key) == (bounds[0] if bounds else 0)
    opens = F.coalesce((F.col("own") > 0) & (F.get(known, F.col("own")) == F.col(key)), F.lit(False)) if bounds else F.lit(False)
    stay = F.struct(F.col("own").alias("range"), F.lit(0).alias("guest"))
    back = F.when(opens, F.struct((F.col("own") - 1).alias("range"), F.lit(1).alias("guest")))
    wrap = F.when(first, F.struct(F.lit(max(0, len(bounds) - 1)).alias("range"), F.lit(2).alias("guest")))
    dealt = docs.withColumn("own", own).withColumn("place", F.explode(F.filter(F.array(stay, back, wrap), lambda x: x.isNotNull())))
    dealt = dealt.select(key, text, "place.range", "place.guest")
    return dealt, Window.partitionBy("range").orderBy("guest", F.col(key).asc_nulls_first(), text)


def edited_likeness(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is the beginning of the next text."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt, order = with_next(rows, "id", "text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    # the second lead reads the fingerprint of the next row: same window, no further shuffle or sort
    out = (
        dealt.withColumn("next_text", F.lead("text").over(order))
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)))
        .withColumn("chosen", winnow(grams(F.col("text"))))
        .withColumn("set", F.array_distinct(hashes(F.col("chosen"))))
        .withColumn("next_set", F.lead("set").over(order))
        .where("guest = 0")
        .withColumn("edited_chosen", winnow(grams(F.col("edited"))))
        .withColumn("edited_set", F.array_distinct(hashes(F.col("edited_chosen"))))
    )
    return out.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("chosen")).alias("fingerprint"),
        as_string(F.col("edited_chosen")).alias("edited_fingerprint"),
        likeness(F.col("set"), F.col("edited_set")).alias("near_edited"),
        likeness(F.col("set"), F.col("next_set")).alias("near_next"),
        positions(F.col("chosen")).alias("positions"),
    )
