"""Redaction bars."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rx import any_of
from . import entities as detector

#: Pixels of a rendered page for each unit of the page.
SCALE = 2.5


@dataclass(frozen=True)
class Config:
    """What is redacted and how."""

    active: tuple[str, ...] = detector.CATEGORIES
    padding: int = 4
    terms: tuple[str, ...] = ()
    use_ocr: bool = True
    force_ocr: bool = False


def parse_terms(raw: Column) -> Column:
    """Terms of a list separated by lines, commas or semicolons."""
    return F.filter(F.transform(F.split(raw, r"[\n,;]+"), lambda x: F.trim(x)), lambda x: x != "")


def term_pattern(terms: tuple[str, ...]) -> str | None:
    """One pattern for all terms, ignoring case; None for no terms."""
    return f"(?iu){any_of(list(terms))}" if terms else None


def needs_redaction(text: Column, config: Config = Config()) -> Column:
    """Whether a text item holds an entity or a term."""
    hit = F.size(detector.candidates(text, "demo-safe", config.active)) > 0 if config.active else F.lit(False)
    pattern = term_pattern(config.terms)
    return hit | text.rlike(pattern) if pattern else hit


def item_box(x: Column, baseline: Column, width: Column, height: Column, text: Column) -> Column:
    """struct<x, y, w, h> of a text item's bar in page units times ``SCALE``: it grows up from the baseline."""
    w = F.greatest(F.coalesce(F.when(width > 0, width), F.char_length(text) * 6.0) * SCALE, F.lit(20.0))
    h = F.greatest(F.coalesce(F.when(height > 0, height), F.lit(10.0)) * SCALE, F.lit(10.0))
    return F.struct((x * SCALE).alias("x"), (baseline * SCALE - h).alias("y"), w.alias("w"), h.alias("h"))


def bar(x: Column, y: Column, w: Column, h: Column, padding: int = 4) -> Column:
    """Whole pixels of a padded bar."""
    pad = max(0, padding) * SCALE
    return F.struct(F.floor(x - pad).alias("x"), F.floor(y - pad).alias("y"), F.ceil(w + 2 * pad).alias("w"), F.ceil(h + 2 * pad).alias("h"))


def word_bars(words: DataFrame, keys: list[str], config: Config = Config()) -> DataFrame:
    """A bar for each word box (``bbox``) that needs one: keys, ``seq``, ``source``, ``bar``."""
    b = F.col("bbox")
    found = words.where(needs_redaction(F.coalesce(F.trim("text"), F.lit("")), config))
    return found.select(*keys, "seq", F.lit("auto").alias("source"), bar(b["x0"], b["y0"], b["x1"] - b["x0"], b["y1"] - b["y0"], config.padding).alias("bar"))


def manual_bars(drags: DataFrame, keys: list[str], thickness: int = 16) -> DataFrame:
    """Bars of drags (``x0``, ``y0``, ``x1``, ``y1``): at least ``thickness`` high, none below 2 pixels width."""
    x, y = F.least("x0", "x1"), F.least("y0", "y1")
    w, h = F.abs(F.col("x1") - F.col("x0")), F.greatest(F.abs(F.col("y1") - F.col("y0")), F.lit(float(thickness)))
    box = F.struct(F.floor(x).alias("x"), F.floor(y).alias("y"), F.ceil(w).alias("w"), F.ceil(h).alias("h"))
    return drags.where(w >= 2).select(*keys, "seq", F.lit("manual").alias("source"), box.alias("bar"))


def undo(bars: DataFrame, page: list[str], undone: DataFrame) -> DataFrame:
    """Without the last ``n`` manual bars of each page named in ``undone`` (page, ``n``)."""
    back = F.row_number().over(Window.partitionBy(*page, "source").orderBy(F.desc("seq")))
    ranked = bars.withColumn("__back", back).join(undone.withColumnRenamed("n", "__n"), page, "left")
    return ranked.where((F.col("source") != "manual") | (F.col("__back") > F.coalesce("__n", F.lit(0)))).drop("__back", "__n")


def finalise(auto: DataFrame, manual: DataFrame) -> DataFrame:
    """All bars of the final pages."""
    return auto.unionByName(manual)


def bar_totals(bars: DataFrame, keys: list[str]) -> DataFrame:
    return bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bars"), F.count_if(F.col("source") == "manual").alias("n_manual"))
