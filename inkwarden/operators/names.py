"""Person names in page words: canonical forms, name spans, spelling checks across pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rx, values
from ..functions.strings import bind, jaro_winkler, phonetic
from ..session import cut, partitions, ship

# Fixed values.
#: Score from which a fuzzy match counts; weights of spelling and sound; longest span in words.
ACCEPT, SPELLING, SOUND, LONGEST = 0.82, 0.6, 0.4, 6
# End of fixed values.
#: Variants that are compared with a word in one task; a larger table meets the words block by block.
BLOCK = 50_000


def variants(spark: SparkSession, families: dict[str, str] | None = None) -> DataFrame:
    """The variant table of name families: ``variant``, ``canonical``, ``entry_ord``, ``key_ord``, ``phon``."""
    rows = spark.createDataFrame(values.name_rows(families), "variant string, canonical string, entry_ord int, key_ord int")
    return rows.withColumn("phon", phonetic(F.col("variant")))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A variant table from JSON lines ``{"canonical": ..., "variants": [...]}`` in order; the last entry wins a
    variant, which keeps its first place."""
    lines = spark.read.schema("canonical string, variants array<string>").json(path).withColumn("entry_ord", F.monotonically_increasing_id())
    each = lines.select("canonical", "entry_ord", F.posexplode("variants").alias("p", "v")).withColumn("variant", F.lower("v"))
    best = each.groupBy("variant").agg(F.max_by("canonical", "entry_ord").alias("canonical"), F.max("entry_ord").alias("entry_ord"), F.min(F.struct("entry_ord", "p")).alias("first"))
    return best.withColumn("key_ord", F.col("first.entry_ord") * 10_000 + F.col("first.p")).drop("first").withColumn("phon", phonetic(F.col("variant")))


class Letters:
    """Strings as rows of code points, to be compared with one string all at once."""

    def __init__(self, strings: list[str]):
        self.strings = np.array(strings, object)
        self.size = np.array([len(x) for x in strings], np.int64)
        self.code = np.full((len(strings), max(1, int(self.size.max(initial=0)))), -1, np.int32)
        for i, x in enumerate(strings):
            self.code[i, : len(x)] = np.frombuffer(x.encode("utf-32-le"), np.int32)
        self.letters = np.unique(self.code[self.code >= 0])
        #: How often each string has each letter.
        self.held = np.stack([(self.code == c).sum(axis=1) for c in self.letters]) if len(self.letters) else np.zeros((0, len(strings)), np.int64)

    def only(self, rows: np.ndarray) -> Letters:
        """Some of the strings, to be compared only."""
        out = object.__new__(Letters)
        out.strings, out.size, out.code = self.strings[rows], self.size[rows], self.code[rows]
        return out

    def bound(self, word: str) -> np.ndarray:
        """No less than ``jaro_winkler(word)``: all common letters match in order, and four first ones."""
        own = np.frombuffer(word.encode("utf-32-le"), np.int32)
        if not len(own):
            return (self.size == 0).astype(float)
        at = np.minimum(np.searchsorted(self.letters, own), max(0, len(self.letters) - 1))
        at, times = np.unique(at[self.letters[at] == own] if len(self.letters) else at[:0], return_counts=True)
        m = np.minimum(self.held[at], times[:, None]).sum(axis=0)
        jaro = np.where(m == 0, 0.0, (m / len(own) + m / np.maximum(self.size, 1) + 1) / 3)
        return jaro + 0.4 * (1 - jaro) * (m > 0)

    def jaro_winkler(self, word: str) -> np.ndarray:
        """As ``strings.jaro_winkler(word, each)``, to the last bit."""
        own, (n, width) = np.frombuffer(word.encode("utf-32-le"), np.int32), self.code.shape
        if not len(own):
            return (self.size == 0).astype(float)
        reach = np.maximum(np.maximum(len(own), self.size) // 2 - 1, 0)
        taken, hit, place = np.zeros((n, width), bool), np.zeros((n, len(own)), bool), np.arange(width)
        for i, letter in enumerate(own):
            near = (self.code == letter) & ~taken & (np.abs(place - i) <= reach[:, None])
            first = near.argmax(axis=1)
            hit[:, i] = near[np.arange(n), first]
            taken[np.flatnonzero(hit[:, i]), first[hit[:, i]]] = True
        m = hit.sum(axis=1)
        # letters matched on either side, in their own order
        mine, theirs = np.zeros((n, len(own)), np.int32), np.zeros((n, len(own)), np.int32)
        for flags, source, out in ((hit, np.broadcast_to(own, hit.shape), mine), (taken, self.code, theirs)):
            row, at = np.nonzero(flags)
            out[row, (np.cumsum(flags, axis=1) - 1)[row, at]] = source[row, at]
        off = (mine != theirs).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = np.where(m == 0, 0.0, (m / len(own) + m / self.size + (m - off / 2) / m) / 3)
        jaro = np.where(self.strings == word, 1.0, jaro)
        prefix = np.zeros(n)
        for k in range(1, min(4, len(own), width) + 1):
            prefix[(self.code[:, :k] == own[:k]).all(axis=1)] = k
        return jaro + prefix * 0.1 * (1 - jaro)


def _nearest(words: pa.Table, variants: pa.Table) -> pa.Table:
    """The best variant of a table's block for each word (``low``, ``sound``), from ``ACCEPT`` on; the first on ties."""
    return _Block(variants).nearest(words)


class _Block:
    """Variants of a block in order, ready to be compared."""

    def __init__(self, variants: pa.Table):
        rows = variants.sort_by("key_ord")
        self.spelled, self.heard = Letters(rows["variant"].to_pylist()), Letters(rows["phon"].to_pylist())
        self.names, self.order = rows["canonical"].to_pylist(), rows["key_ord"].to_pylist()

    def nearest(self, words: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        for low, sound in zip(words["low"].to_pylist(), words["sound"].to_pylist()) if len(self.names) else ():
            # few variants can come up to ACCEPT at all; the rounding of the bound is allowed for
            near = np.flatnonzero(self.spelled.bound(low) * SPELLING + self.heard.bound(sound) * SOUND >= ACCEPT - 1e-6)
            if not len(near):
                continue
            score = self.spelled.only(near).jaro_winkler(low) * SPELLING + self.heard.only(near).jaro_winkler(sound) * SOUND
            best = int(score.argmax())
            if score[best] >= ACCEPT:
                for column, x in zip(out, (low, sound, self.names[near[best]], float(score[best]), self.order[near[best]])):
                    column.append(x)
        return pa.table({"low": pa.array(out[0], pa.string()), "sound": pa.array(out[1], pa.string()), "canonical": pa.array(out[2], pa.string()), "score": pa.array(out[3], pa.float64()), "key_ord": pa.array(out[4], pa.int64())})


def _shape(low: Column, letters: str) -> Column:
    """A word with all letters that no variant has (``letters`` are theirs) made one: none of them can match."""
    stand_in = next(c for c in map(chr, range(1, 0x110000)) if c not in letters)
    return F.regexp_replace(low, F.lit(f"[^{''.join(f'\\x{{{ord(c):x}}}' for c in letters)}]" if letters else "(?s)."), F.lit(stand_in))


def canonical_names(words: DataFrame, word_col: str, table: DataFrame) -> DataFrame:
    """``word``, ``canonical``, ``method``, ``score`` of each distinct word that has one.

    Known variants are joined. Only distinct words without one are compared with the table, which Catalyst has no
    set-at-a-time operator for: in Arrow batches against all variants at once, a table above ``BLOCK`` variants
    block by block. Words that differ only in letters which no variant has (numbers, signs) score alike and are
    compared once. Of equal scores the first variant wins.
    """
    spark = words.sparkSession
    ship(spark)
    few = table.limit(BLOCK + 1).count() <= BLOCK
    dim = F.broadcast(table) if few else table
    letters = "".join(sorted(r.c for r in table.select(F.explode(F.split("variant", "")).alias("c")).distinct().collect() if r.c))
    low = F.lower(F.trim("word"))
    distinct = cut(words.select(F.col(word_col).alias("word")).where("word is not null and word <> ''").distinct().withColumn("known", low))
    direct = distinct.join(dim, distinct["known"] == table["variant"]).select("word", "canonical", F.lit("direct").alias("method"), F.lit(1.0).alias("score"))
    rest = distinct.join(dim.select("variant"), distinct["known"] == table["variant"], "left_anti").select("word", _shape(F.col("known"), letters).alias("low"), phonetic(F.col("known")).alias("sound"))
    shapes = rest.select("low", "sound").distinct()
    kind, columns = "low string, sound string, canonical string, score double, key_ord long", table.select("variant", "canonical", F.col("key_ord").cast("long").alias("key_ord"), "phon")
    if few:
        shared = spark.sparkContext.broadcast(columns.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _Block(shared.value)
            for batch in batches:
                yield from block.nearest(pa.Table.from_batches([batch])).to_batches()

        # by number, as few bytes are much work here
        found = shapes.repartition(partitions(spark), "low", "sound").mapInArrow(run, kind)
    else:
        n, m = -(-table.count() // BLOCK), max(1, -(-shapes.count() // BLOCK))
        every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        asked = shapes.select("low", "sound", F.pmod(F.xxhash64("low", "sound"), F.lit(m)).cast("int").alias("w"), every(n).alias("v"))
        known = columns.select("*", F.pmod(F.xxhash64("variant"), F.lit(n)).cast("int").alias("v"), every(m).alias("w"))
        found = asked.groupBy("v", "w").cogroup(known.groupBy("v", "w")).applyInArrow(_nearest, kind)
    best = found.groupBy("low", "sound").agg(F.max_by(F.struct("canonical", "score"), F.struct("score", (-F.col("key_ord")).alias("back"))).alias("best"))
    fuzzy = rest.join(best.hint("merge"), ["low", "sound"])
    return direct.unionByName(fuzzy.select("word", "best.canonical", F.lit("fuzzy").alias("method"), "best.score"))


def name_similarity(a: Column, b: Column, same_canonical: Column | None = None) -> Column:
    """Best of spelling, nine tenths of sound, and 1 for the same canonical form."""
    same = F.when(F.coalesce(same_canonical, F.lit(False)), 1.0).otherwise(0.0) if same_canonical is not None else F.lit(0.0)
    both = F.greatest(jaro_winkler(F.lower(a), F.lower(b)), jaro_winkler(phonetic(a), phonetic(b)) * 0.9, same)
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(both)


def _bare(word: Column) -> Column:
    return F.regexp_replace(F.coalesce(word, F.lit("")), r"[^A-Za-z'\-]", "")


def is_name_token(word: Column) -> Column:
    bare = _bare(word)
    # most words fail at the first test, which is the cheapest
    return (
        F.substring(word, 1, 1).between("A", "Z")
        & (F.char_length(bare) >= 2)
        & ~F.lower(bare).isin(values.NOT_NAMES.split())
        & ~(word.rlike(r"^[A-Z\s\-]+$") & (F.char_length(bare) > 4))
    )


_OTHER = r"[^A-Za-z'\-]*+"
#: A particle with any signs in between: as ``_bare`` compared, but most words fail at their first letter.
_PARTICLE = rf"\A{_OTHER}(?i:{'|'.join(_OTHER.join(p) for p in values.SPAN_PARTICLES.split())}){_OTHER}\z"


def is_particle(word: Column) -> Column:
    return F.coalesce(word, F.lit("")).rlike(_PARTICLE)


def name_spans(words: DataFrame, keys: list[str], table: DataFrame | None = None) -> DataFrame:
    """Name spans of each page: runs of name tokens and particles of two to six words that end in a name token.

    ``words`` has the keys, ``seq``, ``text``, ``confidence``, ``bbox``. A page's words are collected; pages
    are bounded.
    """
    return page_name_spans(words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "text", "confidence", "bbox"))).alias("w")), keys, table)


def page_name_spans(pages: DataFrame, keys: list[str], table: DataFrame | None = None) -> DataFrame:
    """``name_spans`` of pages whose words are an array already: the keys, ``w`` (``text``, ``confidence``, ``bbox``)."""
    # a letter for each word: name, particle or neither; a run has six words, or two to five up to its end
    marks = F.array_join(F.transform("w", lambda x: F.when(is_name_token(x["text"]), "n").when(is_particle(x["text"]), "p").otherwise(".")), "")
    runs = F.transform(rx.spans(F.col("marks"), rf"[np]{{{LONGEST - 1}}}n|[np]{{1,{LONGEST - 2}}}n(?![np])"), lambda s: F.slice("w", s["start"] + 1, s["end"] - s["start"]))
    found = pages.select(*keys, "w", marks.alias("marks")).select(*keys, F.posexplode(runs).alias("seq", "ws"))
    mean = F.aggregate("ws", F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size("ws")
    first, last = F.get("ws", F.lit(0))["bbox"], F.get("ws", F.size("ws") - 1)["bbox"]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    box = F.struct(zero(first["x0"]).alias("x0"), zero(first["y0"]).alias("y0"), zero(last["x1"]).alias("x1"), zero(first["y1"]).alias("y1"))
    spans = found.select(*keys, "seq", F.array_join(F.transform("ws", lambda x: x["text"]), " ").alias("text"), mean.alias("confidence"), box.alias("bbox"), F.transform("ws", lambda x: x["text"]).alias("words"))
    if table is None:
        return spans
    # spans are found twice, which costs less than to write them; what is known of their words is small, or sorted and merged
    known = cut(canonical_names(spans.select(F.explode("words").alias("word")), "word", table))
    known = F.broadcast(known) if known.limit(BLOCK + 1).count() <= BLOCK else known.hint("merge")
    each = spans.select(*keys, "seq", "text", "confidence", "bbox", F.posexplode("words").alias("place", "word")).join(known, "word", "left")
    scored = F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("place")).alias("back")))
    best = each.groupBy(*keys, "seq").agg(*(F.first(c).alias(c) for c in ("text", "confidence", "bbox")), F.max_by(F.struct("canonical", "method", "score"), scored).alias("best"))
    return best.select(*keys, "seq", "text", "confidence", "best.canonical", "best.method", "best.score", "bbox")


def cross_reference(spans: DataFrame, doc: str, page: str) -> DataFrame:
    """Flags names of a document that appear with several spellings."""
    keyed = spans.withColumn("name", F.coalesce("canonical", F.lower("text"))).withColumn("low", F.lower("text"))
    spellings = keyed.groupBy(doc, "name", "low").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(page, "seq")).alias("first"))
    names = spellings.groupBy(doc, "name").agg(F.sum("n").alias("occurrences"), F.array_sort(F.collect_list(F.struct("first", "low"))).alias("all")).where((F.col("occurrences") >= 2) & (F.size("all") > 1))
    listed = F.array_join(F.transform("all", lambda x: x["low"]), ", ")
    message = F.concat(F.lit('Name "'), F.col("name"), F.lit('" appears with different spellings: '), listed)
    return names.select(doc, F.lit("SPELLING_INCONSISTENCY").alias("type"), F.lit("warn").alias("severity"), message.alias("message"), "name", "occurrences")
