"""Mixing sources to target weights, in DataFrame expressions only.

Sizes of sources fix how many words each source gives (``targets``). A source gives its documents in an
order that depends on their ids alone, from the start again when one pass isn't enough; the document in
which the target is reached is taken in part. Every source has a weight schedule over the training run, a
line from ``1 - tilt`` to ``1 + tilt``; its integral is the source's cumulative demand. Inverting the demand
at the middle of a take gives the take's training position between 0 and 1.

Results: null texts have size 0; a null source is a source of its own, after all others; rows without an id
have places by their size; repeated rows are each taken as rows of their own; empty input gives no rows. Rows of
size 0 are never taken and have no position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: Tilt of the schedule of each weight: heavy sources come early, light ones late.
TILTS = (-0.5, 0.0, 0.5)
#: Rows of a range of the order, about; ranges share leading hexadecimal digits of the order key, at most so many.
ROWS, MOST_DIGITS = 4000, 6


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """``source``, ``source_size`` -> adds ``rank``, ``weight``, ``target``.

    Water level: sources in order of cap over weight stop at their cap (twice their size) as long as the
    level that the others share lies above; the rest share what is left by weight. Half-words keep all sums
    whole numbers.
    """
    everyone = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("rank", F.row_number().over(everyone.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    by_cap = everyone.orderBy(F.col("source_size") * (720 / F.col("weight")), "rank")
    level = (
        ranked.withColumn("weight", weight)
        .withColumn("total2", F.sum("source_size").over(everyone) * int(2 * SHARE))
        .withColumn("before2", F.coalesce(F.sum(F.col("source_size") * (2 * CAP)).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("sharing", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("left2", F.col("total2") - F.col("before2"))
        .withColumn("full", F.col("source_size") * (2 * CAP) * F.col("sharing") <= F.col("left2") * F.col("weight"))
        .withColumn("stop", F.min(F.when(~F.col("full"), F.struct(F.col("source_size") * (720 / F.col("weight")), "rank", "left2", "sharing"))).over(everyone))
    )
    shared = F.col("weight").cast("double") * F.col("stop.left2").cast("double") / (2 * F.col("stop.sharing")).cast("double")
    target = F.when(F.col("full"), (F.col("source_size") * CAP).cast("double")).otherwise(shared)
    return level.select("source", "source_size", "rank", "weight", target.alias("target"))


def takes(docs: DataFrame, id_col: str, source_col: str, size: Column, carried: Column | None = None) -> DataFrame:
    """``id``, ``source``, ``size``, ``source_size``, ``target``, ``rank``, ``first_taken``, ``again_taken``, the two
    takes' training positions, and ``carried`` of each row.

    A document's place depends on its id and size only; a source's documents are dealt to ranges of places, whose
    sums give each range its offset.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), size.alias("size"), (F.lit(None) if carried is None else carried).alias("carried"))
    order = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(" "), F.col("size").cast("string")).cast("binary"))
    # a key that is never null: join and window then share one shuffle
    rows = rows.withColumns({"order": order, "key": F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))})
    sized = cut(rows.drop("carried"))
    digits = max(2, min(MOST_DIGITS, math.ceil(math.log(max(1, sized.count() / ROWS), 16))))
    range_ = F.substring("order", 1, digits)
    sums = cut(sized.groupBy("key", range_.alias("range")).agg(F.sum("size").alias("range_size"), F.first("source").alias("source")))
    goals = targets(sums.groupBy("key").agg(F.first("source").alias("source"), F.sum("range_size").alias("source_size")).drop("key"))
    before = F.coalesce(F.sum("range_size").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.withColumn("offset", before).alias("o").join(goals.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select("g.source_size", "g.target", "g.rank", "o.key", "o.range", "o.offset")
    placed = (rows if carried is not None else sized.withColumn("carried", F.lit(None))).withColumn("range", range_).join(offsets, ["key", "range"])
    within = Window.partitionBy("key", "range").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    limit = F.floor("target").cast("long")
    taken = lambda pass_: F.least(F.greatest(limit - F.col("start") - pass_ * F.col("source_size"), F.lit(0)), F.col("size"))
    out = placed.withColumn("start", start).withColumn("first_taken", taken(0)).withColumn("again_taken", taken(1))
    tilt = F.element_at(F.array(*map(F.lit, TILTS)), (F.col("rank") % len(TILTS) + 1).cast("int"))

    def position(pass_: int, n: str) -> Column:
        done = F.least((F.col("start") + pass_ * F.col("source_size") + F.col(n) / 2) / F.col("target"), F.lit(1.0))
        # demand up to time t is target * ((1 - tilt) * t + tilt * t * t)
        inverse = F.when(tilt == 0, done).otherwise((-(1 - tilt) + F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * done)) / (2 * tilt))
        return F.when(F.col(n) > 0, inverse)

    out = out.withColumn("first_position", position(0, "first_taken")).withColumn("again_position", position(1, "again_taken"))
    return out.select("id", "source", "size", "source_size", "target", "rank", "first_taken", "again_taken", "first_position", "again_position", "carried")


def mix(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """What the mix takes of every document, range-sorted by training position."""
    t = takes(docs, id_col, source_col, n_words(F.col(text_col)))
    out = t.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("first_taken") + F.col("again_taken")).alias("taken"), "first_position", "again_position")
    return out.orderBy(F.col("first_position").asc_nulls_last(), id_col)


def mixed_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The documents that the mix takes, a row for each take, range-sorted by training position; the text of a
    document taken in part ends after its last taken word. Columns stay those of ``docs``."""
    t = takes(docs, id_col, source_col, n_words(F.col(text_col)), F.struct(*docs.columns))
    both = F.array(F.struct(F.col("first_taken").alias("n"), F.col("first_position").alias("position")), F.struct(F.col("again_taken").alias("n"), F.col("again_position").alias("position")))
    each = t.select("id", "size", "carried", F.explode(F.filter(both, lambda x: x.n > 0)).alias("take"))
    own = lambda c: F.col("carried").getField(c)
    part = F.array_join(F.slice(F.regexp_extract_all(own(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("take.n").cast("int")), "")
    text = F.when(F.col("take.n") < F.col("size"), part).otherwise(own(text_col))
    cols = [(text if c == text_col else own(c)).alias(c) for c in docs.columns]
    return each.orderBy("take.position", "id").select(*cols)


#: The mix in DuckDB.
MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CAST([5, 2, 1][rank % 3 + 1] AS BIGINT) AS weight FROM r),
c AS (SELECT *, source_size * (720.0::DOUBLE / weight) AS ratio FROM w),
l AS (SELECT *, 3 * (sum(source_size) OVER ())
    - coalesce(sum(4 * source_size) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left2,
    sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing FROM c),
f AS (SELECT *, 4 * source_size * sharing <= left2 * weight AS is_full FROM l),
stop AS (SELECT left2, sharing FROM f WHERE NOT is_full ORDER BY ratio, rank LIMIT 1),
g AS (SELECT source, source_size, rank, weight, CASE WHEN is_full THEN 2.0::DOUBLE * source_size
    ELSE weight::DOUBLE * (SELECT left2 FROM stop)::DOUBLE / (2 * (SELECT sharing FROM stop))::DOUBLE END AS target FROM f),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.rank,
    coalesce(sum(d.size) OVER (PARTITION BY g.rank ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ' ' || d.size), d.doc_id NULLS FIRST, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
t AS (SELECT *, least(greatest(floor(target)::BIGINT - start, 0), size) AS a,
    least(greatest(floor(target)::BIGINT - start - source_size, 0), size) AS b, [-0.5, 0.0, 0.5][rank % 3 + 1]::DOUBLE AS tilt FROM p),
q AS (SELECT *, least((start + a / 2.0::DOUBLE) / target, 1.0) AS fa, least((start + source_size + b / 2.0::DOUBLE) / target, 1.0) AS fb FROM t)
SELECT doc_id, size, source_size, target, (a + b)::BIGINT AS taken,
  CASE WHEN a > 0 THEN CASE WHEN tilt = 0 THEN fa ELSE (-(1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * fa)) / (2 * tilt) END END AS first_position,
  CASE WHEN b > 0 THEN CASE WHEN tilt = 0 THEN fb ELSE (-(1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * fb)) / (2 * tilt) END END AS again_position
FROM q
"""
