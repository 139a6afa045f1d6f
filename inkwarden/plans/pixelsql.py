"""DuckDB SQL of the raster kernels: an image is rows (path, y, x, v); every function gives CTEs that end in ``out``."""

from __future__ import annotations

#: The test images: the nations' names over and over, 40 x 40 pixels.
SIDE = 40


def images(side: int = SIDE) -> str:
    return f"""images AS (SELECT n_name AS path, i // {side} AS y, i % {side} AS x, ascii(substr(n_name, CAST(i % length(n_name) AS INT) + 1, 1))::BIGINT AS v
  FROM nation, (SELECT unnest(range({side * side})) AS i) p)"""


IMAGES = images()


def _byte(x: str) -> str:
    return f"CAST(least(greatest(floor({x} + 0.5::DOUBLE), 0), 255) AS BIGINT)"


def upscaled(src: str, out: str, side: int = SIDE, f: int = 4) -> str:
    pos = f"least(greatest((i + 0.5::DOUBLE) / {f}::DOUBLE - 0.5::DOUBLE, 0), {side - 1})"
    return f"""{out}_axis AS (SELECT i, CAST(floor(p) AS BIGINT) AS a, least(CAST(floor(p) AS BIGINT) + 1, {side - 1}) AS b, p - floor(p) AS w FROM (SELECT i, {pos} AS p FROM (SELECT unnest(range({side * f})) AS i) r) q),
{out} AS (SELECT p.path, ya.i AS y, xa.i AS x, {_byte('(p.v * (1 - xa.w) + q.v * xa.w) * (1 - ya.w) + (r.v * (1 - xa.w) + s.v * xa.w) * ya.w')} AS v
  FROM {out}_axis ya, {out}_axis xa, {src} p, {src} q, {src} r, {src} s WHERE p.y = ya.a AND p.x = xa.a AND q.path = p.path AND q.y = ya.a AND q.x = xa.b AND r.path = p.path AND r.y = ya.b AND r.x = xa.a AND s.path = p.path AND s.y = ya.b AND s.x = xa.b)"""


def gray(src: str, out: str) -> str:
    """Of colours made from each value: itself, its complement, and a multiple."""
    return f"{out} AS (SELECT path, y, x, CAST(least(greatest(round_even(v * 0.299::DOUBLE + (255 - v) * 0.587::DOUBLE + (v * 7 % 256) * 0.114::DOUBLE, 0), 0), 255) AS BIGINT) AS v FROM {src})"


def equalised(src: str, out: str, side: int, tile: int = 32) -> str:
    n = -(-side // tile)
    axis = f"SELECT i, greatest(0, CAST(floor(f) AS BIGINT)) AS a, least({n - 1}, greatest(0, CAST(floor(f) AS BIGINT)) + 1) AS b, greatest(f - greatest(0, floor(f)), 0) AS w FROM (SELECT i, i / {tile}::DOUBLE - 0.5::DOUBLE AS f FROM (SELECT unnest(range({side})) AS i) r) q"
    lut = lambda n: f"{n}.lut"
    at = lambda n, y, x: f"JOIN {out}_luts {n} ON {n}.path = i.path AND {n}.ty = ya.{y} AND {n}.tx = xa.{x} AND {n}.value = i.v"
    return f"""{out}_sizes AS (SELECT path, y // {tile} AS ty, x // {tile} AS tx, count(*)::DOUBLE AS size FROM {src} GROUP BY ALL),
{out}_hist AS (SELECT s.path, s.ty, s.tx, s.size, b.value, coalesce(h.n, 0)::DOUBLE AS n, 3.0::DOUBLE * s.size / 256 AS most FROM {out}_sizes s CROSS JOIN (SELECT unnest(range(256)) AS value) b
  LEFT JOIN (SELECT path, y // {tile} AS ty, x // {tile} AS tx, v AS value, count(*) AS n FROM {src} GROUP BY ALL) h USING (path, ty, tx, value)),
{out}_flat AS (SELECT *, least(n, most) + (sum(greatest(n - most, 0)) OVER (PARTITION BY path, ty, tx)) / 256 AS h FROM {out}_hist),
{out}_sums AS (SELECT *, sum(h) OVER (PARTITION BY path, ty, tx ORDER BY value) AS c FROM {out}_flat),
{out}_least AS (SELECT *, first_value(CASE WHEN h > 0 THEN c END IGNORE NULLS) OVER (PARTITION BY path, ty, tx ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS m FROM {out}_sums),
{out}_luts AS (SELECT path, ty, tx, value, {_byte('(c - m) / greatest(size - m, 1e-12::DOUBLE) * 255')}::DOUBLE AS lut FROM {out}_least),
{out}_axis AS ({axis}),
{out} AS (SELECT i.path, i.y, i.x, {_byte('p.lut * (1 - xa.w) * (1 - ya.w) + q.lut * xa.w * (1 - ya.w) + r.lut * (1 - xa.w) * ya.w + s.lut * xa.w * ya.w')} AS v
  FROM {src} i JOIN {out}_axis ya ON ya.i = i.y JOIN {out}_axis xa ON xa.i = i.x {at('p', 'a', 'a')} {at('q', 'a', 'b')} {at('r', 'b', 'a')} {at('s', 'b', 'b')})"""


def blurred(src: str, out: str, side: int) -> str:
    near = "ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING"
    return f"""{out}_across AS (SELECT path, y, x, sum(v) OVER (PARTITION BY path, y ORDER BY x {near}) AS s FROM {src}),
{out}_sums AS (SELECT path, y, x, sum(s) OVER (PARTITION BY path, x ORDER BY y {near})::DOUBLE AS s FROM {out}_across),
{out} AS (SELECT path, y, x, CASE WHEN y IN (0, {side - 1}) OR x IN (0, {side - 1}) THEN 0 ELSE {_byte('s / 9')} END AS v FROM {out}_sums)"""


def unsharp(src: str, out: str, side: int, strength: float) -> str:
    return f"{blurred(src, f'{out}_soft', side)},\n{out} AS (SELECT i.path, i.y, i.x, {_byte(f'i.v + {strength}::DOUBLE * (i.v - s.v)')} AS v FROM {src} i JOIN {out}_soft s USING (path, y, x))"


def thresholds(src: str, out: str) -> str:
    """``path``, ``t``."""
    return f"""{out}_sums AS (SELECT path, value, sum(n) OVER w AS below, sum(n * value) OVER w AS level, sum(n) OVER (PARTITION BY path) AS total, sum(n * value) OVER (PARTITION BY path) AS whole FROM (
    SELECT path, value, coalesce(n, 0)::DOUBLE AS n FROM (SELECT DISTINCT path FROM {src}) p CROSS JOIN (SELECT unnest(range(256)) AS value) b LEFT JOIN (SELECT path, v AS value, count(*) AS n FROM {src} GROUP BY ALL) h USING (path, value)) f
  WINDOW w AS (PARTITION BY path ORDER BY value)),
{out}_between AS (SELECT path, value, below * (total - below) * ((level / below - (whole - level) / (total - below)) * (level / below - (whole - level) / (total - below))) AS s FROM {out}_sums WHERE below > 0 AND total - below > 0),
{out} AS (SELECT p.path, coalesce(b.t, 128) AS t FROM (SELECT DISTINCT path FROM {src}) p LEFT JOIN (SELECT path, arg_max(value, {{'s': s, 'v': -value}}) AS t FROM {out}_between WHERE s > 0 GROUP BY path) b USING (path))"""


def binarised(src: str, out: str) -> str:
    return f"{thresholds(src, f'{out}_t')},\n{out} AS (SELECT path, y, x, CASE WHEN v > t THEN 255 ELSE 0 END AS v FROM {src} JOIN {out}_t USING (path))"


def deskewed(src: str, out: str, side: int) -> str:
    """``{out}_angle`` has the angle of each path, ``out`` the image turned by it."""
    cy, cx = f"(y - {side}::DOUBLE / 2)", f"(x - {side}::DOUBLE / 2)"
    turned = f"CAST(floor(-{cx} * sin(t) + {cy} * cos(t) + {side}::DOUBLE / 2 + 0.5::DOUBLE) AS BIGINT) AS sy, CAST(floor({cx} * cos(t) + {cy} * sin(t) + {side}::DOUBLE / 2 + 0.5::DOUBLE) AS BIGINT) AS sx"
    return f"""{binarised(src, f'{out}_bin')},
{out}_places AS (SELECT a, y, x, {turned} FROM (SELECT k / 2.0::DOUBLE - 10 AS a, radians(k / 2.0::DOUBLE - 10) AS t FROM (SELECT unnest(range(41)) AS k) k) a, (SELECT unnest(range({side})) AS y) ys, (SELECT unnest(range({side})) AS x) xs),
{out}_rows AS (SELECT b.path, p.a, p.y, count(*) AS n FROM {out}_places p JOIN {out}_bin b ON b.y = p.sy AND b.x = p.sx AND b.v = 0 GROUP BY ALL),
{out}_spread AS (SELECT path, a, sum(n * n)::DOUBLE - sum(n)::DOUBLE * sum(n) / {side} AS s FROM {out}_rows GROUP BY ALL),
{out}_angle AS (SELECT p.path, coalesce(arg_max(a, {{'s': round(s, 4), 'a': -a}}), -10.0::DOUBLE) AS a FROM (SELECT DISTINCT path FROM {src}) p LEFT JOIN {out}_spread USING (path) GROUP BY p.path),
{out} AS (SELECT g.path, p.y, p.x, CASE WHEN abs(g.a) < 0.3 THEN own.v ELSE coalesce(i.v, 255) END AS v FROM {out}_angle g JOIN {out}_places p USING (a)
  JOIN {src} own ON own.path = g.path AND own.y = p.y AND own.x = p.x LEFT JOIN {src} i ON i.path = g.path AND i.y = p.sy AND i.x = p.sx)"""


def stretched(src: str, out: str) -> str:
    return f"""{out} AS (SELECT path, y, x, {_byte('pow(floor((v - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END)::DOUBLE * 255 + 0.5::DOUBLE) / 255, 0.7::DOUBLE) * 255')} AS v
  FROM {src} JOIN (SELECT path, min(v) AS lo, max(v) AS hi FROM {src} GROUP BY path) m USING (path))"""


def digests(src: str, side: int) -> str:
    """All pixels of each image as one hash."""
    return f"SELECT path, {side} AS w, {side} AS h, sha256(unhex(string_agg(printf('%02x', v), '' ORDER BY y, x))) AS digest FROM {src} GROUP BY path"


def _kept(ctes: str) -> str:
    """Each step worked out once, however often later ones read it."""
    return ctes.replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


def kernel(ctes: str, side: int = SIDE) -> str:
    return _kept(f"WITH {IMAGES}, {ctes} ") + digests("out", side)


def enhanced(small: int) -> str:
    """The whole chain on images of ``small`` by ``small`` pixels."""
    big = 4 * small
    ctes = f"""{images(small)}, {upscaled('images', 'up', small)}, {deskewed('up', 'straight', big)}, {equalised('straight', 'even', big)}, {blurred('even', 'soft', big)},
{unsharp('soft', 'enhanced', big, 1.8)}, {stretched('straight', 'wide')}, {unsharp('wide', 'contrast', big, 2.0)}, {unsharp('enhanced', 'sharp', big, 2.5)}"""
    parts = [("original", "images", small), ("enhanced", "enhanced", big), ("high_contrast", "contrast", big), ("sharpened", "sharp", big)]
    return _kept(f"WITH {ctes} ") + " UNION ALL ".join(f"SELECT *, '{n}' AS variant, CAST(NULL AS VARCHAR) AS error FROM ({digests(src, side)}) {src}_d" for n, src, side in parts)
