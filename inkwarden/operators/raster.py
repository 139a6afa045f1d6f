"""Raster kernels on gray images, in numpy, and their use on tables of images.

An image is a ``uint8`` array of rows. Catalyst has no pixel operators, so ``enhance_images`` runs the
kernels in Arrow batches, an image at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Least side and most enlargement, tile and clip of the equalisation, angles tried.
SIDE, MOST, TILE, CLIP = 1200, 4, 32, 3.0
ANGLES = np.arange(-10, 10.5, 0.5)
# End of fixed values.


def _round(x: np.ndarray) -> np.ndarray:
    """Half up, then into a byte."""
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def to_gray(rgb: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(rgb[..., :3] @ np.array([0.299, 0.587, 0.114])), 0, 255).astype(np.uint8)


def upscale(g: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Whole-number bilinear enlargement until the shorter side reaches ``side``, at most four times."""
    h, w = g.shape
    if w >= side and h >= side:
        return g
    f = min(-(-side // min(w, h)), MOST)
    axis = lambda n: np.clip((np.arange(n * f) + 0.5) / f - 0.5, 0, n - 1)
    ys, xs = axis(h), axis(w)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    wy, wx = (ys - y0)[:, None], (xs - x0)[None, :]
    a = g.astype(float)
    top, low = a[y0][:, x0] * (1 - wx) + a[y0][:, x1] * wx, a[y1][:, x0] * (1 - wx) + a[y1][:, x1] * wx
    return _round(top * (1 - wy) + low * wy)


def equalise(g: np.ndarray, tile: int = TILE, clip: float = CLIP) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation with bilinear blending of tiles."""
    h, w = g.shape
    ny, nx = -(-h // tile), -(-w // tile)
    luts = np.zeros((ny, nx, 256))
    for ty in range(ny):
        for tx in range(nx):
            part = g[ty * tile : (ty + 1) * tile, tx * tile : (tx + 1) * tile]
            hist, limit = np.bincount(part.ravel(), minlength=256).astype(float), clip * part.size / 256
            hist = np.minimum(hist, limit) + np.maximum(hist - limit, 0).sum() / 256
            cdf = np.cumsum(hist)
            least = cdf[np.flatnonzero(hist > 0)[0]]
            luts[ty, tx] = _round((cdf - least) / max(part.size - least, 1e-12) * 255)
    fy, fx = np.arange(h) / tile - 0.5, np.arange(w) / tile - 0.5
    y0, x0 = np.maximum(0, np.floor(fy)).astype(int), np.maximum(0, np.floor(fx)).astype(int)
    y1, x1 = np.minimum(ny - 1, y0 + 1), np.minimum(nx - 1, x0 + 1)
    wy, wx = np.maximum(fy - y0, 0)[:, None], np.maximum(fx - x0, 0)[None, :]
    at = lambda y, x: luts[y[:, None], x[None, :], g]
    return _round(at(y0, x0) * (1 - wx) * (1 - wy) + at(y0, x1) * wx * (1 - wy) + at(y1, x0) * (1 - wx) * wy + at(y1, x1) * wx * wy)


def blur(g: np.ndarray, times: int = 1) -> np.ndarray:
    """Mean of each 3 x 3 box; the one-pixel border is zero."""
    for _ in range(times):
        out = np.zeros_like(g)
        if min(g.shape) > 2:
            h, w = g.shape
            total = sum(g[y : h - 2 + y, x : w - 2 + x].astype(float) for y in range(3) for x in range(3))
            out[1:-1, 1:-1] = _round(total / 9)
        g = out
    return g


def unsharp(g: np.ndarray, strength: float = 1.5) -> np.ndarray:
    a = g.astype(float)
    return _round(a + strength * (a - blur(g)))


def otsu(g: np.ndarray) -> int:
    """Threshold with most variance between classes, 128 if there are none."""
    hist = np.bincount(g.ravel(), minlength=256).astype(float)
    below, level = np.cumsum(hist), np.cumsum(hist * np.arange(256))
    above = below[-1] - below
    good = (below > 0) & (above > 0)
    if not good.any():
        return 128
    means = level[good] / below[good] - (level[-1] - level[good]) / above[good]
    between = below[good] * above[good] * means**2
    return int(np.flatnonzero(good)[np.argmax(between)]) if between.max() > 0 else 128


def binarise(g: np.ndarray, threshold: int | None = None) -> np.ndarray:
    return np.where(g > (otsu(g) if threshold is None else threshold), 255, 0).astype(np.uint8)


def _rotated(shape: tuple[int, int], degrees: float) -> tuple[np.ndarray, np.ndarray]:
    h, w = shape
    t = np.deg2rad(degrees)
    cx, cy = np.arange(w)[None, :] - w / 2, np.arange(h)[:, None] - h / 2
    return np.floor(-cx * np.sin(t) + cy * np.cos(t) + h / 2 + 0.5).astype(int), np.floor(cx * np.cos(t) + cy * np.sin(t) + w / 2 + 0.5).astype(int)


def skew(g: np.ndarray) -> float:
    """The angle whose row profile of dark pixels varies most."""
    dark, (h, w) = binarise(g) < 128, g.shape
    best, most = 0.0, -1.0
    for a in ANGLES:
        y, x = _rotated(g.shape, a)
        inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
        rows = (dark[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)] & inside).sum(axis=1).astype(float)
        if (v := ((rows - rows.mean()) ** 2).sum()) > most:
            best, most = float(a), v
    return best


def deskew(g: np.ndarray) -> tuple[np.ndarray, float]:
    """The image turned upright on white, and the angle found."""
    a = skew(g)
    if abs(a) < 0.3:
        return g, a
    (h, w), (y, x) = g.shape, _rotated(g.shape, a)
    inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
    return np.where(inside, g[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)], 255).astype(np.uint8), a


def stretch(g: np.ndarray) -> np.ndarray:
    """Full range, then a gamma of 0.7."""
    a = g.astype(float)
    v = np.floor((a - a.min()) / ((a.max() - a.min()) or 1) * 255 + 0.5)
    return _round((v / 255) ** 0.7 * 255)


def enhance(g: np.ndarray) -> dict:
    """The variants that recognition reads; the originals if anything fails."""
    try:
        up = upscale(g)
        straight, angle = deskew(up)
        enhanced = unsharp(blur(equalise(straight)), 1.8)
        return {"original": g, "enhanced": enhanced, "high_contrast": unsharp(stretch(straight), 2.0), "sharpened": unsharp(enhanced, 2.5), "angle": angle, "scale": up.shape[0] / g.shape[0], "error": None}
    except Exception as failure:  # noqa: BLE001
        return {"original": g, "enhanced": g, "high_contrast": g, "sharpened": g, "angle": 0.0, "scale": 1.0, "error": str(failure)}


def enhance_images(images: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each variant of each image (``gray`` bytes, ``w``, ``h``)."""
    schema = ", ".join(f"{k} {images.schema[k].dataType.simpleString()}" for k in keys) + ", variant string, gray binary, w int, h int, angle double, scale double, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                g = np.frombuffer(row["gray"], np.uint8).reshape(row["h"], row["w"])
                found = enhance(g)
                out = [[*(row[k] for k in keys), v, found[v].tobytes(), found[v].shape[1], found[v].shape[0], found["angle"], found["scale"], found["error"]] for v in ("original", "enhanced", "high_contrast", "sharpened")]
                yield pd.DataFrame(out, columns=[*keys, "variant", "gray", "w", "h", "angle", "scale", "error"])

    return images.select(*keys, "gray", "w", "h").mapInPandas(run, schema)


def kernel_images(images: DataFrame, keys: list[str], kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Each image (``gray`` bytes, ``w``, ``h``) after one kernel; a failing image keeps its pixels and has a message."""
    schema = ", ".join(f"{k} {images.schema[k].dataType.simpleString()}" for k in keys) + ", gray binary, w int, h int, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    g, error = kernel(np.frombuffer(row["gray"], np.uint8).reshape(row["h"], row["w"])), None
                    out.append([*(row[k] for k in keys), g.tobytes(), g.shape[1], g.shape[0], error])
                except Exception as failure:  # noqa: BLE001 - one bad image is a row, not a failed job
                    out.append([*(row[k] for k in keys), row["gray"], row["w"], row["h"], str(failure)])
            yield pd.DataFrame(out, columns=[*keys, "gray", "w", "h", "error"])

    return images.select(*keys, "gray", "w", "h").mapInPandas(run, schema)


def black_out(g: np.ndarray, bars: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The image with bars (x, y, w, h) painted black."""
    out = g.copy()
    for x, y, w, h in bars:
        out[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)] = 0
    return out
