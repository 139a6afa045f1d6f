"""Redacted output: page images to PDF, PDFs to archives. Nothing of a text layer is written."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rx
from ..operators.geometry import SCALE, Config, bar, item_box, needs_redaction
from ..operators.raster import black_out


def output_name(source: str) -> str:
    return re.sub(r"\.pdf$", "", source, flags=re.I) + "_REDACTED.pdf"


def page_size(w: int, h: int) -> tuple[float, float, str]:
    """Millimetres of a rendered page and its orientation."""
    mm = lambda px: px / SCALE * 25.4 / 96
    return mm(w), mm(h), "l" if w > h else "p"


def image_pdf(images: list[np.ndarray]) -> bytes:
    """A PDF with one losslessly compressed gray image a page."""
    out, offsets = io.BytesIO(), []

    def put(body: bytes) -> None:
        offsets.append(out.tell())
        out.write(b"%d 0 obj\n" % len(offsets) + body + b"\nendobj\n")

    out.write(b"%PDF-1.5\n")
    kids = b" ".join(b"%d 0 R" % (3 + 3 * i) for i in range(len(images)))
    put(b"<< /Type /Catalog /Pages 2 0 R >>")
    put(b"<< /Type /Pages /Kids [" + kids + b"] /Count %d >>" % len(images))
    for i, g in enumerate(images):
        h, w = g.shape
        x, y, _ = page_size(w, h)
        pt = (x * 72 / 25.4, y * 72 / 25.4)
        n = 3 + 3 * i
        put(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.3f %.3f] /Resources << /XObject << /I %d 0 R >> >> /Contents %d 0 R >>" % (*pt, n + 2, n + 1))
        draw = b"q %.3f 0 0 %.3f 0 0 cm /I Do Q" % pt
        put(b"<< /Length %d >>\nstream\n" % len(draw) + draw + b"\nendstream")
        data = zlib.compress(np.ascontiguousarray(g).tobytes())
        put(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /FlateDecode /Length %d >>\nstream\n" % (w, h, len(data)) + data + b"\nendstream")
    start = out.tell()
    out.write(b"xref\n0 %d\n0000000000 65535 f \n" % (len(offsets) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets))
    out.write(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(offsets) + 1, start))
    return out.getvalue()


def redacted_pdfs(pages: DataFrame, name: str = "path") -> DataFrame:
    """``name``, ``filename``, ``pdf``, ``error``, ``message`` of each document from its page images (``page_num``,
    ``gray``, ``w``, ``h``) and bars (``bars``: array<struct<x, y, w, h>>). A document's pages meet in one task."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        source = frame[name].iloc[0]
        try:
            images = []
            for r in frame.sort_values("page_num").to_dict("records"):
                g = np.frombuffer(r["gray"], np.uint8).reshape(int(r["h"]), int(r["w"]))
                images.append(black_out(g, [(b["x"], b["y"], b["w"], b["h"]) for b in (r["bars"] if r["bars"] is not None else [])]))
            return pd.DataFrame([[source, output_name(source), image_pdf(images), False, None]], columns=[name, "filename", "pdf", "error", "message"])
        except Exception as failure:  # noqa: BLE001
            return pd.DataFrame([[source, None, None, True, str(failure)]], columns=[name, "filename", "pdf", "error", "message"])

    return pages.select(name, "page_num", "gray", "w", "h", "bars").groupBy(name).applyInPandas(run, f"{name} string, filename string, pdf binary, error boolean, message string")


def black_bars(pages: DataFrame, config: Config = Config(), name: str = "path") -> DataFrame:
    """From opened pages (``files.pages``) to redacted PDFs: bars of the text items that hold an entity or a term are
    painted on each page's image. Adds ``n_bars``; files that failed before stay rows with their message."""

    def bar_of(i: Column) -> Column:
        b = item_box(i["x"], i["baseline"], i["width"], i["height"], i["text"])
        return rx.bind(b, lambda b: bar(b["x"], b["y"], b["w"], b["h"], config.padding))

    items = F.coalesce("items", F.array().cast(pages.schema["items"].dataType))
    hits = F.filter(items, lambda i: needs_redaction(F.coalesce(F.trim(i["text"]), F.lit("")), config))
    barred = pages.where("not error").withColumn("bars", F.transform(hits, bar_of))
    counts = barred.groupBy(name).agg(F.sum(F.size("bars")).alias("n_bars"))
    failed = pages.where("error").select(name, F.lit(None).cast("string").alias("filename"), F.lit(None).cast("binary").alias("pdf"), "error", "message", F.lit(0).cast("long").alias("n_bars"))
    return redacted_pdfs(barred, name).join(counts, name).unionByName(failed)


def archives(outputs: DataFrame, date: str, shards: int = 64) -> DataFrame:
    """Deflated ZIP archives ``redacted-<date>[-shard].zip`` of all successful outputs, dealt to ``shards``."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for r in frame.sort_values("filename").to_dict("records"):
                z.writestr(r["filename"], bytes(r["pdf"]))
        shard = int(frame["shard"].iloc[0])
        return pd.DataFrame([[f"redacted-{date}" + (f"-{shard:04d}" if shards > 1 else "") + ".zip", held.getvalue(), len(frame)]], columns=["archive", "content", "n_files"])

    good = outputs.where("not error").select("filename", "pdf", F.pmod(F.xxhash64("filename"), F.lit(shards)).alias("shard"))
    return good.groupBy("shard").applyInPandas(run, "archive string, content binary, n_files long")


def write_files(rows: DataFrame, name: str, content: str, folder: str) -> None:
    """Writes each row as a Parquet record of name and bytes, partition by partition, to a shared folder."""
    rows.select(name, content).write.mode("append").parquet(folder)


def iterate(rows: DataFrame, name: str, content: str) -> Iterator[tuple[str, bytes]]:
    """Names and bytes one after the other, for a caller that saves them itself."""
    for row in rows.select(name, content).toLocalIterator():
        yield row[0], bytes(row[1])
