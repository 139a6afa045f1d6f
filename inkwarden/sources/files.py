"""Files of a case: listing, validation, and pages."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes searched for the header, and for signs of an HTML page.
SEARCHED, SNIFFED = 4096, 256


def read_files(spark: SparkSession, folder: str, extension: str = "pdf") -> DataFrame:
    """``path``, ``length``, ``content`` of files with an extension, whatever its case; each path once.

    Spark's reader leaves out empty files; their paths come from its file index.
    """
    letters = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{letters}").load(folder)
    full = first_of_each(found, ["path"], ["modificationTime"]).select("path", "length", "content")
    listed = spark.createDataFrame([(unquote(p),) for p in found.inputFiles()], "path string")
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    empty = listed.join(found.select(F.col("path").alias("read")), bare(F.col("path")) == bare(F.col("read")), "left_anti")
    return full.unionByName(empty.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))


def queued(files: DataFrame, name: str, order: str, extension: str = "pdf") -> DataFrame:
    """Of a list of files those with the extension, the first of each name."""
    kept = files.where(F.lower(F.substring_index(name, ".", -1)) == extension.lower())
    return first_of_each(kept, [name], [order])


def first_of_each(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def latin1(content: Column, n: int) -> Column:
    return F.decode(F.substring(content, 1, n), "ISO-8859-1")


def header_offset(content: Column) -> Column:
    """Bytes before ``%PDF`` within the searched part, -1 without one."""
    limit = F.least(F.octet_length(content), F.lit(SEARCHED)) - 4
    at = F.instr(latin1(content, SEARCHED), "%PDF") - 1
    return F.when((at >= 0) & (at < limit), at).otherwise(F.lit(-1)).cast("long")


def looks_like_html(content: Column) -> Column:
    return latin1(content, SNIFFED).rlike(r"(?i)^\s*<!DOCTYPE|^\s*<html")


def problem(content: Column, name: Column) -> Column:
    """Why a file can't be processed; null if it can."""
    said = lambda what: F.concat(F.lit('"'), name, F.lit(f'" {what}'))
    return (
        F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, said("is empty."))
        .when(looks_like_html(content), said("is an HTML page, not a PDF."))
        .when(header_offset(content) < 0, said("has no PDF header."))
    )


def validated(files: DataFrame, name: str = "path") -> DataFrame:
    """Adds ``error``, ``message`` and ``body``, the content from its header on."""
    message = problem(F.col("content"), F.col(name))
    body = F.when(F.col("message").isNull(), F.substring(F.col("content"), (header_offset(F.col("content")) + 1).cast("int"), F.octet_length("content")))
    return files.withColumn("message", message).withColumn("error", F.col("message").isNotNull()).withColumn("body", body)


#: Opens a document: bytes -> [(page number, [(text, x, baseline, width, height)], gray, w, h)].
Opener = Callable[[bytes], list]


def pages(files: DataFrame, opener: Opener, name: str = "path") -> DataFrame:
    """A row for each page of the valid files, and one with the message for each file that fails."""
    schema = f"{name} string, page_num int, items array<struct<text:string,x:double,baseline:double,width:double,height:double>>, gray binary, w int, h int, error boolean, message string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [name, "page_num", "items", "gray", "w", "h", "error", "message"]
        for frame in frames:
            for row in frame.to_dict("records"):
                out = []
                try:
                    if row["message"]:
                        raise ValueError(row["message"])
                    for number, items, gray, w, h in opener(row["body"]):
                        listed = [dict(zip(("text", "x", "baseline", "width", "height"), i)) for i in items]
                        out.append([row[name], number, listed, gray, w, h, False, None])
                    if not out:
                        raise ValueError(f'"{row[name]}" has no pages that could be processed.')
                except Exception as failure:  # noqa: BLE001 - a bad file is a row, not a failed job
                    out = [[row[name], None, None, None, None, None, True, str(failure)]]
                yield pd.DataFrame(out, columns=columns)

    return files.select(name, "body", "message").mapInPandas(run, schema)


_IMAGE = re.compile(rb"/Subtype /Image /Width (\d+) /Height (\d+) /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /FlateDecode /Length (\d+) >>\nstream\n")


def open_image_pdf(body: bytes) -> list:
    """Opens the PDFs that ``sinks.image_pdf`` writes: one gray image a page, no text."""
    out = []
    for number, m in enumerate(_IMAGE.finditer(body), 1):
        w, h, n = map(int, m.groups())
        out.append((number, [], zlib.decompress(body[m.end() : m.end() + n]), w, h))
    return out


def text_pages(rows: DataFrame, doc: str, text: str, page: str | None = None) -> DataFrame:
    """Any table of texts as pages: ``doc_id``, ``page_num``, ``text``."""
    number = F.col(page).cast("int") if page else F.lit(1)
    return rows.select(F.col(doc).alias("doc_id"), number.alias("page_num"), F.coalesce(F.col(text), F.lit("")).alias("text"))
