"""Sources, rasters, bars, sinks and streams."""

import io
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwarden.operators import geometry, ocr, raster
from inkwarden.sources import files, sinks
from inkwarden.streaming import redaction


def test_validation(spark, tmp_path):
    made = {"ok.pdf": b"junk%PDF-1.4 body", "late.PDF": b"x" * 5000 + b"%PDF", "page.pdf": b" <!doctype html>", "none.pdf": b"", "note.txt": b"%PDF"}
    for n, b in made.items():
        (tmp_path / n).write_bytes(b)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in files.validated(files.read_files(spark, str(tmp_path))).collect()}
    assert set(rows) == {"ok.pdf", "late.PDF", "page.pdf", "none.pdf"}
    assert bytes(rows["ok.pdf"].body) == b"%PDF-1.4 body" and not rows["ok.pdf"].error
    assert "no PDF header" in rows["late.PDF"].message and "HTML" in rows["page.pdf"].message and "empty" in rows["none.pdf"].message

    def opener(body):
        if b"1.4" not in body:
            raise ValueError("bad")
        return [(1, [("hello", 1.0, 2.0, 3.0, 4.0)], b"\0" * 4, 2, 2)]

    got = {r.path.rsplit("/", 1)[-1]: r for r in files.pages(files.validated(files.read_files(spark, str(tmp_path))), opener).collect()}
    assert got["ok.pdf"].page_num == 1 and got["ok.pdf"]["items"][0].text == "hello" and got["page.pdf"].error


def test_kernels():
    rng = np.random.default_rng(1)
    g = rng.integers(0, 256, (40, 50), dtype=np.uint8)
    b = raster.blur(g)
    assert b[0].max() == 0 and b[5, 5] == int(np.floor(g[4:7, 4:7].mean() + 0.5))
    assert raster.otsu(np.full((4, 4), 9, np.uint8)) == 128
    two = np.repeat(np.array([[10, 200]], np.uint8), 20, axis=0)
    assert raster.binarise(two).tolist() == [[0, 255]] * 20
    assert raster.stretch(two).min() == 0 and raster.stretch(two).max() == 255
    assert raster.upscale(g).shape == (160, 200) and raster.equalise(g).shape == g.shape
    lines = np.full((120, 120), 255, np.uint8)
    lines[20::20] = 0
    assert raster.skew(lines) == 0.0
    found = raster.enhance(g)
    assert found["error"] is None and found["scale"] == 4
    assert raster.enhance(np.zeros((0, 0), np.uint8))["error"]


def test_pdf_has_black_bars_and_no_text(spark):
    g = np.full((10, 20), 255, np.uint8)
    rows = [("a.PDF", 1, g.tobytes(), 20, 10, [(2, 3, 4, 5)]), ("b.pdf", 1, b"short", 20, 10, None)]
    df = spark.createDataFrame(rows, "path string, page_num int, gray binary, w int, h int, bars array<struct<x:int,y:int,w:int,h:int>>")
    made = sinks.redacted_pdfs(df)
    good, bad = made.orderBy("path").collect()
    assert good.filename == "a_REDACTED.pdf" and bad.error and not good.error
    body = bytes(good.pdf)
    data = body[body.index(b"/FlateDecode") :]
    image = np.frombuffer(zlib.decompress(data[data.index(b"stream\n") + 7 :]), np.uint8).reshape(10, 20)
    assert (image[3:8, 2:6] == 0).all() and (image == 0).sum() == 20 and b"BT" not in body.replace(data, b"")
    held = sinks.archives(made, "2024-01-02", 1).first()
    assert held.archive == "redacted-2024-01-02.zip" and zipfile.ZipFile(io.BytesIO(bytes(held.content))).namelist() == ["a_REDACTED.pdf"]
    assert sinks.page_size(250, 100)[2] == "l" and sinks.page_size(250, 100)[0] == pytest.approx(26.458, abs=1e-3)


def test_bars(spark):
    df = spark.createDataFrame([(10.4, 20.6, 30.2, 5.1)], "x double, y double, w double, h double")
    b = df.select(geometry.bar(F.col("x"), F.col("y"), F.col("w"), F.col("h"), 4).alias("b")).first().b
    assert tuple(b) == (0, 10, 51, 26)
    drags = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 9.0), (1, 2, 5.0, 5.0, 0.0, 6.0), (1, 3, 0.0, 0.0, 9.0, 99.0)], "d int, seq int, x0 double, y0 double, x1 double, y1 double")
    bars = geometry.manual_bars(drags, ["d"])
    assert {(r.seq, r.bar.h) for r in bars.collect()} == {(2, 16), (3, 99)}
    left = geometry.undo(bars, ["d"], spark.createDataFrame([(1, 1)], "d int, n int"))
    assert [r.seq for r in left.collect()] == [2]


def test_verify_and_recognise(spark):
    words = spark.createDataFrame([(1, 1, "a", 20.0), (1, 2, "b", 50.0)], "p int, place int, text string, confidence double")
    again = spark.createDataFrame([(1, 1, "A", 31.0), (1, 2, "B", 60.0)], "p int, place int, text string, confidence double")
    got = {r.place: (r.text, r.confidence, r.verified) for r in ocr.verify(words, again, ["p"]).collect()}
    assert got == {1: ("A", 31.0, True), 2: ("b", 50.0, False)}

    def engine(gray, w, h, languages):
        if w == 0:
            raise ValueError("no image")
        return [(" hi ", 70, 0, 0, 5, 5), (" ", 1, 0, 0, 1, 1)]

    images = spark.createDataFrame([(1, 0, b"x", 1, 1, "eng"), (2, 0, b"", 0, 0, "eng")], "p int, pass_id int, gray binary, w int, h int, languages string")
    rows = ocr.recognise(images, ["p"], engine).orderBy("p").collect()
    assert rows[0].text == "hi" and rows[1].error == "no image"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    df = spark.createDataFrame([("s", "a@x.com and b@y.org"), ("s", "b@y.org"), ("t", "nothing")], "session string, text string")
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = redaction.read_texts(spark, str(tmp_path / "in"), df.schema)
    for name, out in (("plain", redaction.redacted(stream)), ("keys", redaction.numbered_keys(stream, "session"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
    assert {r.redacted for r in spark.table("plain").collect()} == {"[REDACTED] and [REDACTED]", "[REDACTED]", "nothing"}
    assert {(r.number_key, r.n) for r in spark.table("keys").where("grp = 'EMAIL'").collect()} == {("b@y.org", 1), ("a@x.com", 2)}


def test_recognition_flow(spark):
    """A stand-in engine: letters of an image are its words, longer where the languages or the size help."""

    def engine(gray, w, h, languages):
        if w > 40:  # an enlarged cutting
            return [("clear", 90, 0, 0, 9, 9)]
        word = bytes(gray[:6]).decode("latin1").strip()
        if word == "broken":
            raise ValueError("no image")
        confidence = 40 if word == "doubt" else 70
        return [("مرحبا بكم" if word == "arab" else word, confidence + 20 * (languages == "ara"), 2, 2, 30, 12)] + ([(languages, 99, 2, 20, 30, 28)] if "+" in languages else [])

    rows = [(p, k, (t.ljust(6) + " " * 894).encode(), 30, 30) for p, t in enumerate(["plain", "doubt", "arab", "broken"]) for k in range(4)]
    variants = spark.createDataFrame(rows, "page int, pass_id int, gray binary, w int, h int")
    got = {}
    for r in ocr.recognise_pages(variants, ["page"], engine).orderBy("page", "place").collect():
        got.setdefault(r.page, []).append((r.text, r.confidence, r.verified))
    assert set(got) == {0, 1, 2}
    assert got[0] == [("plain", 70.0, False), ("eng+fra+som+tur", 99.0, False)]
    assert got[1][0] == ("clear", 90.0, True)
    assert got[2][0][:2] == ("مرحبا بكم", 90.0) and got[2][1][0] == "ara+eng+fra+urd+kur"


def test_black_bar_flow(spark):
    pages = [("a.pdf", 1, [("x@y.org", 1.0, 6.0, 4.0, 2.0), ("nothing", 1.0, 12.0, 4.0, 2.0)], b"\xff" * 1600, 40, 40, False, None), ("b.pdf", None, None, None, None, None, True, "bad")]
    df = spark.createDataFrame(pages, "path string, page_num int, items array<struct<text:string,x:double,baseline:double,width:double,height:double>>, gray binary, w int, h int, error boolean, message string")
    good, bad = sinks.black_bars(df, geometry.Config(active=("EMAIL",))).orderBy("path").collect()
    assert (good.filename, good.n_bars, bad.error, bad.message) == ("a_REDACTED.pdf", 1, True, "bad")
    ((number, items, gray, w, h),) = files.open_image_pdf(bytes(good.pdf))
    image = np.frombuffer(gray, np.uint8).reshape(h, w)
    assert (number, items) == (1, []) and (image[:15, :30] == 0).all() and (image[30:] == 255).all()
