import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.operators import cascade as X
from docflow.operators import engines as E
from docflow.operators import models as M
from docflow.operators import ocr as O
from docflow.operators import runner as U
from docflow.plans import catalog
from docflow.sources import files, pdf


def test_deadlines():
    assert E.within(500, "x", lambda a: a + 1, 1) == 2 and E.within(0, "x", lambda: 3) == 3
    with pytest.raises(E.TimedOut, match="render timed out after 50ms"):
        E.within(50, "render", time.sleep, 5)
    with pytest.raises(KeyError):
        E.within(500, "x", {}.__getitem__, "k")


def test_a_failed_session_is_made_again():
    tries = []

    def make():
        tries.append(1)
        if len(tries) < 2:
            raise OSError("no network")
        return lambda fed: ("  text \n", 0.9)

    read = E.layout_reader(E.Session(make), lambda image: image, lambda out: out)
    assert read(b"") == ("", None) and not tries
    with pytest.raises(OSError):
        read(b"x")
    assert read(b"x") == ("text", 0.9) and read(b"x") == ("text", 0.9) and len(tries) == 2


@pytest.mark.parametrize("out,want", [(("ok", 0.2), ("ok", 0.2)), (("bad", 0.19), ("", None)), (("", 0.9), ("", None)), (("said", None), ("said", None))])
def test_unsure_results_are_empty(out, want):
    assert E.layout_reader(E.Session(lambda: lambda fed: fed), lambda image: out, lambda x: x)(b"x") == want


def test_large_images_are_refused_and_types_are_told():
    with pytest.raises(ValueError, match=r"granite-docling: image too large \(4 > 3 bytes\)"):
        E.layout_reader(E.Session(dict), None, None, max_bytes=3)(b"1234")
    assert [E.image_type(x, "image/gif") for x in (b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"\x89PNG", b"RIFF\0\0\0\0WEBP", b"RIFF\0\0\0\0WAVE", b"")] == ["image/jpeg", "image/png", "image/gif", "image/webp", "image/gif", "image/gif"]
    assert E.vision(lambda image, mime: None)(b"x") == ("", None) and E.trimmed(lambda image: ("﻿ a ", 0.5))(b"") == ("a", 0.5)


def test_which_engine_is_used():
    registry, own, other = E.Registry(), X.Engine("own"), X.Engine("other")
    assert registry.resolve() is X.NONE
    registry.set(own)
    assert registry.resolve() is own and registry.resolve(mode="off") is X.NONE and registry.resolve(other, "off") is other
    assert E.layout_available(True, "edge") and not E.layout_available(False, "edge") and not E.layout_available(True, "browser") and E.layout_available(True, "browser", True)


def test_pages_that_hang_or_fail_do_not_hold_up_the_route(spark):
    def read(image):
        if image.startswith(b"p1"):
            time.sleep(20)
        if image.startswith(b"p2"):
            raise ValueError("boom")
        return "some text", 0.9

    plan = "array<struct<engine string, location string, script string, reason string>>"
    docs = spark.createDataFrame([(1, bytearray(b"x"), "pdf", 3, [("rapidocr", "edge", None, "")])], f"doc_id long, content binary, kind string, pages int, strategies {plan}")
    images = spark.createDataFrame([(1, i, bytearray(f"p{i}".encode())) for i in range(3)], "doc_id long, index int, image binary")
    began = time.time()
    r = X.execute(docs, X.Engines({}, {"rapidocr": E.reader("rapidocr", read, 700)}), images).first()
    assert r["warnings"] == ["rapidocr: page 1 failed (rapidocr timed out after 700ms)", "rapidocr: page 2 failed (boom)"]
    assert r["text"] == "some text" and r["meta"]["pages_processed"] == 3 and time.time() - began < 18


def test_pages_that_hang_are_waited_for_together():
    def read(x):
        if x % 10 == 7:
            time.sleep(5)
        if x % 10 == 8:
            raise ValueError("broken")
        return x

    began = time.time()
    got = list(E.each_within(400, "slow", read, iter([range(100), [], range(100, 300)])))
    assert [len(b) for b in got] == [100, 0, 200] and time.time() - began < 4  # 30 hang: 12 s one after the other
    for x, (value, error) in enumerate(a for b in got for a in b):
        assert str(error) == {7: "slow timed out after 400ms", 8: "broken"}.get(x % 10, "None") and value == (None if error else x)
    # A page that is late but within its deadline counts.
    late = list(E.each_within(2000, "x", lambda s: time.sleep(s) or s, [[0.01] * 20 + [0.5], [0.01]]))
    assert [v for b in late for v, _ in b] == [0.01] * 20 + [0.5, 0.01]
    assert list(E.each_within(0, "x", {1: 2}.get, [[1, 3]])) == [[(2, None), (None, None)]]


def test_batches_to_python_are_bounded(spark):
    limits = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(k, None) for k in limits]
    try:
        for start, want in (([None, None], ["2048", str(1 << 20)]), (["100", "64k"], ["100", "64k"]), (["0", "8m"], ["2048", str(1 << 20)])):
            for make in (E.reader("x", lambda image: ("", None)).recognize, files.extract_docx, files.extract_xlsx, catalog._container(len)):
                for k, v in zip(limits, start, strict=True):
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)
                make(F.col("content"))
                assert [spark.conf.get(k) for k in limits] == want
    finally:
        for k, v in zip(limits, before, strict=True):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_tensors_have_the_shapes_of_the_column_forms(spark):
    sizes = [(800, 600), (90, 2000), (31, 17), (736, 736)]
    rows = spark.createDataFrame([(float(w), float(h)) for w, h in sizes], "w double, h double").select(O.det_size(F.col("w"), F.col("h")).alias("s"), O.rec_width(F.col("w"), F.col("h")).alias("r")).collect()
    for (w, h), r in zip(sizes, rows, strict=True):
        tensor, ratio_w, ratio_h = U.det_tensor(np.zeros((h, w, 3), np.uint8))
        assert tensor.shape == (1, 3, r["s"]["h"], r["s"]["w"]) and (ratio_w, ratio_h) == (r["s"]["ratio_w"], r["s"]["ratio_h"])
        assert U.rec_tensor(np.zeros((h, w, 3), np.uint8)).shape == (1, 3, 48, r["r"])
    assert np.allclose(U.det_tensor(np.zeros((32, 32, 3), np.uint8))[0][0, :, 0, 0], -U.MEAN / U.STD)
    row = U.rec_tensor(np.full((48, 10, 3), [255, 0, 51], np.uint8), 16)
    assert np.allclose(row[0, :, 5, 5], [51 / 127.5 - 1, -1, 1]) and (row[0, :, :, 10:] == 1).all()


def test_boxes_are_read_apart():
    runner = catalog.page_reader()
    assert len(runner.boxes(catalog.drawn_page(3))) == 3  # the speck makes no box
    assert runner.page(catalog.drawn_page(3)) == ("d", pytest.approx(0.97))  # 'e' fails and 'f' is unsure
    assert runner.page(catalog.drawn_page(7))[0] == "b\nc\nd" and runner.page(catalog.drawn_page(4)) == ("", 0.0)
    runner.doc_floor = 0.98
    assert runner.page(catalog.drawn_page(7)) == ("", pytest.approx(0.97))
    runner.min_side = 30
    assert runner.read(catalog.drawn_page(7)) == ([], 0.0)


def test_reading_order_and_decoding():
    at = lambda x, y: U.Box(np.array([[x, y], [x + 9, y], [x + 9, y + 5], [x, y + 5]], float), 1.0, f"{x},{y}")
    assert [b.text for b in U.in_reading_order([at(50, 3), at(9, 40), at(5, 6), at(90, 0)])] == ["5,6", "50,3", "90,0", "9,40"]
    steps = np.eye(5)[[1, 1, 0, 1, 4, 2, 3, 0]] * 0.9
    assert U.decoded(steps, ["a", "b"]) == ("aa b", pytest.approx(0.9)) and U.decoded(np.eye(5)[[0, 0]], ["a", "b"]) == ("", 0.0)
    assert U.cropped(np.ones((10, 10, 3)), np.array([[-2.0, 8.0], [3.0, 12.0]])).sum() == 3 * 2 * 3
    with pytest.raises(ValueError):
        U.cropped(np.ones((10, 10, 3)), np.array([[3.0, 3.0], [3.0, 9.0]]))


def test_pdf_pages_come_from_an_injected_opener(spark):
    def open_images(content):
        if content.endswith(b"bad"):
            raise ValueError("broken")
        yield from (bytes([c]) for c in content[4:])

    docs = spark.createDataFrame([("a", bytearray(b"%PDFxyz")), ("b", bytearray(b"%PDFbad")), ("c", bytearray(b"text"))], "doc_id string, content binary")
    rows = pdf.page_images(docs, open_images, 2)
    assert [tuple(r) for r in rows.orderBy("doc_id", "index").collect()] == [("a", 0, b"x", None), ("a", 1, b"y", None), ("b", None, None, "broken")]
    assert pdf.opened(rows).count() == 2 and pdf.page_images(docs, open_images, 0).count() == 4


@pytest.mark.parametrize("x,code,want", [
    (0.1 + 0.2, "", "0.3"), (3, "", "3"), (1e20, "", "1E+20"), (0.256, "0%", "26%"), (0.256, "0.00%", "25.60%"), (1234567.891, "#,##0.00", "1,234,567.89"), (2.5, "0", "3"), (45123, "m/d/yy", "7/16/23"), (45123.75, "m/d/yy h:mm", "7/16/23 18:00"), (45123, "yyyy-mm-dd", "2023-07-16"),
    (45123.75, "h:mm AM/PM", "6:00 PM"), (1.5, "[h]:mm:ss", "36:00:00"), (45123, "d-mmm-yy", "16-Jul-23"), (-5, "0.0;(0.0)", "(5.0)"), (5, '"EUR "0.00', "EUR 5.00"), (12345, "0.00E+00", "1.23E+04"), (1, "m/d/yy", "1/1/00"), (1.5, "0.0#", "1.5"), (45123.5, "mmmm d, yyyy hh:mm:ss", "July 16, 2023 12:00:00"),
])
def test_number_formats(x, code, want):
    assert files.formatted(x, code) == want


def test_cells_show_their_formats():
    parts = {"xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>', "xl/styles.xml": '<s><numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="10"/></cellXfs></s>', "xl/worksheets/sheet1.xml": '<w><row><c r="A1" s="1"><v>45123</v></c><c r="C1" s="2"><v>0.5</v></c><c r="D1"><v>7</v></c></row></w>'}
    assert files.xlsx_text(catalog.zipped(parts)) == "2023-07-16,,50.00%,7"


def test_quoted_cells_keep_their_lines(spark):
    raw = 'a,"x\n\ny"\r\n,,\r\n"z ""q"" \n",1\n\n"open\n\nend'
    row = spark.createDataFrame([(bytearray(raw.encode()),)], "b binary").select(files.csv_text(F.col("b"))).first()
    assert row[0] == 'a,"x\n\ny"\n"z ""q"" \n",1\n"open\n\nend'


def test_rows_stored_at_once_have_one_latest(spark):
    rows = [("m", "1", b, t) for b, t in ((b"b", 5), (b"c", 5), (b"a", 5), (b"z", 4))]
    models = spark.createDataFrame([(i, v, bytearray(b), t) for i, v, b, t in rows], "id string, version string, blob binary, stored_at int")
    assert [bytes(r["blob"]) for r in M.latest(models.repartition(3)).collect()] == [b"c"]


def test_progress_is_throttled(spark):
    events = [("a", ms, k, stage, page, 10) for k, (ms, stage, page) in enumerate([(0, "r", 0), (100, "r", 1), (250, "r", 2), (300, "s", 3), (310, "s", 9), (320, "s", 4)])] + [("b", 5, 90, "s", 0, 0)]
    rows = spark.createDataFrame(events, "job string, ms long, seq int, stage string, page_index int, total_pages int").repartition(4)
    assert sorted(tuple(r) for r in M.throttled(rows, "job").collect()) == [("a", 0), ("a", 2), ("a", 3), ("a", 4), ("b", 90)]
