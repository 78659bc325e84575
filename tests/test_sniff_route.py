import pytest
from pyspark.sql import functions as F

from docflow.functions import sniff as S
from docflow.operators import classify as C
from docflow.operators import route as R

CASES = [
    ("25504446", "", "", "pdf", ""), ("89504E47", "", "", "image", ""), ("FFD8FFE0", "", "", "image", ""), ("47494638", "", "", "image", ""), ("424D", "", "", "image", ""), ("424D", "a.txt", "", "image", ""),
    ("524946460000000057454250", "", "", "image", ""), ("524946460000000057415645", "song.wav", "", "other", "kind_unknown"), ("504B0304", "report.xlsx", "", "xlsx", ""), ("504B0304", "notes.docx", "", "docx", ""), ("504B0304", "", "", "docx", "ooxml_kind_ambiguous"),
    ("504B0304" + b"word/document.xml".hex(), "", "", "docx", ""), ("504B0304" + b"xl/workbook.xml".hex(), "", "", "xlsx", ""), ("D0CF11E0A1B11AE1", "old.doc", "", "other", "legacy_office_not_supported"), ("", "data.csv", "", "csv", ""), ("", "readme.md", "", "text", ""),
    ("", "photo.PNG", "", "image", ""), ("", "mystery.doc", "", "other", "legacy_office_not_supported"), ("", "", "application/pdf", "pdf", ""), ("", "", "image/jpeg", "image", ""), ("", "", "text/csv", "csv", ""), ("", "", "text/plain", "text", ""), ("", "blob.dat", "", "other", "kind_unknown"),
]


def test_sniff(spark):
    rows = [(k, bytearray(bytes.fromhex(h) + b"\0" * 50 if h else b""), n or None, m or None) for k, (h, n, m, _, _) in enumerate(CASES)]
    out = spark.createDataFrame(rows, "k int, b binary, n string, m string").select("k", S.sniff(F.col("b"), F.col("n"), F.col("m")).alias("s")).orderBy("k").collect()
    assert [(r["s"]["kind"], (r["s"]["warnings"] or [""])[0].split(":")[0]) for r in out] == [(k, w) for *_, k, w in CASES]


def test_three_magic_bytes_are_too_few(spark):
    row = spark.sql("SELECT unhex('255044') AS b").select(S.sniff(F.col("b"), F.lit("a.pdf"))["kind"], S.sniff(F.col("b"), F.lit("a.bin"))["kind"]).first()
    assert tuple(row) == ("pdf", "other")


B, N = "browser", "node"
O = "rapidocr@{} granite-docling@{}"
ROUTES = [
    ("docx", 1, None, "unknown", B, True, False, "mammoth@browser"), ("xlsx", 1, None, "unknown", B, True, False, "xlsx@browser"), ("csv", 1, None, "latin", B, True, False, "xlsx@browser"), ("text", 1, None, "latin", N, False, False, "text@edge"),
    ("image", 1, None, "unknown", B, True, False, O.format(B, B)), ("image", 1, None, "arabic", B, True, False, O.format(B, B)), ("image", 1, None, "cjk", B, True, False, O.format("edge", B)), ("image", 1, None, "latin", B, False, False, O.format(B, "edge")),
    ("image", 1, None, "latin", B, True, True, O.format(B, B) + " vlm@edge"), ("pdf", 10, False, "latin", B, True, False, "pdfjs-text@browser"), ("pdf", 11, False, "latin", B, True, False, "pdfjs-text@edge"), ("pdf", 8, True, "latin", B, True, False, O.format(B, B)),
    ("pdf", 8, True, "cjk", B, True, False, O.format("edge", B)), ("pdf", 15, True, "cjk", B, True, True, O.format("edge", "edge") + " vlm@edge"), ("pdf", 3, True, "latin", B, False, False, O.format(B, "edge")), ("pdf", 5, True, "latin", B, False, False, O.format("edge", "edge")),
    ("pdf", 5, None, "latin", B, True, True, "pdfjs-text@browser " + O.format(B, B) + " vlm@edge"), ("pdf", 0, None, "unknown", B, True, True, O.format("edge", "edge") + " vlm@edge"), ("pdf", 4, True, "latin", N, True, False, O.format("edge", "edge")),
    ("other", 1, None, "unknown", B, True, True, "vlm@edge"), ("other", 1, None, "unknown", B, True, False, "text@browser"),
]


def test_routes(spark):
    c = F.col
    rows = spark.createDataFrame([(k, *r[:7]) for k, r in enumerate(ROUTES)], "k int, kind string, pages int, scanned boolean, script string, runtime string, gpu boolean, vlm boolean")
    plan = R.route(has_webgpu="gpu", available_scripts="array('latin', 'arabic')", vlm="vlm")
    out = rows.withColumn("s", plan).select("k", F.array_join(F.transform("s", lambda s: F.concat(s["engine"], F.lit("@"), s["location"])), " ").alias("p"), R.summary(c("kind"), c("pages"), c("script"), c("s")).alias("r")).orderBy("k").collect()
    assert [r["p"] for r in out] == [r[-1] for r in ROUTES]
    assert out[11]["r"] == "pdf, 8p, latin → rapidocr → granite-docling"
    assert out[3]["r"] == "text, latin → edge text"


def test_overrides_win_also_with_false():
    base = R.Capabilities(runtime="browser", has_webgpu=True)
    assert R.capabilities({"has_webgpu": False}, base) == R.Capabilities(runtime="browser", has_webgpu=False)
    assert R.capabilities({"has_webgpu": None}, base).has_webgpu


D = "The quick brown fox jumps over the lazy dog. " * 4


@pytest.mark.parametrize("pages,expected", [([D, "", "", "", ""], (5, False)), (["ab3"] * 3, (3, True)), (["x" * 50, D, D], (3, False)), (["x" * 50, D, "ab3"], (3, None))])
def test_scan_vote(spark, pages, expected):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(pages)], "doc_id long, index int, text string")
    r = C.probe_pages(rows).first()
    assert (r["pages"], r["scanned"]) == expected


def test_unopened_pdf(spark):
    docs = spark.sql("SELECT 1L AS doc_id, unhex('2550444631') AS content, 'a.pdf' AS filename")
    r = C.profile(docs, spark.createDataFrame([], "doc_id long, index int, text string")).first()
    assert (r["pages"], r["scanned"], r["script"], r["note"]) == (0, None, "unknown", "pdfjs_unavailable")
