import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docflow.operators import cascade as X
from docflow.plans import api, catalog
from docflow.sources import files

PLAN = "array<struct<engine string, location string, script string, reason string>>"


def routed(spark, kind, *engines, content=b"x", pages=1):
    rows = [(1, bytearray(content), kind, pages, [(e, "edge", None, "") for e in engines])]
    return spark.createDataFrame(rows, f"doc_id long, content binary, kind string, pages int, strategies {PLAN}")


def says(text, error=None):
    return lambda c: F.struct(F.lit(text).cast("string").alias("text"), F.lit(error).cast("string").alias("error"))


def run(spark, docs, extractors=None, readers=None, images=None, **options):
    return X.execute(docs, X.Engines(extractors or {}, {k: X.Engine(k, v) for k, v in (readers or {}).items()}), images, **options).first()


def test_text_engine(spark):
    r = run(spark, routed(spark, "docx", "mammoth"), {"mammoth": says(" hello world ")})
    assert (r["engine"], r["source"], r["text"], r["meta"]["pages_processed"]) == ("mammoth", "native", "hello world", 1)


@pytest.mark.parametrize("extractors,options,part", [({"mammoth": says("ab")}, {}, "mammoth: only 2 non-ws chars, falling through"), ({"mammoth": says("abcd")}, {"floor": 5}, "mammoth: only 4 non-ws"), ({}, {}, "mammoth: no extractor wired, skipping"), ({"mammoth": says(None, "boom")}, {}, "mammoth extractor failed: boom")])
def test_misses_warn(spark, extractors, options, part):
    r = run(spark, routed(spark, "docx", "mammoth"), extractors, **options)
    assert (r["engine"], r["source"], r["meta"]["total_pages"]) == (None, "none", 1) and part in r["warnings"][0]


def images(spark, n):
    return spark.createDataFrame([(1, i, f"p{i}") for i in range(n)], "doc_id long, index int, image string")


def test_page_engines_fall_through_in_order(spark):
    docs = routed(spark, "pdf", "rapidocr", "granite-docling", pages=2)
    r = run(spark, docs, None, {"rapidocr": says(None, "down"), "granite-docling": says("found it")}, images(spark, 2))
    assert r["engine"] == "granite-docling" and r["meta"]["ocr_pages"] == 2 and r["text"] == "found it\n\nfound it"
    assert r["warnings"] == ["rapidocr: page 0 failed (down)", "rapidocr: page 1 failed (down)", "rapidocr: 0 non-ws chars across 2 page(s), falling through"]


def test_page_budget_and_missing_parts(spark):
    docs = routed(spark, "pdf", "rapidocr", "vlm", pages=5)
    r = run(spark, docs, None, {"rapidocr": says("text")}, images(spark, 5), max_pages=2)
    assert r["meta"]["pages_processed"] == 2 and r["warnings"] == ["page_budget: capped OCR/VLM at 2 of 5 pages"]
    assert run(spark, docs, None, {"rapidocr": says("text")}, images(spark, 5), max_pages=0)["meta"]["pages_processed"] == 5
    r = run(spark, docs)
    assert r["warnings"] == ["rapidocr: engine not wired, skipping", "vlm: engine not wired, skipping"]


def test_later_engine_runs_only_on_the_rest(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf(StructType([StructField("text", StringType()), StructField("error", StringType())]))
    def second(image):
        calls.add(1)
        return ("second", None)

    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit(b"x").alias("content"), F.lit("image").alias("kind"), F.lit(1).alias("pages"), F.array(*[F.struct(F.lit(e).alias("engine"), F.lit("edge").alias("location"), F.lit("").alias("script"), F.lit("").alias("reason")) for e in ("rapidocr", "granite-docling")]).alias("strategies"))
    first = lambda c: F.struct(F.when(F.rand(3) >= 0, "long enough").alias("text"), F.lit(None).cast("string").alias("error"))
    assert X.execute(docs, X.Engines({}, {"rapidocr": X.Engine("rapidocr", first), "granite-docling": X.Engine("granite-docling", second)})).where("engine = 'rapidocr'").count() == 20
    assert calls.value == 0


def test_limits(spark):
    docs = spark.createDataFrame([(1, bytearray(b""), "a.txt"), (2, bytearray(b"y" * 200), "b.txt"), (3, bytearray("é🎉é".encode() * 10), "c.txt")], "doc_id long, content binary, filename string")
    out = {r["doc_id"]: r for r in api.parse(docs, api.ParseOptions(max_bytes=150, max_chars=6)).collect()}
    assert out[1]["warnings"] == ["empty_input"] and out[2]["warnings"] == ["input_too_large:0KB_exceeds_0KB"] and out[2]["meta"]["total_pages"] == 0
    assert out[3]["warnings"] == ["truncated_chars:40_to_6"] and out[3]["text"] == "é🎉éé" and out[3]["meta"]["truncated"]


def test_slots(spark):
    docs = spark.createDataFrame([(1, bytearray(b"plain text"), "a.txt")], "doc_id long, content binary, filename string")
    options = api.ParseOptions(engines=X.Engines({"text": X.plain_text(lambda c: c.cast("string"))}), text_only=True)
    engine = lambda *slots: api.parse_with_fallbacks(docs, list(slots), options).first()["engine"]
    assert engine(X.Slot("hosted", says("hosted OCR result"))) == "hosted"
    assert engine(X.Slot("hosted", says("ab"))) == "native"
    assert engine(X.Slot("hosted", says("long text"), F.lit(False))) == "native"
    assert engine(X.Slot("hosted", says("long text", "boom"))) == "native"


def test_office(spark):
    assert files.docx_text(catalog.docx_blob("a b", "c")).strip() == "a b\n\nc"
    assert files.xlsx_text(catalog.xlsx_blob({"S": [["Name", "City"], ["Ann", 'x"y']]})) == 'Name,City\nAnn,"x""y"'
    assert files.xlsx_text(catalog.xlsx_blob({"Sheet1": [["a"]], "Sheet2": [["b"]]})) == "# Sheet1\na\n# Sheet2\nb"
    docs = spark.createDataFrame([(1, bytearray(catalog.docx_blob("Hello there")), "a.docx")], "doc_id long, content binary, filename string")
    r = api.parse(docs).first()
    assert (r["kind"], r["engine"], r["text"]) == ("docx", "mammoth", "Hello there")


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.txt").write_text("x" * 100)
    assert [r["filename"] for r in files.read_files(spark, str(tmp_path), 50).collect()] == ["a.txt"]
    assert [r["filename"] for r in files.oversized(spark, str(tmp_path), 50).collect()] == ["b.txt"]


def test_images_are_shuffled_once_where_documents_are_many(spark, monkeypatch):
    """Neither the pages that the budget cuts nor the texts read off the others move again, and counts move without images."""
    monkeypatch.setattr(X, "_few", lambda df: df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = []

        def keep(df):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return df.localCheckpoint()

        step = F.struct(F.lit("rapidocr").alias("engine"), F.lit("edge").alias("location"), F.lit("").alias("script"), F.lit("").alias("reason"))
        docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(b"x").alias("content"), F.when(F.col("id") < 99, "pdf").otherwise("image").alias("kind"), F.lit(5).alias("pages"), F.array(step).alias("strategies"))
        images = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("index")).withColumn("image", F.concat(F.lit("page "), "index"))
        reader = X.Engine("rapidocr", lambda c: F.struct(c.alias("text"), F.lit(None).cast("string").alias("error")))
        out = X.execute(docs, X.Engines({}, {"rapidocr": reader}), images, max_pages=2, keep=keep)
        assert [(r["text"], r["warnings"]) for r in out.select("text", "warnings").distinct().collect()] == [("page 0\n\npage 1", ["page_budget: capped OCR/VLM at 2 of 5 pages"])]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Images, the ids they are joined with, the documents and the counts.
    assert max(p.count("Exchange hashpartitioning") for p in plans) == 4 and not any("Union" in p for p in plans)
