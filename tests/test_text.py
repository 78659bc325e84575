import pytest
from pyspark.sql import functions as F

from docflow.functions import text as T

SCRIPTS = {
    "Hello world": "latin", "السلام عليكم": "arabic", "Привет мир": "cyrillic", "日本語テスト": "cjk", "नमस्ते": "devanagari", "": "unknown", "123 !!!": "unknown", "café résumé naïve": "latin", "Aſ ł ŋ": "latin", "Hello П": "latin",
    "При": "cyrillic", "Hi Пя": "latin", "Hi العربية": "arabic", "안녕하세요": "cjk", "こんにちは": "cjk", "A🎉B": "latin", "П": "unknown", "×÷": "unknown",
}


def test_scripts(spark):
    rows = spark.createDataFrame([(t,) for t in SCRIPTS], "t string").select("t", T.detect_script(F.col("t")).alias("s"))
    assert {r["t"]: r["s"] for r in rows.collect()} == SCRIPTS


def test_lengths_and_white_space(spark):
    text = "a  ﻿b🎉 c"
    row = spark.createDataFrame([(text,)], "t string").select(T.nonws_length(F.col("t")), T.utf16_length(F.col("t")), T.collapse(F.col("t")), T.trim(F.lit("　x y\n")), T.utf16_prefix(F.col("t"), 6)).first()
    assert tuple(row) == (4, len(text.encode("utf-16-le")) // 2, "a b🎉 c", "x y", "a  ﻿b")


@pytest.mark.parametrize("raw", [b"\xef\xbb\xbfh\xc3\xa9llo", b"ab\xff\xc3", b"", b"\xe4\xb8\x96"])
def test_decode_is_lenient(spark, raw):
    row = spark.createDataFrame([(bytearray(raw),)], "b binary").select(T.decode_utf8(F.col("b"))).first()
    assert row[0] == raw.decode("utf-8", "replace").removeprefix("﻿")


def test_language_plan(spark):
    cases = [("latin", ["latin", "cjk"], [], []), ("unknown", ["latin"], [], []), ("arabic", ["latin", "arabic"], [], []), ("arabic", ["latin", "cjk"], ["arabic"], ["cjk"]), ("cjk", ["latin"], ["cjk"], [])]
    rows = spark.createDataFrame([c[:2] for c in cases], "d string, c array<string>").select(T.language_plan(F.col("d"), F.col("c")).alias("p")).collect()
    assert [(r["p"]["load"], r["p"]["offload"]) for r in rows] == [c[2:] for c in cases]


def test_rec_model(spark):
    rows = spark.createDataFrame([(s,) for s in ("latin", "arabic", "cyrillic", "cjk", "devanagari", "other", "unknown")], "s string").select(T.script_to_rec_model(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["en", "ar", "ru", "zh", "hi", None, None]
