"""From page results to document records: joined text, provenance, counts and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, utf16_length, utf16_prefix

PAGES = "array<struct<index int, text string, source string>>"
MAX_CHARS, MAX_PAGES = 50_000, 20
#: Source of the text that an engine yields.
SOURCE = {"pdfjs-text": "native", "mammoth": "native", "xlsx": "native", "text": "native", "rapidocr": "ocr", "granite-docling": "ocr", "vlm": "vlm"}
STAGE = {"rapidocr": "rapidocr", "granite-docling": "granite", "vlm": "vlm"}
TEXT_ENGINES = ("pdfjs-text", "mammoth", "xlsx", "text")


#: Of pages_out: the one source of all pages, mixed, or none without pages; texts that are not empty, joined.
SOURCE_OF = "CASE WHEN size(pages_out) = 0 THEN 'none' WHEN size(array_distinct(pages_out.source)) = 1 THEN pages_out.source[0] ELSE 'mixed' END"
JOINED = r"array_join(filter(pages_out.text, t -> t <> ''), '\n\n')"


UNITS = "cast(octet_length(encode(text, 'UTF-16BE')) / 2 AS int)"


def meta(pages: str = "pages", code_points: bool = False) -> Column:
    """Counts of pages_out and text, the latter in UTF-16 units or ``code_points``; ``pages``: an expression of the profile's page count."""
    count = lambda source: f"size(filter(pages_out.source, s -> s = '{source}'))"
    return F.expr(f"""named_struct('pages_processed', size(pages_out), 'total_pages', CASE WHEN size(pages_out) > 0 THEN size(pages_out) WHEN {pages} > 0 THEN {pages} ELSE 1 END,
     'native_pages', {count("native")}, 'ocr_pages', {count("ocr")}, 'vlm_pages', {count("vlm")}, 'truncated', false, 'chars', {'length(text)' if code_points else UNITS})""")


def documents(rows: DataFrame, code_points: bool = False) -> DataFrame:
    """``rows`` (pages_out, pages) with text, source and meta."""
    out = bound(rows, text=F.expr(JOINED), source=F.expr(SOURCE_OF))
    return out.withColumn("meta", meta(code_points=code_points))


def limit_chars(rows: DataFrame, most: int = MAX_CHARS, code_points: bool = False) -> DataFrame:
    """Cuts text (not the pages) to ``most`` UTF-16 units or ``code_points``, with a warning and the counts to match. 0 or less cuts nothing."""
    if most <= 0:
        return rows
    prefix = F.substring("text", 1, most) if code_points else utf16_prefix(F.col("text"), most)
    over = F.col("meta.chars") > most
    note = f"concat('truncated_chars:', cast(meta.chars AS string), '_to_{most}')"
    counts = f"if(meta.chars > {most}, named_struct('pages_processed', meta.pages_processed, 'total_pages', meta.total_pages, 'native_pages', meta.native_pages, 'ocr_pages', meta.ocr_pages, 'vlm_pages', meta.vlm_pages, 'truncated', true, 'chars', {most}), meta)"
    return rows.select(*[c for c in rows.columns if c not in ("text", "warnings", "meta")], F.when(over, prefix).otherwise(F.col("text")).alias("text"), F.expr(f"if(meta.chars > {most}, array_append(warnings, {note}), warnings)").alias("warnings"), F.expr(counts).alias("meta"))


def from_page_table(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, text, source, counts) from a page table (key, index, text, source): one shuffle, by document."""
    count = lambda s: F.count_if(F.col("source") == s).cast("int").alias(f"{s}_pages")
    text = F.coalesce(F.expr("listagg(nullif(text, ''), '\n\n') within group (order by index)"), F.lit(""))
    same = F.min("source") == F.max("source")
    out = pages.groupBy(key).agg(text.alias("text"), F.when(same, F.min("source")).otherwise("mixed").alias("source"), F.count("*").cast("int").alias("pages_processed"), count("native"), count("ocr"), count("vlm"))
    return out.withColumn("total_pages", F.col("pages_processed")).withColumn("chars", utf16_length(F.col("text")))


def page_budget(pages: DataFrame, most: int = MAX_PAGES, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(the pages to render, a warning per document that was capped). 0 or less caps nothing."""
    totals = pages.groupBy(key).agg(F.count("*").alias("n"))
    note = F.concat(F.lit(f"page_budget: capped OCR/VLM at {most} of "), F.col("n").cast("string"), F.lit(" pages"))
    if most <= 0:
        return pages, totals.select(key, note.alias("warning")).limit(0)
    return pages.where(F.col("index") < most), totals.where(F.col("n") > most).select(key, note.alias("warning"))
