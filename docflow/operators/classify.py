"""Document profiles: kind, page count, scanned or digital, script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sniff as S
from ..functions import text as T

DIGITAL, SCANNED, PROBE_PAGES = 100, 10, 3
MAX_BYTES = 20 * 1024 * 1024


def kilobytes(n: Column) -> Column:
    return F.floor(n / 1024 + 0.5)


def input_guard(size: Column, max_bytes: int = MAX_BYTES) -> Column:
    """The warning of an input that is not parsed; null if it is. With ``max_bytes`` 0 or less every input is."""
    if max_bytes <= 0:
        return F.lit(None).cast("string")
    large = F.concat(F.lit("input_too_large:"), kilobytes(size).cast("string"), F.lit("KB_exceeds_"), kilobytes(F.lit(max_bytes)).cast("string"), F.lit("KB"))
    return F.when(size == 0, "empty_input").when(size > max_bytes, large)


def scanned(first: Column, digital: Column, scans: Column) -> Column:
    """Of the probed pages: the first page's length, how many are digital and how many scanned. True is scanned, null undecided."""
    return F.when(first >= DIGITAL, False).when(first < SCANNED, True).when(digital > scans, False).when(scans > digital, True)


def probe_pages(pages: DataFrame, key: str = "doc_id", probe: int = PROBE_PAGES) -> DataFrame:
    """Rows (key, pages, scanned, script) from a page table (key, index, text), reading the text of the first ``probe`` pages only."""
    probed, n = F.col("index") < probe, T.nonws_length(F.col("text"))
    tally = T.script_tally(F.when(probed, F.col("text")))
    rows = pages.select(key, "index", F.when(probed, n).alias("n"), tally.alias("t"))
    made = rows.groupBy(key).agg(
        F.count("*").cast("int").alias("pages"), F.max(F.when(F.col("index") == 0, F.col("n"))).alias("first"),
        F.count_if(F.col("n") >= DIGITAL).alias("digital"), F.count_if(F.col("n") < SCANNED).alias("scans"), *[F.sum(f"t.{s}").cast("int").alias(s) for s in T.SCRIPTS],
    )
    return made.select(key, "pages", scanned(F.col("first"), F.col("digital"), F.col("scans")).alias("scanned"), T.dominant_script(F.struct(*T.SCRIPTS)).alias("script"))


def profile(docs: DataFrame, pages: DataFrame | None = None, code_points: bool = False) -> DataFrame:
    """``docs`` (doc_id, content, filename[, mime, declared]) with kind, sniff_warnings, pages, scanned, script, bytes and note.

    ``declared`` is a kind that is known, so it is not sniffed; null where it is not. The script is told by the
    first 8192 bytes, or ``code_points``.

    ``pages`` is the page table of the PDFs among them. A PDF without a row there could not be opened: it
    has 0 pages, an undecided scan, an unknown script, and a note.
    """
    mime = F.col("mime") if "mime" in docs.columns else None
    sniffed = S.sniff(F.col("content"), F.col("filename"), mime)
    if "declared" in docs.columns:
        sniffed = F.when(F.col("declared").isNull(), sniffed).otherwise(F.struct(F.col("declared").alias("kind"), F.array().cast("array<string>").alias("warnings")))
    out = T.bound(docs, _sniffed=sniffed)
    pdf, texty = F.col("kind") == "pdf", F.col("kind").isin("text", "csv")
    sample = F.when(F.col("_sniffed.kind").isin("text", "csv"), (T.character_sample if code_points else T.utf8_sample)(F.col("content")))
    out = T.bound(out.select(*docs.columns, F.col("_sniffed.kind").alias("kind"), F.col("_sniffed.warnings").alias("sniff_warnings"), F.octet_length("content").alias("bytes"), sample.alias("_sample")), _tally=T.script_tally(F.col("_sample"))).drop("_sample")
    own = F.when(texty, T.dominant_script(F.col("_tally"))).otherwise("unknown")
    if pages is None:
        out = out.select("*", F.lit(None).cast("int").alias("_pages"), F.lit(None).cast("boolean").alias("_scanned"), F.lit(None).cast("string").alias("_script"))
    else:
        found = probe_pages(pages).select("doc_id", F.col("pages").alias("_pages"), F.col("scanned").alias("_scanned"), F.col("script").alias("_script"))
        out = out.join(found, "doc_id", "left")
    return out.select(
        "*", F.when(pdf, F.coalesce("_pages", F.lit(0))).otherwise(1).alias("pages"), F.when(pdf, F.col("_scanned")).alias("scanned"),
        F.when(pdf, F.coalesce("_script", F.lit("unknown"))).otherwise(own).alias("script"), F.when(pdf & F.col("_pages").isNull(), "pdfjs_unavailable").alias("note"),
    ).drop("_pages", "_scanned", "_script", "_tally")
