"""The whole pipeline: profile, route, execute, assemble, limit."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode_utf8
from ..operators.assemble import MAX_CHARS, MAX_PAGES, PAGES, documents, limit_chars
from ..operators.cascade import FLOOR, Engines, Slot, engine_label, execute, execute_text, plain_text, with_fallbacks
from ..operators.classify import MAX_BYTES, input_guard, profile
from ..operators.route import Capabilities, RouteOptions, with_route
from ..sources.files import csv_text, extract_docx, extract_xlsx, split_pages

COLUMNS = ["doc_id", "filename", "kind", "script", "source", "engine", "text", "pages_out", "warnings", "meta"]


def default_engines() -> Engines:
    """Text, CSV, Word and Excel. Page readers and PDF text are for the caller to wire."""
    return Engines({"text": plain_text(decode_utf8), "mammoth": extract_docx, "xlsx": extract_xlsx})


@dataclass
class ParseOptions:
    max_bytes: int = MAX_BYTES
    max_pages: int = MAX_PAGES
    max_chars: int = MAX_CHARS
    floor: int = FLOOR
    capabilities: Capabilities = Capabilities()
    route: RouteOptions = RouteOptions()
    engines: Engines = field(default_factory=default_engines)
    text_only: bool = False
    #: Characters of text_only plans are code points, not UTF-16 units.
    code_points: bool = False


def parse(docs: DataFrame, options: ParseOptions | None = None, pages: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """Document records (COLUMNS) of ``docs`` (doc_id, content, filename[, mime]).

    ``pages``: text layers of the PDFs (doc_id, index, text); ``images``: their renderings (doc_id, index, image).
    Empty and oversized inputs get a record with a warning; with max_bytes, floor and max_chars of 0 none is refused,
    missed or cut. ``docs`` may have a column ``declared``, a kind that is not sniffed. ``text_only`` promises that no page reader is
    wired and all extractors are expressions; the plan is then one projection.
    """
    if docs is None:
        raise ValueError("docs is required")
    o = options or ParseOptions()
    guarded = docs.withColumn("_guard", input_guard(F.octet_length("content"), o.max_bytes))
    refused = guarded.where("_guard is not null").select("doc_id", "filename", F.lit("other").alias("kind"), F.lit("unknown").alias("script"), F.lit(None).cast("string").alias("engine"), F.array().cast(PAGES).alias("pages_out"), F.array("_guard").alias("warnings"), F.lit(0).alias("pages"))
    refused = documents(refused).withColumn("meta", F.col("meta").withField("total_pages", F.lit(0)))
    routed = with_route(profile(guarded.where("_guard is null").drop("_guard"), pages, o.code_points), o.capabilities, o.route)
    engines = o.engines
    if pages is not None and "pdfjs-text" not in engines.extractors:
        layer = pages.groupBy("doc_id").agg(F.expr("listagg(text, '\n\n') within group (order by index)").alias("_layer"))
        routed = routed.join(layer, "doc_id", "left").withColumn("content", F.when(F.col("kind") == "pdf", F.coalesce("_layer", F.lit("")).cast("binary")).otherwise(F.col("content"))).drop("_layer")
        engines = Engines({**engines.extractors, "pdfjs-text": plain_text(lambda c: c.cast("string"))}, engines.readers)
    done = execute_text(routed, engines, o.floor, o.code_points) if o.text_only else execute(routed, engines, images, o.floor, o.max_pages)
    return limit_chars(done.select(*COLUMNS).unionByName(refused.select(*COLUMNS)), o.max_chars, o.code_points).select(*COLUMNS)


def parse_with_fallbacks(docs: DataFrame, slots: list[Slot], options: ParseOptions | None = None, reader: str | None = None, **tables) -> DataFrame:
    """The same after whole-document ``slots``, tried in order; engine is the slot's name or the route's label."""
    from ..functions.sniff import sniff

    sniffed = docs.withColumn("kind", sniff(F.col("content"), F.col("filename"))["kind"])
    hits, rest = with_fallbacks(sniffed, slots, code_points=options is not None and options.code_points)
    routed = parse(rest.drop("kind"), options, **tables).withColumn("engine", engine_label(F.col("source"), reader))
    return hits.withColumn("script", F.lit("unknown")).select(*COLUMNS).unionByName(routed)


__all__ = ["COLUMNS", "ParseOptions", "csv_text", "default_engines", "parse", "parse_with_fallbacks", "split_pages"]
