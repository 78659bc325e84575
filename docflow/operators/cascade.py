"""Execution of routes as a residual cascade.

A conditional expression does not keep a Python engine from running on rows that do not need it. So
each rank of the plan runs on what the ranks before it left: documents whose strategy there is a
given engine go through that engine's sub-plan; those with enough text are done, the rest carry
their warnings on. What a rank made is read twice, by both continuations, so it is written once,
without the documents' content.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, nonws_length, trim, utf16_length
from .assemble import MAX_PAGES, PAGES, SOURCE, TEXT_ENGINES, documents

FLOOR, DEPTH = 3, 4
RESULT = "struct<text string, error string>"


@dataclass(frozen=True)
class Engine:
    """A page reader. ``recognize``: image column to struct<text, error[, confidence]>; an error is a failed page."""

    name: str
    recognize: Callable[[Column], Column] | None = None
    available: bool = True


NONE = Engine("none", available=False)


@dataclass
class Engines:
    """What is wired. extractors: content column to struct<text, error>, by engine tag; readers: page engines, by tag."""

    extractors: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    readers: dict[str, Engine] = field(default_factory=dict)


def plain_text(decode: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """An extractor that cannot fail."""
    return lambda content: F.struct(decode(content).alias("text"), F.lit(None).cast("string").alias("error"))


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its plan, in the folder of spark.checkpoint.dir. Only a local master without one gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="docflow-"))
    return df.checkpoint()


def _few(df: DataFrame, most: int = 1 << 18) -> DataFrame:
    """``df``, marked for broadcast only if it was counted and has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _missed(part: DataFrame, note: Column) -> DataFrame:
    return part.drop("content").select("*", F.array().cast(PAGES).alias("pages_out"), F.lit(0).alias("chars"), F.array(note).alias("notes"))


def _by_extractor(part: DataFrame, tag: str, extract: Callable[[Column], Column] | None, floor: int) -> DataFrame:
    if extract is None:
        return _missed(part, F.lit(f"{tag}: no extractor wired, skipping"))
    rows = bound(part, _got=extract(F.col("content"))).drop("content")
    rows = bound(rows, _n=nonws_length(F.coalesce("_got.text", F.lit(""))))
    text, n = F.coalesce("_got.text", F.lit("")), F.col("_n")
    page = F.array(F.struct(F.lit(0).alias("index"), trim(text).alias("text"), F.lit(SOURCE[tag]).alias("source"))).cast(PAGES)
    failed = F.concat(F.lit(f"{tag} extractor failed: "), F.col("_got.error"))
    short = F.concat(F.lit(f"{tag}: only "), n.cast("string"), F.lit(" non-ws chars, falling through"))
    notes = F.when(F.col("_got.error").isNotNull(), F.array(failed)).when(n < floor, F.array(short)).otherwise(F.array().cast("array<string>"))
    got = F.col("_got.error").isNull() & (n >= floor)
    return rows.select("*", F.when(got, page).otherwise(F.array().cast(PAGES)).alias("pages_out"), F.when(got, n).otherwise(0).alias("chars"), notes.alias("notes")).drop("_got", "_n")


def _by_reader(part: DataFrame, tag: str, reader: Engine | None, images: DataFrame | None, floor: int, max_pages: int, kinds: set[bool]) -> DataFrame:
    """``kinds``: whether there are PDFs (True), others (False) or both in ``part``."""
    if reader is None:
        return _missed(part, F.lit(f"{tag}: engine not wired, skipping"))
    if not reader.available or reader.recognize is None:
        return _missed(part, F.lit(f"{reader.name}: unavailable in this runtime, skipping"))
    whole = part.where("kind <> 'pdf'").select("doc_id", F.lit(0).alias("index"), F.col("content").alias("image"))
    pages = whole
    capped = None
    if images is not None and True in kinds:
        # Only images of the documents that are left are read, and the budget cuts pages before any is moved or
        # recognised. While the documents are few no image is shuffled; else once, by document, and what is read off it
        # stays there: a union would undo that, so there is none without need.
        first = images.where(F.col("index") < max_pages) if max_pages > 0 else images
        own = first.join(_few(part.where("kind = 'pdf'").select("doc_id")), "doc_id", "left_semi").select("doc_id", "index", "image")
        pages = whole.union(own) if False in kinds else own
        # Counts need no images, so they are not taken from the joined ones.
        capped = images.groupBy("doc_id").agg(F.count("*").alias("_all"))
    read = bound(pages, _got=reader.recognize(F.col("image"))).drop("image")
    failed = F.when(F.col("_got.error").isNotNull(), F.concat(F.lit(f"{reader.name}: page "), F.col("index").cast("string"), F.lit(" failed ("), F.col("_got.error"), F.lit(")")))
    text = F.when(F.col("_got.error").isNull(), trim(F.coalesce("_got.text", F.lit("")))).otherwise("")
    done = read.select("doc_id", F.struct(F.col("index").cast("int").alias("index"), text.alias("text"), F.lit(SOURCE[tag]).alias("source")).alias("page"), failed.alias("failed"))
    byd = done.groupBy("doc_id").agg(F.sort_array(F.collect_list("page")).alias("_pages"), F.transform(F.sort_array(F.collect_list(F.struct(F.col("page.index").alias("i"), "failed"))), lambda x: x["failed"]).alias("_failed"))
    part = part.drop("content")
    rows = part.join(byd, "doc_id", "left")
    if capped is not None:
        rows = rows.join(capped, "doc_id", "left")
    else:
        rows = rows.withColumn("_all", F.lit(None).cast("long"))
    found = F.coalesce("_pages", F.array().cast(PAGES))
    rows = bound(rows, _n=F.aggregate(found, F.lit(0), lambda a, p: a + nonws_length(p["text"])))
    n = F.col("_n")
    no_pages = (F.col("kind") == "pdf") & F.col("_all").isNull()
    budget = F.when((F.lit(max_pages) > 0) & (F.col("_all") > max_pages), F.concat(F.lit(f"page_budget: capped OCR/VLM at {max_pages} of "), F.col("_all").cast("string"), F.lit(" pages")))
    short = F.when(n < floor, F.concat(F.lit(f"{reader.name}: "), n.cast("string"), F.lit(" non-ws chars across "), F.size(found).cast("string"), F.lit(" page(s), falling through")))
    render = F.lit(f"{tag}: render failed (pdf OCR requires a raster adapter), skipping")
    notes = F.when(no_pages, F.array(render)).otherwise(F.array_compact(F.concat(F.array(budget), F.coalesce("_failed", F.array().cast("array<string>")), F.array(short))))
    return rows.select(*part.columns, F.when(n >= floor, found).otherwise(F.array().cast(PAGES)).alias("pages_out"), n.alias("chars"), notes.alias("notes"))


def execute(routed: DataFrame, engines: Engines, images: DataFrame | None = None, floor: int = FLOOR, max_pages: int = MAX_PAGES, keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """``routed`` (doc_id, content, kind, pages, strategies) without content, with engine, pages_out, text, source, meta and warnings.

    ``images``: page images (doc_id, index, image) of the PDFs. doc_id is unique. engine is null where nothing
    yielded text. Ranks run one after the other, each engine once on the documents that reach it; only sub-plans
    of engines that some document wants at that rank are built. What is kept between ranks has no content:
    a rank reads the content of its own documents again.
    """
    columns = [c for c in routed.columns if c != "content"]
    step = lambda rank: F.get("strategies", F.lit(rank))["engine"]
    none = F.array().cast("array<string>")
    todo = keep(routed.select(*columns, none.alias("warnings")))
    ended = []
    for rank in range(DEPTH):
        ended.append(todo.where(step(rank).isNull()).select(*columns, "warnings", F.lit(None).cast("string").alias("engine"), F.array().cast(PAGES).alias("pages_out")))
        # At most two values per engine of the routing table.
        wanted: dict[str, set[bool]] = {}
        for r in todo.select(step(rank).alias("e"), F.coalesce(F.col("kind") == "pdf", F.lit(False)).alias("pdf")).where("e is not null").distinct().collect():
            wanted.setdefault(r["e"], set()).add(r["pdf"])
        tried = None
        for tag in (t for t in SOURCE if t in wanted):
            # At first every document is there, so the source is filtered; later the few that are left are joined with it.
            part = routed.withColumn("warnings", none).where(step(0) == tag) if rank == 0 else routed.select("doc_id", "content").join(_few(todo.where(step(rank) == tag)), "doc_id").select(*routed.columns, "warnings")
            made = _by_extractor(part, tag, engines.extractors.get(tag), floor) if tag in TEXT_ENGINES else _by_reader(part, tag, engines.readers.get(tag), images, floor, max_pages, wanted[tag])
            made = made.select(*columns, F.concat("warnings", "notes").alias("warnings"), F.lit(tag).alias("engine"), "pages_out", "chars")
            tried = made if tried is None else tried.unionByName(made)
        if tried is None:
            todo = todo.limit(0)
            break
        tried = keep(tried)
        ended.append(tried.where(F.col("chars") >= floor).select(*columns, "warnings", "engine", "pages_out"))
        todo = tried.where(F.col("chars") < floor).select(*columns, "warnings")
    ended.append(todo.select(*columns, "warnings", F.lit(None).cast("string").alias("engine"), F.array().cast(PAGES).alias("pages_out")))
    out = ended[0]
    for rows in ended[1:]:
        out = out.unionByName(rows)
    return documents(out)


def execute_text(routed: DataFrame, engines: Engines, floor: int = FLOOR, code_points: bool = False) -> DataFrame:
    """The same where every strategy is a text engine whose extractor is an expression: one projection, nothing is kept or shuffled."""
    tag = F.expr("strategies[0].engine")
    got = F
    for name, extract in engines.extractors.items():
        got = got.when(tag == name, extract(F.col("content"))["text"])
    rows = bound(routed, _text=F.coalesce(got.otherwise(F.lit(None).cast("string")), F.lit(""))).drop("content")
    rows = bound(rows, _n=nonws_length(F.col("_text")), _trimmed=trim(F.col("_text"))).drop("_text").withColumn("_ok", F.col("_n") >= floor)
    wired = ", ".join(f"'{name}'" for name in engines.extractors) or "null"
    texts = ", ".join(f"'{name}'" for name in TEXT_ENGINES)
    e = "strategies[0].engine"
    note = f"concat({e}, CASE WHEN {e} IN ({wired}) THEN concat(': only ', cast(_n AS string), ' non-ws chars, falling through') WHEN {e} IN ({texts}) THEN ': no extractor wired, skipping' ELSE ': engine not wired, skipping' END)"
    return documents(rows.select(
        *[c for c in routed.columns if c != "content"], F.expr(f"if(_ok, {e}, cast(null AS string))").alias("engine"),
        F.expr("if(_ok, array(named_struct('index', 0, 'text', _trimmed, 'source', 'native')), array())").cast(PAGES).alias("pages_out"),
        F.expr(f"if(_ok, cast(array() AS array<string>), array({note}))").alias("warnings"),
    ), code_points)


@dataclass(frozen=True)
class Slot:
    """A whole-document reader that is tried before the route; ``when``: a condition over the row."""

    name: str
    read: Callable[[Column], Column]
    when: Column | None = None


def with_fallbacks(docs: DataFrame, slots: list[Slot], adequate: int = 3, keep: Callable[[DataFrame], DataFrame] = kept, code_points: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents that a slot read: with engine, pages_out, text, source, meta; documents left for the route). Slot errors fall through silently."""
    todo, done = docs, None
    for slot in slots:
        gate = F.lit(True) if slot.when is None else F.coalesce(slot.when, F.lit(False))
        tried = keep(todo.where(gate).withColumn("_got", slot.read(F.col("content"))))
        text = F.coalesce("_got.text", F.lit(""))
        good = F.coalesce(F.col("_got.error").isNull() & (utf16_length(trim(text)) >= adequate), F.lit(False))
        page = F.array(F.struct(F.lit(0).alias("index"), text.alias("text"), F.lit("ocr").alias("source"))).cast(PAGES)
        hit = tried.where(good).select(*docs.columns, F.lit(slot.name).alias("engine"), page.alias("pages_out"), F.array().cast("array<string>").alias("warnings"), F.lit(1).alias("pages"))
        done = hit if done is None else done.unionByName(hit)
        todo = todo.where(~gate).unionByName(tried.where(~good).select(*docs.columns))
    return (documents(done, code_points) if done is not None else documents(docs.limit(0).select("*", F.lit("").alias("engine"), F.array().cast(PAGES).alias("pages_out"), F.array().cast("array<string>").alias("warnings"), F.lit(1).alias("pages")))), todo


def engine_label(source: Column, reader: str | None = None) -> Column:
    """The label of a routed result: its source, or the injected reader's name for OCR, whichever tier read it."""
    return F.when(source == "ocr", reader or "ocr").otherwise(source)
