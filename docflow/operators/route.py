"""The routing table: which engines to try for a document, in which order and where."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound

STRATEGY = "array<struct<engine string, location string, script string, reason string>>"


@dataclass(frozen=True)
class RouteOptions:
    webgpu_pages: int = 10
    wasm_pages: int = 3
    digital_pages: int = 10
    vlm: bool = False


@dataclass(frozen=True)
class Capabilities:
    runtime: str = "node"
    has_webgpu: bool = False
    metered: bool = False
    available_scripts: tuple[str, ...] = ("latin",)
    storage_persisted: bool = False


def capabilities(overrides: dict | None = None, detected: Capabilities | None = None) -> Capabilities:
    """Overrides win wherever they are given, also with False."""
    base = detected or Capabilities()
    return Capabilities(**{k: v if (v := (overrides or {}).get(k)) is not None else getattr(base, k) for k in Capabilities.__dataclass_fields__})


def _step(engine: str, location: str, reason: str, script: str = "cast(null AS string)") -> str:
    return f"named_struct('engine', '{engine}', 'location', {location}, 'script', {script}, 'reason', '{reason}')"


def route(kind: str = "kind", pages: str = "pages", scanned: str = "scanned", script: str = "script", runtime: str = "runtime", has_webgpu: str = "has_webgpu", available_scripts: str = "available_scripts", options: RouteOptions = RouteOptions(), vlm: str | None = None) -> Column:
    """array<struct<engine, location, script, reason>> over SQL expressions of a profile. A PDF of 0 pages is planned as if on a server."""
    vlm = str(options.vlm).lower() if vlm is None else vlm
    local = f"({runtime} = 'browser')"
    here = f"if({local}, 'browser', 'edge')"
    opened = f"({local} AND NOT ({kind} = 'pdf' AND {pages} = 0))"
    readable = f"({script} IN ('latin', 'unknown') OR array_contains({available_scripts}, {script}))"
    ocr_here = f"if({opened} AND {pages} <= if({has_webgpu}, {options.webgpu_pages}, {options.wasm_pages}) AND {readable}, 'browser', 'edge')"
    docling_here = f"if({opened} AND {has_webgpu} AND {pages} <= {options.webgpu_pages}, 'browser', 'edge')"
    digital_here = f"if({local} AND {pages} <= {options.digital_pages}, 'browser', 'edge')"
    first = _step("rapidocr", ocr_here, "OCR of page images", f"if({script} = 'unknown', 'latin', {script})")
    second = _step("granite-docling", docling_here, "layout-aware reading where OCR found too little")
    last = _step("vlm", "'edge'", "vision model where all else found too little")
    chain = f"if({vlm}, array({first}, {second}, {last}), array({first}, {second}))"
    native = lambda reason: _step("pdfjs-text", digital_here, reason)
    plan = f"""CASE
     WHEN {kind} = 'docx' THEN array({_step("mammoth", here, "paragraphs of a Word container")})
     WHEN {kind} IN ('xlsx', 'csv') THEN array({_step("xlsx", here, "cells of a table as CSV")})
     WHEN {kind} = 'text' THEN array({_step("text", here, "text as it is")})
     WHEN {kind} = 'image' THEN {chain}
     WHEN {kind} = 'pdf' AND NOT {scanned} THEN array({native("the pages have a text layer")})
     WHEN {kind} = 'pdf' AND {scanned} IS NULL AND {pages} > 0 THEN concat(array({native("the text layer may do")}), {chain})
     WHEN {kind} = 'pdf' THEN {chain}
     WHEN {vlm} THEN array({_step("vlm", "'edge'", "unknown kind, as an image")})
     ELSE array({_step("text", here, "unknown kind, as text")}) END"""
    return F.expr(plan).cast(STRATEGY)


def summary(kind: Column, pages: Column, script: Column, strategies: Column) -> Column:
    """One line: what the document is, then its engines in order."""
    head = F.concat(kind, F.when(pages > 1, F.concat(F.lit(", "), pages.cast("string"), F.lit("p"))).otherwise(""), F.when(script != "unknown", F.concat(F.lit(", "), script)).otherwise(""))
    steps = F.transform(strategies, lambda s: F.concat(F.when(s["location"] == "edge", "edge ").otherwise(""), s["engine"]))
    return F.concat(head, F.lit(" → "), F.array_join(steps, " → "))


def with_route(profiles: DataFrame, caps: Capabilities = Capabilities(), options: RouteOptions = RouteOptions()) -> DataFrame:
    """``profiles`` (kind, pages, scanned, script) with strategies and reason. Capabilities and options are literals, so dead branches fold away."""
    c = F.col
    scripts = "cast(array({}) AS array<string>)".format(", ".join(f"'{s}'" for s in caps.available_scripts))
    planned = bound(profiles, strategies=route(runtime=f"'{caps.runtime}'", has_webgpu=str(caps.has_webgpu).lower(), available_scripts=scripts, options=options))
    return planned.withColumn("reason", summary(c("kind"), c("pages"), c("script"), c("strategies")))


def ranked(routed: DataFrame) -> DataFrame:
    """A row per strategy: (…, rank, engine, location, script, reason)."""
    keep = [x for x in routed.columns if x not in ("strategies", "reason", "script")]
    return routed.select(*keep, F.posexplode("strategies").alias("rank", "_step")).select(*keep, "rank", "_step.*")
