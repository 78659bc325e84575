"""Mixing sources to target weights by iterative proportional fitting.

Documents are first summed into cells (source, language, topic); the fitting runs on cells only. One
step scales a cell by target / current total of its marginal; a sweep does this for each of the three
marginals. A document is then kept with its cell's weight divided by the largest weight, so that
expected token totals have the fitted marginals exactly. If the sweeps end before the targets are met, a
warning says by how much; the cell that sets the scale is logged; the draw is a hash of doc_id and seed,
so it is the same in any run, partitioning or engine.

Defined results: a null source or language is its own class ``(none)``; texts without words have no
tokens, take their cell's probability (1 where the cell has no tokens), and weigh nothing; rows that
repeat a doc_id draw alike; an empty table gives an empty table; other columns pass through or are ignored.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, small

LOG = logging.getLogger(__name__)
DIMENSIONS = ("source", "lang", "topic")
#: Default targets: each marginal's token share to this power, normalised.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.5}
SWEEPS, SEED = 8, "mix-1"
#: The stand-in where a table has no topic column: the form that a text's length suggests.
FORMS = (("note", 150), ("article", 600), ("essay", 2000))


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_by_length(tokens: Column) -> Column:
    out = F
    for name, most in FORMS:
        out = out.when(tokens < most, name)
    return out.otherwise("book")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) with 52 bits of md5; a null id draws as the empty text."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Rows (dimension, target): token shares to ``power``, normalised over the classes."""
    totals = cells.where("mass > 0").groupBy(dimension).agg(F.pow(F.sum("mass").cast("double"), F.lit(power)).alias("t"))
    whole = totals.agg(F.sum("t").alias("whole"))
    return totals.join(F.broadcast(whole)).select(dimension, (F.col("t") / F.col("whole")).alias("target"))


def fit(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch, sweeps: int = SWEEPS, tolerance: float = 1e-9, broadcast_cells: int = 1 << 16) -> DataFrame:
    """``cells`` (the dimensions, mass) with ``weight``. Ends after ``sweeps`` or once no factor of a sweep is off 1 by more than ``tolerance``.

    Classes without a target keep their weight; a class with a target and no mass is left out. Cells that are
    counted to be few go into one partition, where class totals are windows: a sweep is one stage whose plan has its
    input once. Joined totals, as for more cells, have it eight times, and each join a broadcast in the driver.
    """
    start = cells
    for name, target in targets.items():
        start = start.join(target.select(name, F.col("target").alias(f"target_{name}")), name, "left")
    now = scratch.keep(start.withColumn("weight", F.lit(1.0)).withColumn("off", F.lit(0.0)), "cells")
    few = now.limit(broadcast_cells + 1).count() <= broadcast_cells
    for _ in range(sweeps):
        step = (now.coalesce(1) if few else now).withColumn("off", F.lit(0.0))
        for name in targets:
            total = F.sum(F.col("mass") * F.col("weight"))
            if few:
                step = step.where(F.col(name).isNotNull()).withColumn("total", total.over(Window.partitionBy(name)))
            else:
                step = step.join(step.groupBy(name).agg(total.alias("total")), name)
            factor = F.coalesce(F.when(F.col("total") > 0, F.col(f"target_{name}") / F.nullif("total", F.lit(0.0))), F.lit(1.0))
            step = step.withColumn("factor", factor).withColumn("off", F.greatest("off", F.abs(F.col("factor") - 1))).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor", "total")
        new = scratch.keep(step, "cells")
        scratch.drop(now)
        now = new
        off = now.agg(F.max("off")).first()[0] or 0.0
        if off <= tolerance:
            break
    else:
        LOG.warning("marginals not met: after %d sweeps a factor is off 1 by up to %.3g, tolerance %.3g", sweeps, off if sweeps else 0.0, tolerance)
    return now.select(*cells.columns, "weight")


def _celled(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` of ``docs`` with n_tokens and the cell (source, lang, topic) of each row."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in ("source", "lang")]
    rows = docs.select(*columns, *named, *([F.col("topic")] if "topic" in docs.columns else []), n_tokens(F.col("text")).alias("n_tokens"))
    return rows.withColumn("topic", F.coalesce(F.col("topic").cast("string"), F.lit("(none)")) if "topic" in docs.columns else topic_by_length(F.col("n_tokens")))


def _odds(rows: DataFrame, power: dict[str, float] | None, targets: dict[str, DataFrame] | None, sweeps: int, broadcast_cells: int, scratch: Scratch) -> DataFrame:
    """Rows (source, lang, topic, probability) for the cells of ``rows``."""
    cells = scratch.keep(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("mass")), "masses")
    whole = cells.agg(F.sum("mass").cast("double").alias("whole"))
    power = TEMPER | (power or {})
    targets = {d: (targets or {}).get(d, tempered(cells, d, power[d])) for d in DIMENSIONS}
    shares = cells.join(F.broadcast(whole)).select(*DIMENSIONS, F.coalesce(F.col("mass") / F.nullif("whole", F.lit(0.0)), F.lit(0.0)).alias("mass"))
    fitted = fit(shares, targets, scratch, sweeps, broadcast_cells=broadcast_cells)
    scale = fitted.where("mass > 0").agg(F.max(F.struct("weight", *DIMENSIONS, "mass")).alias("s"), F.sum(F.col("mass") * F.col("weight")).alias("t")).first()
    if scale["s"]:
        LOG.info("cell %s with %.3g of the tokens sets the scale: %.3g of all tokens are kept", tuple(scale["s"][d] for d in DIMENSIONS), scale["s"]["mass"], scale["t"] / scale["s"]["weight"])
    most = F.lit(scale["s"]["weight"] if scale["s"] else None).cast("double")
    odds = fitted.select(*DIMENSIONS, F.when(F.col("mass") > 0, F.round(F.col("weight") / most, 9)).otherwise(F.lit(1.0)).alias("probability"))
    return small(scratch.keep(odds, "odds"), broadcast_cells)


def mix(docs: DataFrame, power: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS, seed: str = SEED, broadcast_cells: int = 1 << 16) -> DataFrame:
    """Rows (doc_id, source, lang, topic, n_tokens, probability, sampled) for every row of ``docs`` (doc_id, text, lang, source[, topic]).

    ``targets`` gives (class, target) tables by dimension, whose targets add to 1 each; by default
    shares are tempered. probability is rounded to 9 places, and compared with the draw as rounded.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep(_celled(docs, "doc_id"), "rows")
    out = rows.join(_odds(rows, power, targets, sweeps, broadcast_cells, scratch), list(DIMENSIONS))
    return out.select("doc_id", *DIMENSIONS, "n_tokens", "probability", (uniform(F.col("doc_id"), seed) < F.col("probability")).alias("sampled"))


def drawn(docs: DataFrame, seed: str = SEED, broadcast_cells: int = 1 << 16) -> DataFrame:
    """The rows of ``docs`` that ``mix`` samples, whole. A row without an id draws by its text, so such rows are not all kept or lost at once."""
    scratch = Scratch(docs.sparkSession, "mixing")
    odds = _odds(scratch.keep(_celled(docs), "rows"), None, None, SWEEPS, broadcast_cells, scratch)
    name = F.coalesce(F.col("row.doc_id").cast("string"), F.md5(F.col("row.text").cast("binary")))
    out = _celled(docs, F.struct(*docs.columns).alias("row")).join(odds, list(DIMENSIONS))
    return out.where(uniform(name, seed) < F.col("probability")).select("row.*")


def oracle(documents: str = "documents", sweeps: int = SWEEPS, select: str = "doc_id, source, lang, topic, n_tokens, probability, sampled") -> str:
    """The same as DuckDB SQL, over a table of that name."""
    forms = " ".join(f"WHEN n_tokens < {most} THEN '{name}'" for name, most in FORMS)
    parts = [
        f"r0 AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM {documents})",
        f"r AS (SELECT *, CASE {forms} ELSE 'book' END AS topic FROM r0)",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS mass FROM r GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        parts.append(f"g_{d} AS (SELECT {d}, pow(sum(mass), {TEMPER[d]}) AS t FROM c WHERE mass > 0 GROUP BY {d})")
        parts.append(f"t_{d} AS (SELECT {d}, t / (SELECT sum(t) FROM g_{d}) AS target FROM g_{d})")
    parts.append("w0 AS (SELECT source, lang, topic, mass / nullif((SELECT sum(mass) FROM c), 0) AS mass, 1.0::DOUBLE AS weight FROM c)")
    last = "w0"
    for k in range(sweeps):
        for d in DIMENSIONS:
            name = f"w{k + 1}_{d}"
            parts.append(f"{name} AS MATERIALIZED (SELECT x.source, x.lang, x.topic, mass, weight * coalesce(target / nullif(sum(mass * weight) OVER (PARTITION BY x.{d}), 0), 1) AS weight FROM {last} x LEFT JOIN t_{d} USING ({d}))")
            last = name
    parts.append(f"o AS (SELECT source, lang, topic, CASE WHEN mass > 0 THEN round(weight / (SELECT max(weight) FROM {last} WHERE mass > 0), 9) ELSE 1.0 END AS probability FROM {last})")
    draw = f"('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"
    return f"WITH {', '.join(parts)} SELECT {select} FROM (SELECT r.*, probability, {draw} < probability AS sampled FROM r JOIN o USING (source, lang, topic))"
