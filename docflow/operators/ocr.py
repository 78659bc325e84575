"""What surrounds an OCR model: probability maps to boxes, decoding, confidence and reading order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import geometry as G
from ..functions.text import JSWS, utf16_length


@dataclass(frozen=True)
class DBParams:
    threshold: float = 0.3
    box_threshold: float = 0.6
    unclip_ratio: float = 1.5
    max_candidates: int = 1000
    min_box: int = 3


MIN_SIDE, BOX_CONFIDENCE, DOC_CONFIDENCE, LINE_GAP = 6, 0.60, 0.90, 5
DET_SIDE, REC_HEIGHT, REC_WIDTH = 736, 48, 2048
#: Bytes of the input tables for a task that sorts boxes; a size that Spark does not know is larger than any.
SORT_BYTES, UNKNOWN_BYTES = 2 << 20, 1 << 60
BOXES = "array<struct<points array<array<double>>, score double>>"


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


# --- detection -----------------------------------------------------------------------------------


def is_logits(values: Column) -> Column:
    return (F.array_max(values) > 1.5) | (F.array_min(values) < -0.5)


def probabilities(values: Column) -> Column:
    """The map as probabilities: a sigmoid where it holds logits."""
    return F.when(is_logits(values), F.transform(values, lambda v: 1 / (1 + F.exp(-v.cast("double"))))).otherwise(F.transform(values, lambda v: v.cast("double")))


def binarize(values: Column, threshold: float | Column = 0.3) -> Column:
    """1 where a value is over the threshold, a number or a map."""
    if isinstance(threshold, Column):
        return F.zip_with(values, threshold, lambda v, t: (v > t).cast("int"))
    return F.transform(values, lambda v: (v > threshold).cast("int"))


def map_stats(values: Column) -> Column:
    """struct<low, high, mean, over30, over50>; the shares in percent."""
    n = F.size(values)
    share = lambda t: 100.0 * F.size(F.filter(values, lambda v: v > t)) / n
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.struct(F.array_min(values).cast("double").alias("low"), F.array_max(values).cast("double").alias("high"), (total / n).alias("mean"), share(0.3).alias("over30"), share(0.5).alias("over50"))


def label_components(binary: np.ndarray) -> np.ndarray:
    """4-connected components of a 0/1 map: each pixel's label is its component's first index in raster order, -1 outside."""
    h, w = binary.shape
    far = h * w
    label = np.where(binary > 0, np.arange(far).reshape(h, w), far)
    while True:
        padded = np.pad(label, 1, constant_values=far)
        near = np.minimum.reduce([padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:], label])
        new = np.where(binary > 0, near, far)
        # Jump to the label of one's label, so long shapes settle in few rounds.
        flat = np.append(new.ravel(), far)
        new = np.where(binary > 0, np.minimum(new, flat[new]), far)
        if (new == label).all():
            return np.where(label < far, label, -1)
        label = new


def text_boxes(values: np.ndarray, height: int, width: int, channels: int = 1, params: DBParams = DBParams(), ratio_w: float = 1.0, ratio_h: float = 1.0) -> list[tuple[np.ndarray, float]]:
    """(corners, score) of the text boxes of a probability map, best first, equals in scan order."""
    prob = np.asarray(values, np.float32)[: height * width]
    if prob.size and (prob.max() > 1.5 or prob.min() < -0.5):
        prob = (1 / (1 + np.exp(-prob.astype(np.float64)))).astype(np.float32)
    prob = prob.reshape(height, width)
    cutoff = np.asarray(values, np.float32)[height * width : 2 * height * width].reshape(height, width) if channels >= 2 else params.threshold
    labels = label_components((prob > cutoff).astype(int))
    seeds = np.unique(labels[(labels >= 0) & (prob >= params.threshold)])
    # A component is seeded by its first pixel that is likely enough, so components come in that order.
    first = sorted((int(np.flatnonzero((labels.ravel() == k) & (prob.ravel() >= params.threshold))[0]), int(k)) for k in seeds)
    out: list[tuple[np.ndarray, float]] = []
    limit = np.floor(np.array([width * ratio_w, height * ratio_h]) + 0.5)
    for _, k in first:
        if len(out) >= params.max_candidates:
            break
        y, x = np.nonzero(labels == k)
        hull = G.convex_hull(np.stack([x, y], 1))
        if len(hull) < 4:
            continue
        box, side = G.mini_box(hull)
        if side < params.min_box:
            continue
        score = G.box_score(prob, box)
        if score < params.box_threshold:
            continue
        box, side = G.mini_box(G.unclip(box, params.unclip_ratio))
        if side < params.min_box + 2:
            continue
        out.append((np.clip(np.floor(box * [ratio_w, ratio_h] + 0.5), 0, limit), score))
    return sorted(out, key=lambda b: -b[1])


def db_postprocess(params: DBParams = DBParams()):
    """A vectorised function (map, height, width, channels, ratio_w, ratio_h) to an array of boxes."""

    @pandas_udf(BOXES)
    def boxes(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"points": p.tolist(), "score": s} for p, s in text_boxes(np.asarray(v), h, w, c, params, rw, rh)] for v, h, w, c, rw, rh in zip(*batch, strict=True)])

    return boxes


def unclip_distances(ratio: float = 1.5):
    """A vectorised function of quads (flat x, y pairs): how far their sides move outwards."""

    @pandas_udf("double")
    def distances(quads: pd.Series) -> pd.Series:
        return quads.map(lambda q: G.unclip_distance(np.asarray(q, float).reshape(-1, 2), ratio))

    return distances


def component_labels(threshold: float):
    """A vectorised function (map, height, width) to an array of component labels."""

    @pandas_udf("array<int>")
    def labels(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([label_components((np.asarray(v).reshape(h, w) > threshold).astype(int)).ravel().tolist() for v, h, w in zip(*batch, strict=True)])

    return labels


def top_boxes(boxes: DataFrame, k: int = 1000, key: str = "page_id") -> DataFrame:
    """The ``k`` best boxes (key, ord, score) of each page; equals by ord."""
    best = Window.partitionBy(key).orderBy(F.desc("score"), "ord")
    return boxes.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def scaled(x: Column, ratio: Column, limit: Column) -> Column:
    return F.least(F.greatest(js_round(x * ratio), F.lit(0)), limit)


def det_size(width: Column, height: Column, side: int = DET_SIDE) -> Column:
    """struct<w, h, ratio_w, ratio_h> of the detector's input: fitted into a square, then to multiples of 32."""
    ratio = F.least(side / width, side / height)
    snap = lambda x: F.greatest(js_round(js_round(x * ratio) / 32.0) * 32, F.lit(32)).cast("int")
    return F.struct(snap(width).alias("w"), snap(height).alias("h"), (width / snap(width)).alias("ratio_w"), (height / snap(height)).alias("ratio_h"))


def rec_width(width: Column, height: Column) -> Column:
    return F.least(F.greatest(js_round(REC_HEIGHT * width / height), F.lit(1)), F.lit(REC_WIDTH)).cast("int")


def bounds(points: Column) -> Column:
    """struct<left, top, width, height> around a polygon."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), (F.array_max(xs) - F.array_min(xs)).alias("width"), (F.array_max(ys) - F.array_min(ys)).alias("height"))


# --- recognition ---------------------------------------------------------------------------------


def ctc_decode(rows: DataFrame, classes: int, dictionary: list[str], key: str = "id", values: str = "logits") -> DataFrame:
    """Rows (key, text, confidence) from flat step-by-class arrays.

    A step's label is its first greatest class. A label counts unless it is blank (0) or the step before had
    it. The last class is a space, 1..N the dictionary, others nothing. Everything happens inside the row.
    """
    v, n = F.col(values), F.lit(classes)
    steps = F.transform(F.sequence(F.lit(0), (F.size(v) / n).cast("int") - 1), lambda t: F.slice(v, (t * n + 1).cast("int"), n))
    best = F.transform(steps, lambda s: F.struct((F.array_position(s, F.array_max(s)) - 1).cast("int").alias("label"), F.array_max(s).cast("double").alias("p")))
    letters = F.array(*[F.lit(c) for c in dictionary]).cast("array<string>")
    spelled = F.transform(
        F.col("best"),
        lambda b, t: F.struct(
            F.when((b["label"] == 0) | ((t > 0) & (b["label"] == F.get("best", t - 1)["label"])), None).when(b["label"] == classes - 1, " ").otherwise(F.get(letters, b["label"] - 1)).alias("c"), b["p"].alias("p")
        ),
    )
    said = F.filter(spelled, lambda x: x["c"].isNotNull())
    return rows.select(key, best.alias("best")).select(key, said.alias("said")).select(
        key, F.array_join(F.transform("said", lambda x: x["c"]), "").alias("text"), F.when(F.size("said") > 0, F.aggregate("said", F.lit(0.0), lambda a, x: a + x["p"]) / F.size("said")).otherwise(0.0).alias("confidence")
    )


def tall_enough(width: Column, height: Column, least: int = MIN_SIDE) -> Column:
    """Boxes to recognise: both sides long enough; a polygon without points passes."""
    return F.coalesce(F.least(width, height) >= least, F.lit(True))


def doc_confidence(conf: Column, weight: Column) -> Column:
    """The mean confidence weighted by text length, 0 without text; an aggregate."""
    return F.coalesce(F.sum(conf * weight) / F.nullif(F.sum(weight), F.lit(0)), F.lit(0.0))


def box_weight(text: Column) -> Column:
    return utf16_length(F.regexp_replace(text, JSWS, ""))


def gated_text(text: Column, conf: Column, floor: float = DOC_CONFIDENCE) -> Column:
    """Text of a page that is sure enough, else none."""
    return F.when((F.regexp_replace(text, JSWS, "") != "") & (conf < floor), "").otherwise(text)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by ``key`` to a partition per SORT_BYTES of the tables they come from, if the session has fewer: so what a task sorts does not grow with the input."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    n = sum(s for s in sizes if s < UNKNOWN_BYTES) // SORT_BYTES
    return rows.repartition(n, key) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def reading_order(boxes: DataFrame, key: str = "page_id", gap: int = LINE_GAP) -> DataFrame:
    """``boxes`` (key, ord, top, left[, text]) with line and position. A line ends where the top is more than ``gap`` below the box before; ties go by text."""
    last = ["text"] if "text" in boxes.columns else []
    boxes = spread(boxes, key)
    down = Window.partitionBy(key).orderBy("top", "left", "ord", *last)
    starts = (F.col("top") - F.lag("top").over(down) > gap).cast("int")
    lined = boxes.withColumn("_new", F.coalesce(starts, F.lit(0))).withColumn("line", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")
    return lined.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("line", "left", "ord", *last)))


def page_text(boxes: DataFrame, key: str = "page_id", box_floor: float = BOX_CONFIDENCE, doc_floor: float = DOC_CONFIDENCE) -> DataFrame:
    """Rows (key, text, confidence) of pages from recognised boxes (key, ord, top, left, text, confidence)."""
    sure = reading_order(boxes.where(F.col("confidence") >= box_floor), key)
    out = sure.groupBy(key).agg(F.expr("listagg(text, '\n') within group (order by position)").alias("text"), doc_confidence(F.col("confidence"), box_weight(F.col("text"))).alias("confidence"))
    return out.select(key, gated_text(F.col("text"), F.col("confidence"), doc_floor).alias("text"), "confidence")


# --- pixels --------------------------------------------------------------------------------------


def luminance(r: Column, g: Column, b: Column) -> Column:
    return (0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def stretched(v: Column, low: Column, high: Column) -> Column:
    """A channel value on the scale from the image's least to its greatest luminance; a flat image stays."""
    return F.when(high > low, F.least(F.greatest(js_round((v - low) * 255 / F.nullif(high - low, F.lit(0))), F.lit(0)), F.lit(255))).otherwise(v).cast("int")


def render_size(width: Column, height: Column, max_edge: int = 1600) -> Column:
    scale = F.least(F.lit(1.0), max_edge / F.greatest(width, height))
    return F.struct(F.ceil(width * scale).cast("int").alias("w"), F.ceil(height * scale).cast("int").alias("h"))
