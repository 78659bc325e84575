"""A model store as a table (id, version, blob, stored_at), and jobs as an event table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ModelFetchError(Exception):
    """A model that neither the store nor its origin has."""


def latest(models: DataFrame) -> DataFrame:
    """The last stored row of each id and version; of rows stored at the same time the greatest blob."""
    last = Window.partitionBy("id", "version").orderBy(F.desc("stored_at"), F.desc("blob"))
    return models.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def has(wanted: DataFrame, models: DataFrame) -> DataFrame:
    return wanted.join(models, ["id", "version"], "left_semi")


def get(wanted: DataFrame, models: DataFrame) -> DataFrame:
    return wanted.join(latest(models), ["id", "version"], "left")


def put(models: DataFrame, new: DataFrame) -> DataFrame:
    return latest(models.unionByName(new))


def invalidate(models: DataFrame, ids: DataFrame) -> DataFrame:
    """Without any version of the ids."""
    return models.join(ids.select("id"), "id", "left_anti")


def listed(models: DataFrame) -> DataFrame:
    return models.select("id", "version").distinct()


def resolve(wanted: DataFrame, models: DataFrame, origin: DataFrame) -> DataFrame:
    """``wanted`` (id, version) with blob and from_cache: the store's, else the origin's, else null."""
    stored = latest(models).select("id", "version", F.col("blob").alias("_stored"))
    out = wanted.join(stored, ["id", "version"], "left").join(origin.select("id", "version", F.col("blob").alias("_fetched")), ["id", "version"], "left")
    return out.select("id", "version", F.coalesce("_stored", "_fetched").alias("blob"), F.col("_stored").isNotNull().alias("from_cache"))


class Origin:
    """Read-through on the driver: one fetch per model however often it is asked for; a failed fetch is tried again."""

    def __init__(self, fetch: Callable[[str, str], bytes] | None = None):
        self.fetch, self.cache = fetch, {}

    def model(self, name: str, version: str) -> bytes:
        key = f"{name}@{version}"
        if key not in self.cache:
            if self.fetch is None:
                raise ModelFetchError(f"no origin for {key}")
            try:
                self.cache[key] = self.fetch(name, version)
            except ModelFetchError:
                raise
            except Exception as e:
                raise ModelFetchError(f"{key}: {e}") from e
        return self.cache[key]


def throttled(events: DataFrame, key: str, gap_ms: int = 250) -> DataFrame:
    """The progress events a client sees, as rows (key, seq), of rows (key, ms, seq, stage, page_index, total_pages).

    An event passes on a new stage, on the last page, or ``gap_ms`` after the last that passed; that last
    time is state, so each job's events are streamed in order through one task, which holds no more than a batch.
    """

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, at, stage = object(), 0, None
        for batch in batches:
            out = []
            for row, (k, ms, kind, page, total) in enumerate(zip(*(batch.column(c).to_pylist() for c in (key, "ms", "stage", "page_index", "total_pages")), strict=True)):
                if k != job or kind != stage or total > 0 and page >= total - 1 or ms - at >= gap_ms:
                    job, at, stage = k, ms, kind
                    out.append(row)
            yield batch.select([key, "seq"]).take(pa.array(out, pa.int64()))

    rows = events.select(key, "ms", "seq", "stage", "page_index", "total_pages").repartition(key).sortWithinPartitions(key, "ms", "seq")
    return rows.mapInArrow(passing, events.select(key, "seq").schema)


def job_status(events: DataFrame, key: str, timeout_ms: int | None = None, now_ms: Column | None = None) -> DataFrame:
    """The last event's type and message of each job of rows (key, ms, seq, type, message), and whether it is settled.

    A result or an error settles a job. With a timeout, an unsettled job that began that long ago is timed out.
    """
    final = F.col("type").isin("result", "error")
    order = F.struct("ms", "seq")
    out = events.groupBy(key).agg(F.max_by("type", order).alias("last_type"), F.min_by(F.when(final, F.col("type")), F.when(final, order)).alias("settled"), F.min("ms").alias("began"), F.count("*").alias("n_events"))
    status = F.coalesce("settled", F.when(now_ms - F.col("began") >= timeout_ms, "timeout") if timeout_ms is not None and now_ms is not None else F.lit(None).cast("string"), F.lit("pending"))
    return out.withColumn("status", status)


def abort(spark, tag: str) -> None:
    """Ends the queries that run under ``spark.addTag(tag)``."""
    spark.interruptTag(tag)
