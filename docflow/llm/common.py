"""Plumbing that the operators of this subpackage share.

Scratch tables go to the folder that the cluster names in ``spark.checkpoint.dir``, which all
executors see. A written table cuts the lineage, survives a lost executor, and is columnar, so
later steps read only the columns they need.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word contracts; a word is a maximal run of other characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_U = np.uint64


#: Limits of an Arrow batch on its way to Python: rows and bytes (one row at least).
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local master without one gets a temporary folder: on a cluster no executor would see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="docflow-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


@contextlib.contextmanager
def batch_rows(spark: SparkSession):
    """Inside, Arrow batches have at most the rows and bytes of BATCH: 10,000 rows of long texts do not fit beside an executor's heap."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables of one operator call. ``keep`` writes and rereads one; ``drop`` deletes some, ``leave`` all but some.

    Results are lazy and read what is left, so that is deleted when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._serial, self._made = 0, []
        files, root = self._files(self.root)
        files.mkdirs(root)
        files.deleteOnExit(root)

    def _files(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def path(self, name: str) -> str:
        self._serial += 1
        return f"{self.root}/{self._serial:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with batch_rows(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self._made.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            files, path = self._files(table._scratch_path)
            files.delete(path, True)

    def leave(self, *tables: DataFrame) -> None:
        paths = {t._scratch_path for t in tables}
        self.drop(*[t for t in self._made if t._scratch_path not in paths])
        self._made = list(tables)


def small(df: DataFrame, most: int) -> DataFrame:
    """``df``, marked for broadcast only if it was counted and has at most ``most`` rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def lower_ascii(column):
    """A-Z to a-z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20, rows: int = 1 << 11) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Arrow batches cut into runs of at most ``rows`` rows and ``most`` bytes of ``column`` (one row at least), with its values as bytes."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(values), 0), np.int64)
        start = 0
        while start < len(sizes):
            ends = np.cumsum(sizes[start : start + rows])
            stop = start + max(1, int(np.searchsorted(ends, most, "right")))
            part = batch.slice(start, stop - start)
            yield part, part.column(part.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on an array."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)  # 5 modulo 8, and its inverse


def _letters(lower: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=_U)) | _U(1)
    if lower:
        table[65:91] = table[97:123]
    table[_SPACE] = 0
    return table


_TABLE = {lower: _letters(lower) for lower in (False, True)}


class _Powers:
    """Powers of the base and of its inverse; grown to the longest piece seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, b, _U)]), dtype=_U) for b in (_BASE, _BACK))
        return self.up, self.down


_POWERS = _Powers()


class Words(NamedTuple):
    hashes: np.ndarray  # of all words in order
    stops: np.ndarray  # where each text's words end in them
    ends: np.ndarray  # the last two bytes of each word (the last first), upper case kept; 0 if it has one


PIECE = 1 << 20  # bytes of which running sums are made at once


def _spans(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the runs of letters in ``data`` begin and end, and each one's polynomial."""
    up, down = _POWERS.to(len(data))
    edges = np.flatnonzero(np.diff(_SPACE[data].view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    first, last = edges[0::2], edges[1::2]
    sums = _TABLE[lower][data]
    sums *= up[: len(data)]
    np.cumsum(sums, out=sums)
    before = np.where(first > 0, sums[first - 1], _U(0))
    return first, last, (sums[last - 1] - before) * down[first]


def _words_of_one(text: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, ends, sizes) of the words of a text of any length, a piece at a time; a word may go over any number of pieces."""
    data, out, sum_, size = np.frombuffer(text, np.uint8), [], 0, 0
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE]
        first, last, poly = _spans(piece, lower)
        sizes, stops = last - first, last + at
        if size:
            if len(first) and first[0] == 0:
                poly[0] = _U((sum_ + int(poly[0]) * pow(_BASE, size, 1 << 64)) % (1 << 64))
                sizes[0] += size
            else:
                poly, sizes, stops = np.insert(poly, 0, _U(sum_)), np.insert(sizes, 0, size), np.insert(stops, 0, at)
        sum_, size = 0, 0
        if len(last) and last[-1] == len(piece) and at + len(piece) < len(data):
            sum_, size = int(poly[-1]), int(sizes[-1])
            poly, sizes, stops = poly[:-1], sizes[:-1], stops[:-1]
        out.append((mix(poly), stops, sizes))
    hashes, stops, sizes = (np.concatenate(x) for x in zip(*out, strict=True))
    return hashes, data[stops - 1].astype(np.int64) * 256 + np.where(sizes > 1, data[stops - 2], 0), sizes


def words_of(texts: list[bytes | None], lower: bool = True) -> Words:
    """64-bit hashes of all words of ``texts``.

    A word's hash is a polynomial over random 64-bit letters, from one running sum over the bytes: no
    Python object is made per word. Words differ in hash but for a chance of about 2**-57 a pair.
    """
    if len(texts) == 1 and len(texts[0] or b"") > PIECE:
        hashes, ends, _ = _words_of_one(texts[0], lower)
        return Words(hashes, np.array([len(hashes)]), ends)
    joined = np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", np.uint8)
    first, last, poly = _spans(joined, lower)
    stops = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts)))
    ends = joined[last - 1].astype(np.int64) * 256 + np.where(last - first > 1, joined[last - 2], 0)
    return Words(mix(poly), np.searchsorted(first, stops), ends)


def word_hashes(texts: list[bytes | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    found = words_of(texts, lower)
    return found.hashes, found.stops
