"""Arrow batches on their way to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Most rows and bytes of a batch (one row at least). Without a limit of bytes it is 10,000 rows, whose containers or images take gigabytes.
LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2048, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 20}
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def _number(value: str | None) -> int:
    digits = (value or "").strip().lower()
    unit = digits.lstrip("-0123456789")
    return int(digits[: len(digits) - len(unit)] or 0) * _UNITS.get(unit[:1], 1)


def small_batches() -> None:
    """Lowers the limits of the active session to LIMITS; smaller ones stay. They hold when a plan runs, which is later, so they are not set back."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        for key, most in LIMITS.items():
            if not 0 < _number(spark.conf.get(key, None)) <= most:
                spark.conf.set(key, str(most))
