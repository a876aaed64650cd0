"""Windows over streams of request logs. An extension of ours: captures are batches, and these agree with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_window(log: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "2 hours", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """(begin, end, kind, requests, users): counts of tumbling or sliding windows. As a stream, rows later than `late`
    are left out and windows end when the watermark passes them; as a batch, all rows count."""
    stamped = log.withColumn(time, F.col(time).cast("timestamp"))
    rows = stamped.withWatermark(time, late) if log.isStreaming else stamped
    window = F.window(time, length, slide) if slide else F.window(time, length)
    counts = rows.groupBy(window.alias("w"), kind).agg(F.count("*").alias("requests"), F.approx_count_distinct("user_id").alias("users"))
    return counts.select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), kind, "requests", "users")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "2 hours", time: str = "ts", user: str = "user_id") -> DataFrame:
    """(user, begin, end, requests): runs of a user's requests with no longer gap between them."""
    stamped = log.withColumn(time, F.col(time).cast("timestamp"))
    rows = stamped.withWatermark(time, late) if log.isStreaming else stamped
    found = rows.groupBy(user, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("requests"))
    return found.select(user, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "requests")


def first_requests(log: DataFrame, key: list[str], late: str = "2 hours", time: str = "ts") -> DataFrame:
    """The log without repeated requests: of equal keys within the lateness one is kept."""
    stamped = log.withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, late).dropDuplicatesWithinWatermark(key) if log.isStreaming else stamped.dropDuplicates(key)


def retry_after(status: Column, attempt: Column) -> Column:
    """When a failed request of a stream is due again; null for those that are final."""
    from bundlelens import rules
    from bundlelens.functions import numbers

    return F.when(status.isNull() | status.isin(rules.RETRYABLE), numbers.backoff_ms(attempt))
