"""Numbers: ratios, unsigned integers, sizes, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bundlelens import rules


def ratio(a: Column, b: Column) -> Column:
    """a / b to three places; 0 where b is."""
    return F.when(b == 0, 0.0).otherwise(F.round(a / b, 3))


def uint32(x: Column) -> Column:
    return F.pmod(x.cast("bigint"), F.lit(1 << 32))


def backoff_ms(attempt: Column) -> Column:
    return F.least(F.lit(250) * F.pow(F.lit(2.0), attempt), F.lit(4000.0)).cast("long")


def duration_name(x: Column) -> Column:
    found = F.lit(None).cast("string")
    for number, name in rules.DURATIONS.items():
        found = F.when(x == number, name).otherwise(found)
    return found


def size_text(octets: Column) -> Column:
    return F.when(octets < 1024, F.concat(octets.cast("string"), F.lit(" B"))).when(octets < 1 << 20, F.concat(F.format_number(octets / 1024, 1), F.lit(" KiB"))).otherwise(F.concat(F.format_number(octets / (1 << 20), 1), F.lit(" MiB")))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
