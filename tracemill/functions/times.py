"""Times: epoch numbers, ISO texts, local days, ages."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis_to_iso(ms: Column) -> Column:
    """UTC ISO text with milliseconds; empty for null, zero and negative numbers. The session zone must be UTC."""
    fine = ms.isNotNull() & (ms > 0)
    return F.when(fine, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise("")


def to_millis(text: Column) -> Column:
    """epoch milliseconds of an ISO text or of a number's text; null if neither."""
    number = text.try_cast("double")
    return F.coalesce(number.cast("long"), F.unix_millis(F.try_to_timestamp(text)))


def local_day(ts: Column) -> Column:
    """the date in the session's zone."""
    return F.date_format(ts, "yyyy-MM-dd")


def local_minute(ts: Column) -> Column:
    """hour and minute in the session's zone."""
    return F.date_format(ts, "HH:mm")


def relative_age(seconds: Column) -> Column:
    """an age in the largest whole unit."""
    unit = lambda n, name: F.concat(F.floor(seconds / n).cast("string"), F.lit(name))
    return F.when(seconds < 60, "now").when(seconds < 3600, unit(60, "m ago")).when(seconds < 86400, unit(3600, "h ago")).otherwise(unit(86400, "d ago"))


def duration(ms: Column) -> Column:
    """milliseconds as ``ms``, seconds or minutes."""
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(F.format_number(ms / 1000, 1), F.lit("s")))
        .otherwise(F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m "), (F.floor(ms / 1000) % 60).cast("string"), F.lit("s")))
    )


def byte_size(n: Column) -> Column:
    """a whole number of bytes in B, KB, MB or GB, to the nearest tenth, upwards from halves."""

    def by(k: int, name: str) -> Column:
        # in whole numbers, as a rounded quotient may lie on a half that it isn't
        tenths = F.floor((n % k * 20 + k) / (2 * k))
        return F.concat((F.floor((n - n % k) / k) + F.floor(tenths / 10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(name))

    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, by(1 << 10, " KB")).when(n < 1 << 30, by(1 << 20, " MB")).otherwise(by(1 << 30, " GB"))
