"""What undocumented binary records still tell (E5, E6): readable results of tool calls, call times, hashes of messages.

The records are messages of tagged fields without a schema. Only rows that need it go through Python, in Arrow batches.
"""

import base64
import binascii

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Lines of a recovered result that are shown.
LINES = 300
#: Fields of a call's record that hold its begin and end, in epoch milliseconds.
BEGAN, ENDED = 59, 60


def fields(data: bytes) -> list[tuple[int, int | bytes]] | None:
    """(field, number or bytes) of a message in order; null where the bytes are none. Fixed-width numbers come as bytes."""
    out, at = [], 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    try:
        while at < len(data):
            field, kind = divmod(number(), 8)
            if not field or kind not in (0, 1, 2, 5):
                return None
            if kind == 0:
                out.append((field, number()))
                continue
            size = {1: 8, 5: 4}.get(kind) or (number() if kind == 2 else 0)
            if at + size > len(data):
                return None
            out.append((field, data[at : at + size]))
            at += size
    except IndexError:
        return None
    return out


def texts(data: bytes) -> list[str]:
    """Texts of two characters or more in a message and in the messages within it, in order."""
    out = []
    for _, value in fields(data) or ():
        if isinstance(value, bytes) and value:
            inner = fields(value) if len(value) > 1 else None
            if inner is not None:
                out += texts(value)
                continue
            text = value.decode("utf-8", "ignore") if _is_text(value) else ""
            if len(text) > 1 and text.strip():
                out.append(text)
    return out


def _is_text(value: bytes) -> bool:
    try:
        value.decode()
    except UnicodeDecodeError:
        return False
    return True


def _opened(text: str | None) -> bytes:
    try:
        return base64.b64decode("".join((text or "").removeprefix("~").split()), validate=True)
    except (binascii.Error, ValueError):
        return b""


def result_of(record: str | None) -> str:
    """E5: the readable lines of a call record (base64): texts in the second field of its parts, at most ``LINES``."""
    lines = []
    for field, value in fields(_opened(record)) or ():
        if field < BEGAN and isinstance(value, bytes):
            lines += [t for f, v in fields(value) or () if f == 2 and isinstance(v, bytes) for t in texts(v)]
    return "\n".join(lines[:LINES] + [f"… ({len(lines) - LINES} more lines)"] * (len(lines) > LINES))


@F.pandas_udf(StringType())
def _results(records: pd.Series) -> pd.Series:
    return records.map(result_of, na_action="ignore")


@F.pandas_udf(StructType([StructField("began", LongType()), StructField("ended", LongType())]))
def call_times(records: pd.Series) -> pd.DataFrame:
    """E5: when a call began and ended, in epoch milliseconds, by its record (base64); null where it doesn't tell."""
    rows = []
    for record in records:
        found = {f: v for f, v in reversed(fields(_opened(record)) or []) if isinstance(v, int)}
        rows.append((found.get(BEGAN), found.get(ENDED)))
    return pd.DataFrame(rows, columns=["began", "ended"]).astype("Int64")


@F.pandas_udf(ArrayType(StringType()))
def state_hashes(states: pd.Series) -> pd.Series:
    """Hashes (hex) of the messages of a conversation's state (base64 after ``~``), in order: values of 32 bytes in its first field."""
    return states.map(lambda s: [v.hex() for f, v in fields(_opened(s)) or () if f == 1 and isinstance(v, bytes) and len(v) == 32])


def recovered(calls: DataFrame, result: str, record: str, done: Column) -> DataFrame:
    """E5: calls that are done, but have no result, with that of their binary record; the others are left as they are."""
    missing = done & (F.coalesce(F.col(result), F.lit("")) == "")
    found = _results(F.when(missing, F.col(record)))
    return calls.withColumn(result, F.coalesce(F.nullif(found, F.lit("")), F.col(result)))
