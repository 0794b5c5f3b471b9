"""Registry of the queries and their DuckDB twins, and the adapters from the given tables to session data."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as events: a session for each conv_id, a system turn being instructions."""
    kind = F.when(F.col("role") == "system", "instructions").otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_key"), F.col("turn").alias("seq"), kind.alias("kind"), "text")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a log: a session for each user, k the number in its properties."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))


#: The same adapters in SQL.
TURNS = "turns AS (SELECT conv_id AS session_key, turn AS seq, CASE WHEN role = 'system' THEN 'instructions' ELSE role END AS kind, text FROM conversations)"
LOG = "log AS (SELECT event_id, ts, user_id, event_type, value, (props::JSON->>'$.k')::BIGINT AS k FROM events)"
#: Single-spaced text, as the operators make it; the given tables hold no white space beyond ASCII.
FLAT = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
