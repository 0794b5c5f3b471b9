"""Unions, precedence, multiset differences, upserts."""

from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_all(sources: list[DataFrame]) -> DataFrame:
    """All rows of all sources; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def union_available(loaders: dict[str, Callable[[], DataFrame]], keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame | None, dict[str, str]]:
    """Rows of all sources that can be read, with their name as ``origin``; and, by name, what was wrong with the others.

    ``keep`` writes a source's rows and reads them again, so that a source which only breaks while it is read is told
    apart from the rest as well.
    """
    found, broken = [], {}
    for name, load in loaders.items():
        try:
            found.append(keep(load(), name).withColumn("origin", F.lit(name)))
        except (PySparkException, Py4JJavaError, OSError) as e:
            broken[name] = str(e).splitlines()[0][:300]
    return (union_all(found) if found else None), broken


def union_by_precedence(sources: list[DataFrame], key: str, side: list[str]) -> DataFrame:
    """One row per key, of the first source that has it; ``side`` fields that it lacks come from the next that has them.

    One shuffle on the key; the sources' order is their rank.
    """
    every = union_all([df.withColumn("_rank", F.lit(i)) for i, df in enumerate(sources)])
    own = [c for c in every.columns if c not in (key, "_rank", *side)]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(c)
    best = F.min_by(F.struct(*own), "_rank") if own else F.lit(None)
    out = every.groupBy(key).agg(best.alias("_own"), *map(first, side))
    return out.select(key, *(F.col(f"_own.{c}").alias(c) for c in own), *side)


def distinct_paths(sources: list[DataFrame], key: str) -> DataFrame:
    """Every key of any source once."""
    return reduce(DataFrame.union, [df.select(key) for df in sources]).distinct()


def surplus(a: DataFrame, b: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """U4: rows of ``a`` beyond the number of equal ones in ``b``: of each value the later ones, with their order kept."""
    counts = b.groupBy(*by, value).agg(F.count("*").alias("_other"))
    numbered = a.withColumn("_n", F.row_number().over(Window.partitionBy(*by, value).orderBy(order)))
    return numbered.join(counts, [*by, value], "left").where(F.col("_n") > F.coalesce("_other", F.lit(0))).drop("_n", "_other")


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows without those of new keys, and the new ones."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def distinct_json(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Of rows whose JSON is the same but for the order of its keys, the first."""
    canonical = F.coalesce(F.to_json(F.try_parse_json(value)), F.col(value))
    window = Window.partitionBy(*by, "_json").orderBy(order)
    return rows.withColumn("_json", canonical).withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n", "_json")


def current_version(rows: DataFrame, version: str) -> DataFrame:
    """Rows of the current version."""
    return rows.where(F.col("version") == version)
