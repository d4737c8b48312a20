"""Inventory and domain checks: each gives the violating rows, and require() fails the job if there are any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(violations: DataFrame, what: str) -> None:
    """Raise ValueError with one example if violations has a row."""
    first = violations.take(1)
    if first:
        raise ValueError(f"{what}: {first[0].asDict()}")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def key_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with a column side."""
    a, b = left.select(keys).distinct(), right.select(keys).distinct()
    only = lambda x, y, name: x.join(y, keys, "left_anti").withColumn("side", F.lit(name))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def outside_domain(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """Rows whose value is null or not one of allowed."""
    return df.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False)))


def conflicting(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one value; null is a value of its own."""
    return df.groupBy(*keys).agg(F.count_distinct(F.struct(value)).alias("n_values")).where("n_values > 1")


def key_closure(json: Column, required: list[str], optional: list[str] | None = None) -> Column:
    """struct(missing, unknown): sorted key names of a JSON object text that break the closed schema."""
    keys = F.json_object_keys(json)
    need, may = F.array(*map(F.lit, required)), F.array(*map(F.lit, [*required, *(optional or [])]))
    return F.struct(F.array_sort(F.array_except(need, keys)).alias("missing"), F.array_sort(F.array_except(keys, may)).alias("unknown"))


def cover_gaps(shards: DataFrame, column: str, n: int) -> DataFrame:
    """(index, times) for each index of 0 .. n - 1 that the index lists do not hold exactly once, and for each outside."""
    held = shards.select(F.explode(column).alias("index")).groupBy(F.col("index").cast("long").alias("index")).agg(F.count("*").alias("times"))
    wanted = shards.sparkSession.range(n).withColumnRenamed("id", "index").withColumn("wanted", F.lit(1))
    both = held.join(wanted, "index", "full_outer").select("index", F.coalesce("times", F.lit(0)).cast("long").alias("times"), F.coalesce("wanted", F.lit(0)).alias("wanted"))
    return both.where("times <> wanted").select("index", "times")


def safe_path(path: Column) -> Column:
    """True for a relative path without empty parts, "..", backslashes or NUL."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", "..")) | path.contains("\\") | path.contains("\x00")
    return F.coalesce(~bad & ~path.startswith("/"), F.lit(False))


def hex_identity(value: Column, length: int) -> Column:
    return F.coalesce(value.rlike(f"^[0-9a-f]{{{length}}}$"), F.lit(False))
