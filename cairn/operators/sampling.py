"""Two-phase, clustered and greedy samples with known inclusion probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.checks import require
from cairn.operators.joins import first_reason
from cairn.operators.shared import Staged
from cairn.operators.windows import first_rows, hash_rank, hash_sample


def clustered(df: DataFrame, cluster: str, stratum: str, prediction: str, key: str, clusters: int, rows: int, seed: str) -> DataFrame:
    """Stage one: clusters of each stratum; stage two: rows of each cluster and prediction. probability is the product.

    A cluster with several strata is of the stratum "mixed".
    """
    value = F.when(F.count_distinct(stratum) > 1, "mixed").otherwise(F.min(stratum))
    strata = df.groupBy(cluster).agg(value.alias("cluster_stratum"))
    first = hash_sample(strata, "cluster_stratum", cluster, clusters, seed).withColumnRenamed("probability", "p1")
    inside = df.join(first, cluster)
    sizes = inside.groupBy(F.col(cluster).alias("__c"), F.col(prediction).alias("__p")).agg(F.count("*").alias("__n"))
    taken = first_rows(inside, [cluster, prediction], [hash_rank(seed, prediction, key), key], rows, "__r")
    taken = taken.join(sizes, F.col(cluster).eqNullSafe(F.col("__c")) & F.col(prediction).eqNullSafe(F.col("__p")))
    return taken.withColumn("probability", F.col("p1") * F.least(F.lit(rows), "__n") / F.col("__n")).drop("__r", "__n", "__c", "__p", "p1")


def multi_arm(df: DataFrame, arms: list[str], key: str, k: int, seed: str) -> DataFrame:
    """k rows of each vector of predictions."""
    return hash_sample(df.withColumn("vector", F.to_json(F.array(*arms))), "vector", key, k, seed)


# Strata that one_per_family() goes through, a job for each.
MOST_STRATA = 1000


def one_per_family(df: DataFrame, stratum: str, family: str, order: list[str], k: int) -> DataFrame:
    """The first k rows, in order, of each stratum, the strata in theirs, skipping families that a row was taken of before.

    Within a stratum only a family's first row can be taken, so one aggregate keeps these, and each stratum is a top-k
    of its families without those of the strata before. The loop is over strata, MOST_STRATA at most or ValueError; no task sees
    more than a sort of one.
    """
    row = F.struct(*order, *[c for c in df.columns if c not in order])
    best = Staged(df.groupBy(stratum, family).agg(F.min(row).alias("row")).select(*[F.col(f"row.{c}").alias(c) for c in df.columns]), "best").df
    chosen = None
    strata = [r[0] for r in best.select(stratum).where(F.col(stratum).isNotNull()).distinct().limit(MOST_STRATA + 1).collect()]
    if len(strata) > MOST_STRATA:
        raise ValueError(f"more than {MOST_STRATA} strata")
    for value in sorted(strata):
        pool = best.where(F.col(stratum) == value)
        if chosen is not None:
            pool = pool.join(chosen.select(family), family, "left_anti").select(df.columns)
        taken = Staged(pool.orderBy(*order).limit(k), "taken").df
        chosen = taken if chosen is None else chosen.unionByName(taken)
    return chosen if chosen is not None else best


def greedy_families(df: DataFrame, stratum: str, family: str, key: str, per_stratum: int, seed: str) -> DataFrame:
    """(stratum, family, key) of the rows taken in hash order until a stratum has its number, skipping families already taken in any stratum."""
    ranked = df.select(stratum, family, key, hash_rank(seed, stratum, key).alias("__rank"))
    return one_per_family(ranked, stratum, family, ["__rank", key], per_stratum).drop("__rank")


def balanced(df: DataFrame, stratum: str, key: str, rules: list[tuple[Column, str]], k: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """(k rows of each stratum in hash order, with rank; (reason, n) of rows left out by the first rule that holds).

    ValueError if a stratum has fewer than k rows left.
    """
    judged = df.withColumn("reason", first_reason(rules))
    left = judged.where("reason is null").drop("reason")
    sizes = df.select(stratum).distinct().join(left.groupBy(stratum).agg(F.count("*").alias("n")), stratum, "left").where(f"coalesce(n, 0) < {k}")
    require(sizes, "too few rows in a stratum")
    return first_rows(left, [stratum], [hash_rank(seed, stratum, key), key], k), judged.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
