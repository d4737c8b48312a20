"""Counts, confusion tables, weighted metrics, agreement and identification bounds.

Ratios are null where their denominator is 0. The three ways to treat abstention stay separate.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.windows import numbered_within

LABELS = ["present", "absent", "unknown"]


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def count_by(df: DataFrame, key: str, domain: list[str] | None = None) -> DataFrame:
    """(key, n); with a domain, every value of it has a row."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    if domain is None:
        return counts
    values = df.sparkSession.createDataFrame([(v,) for v in domain], f"{key} string")
    return values.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def marginals(df: DataFrame, fields: list[str], label: str) -> DataFrame:
    """(field, key, label, n): one-way counts of label by each field, in one pass over the data."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("key")) for c in fields])).alias("m"), F.col(label).alias("label"))
    return long.groupBy("m.field", "m.key", "label").agg(F.count("*").alias("n"))


def confusion(df: DataFrame, by: list[str], gold: str = "gold", prediction: str = "prediction") -> DataFrame:
    """Abstentions are no fn, and recall is over all positives."""
    g, p = F.col(gold), F.col(prediction)
    n = lambda c: F.count_if(c)
    counts = df.where(g.isin("present", "absent")).groupBy(*by).agg(
        n((g == "present") & (p == "present")).alias("tp"), n((g == "absent") & (p == "present")).alias("fp"), n((g == "present") & (p == "absent")).alias("fn"),
        n((g == "absent") & (p == "absent")).alias("tn"), n(~F.coalesce(p.isin("present", "absent"), F.lit(False))).alias("abstained"), n(g == "present").alias("positives"), F.count("*").alias("n"),
    )
    c = F.col
    decided = c("tp") + c("fp") + c("fn") + c("tn")
    return counts.withColumns({
        "precision": ratio(c("tp"), c("tp") + c("fp")), "recall": ratio(c("tp"), c("positives")), "coverage": ratio(decided, c("n")),
        "decided_accuracy": ratio(c("tp") + c("tn"), decided), "selective_risk": ratio(c("fp") + c("fn"), decided),
    })


def confusion_missed(df: DataFrame, by: list[str], gold: str = "gold", prediction: str = "prediction") -> DataFrame:
    """An abstained positive counts as fn; an abstained negative in no cell."""
    g, p = F.col(gold), F.coalesce(F.col(prediction), F.lit("unknown"))
    out = df.where(g.isin("present", "absent")).groupBy(*by).agg(
        F.count_if((g == "present") & (p == "present")).alias("tp"), F.count_if((g == "absent") & (p == "present")).alias("fp"),
        F.count_if((g == "present") & (p != "present")).alias("fn"), F.count_if((g == "absent") & (p == "absent")).alias("tn"),
    )
    return out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def truth_matrix(df: DataFrame, gold: str = "gold", prediction: str = "prediction") -> DataFrame:
    """(truth, prediction, n) of all nine cells; a null counts as unknown."""
    spark = df.sparkSession
    cells = spark.createDataFrame([(a, b) for a in LABELS for b in LABELS], "truth string, prediction string")
    counts = df.groupBy(F.coalesce(gold, F.lit("unknown")).alias("truth"), F.coalesce(prediction, F.lit("unknown")).alias("prediction")).agg(F.count("*").alias("n"))
    return cells.join(counts, ["truth", "prediction"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def weighted_metrics(df: DataFrame, by: list[str], weight: Column, gold: str = "gold", prediction: str = "prediction") -> DataFrame:
    """Inverse-probability-weighted precision, recall, decision coverage and the share with known truth."""
    g, p, w = F.col(gold), F.coalesce(F.col(prediction), F.lit("unknown")), weight
    total = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    known = F.coalesce(g.isin("present", "absent"), F.lit(False))
    sums = df.groupBy(*by).agg(
        total((g == "present") & (p == "present")).alias("tp"), total((g == "absent") & (p == "present")).alias("fp"), total((g == "present") & (p != "present")).alias("fn"),
        total(known & p.isin("present", "absent")).alias("decided"), total(known).alias("known"), F.sum(w).alias("weight"), F.sum(w * w).alias("squares"),
    )
    c = F.col
    return sums.withColumns({"precision": ratio(c("tp"), c("tp") + c("fp")), "recall": ratio(c("tp"), c("tp") + c("fn")), "decision_coverage": ratio(c("decided"), c("known")), "oracle_coverage": ratio(c("known"), c("weight")), "effective_n": ratio(c("weight") * c("weight"), c("squares"))})


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, clamped so that they hold the point."""
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    # least() and greatest() pass over nulls
    none = p.isNull() | n.isNull()
    return F.when(~none, F.greatest(F.lit(0.0), F.least(p, centre - half))), F.when(~none, F.least(F.lit(1.0), F.greatest(p, centre + half)))


def kappa(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(n, agreement, kappa) of two raters; rows where one is null are left out; null where chance agreement is 1."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    one = both.groupBy(*by, "a", "b").agg(F.count("*").alias("c"))
    total = one.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    left, right = one.groupBy(*by, F.col("a").alias("v")).agg(F.sum("c").alias("ca")), one.groupBy(*by, F.col("b").alias("v")).agg(F.sum("c").alias("cb"))
    chance = left.join(right, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("ca") * F.col("cb")).alias("product"))
    joined = total.join(chance, by, "left") if by else total.crossJoin(chance)
    expected = F.coalesce("product", F.lit(0)) / (F.col("n") * F.col("n"))
    return joined.select(*by, "n", ratio(F.col("same"), F.col("n")).alias("agreement"), F.try_divide(F.col("same") / F.col("n") - expected, 1 - expected).alias("kappa"))


def bounds(df: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """Coverage, lower and upper bound of the share of positives, and their share of the decided."""
    x = F.col(label)
    c = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(x == "present").alias("positive"), F.count_if(x == "absent").alias("negative"))
    n, positive, negative = F.col("n"), F.col("positive"), F.col("negative")
    return c.withColumns({"coverage": ratio(positive + negative, n), "lower": ratio(positive, n), "upper": ratio(n - negative, n), "decided_share": ratio(positive, positive + negative)})


def cluster_bounds(df: DataFrame, cluster: str, label: str = "label") -> DataFrame:
    """Clusters with a positive, and with a positive or an undecided row, of all clusters."""
    each = df.groupBy(cluster).agg(F.bool_or(F.coalesce(F.col(label) == "present", F.lit(False))).alias("some"), F.bool_or(F.coalesce(F.col(label) != "absent", F.lit(True))).alias("may"))
    out = each.agg(F.count("*").alias("clusters"), F.count_if("some").alias("with_positive"), F.count_if("may").alias("with_possible"))
    return out.withColumns({"lower": ratio(F.col("with_positive"), F.col("clusters")), "upper": ratio(F.col("with_possible"), F.col("clusters"))})


def poisson_steps(digits: int = 12) -> list[int]:
    """The numbers of so many hexadecimal digits at which a Poisson variate of mean 1 gets one more: 16^digits times its distribution function."""
    steps, term, total = [], math.exp(-1), math.exp(-1)
    while int(total * 16**digits) < 16**digits - 1 and len(steps) < 16:
        steps.append(int(total * 16**digits))
        term /= len(steps)
        total += term
    return steps


def cluster_bootstrap(df: DataFrame, cluster: str, numerator: Column, denominator: Column, iterations: int = 200, seed: str = "bootstrap") -> DataFrame:
    """(point, lower, upper): a ratio of sums with the percentile interval of resampled clusters.

    In each iteration a cluster has a weight: a Poisson variate of mean 1 from a sha256 of seed, iteration and cluster, as
    the number of times that a draw with replacement from many clusters takes one. Rows are summed by cluster, and
    every task adds its clusters' weighted sums for all iterations before anything is shuffled.
    """
    sums = df.groupBy(cluster).agg(F.sum(numerator).cast("double").alias("a"), F.sum(denominator).cast("double").alias("b"))
    each = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("i"))
    digest = F.sha2(F.concat_ws("\x00", F.lit(seed), F.col("i").cast("string"), F.col(cluster).cast("string")), 256)
    number = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    weight = sum(((number >= step).cast("int") for step in poisson_steps()[1:]), (number >= poisson_steps()[0]).cast("int"))
    drawn = each.groupBy("i").agg(ratio(F.sum(F.col("a") * weight), F.sum(F.col("b") * weight)).alias("r"))
    interval = drawn.agg(F.percentile("r", 0.025).alias("lower"), F.percentile("r", 0.975).alias("upper"))
    return sums.agg(ratio(F.sum("a"), F.sum("b")).alias("point")).crossJoin(interval)


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, a column for each share): exact quantiles by linear interpolation between order statistics (type 7); null without values.

    Values are sorted by group over all tasks and numbered; of each group only the two rows beside each share's place are
    kept, so a group of any size meets in no task. Nulls are not counted; NaN is the largest value.
    """
    if not by:
        return quantiles(df.withColumn("__all", F.lit(0)), ["__all"], value, shares).drop("__all")
    n = df.groupBy(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]).agg(F.count(value).alias("n"))
    rows = numbered_within(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v")), by, ["__v"], "__r")
    place = {name: (F.col("__size") - 1) * share for name, share in shares.items()}
    low = {name: F.floor(x) + 1 for name, x in place.items()}
    held = functools.reduce(Column.__or__, [F.col("__r").isin(x, x + 1) for x in low.values()])
    kept = rows.where(held)
    part = {name: place[name] - F.floor(place[name]) for name in shares}
    at = lambda name, k: F.max(F.when(F.col("__r") == low[name] + k, F.col("__v")))
    between = lambda name: F.coalesce(at(name, 0) * (1 - F.max(part[name])) + at(name, 1) * F.max(part[name]), at(name, 0))
    found = kept.groupBy(*by).agg(*[between(name).alias(name) for name in shares])
    same = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)]
    return n.join(found, same, "left").select(*[F.col(f"__g{i}").alias(c) for i, c in enumerate(by)], "n", *shares)


def quartiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(n, q1, median, q3), as quantiles() has them."""
    return quantiles(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})


def sum_or_null(x: Column) -> Column:
    """The sum, or null if any value is missing."""
    return F.when(F.count_if(x.isNull()) == 0, F.sum(x))


def rollup_label(label: Column) -> Column:
    """present if any child is, absent if all are, unknown otherwise; null without children."""
    some = F.bool_or(F.coalesce(label == "present", F.lit(False)))
    every = F.bool_and(F.coalesce(label == "absent", F.lit(False)))
    return F.when(some.isNull(), F.lit(None)).when(some, "present").when(every, "absent").otherwise("unknown")
