"""Decision lattices: ordered rules over three-valued facts, as column expressions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = ["reachable", "guarded", "denies", "dominates", "same_resource", "commits"]
VALUES = ["true", "false", "unknown"]


def tri(value: Column) -> Column:
    """A three-valued text as a nullable boolean."""
    return F.when(value == "true", True).when(value == "false", False)


def assess(facts: dict[str, Column]) -> Column:
    """present, blocked, absent or unknown for one set of facts; a contradiction is unknown.

    An effect that is not reached or does not commit is absent. A reached, committing effect is blocked
    if a guard denies it, dominates it and protects the same resource, and present if one of these is
    known to fail.
    """
    reach, guard, deny, order, same, commit = (tri(facts[f]) for f in FACTS)
    contradiction = (~guard) & deny
    blocks = guard & deny & order & same
    out = F.when(contradiction, "unknown").when((~reach) | (~commit), "absent").when(reach & commit & blocks, "blocked")
    return out.when(reach & commit & ~blocks, "present").otherwise("unknown")


def fact_table(spark: SparkSession) -> DataFrame:
    """All 729 value combinations of the six facts."""
    return spark.createDataFrame(list(itertools.product(VALUES, repeat=len(FACTS))), ", ".join(f"{f} string" for f in FACTS))


def truth_table(spark: SparkSession) -> DataFrame:
    """fact_table with outcome."""
    return fact_table(spark).withColumn("outcome", assess({f: F.col(f) for f in FACTS}))


def pivotal(spark: SparkSession) -> DataFrame:
    """truth_table with pivotal: the unknown facts of which some known completion of the others changes the outcome.

    The completions are rows of the same 729-row table, so this is a join of two small, fixed tables.
    """
    full = truth_table(spark)
    known = full.where(" and ".join(f"{f} <> 'unknown'" for f in FACTS)).select(*[F.col(f).alias(f"k_{f}") for f in FACTS], F.col("outcome").alias("k_outcome"))
    fits = [F.col(f).isin("unknown") | (F.col(f) == F.col(f"k_{f}")) for f in FACTS]
    on = fits[0]
    for f in fits[1:]:
        on = on & f
    met = full.join(F.broadcast(known), on)
    matter = None
    for f in FACTS:
        others = [F.col(g) for g in FACTS] + [F.col(f"k_{g}") for g in FACTS if g != f]
        changes = met.where(F.col(f) == "unknown").groupBy(*others).agg(F.count_distinct("k_outcome").alias("d")).where("d > 1").select(*FACTS, F.lit(f).alias("fact")).distinct()
        matter = changes if matter is None else matter.unionByName(changes)
    listed = matter.groupBy(*FACTS).agg(F.array_sort(F.collect_set("fact")).alias("pivotal"))
    return full.join(listed, FACTS, "left").withColumn("pivotal", F.coalesce("pivotal", F.array().cast("array<string>")))


def logical_verdict(states: Column) -> Column:
    """present if any realization is, blocked if there are some and all are, unknown otherwise."""
    some = F.exists(states, lambda s: s == "present")
    every = (F.size(states) > 0) & F.forall(states, lambda s: s == "blocked")
    return F.when(some, "present").when(every, "blocked").otherwise("unknown")


def verdict_of(state: Column) -> Column:
    """logical_verdict over the rows of a group, as an aggregate."""
    some, every = F.bool_or(F.coalesce(state == "present", F.lit(False))), F.bool_and(F.coalesce(state == "blocked", F.lit(False)))
    return F.when(some, "present").when(every, "blocked").otherwise("unknown")


def agree_or_unknown(*predictions: Column) -> Column:
    """The common value of the predictions if all are decided and equal."""
    first = predictions[0]
    same = first.isin("present", "absent")
    for p in predictions[1:]:
        same = same & (p == first)
    return F.when(same, first).otherwise("unknown")


def disposition(rules: list[tuple[Column, str, str, bool]], strict: bool = False) -> Column:
    """struct(label, authority, candidate) of the first rule (condition, label, authority, mechanical) that holds.

    A rule is mechanical if its condition is a recorded fact or a proof, and not what models or reviewers agree on. In
    strict mode only these release a label: without one it is unknown, and the first other rule that holds gives the candidate, which
    waits for a witness. Outside strict mode every rule releases and there is no candidate.
    """
    text = lambda x: F.lit(x).cast("string")
    label, authority, candidate = text("unknown"), text("none"), text(None)
    for condition, name, source, mechanical in reversed(rules):
        if mechanical or not strict:
            label, authority = F.when(condition, name).otherwise(label), F.when(condition, source).otherwise(authority)
            candidate = F.when(condition, text(None)).otherwise(candidate)
        else:
            candidate = F.when(condition, name).otherwise(candidate)
    # a candidate is told only of what stays unknown
    return F.struct(label.alias("label"), authority.alias("authority"), F.when(authority == "none", candidate).alias("candidate"))


def scope_verdict(some_present: Column, every_absent: Column, quantifier: Column, exhaustive: Column) -> Column:
    """An open domain is never absent; a finite one only if it was gone through in full."""
    return F.when(some_present, "present").when((quantifier == "finite") & exhaustive & every_absent, "absent").otherwise("unknown")
