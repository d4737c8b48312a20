"""Verdict rules over evidence: checks, gates, reductions and prediction arms.

Row rules are column expressions; rules over several rows are one aggregate of counts and flags, so no key's rows
are gathered in a list unless the list is the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.joins import all_reasons, first_reason

# What is known of a guard by a part of its marker (in lower case) and, where one is named, its framework. The
# first row that fits counts.
_TOOL_BEFORE = ("pre_effect_decidable", "guard contract executes before protected tool dispatch")
_TOOL_AFTER = ("post_effect_dependent", "guard contract executes after protected tool or model output")
LIFECYCLES = [
    (None, "tool_input_guardrail", *_TOOL_BEFORE),
    (None, "input_guardrail", *_TOOL_BEFORE),
    (None, "before_tool_callback", *_TOOL_BEFORE),
    (None, "before_tool_call", *_TOOL_BEFORE),
    (None, "needs_approval", *_TOOL_BEFORE),
    (None, "request_confirmation", *_TOOL_BEFORE),
    (None, "wrap_tool_call", *_TOOL_BEFORE),
    (None, "tool_output_guardrail", *_TOOL_AFTER),
    (None, "output_guardrail", *_TOOL_AFTER),
    (None, "after_tool_callback", *_TOOL_AFTER),
    (None, "after_tool_call", *_TOOL_AFTER),
    (None, "output_validator", *_TOOL_AFTER),
    ("crewai", "guardrail", "post_effect_dependent", "CrewAI task guardrail validates task output after task execution"),
    (None, "before_model_callback", "pre_effect_decidable", "callback executes before model-driven tool selection"),
    (None, "after_model_callback", "unknown_dynamic", "after-model position alone does not establish ordering relative to tool effects"),
    (None, "", "unknown_dynamic", "no pinned lifecycle contract matched the guard marker"),
]


def some(condition: Column) -> Column:
    """Whether a condition holds for some row of a group; a null does not hold."""
    return F.coalesce(F.bool_or(condition), F.lit(False))


def holds(condition: Column) -> Column:
    """A condition with null as false, so that its negation is the rest."""
    return F.coalesce(condition, F.lit(False))


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(rows for which the condition holds, all others); a null is among the others."""
    return df.where(holds(condition)), df.where(~holds(condition))


def joint_claim(prerequisites: dict[str, Column], joint: Column) -> Column:
    """struct(consistent, contradictions, claim) of three-valued texts: a joint fact that is true contradicts each
    prerequisite known false; the claim follows the joint fact where all prerequisites are true."""
    against = all_reasons([((joint == "true") & (value == "false"), name) for name, value in sorted(prerequisites.items())])
    every = F.lit(True)
    for value in prerequisites.values():
        every = every & holds(value == "true")
    claim = F.when((F.size(against) > 0) | ~every, "unknown").when(joint == "true", "present").when(joint == "false", "absent").otherwise("unknown")
    return F.struct((F.size(against) == 0).alias("consistent"), against.alias("contradictions"), claim.alias("claim"))


def gated_prediction(supported: Column, ready: Column, reason: Column, missing: Column, issue: Column) -> Column:
    """struct(prediction, status, reason): a certificate's claim, withheld where it is unsupported, its evidence gate is
    not ready (with what is missing) or it makes no claim."""
    held = F.concat(F.coalesce(reason, F.lit("evidence_gate_not_ready")), F.when(F.size(missing) > 0, F.concat(F.lit(":"), F.array_join(missing, ","))).otherwise(""))
    why = F.when(~holds(supported), "static_certificate_unsupported").when(~holds(ready), held).when(issue.isNull(), "certificate_without_issue_prediction").otherwise("certificate_and_gate_verified")
    known = holds(supported) & holds(ready) & issue.isNotNull()
    return F.struct(F.when(known, issue).alias("prediction"), F.when(known, "known").otherwise("unknown").alias("status"), why.alias("reason"))


def proof_label(in_protocol: Column, eligible: Column, label: Column, reason: Column) -> Column:
    """struct(label, reason): contracts of another protocol are EXCLUDED, ineligible ones and those without a proof UNKNOWN."""
    out = F.when(~holds(in_protocol), "EXCLUDED").when(~holds(eligible), "UNKNOWN").otherwise(F.coalesce(label, F.lit("UNKNOWN")))
    why = F.when(~holds(in_protocol), "other_protocol").when(~holds(eligible), "structure_unproven").otherwise(reason)
    return F.struct(out.alias("label"), why.alias("reason"))


def reduce_pairs(pairs: DataFrame, contract: str, label: Column, reason: Column, unresolved: Column) -> DataFrame:
    """(contract, status, label, pairs, reasons): one violation proves a violation; conformance needs every pair and nothing
    unresolved; otherwise the reasons of open pairs with their counts. unresolved is a number, the same in each row of a contract."""
    row = pairs.select(F.col(contract), label.alias("__label"), reason.alias("__reason"), unresolved.alias("__open"))
    by_reason = row.where("__label is null").groupBy(contract, "__reason").agg(F.count("*").alias("n")).groupBy(contract)
    reasons = by_reason.agg(F.array_sort(F.collect_list(F.concat_ws("=", "__reason", F.col("n").cast("string")))).alias("reasons"))  # one entry for each reason
    flags = row.groupBy(contract).agg(some(F.col("__label") == "violation").alias("__v"), (F.count_if(F.col("__label") == "conformant") == F.count("*")).alias("__c"), F.max("__open").alias("__o"), F.count("*").alias("pairs"))
    out = F.when(F.col("__v"), "violation").when(F.col("__c") & (F.coalesce("__o", F.lit(0)) == 0), "conformant")
    joined = flags.join(reasons, contract, "left").withColumn("label", out)
    open_reasons = F.when(F.col("label").isNull(), F.coalesce("reasons", F.expr("cast(array() as array<string>)")))
    return joined.select(contract, F.when(F.col("label").isNull(), "unknown").otherwise("proved").alias("status"), "label", "pairs", open_reasons.alias("reasons"))


def critic_gate(claims: DataFrame, sample: str, claim: str, expected: Column, analyst: Column, critic: Column) -> DataFrame:
    """(sample, accepted, corrections, unresolved): accepted if the critic gives every expected verdict, negative controls
    included; corrections are claims that only the critic got right, unresolved those it got wrong, both sorted."""
    right, was = holds(critic == expected), holds(analyst == expected)
    listed = lambda condition: F.array_sort(F.collect_list(F.when(condition, F.col(claim))))
    return claims.groupBy(sample).agg(F.bool_and(right).alias("accepted"), listed(right & ~was).alias("corrections"), listed(~right).alias("unresolved"))


def scoped_verdicts(rows: DataFrame, scopes: DataFrame, scope: str, scenario: str, label: str) -> DataFrame:
    """scopes (scope, scenarios, quantifier, open_dimensions) with verdict and reason from verified rows (scope, scenario, label).

    A positive row is enough for present. absent needs a closed domain with no open dimension in which every
    enrolled scenario has an absent row and no other.
    """
    flags = rows.groupBy(scope).agg(some(F.col(label) == "present").alias("__p"), F.bool_and(holds(F.col(label) == "absent")).alias("__a"), F.count_distinct(scenario).alias("__n"))
    hit, clear = holds(F.col("__p")), holds(F.col("__a")) & (F.coalesce("__n", F.lit(0)) == F.col("scenarios"))
    is_open = F.col("quantifier") == "open"
    reason = F.when(hit, "positive_witness").when(is_open, "open_domain").when(F.col("open_dimensions") > 0, "open_dimensions").when(clear, "all_scenarios_absent").otherwise("incomplete")
    out = scopes.join(flags, scope, "left").withColumn("reason", reason)
    return out.withColumn("verdict", F.when(F.col("reason") == "positive_witness", "present").when(F.col("reason") == "all_scenarios_absent", "absent").otherwise("unknown")).drop("__p", "__a", "__n")


def vetoed(verdict: Column, hypothesis: Column) -> Column:
    """struct(prediction, disagrees): a decided verdict that a decided hypothesis contradicts is unknown."""
    decided = ["present", "absent"]
    against = holds(verdict.isin(decided) & hypothesis.isin(decided) & (verdict != hypothesis))
    return F.struct(F.when(against, "unknown").otherwise(verdict).alias("prediction"), against.alias("disagrees"))


def four_arms(df: DataFrame, keys: list[str], static: Column, unsupported: Column, analyst: Column, critic: Column) -> DataFrame:
    """(keys, arm, prediction, status) for static, llm_only, static_analyst and full.

    A null review is incomplete: its arm is an error. full and llm_only take what analyst and critic agree on.
    """
    pair = F.when(analyst.isNull() | critic.isNull(), F.lit(None)).when(analyst == critic, analyst).otherwise("unknown")
    lacking = lambda prediction: F.when(holds(unsupported) & (prediction == "unknown"), "unsupported").otherwise("completed")

    def reviewed(review: Column) -> Column:
        prediction = F.when(review.isNull(), "unknown").otherwise(vetoed(static, review)["prediction"])
        return F.struct(prediction.alias("prediction"), F.when(review.isNull(), "error").otherwise(lacking(prediction)).alias("status"))

    arms = {
        "static": F.struct(static.alias("prediction"), lacking(static).alias("status")),
        "llm_only": F.struct(F.coalesce(pair, F.lit("unknown")).alias("prediction"), F.when(pair.isNull(), "error").otherwise("completed").alias("status")),
        "static_analyst": reviewed(analyst),
        "full": reviewed(pair),
    }
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("arm"), x["prediction"].alias("prediction"), x["status"].alias("status")) for name, x in arms.items()]))
    return df.select(*keys, each.alias("__arm")).select(*keys, "__arm.arm", "__arm.prediction", "__arm.status")


def observations(events: DataFrame, run: str, invocation: str, kind: str, health: Column, denies: Column) -> DataFrame:
    """(run, status, denials, attempts, commits, violation, correlated) from events of the kinds verdict, attempt, skip, marker.

    Markers are commits that were observed apart from the log. They are correlated if the log's invocations and
    the markers' are the same set, or if nothing was tried or committed and one skip covers the only invocations.
    An incomplete run is an error.
    """
    is_marker, is_skip = F.col(kind) == "marker", F.col(kind) == "skip"
    logged = ~is_marker
    each = events.groupBy(run, invocation).agg(
        some(logged).alias("__log"), some(is_marker).alias("__mark"), F.count_if(is_skip).alias("__skips"), F.count_if(is_marker).alias("__markers"),
        F.count_if(F.col(kind) == "attempt").alias("__attempts"), F.count_if((F.col(kind) == "verdict") & denies).alias("__denials"), F.bool_and(holds(health)).alias("__healthy"),
    )
    named = F.col(invocation).isNotNull()
    total = each.groupBy(run).agg(
        F.sum("__denials").alias("denials"), F.sum("__attempts").alias("attempts"), F.sum("__markers").alias("commits"), F.sum("__skips").alias("__skips"), F.bool_and("__healthy").alias("__healthy"),
        (F.count_if(named & F.col("__log")) > 0).alias("__any"), F.coalesce(F.bool_and(F.when(named, F.col("__log") == F.col("__mark"))), F.lit(False)).alias("__same"),
        F.coalesce(F.bool_and(F.when(named & F.col("__log"), F.col("__skips") > 0)), F.lit(False)).alias("__skipped"),
    )
    skipped = (F.col("commits") == 0) & (F.col("attempts") == 0) & (F.col("__skips") == 1) & F.col("__any") & F.col("__skipped")
    return total.select(
        run, F.when(F.col("__healthy"), "scored").otherwise("error").alias("status"), "denials", "attempts", "commits",
        ((F.col("denials") > 0) & (F.col("commits") > 0)).alias("violation"), ((F.col("__any") & F.col("__same")) | skipped).alias("correlated"),
    )


def fixture_pairs(events: DataFrame, pair: str, decision: str, kind: str, verdict: str) -> DataFrame:
    """(pair, fault) of ALLOW/DENY fixtures: null for a pair whose two runs have one matching verdict, an ALLOW run with a
    start, a selection, an attempt and one marker, and a DENY run with a start and no marker; else the first fault."""
    has = lambda *kinds: F.lit(True) if not kinds else some(F.col(kind) == kinds[0]) & has(*kinds[1:])
    runs = events.groupBy(pair, decision).agg(
        F.count_if(F.col(kind) == "verdict").alias("__verdicts"), F.count_if((F.col(kind) == "verdict") & (F.col(verdict) == F.col(decision))).alias("__right"), F.count_if(F.col(kind) == "marker").alias("__markers"),
        has("start").alias("__start"), has("start", "select", "attempt").alias("__tried"),
    )
    allow = F.col(decision) == "ALLOW"
    fault = first_reason([
        (~F.col(decision).isin("ALLOW", "DENY"), "decision"), ((F.col("__verdicts") != 1) | (F.col("__right") != 1), "verdict"), (allow & (F.col("__markers") != 1), "allow_marker"), (~allow & (F.col("__markers") > 0), "deny_marker"),
        (F.when(allow, ~F.col("__tried")).otherwise(~F.col("__start")), "events"),
    ])
    return runs.withColumn("__fault", fault).groupBy(pair).agg(F.when(F.count("*") != 2, "pair").otherwise(F.min("__fault")).alias("fault"))


def attached(effects: DataFrame, attestations: DataFrame, key: str, same: list[str], flags: list[str], digests: list[str]) -> tuple[DataFrame, DataFrame]:
    """(effects with the attestations' flags and digests, faulty attestations with reason).

    An attestation is faulty if its key is repeated or unknown, a column of same differs from the effect's, a
    flag is null, or a digest is not 64 lower-case hexadecimal digits. Only faultless ones are attached.
    """
    own = attestations.groupBy(key).agg(F.count("*").alias("__k"), *[F.first(c).alias(f"__{c}") for c in [*same, *flags, *digests]])
    known = own.join(effects.select(key, *[F.col(c).alias(f"__own_{c}") for c in same], F.lit(True).alias("__known")), key, "left")
    rules = [(F.col("__k") > 1, "repeated"), (F.col("__known").isNull(), "unknown")]
    rules += [(~F.equal_null(f"__{c}", f"__own_{c}"), f"other_{c}") for c in same] + [(F.col(f"__{c}").isNull(), f"no_{c}") for c in flags]
    rules += [(~holds(F.col(f"__{c}").rlike("^[0-9a-f]{64}$")), f"bad_{c}") for c in digests]
    judged = known.withColumn("reason", first_reason(rules))
    good = judged.where("reason is null").select(key, *[F.col(f"__{c}").alias(c) for c in [*flags, *digests]])
    return effects.join(good, key, "left"), judged.where("reason is not null").select(key, "reason")


def lifecycle(framework: Column, marker: Column, facts: list[tuple] = LIFECYCLES) -> Column:
    """struct(position, reason) of the first fact that fits a guard's framework and marker; null if none does."""
    known = F.array(*[F.struct(*[F.lit(v).cast("string").alias(c) for c, v in zip(("framework", "part", "position", "reason"), fact, strict=True)]) for fact in facts])
    fits = lambda x: (x["framework"].isNull() | x["framework"].eqNullSafe(framework)) & F.contains(F.lower(F.coalesce(marker, F.lit(""))), x["part"])
    first = F.get(F.filter(known, fits), F.lit(0))
    return F.struct(first["position"].alias("position"), first["reason"].alias("reason"))


def looked_up(df: DataFrame, facts: DataFrame, keys: list[str], defaults: dict[str, str]) -> DataFrame:
    """df with the columns of a table of facts for its keys, in which each key stands once; what is not there takes its default."""
    found = df.join(facts, keys, "left")  # Spark broadcasts facts if its bytes are few
    return found.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def adjudicated(path_verified: Column, effects: Column) -> Column:
    return F.when(~holds(path_verified), "unknown_path").when(holds(effects > 0), "auditable").otherwise("no_effect")


def priority(name: Column, samples: Column, partial: list[str], core: list[str]) -> Column:
    """struct(support, key): key orders core names first, then by falling sample counts."""
    support = F.when(name.isin(partial), "partial").when(name.isin(core), "unsupported").otherwise("discovery")
    return F.struct(support.alias("support"), F.struct(F.when(name.isin(core), 0).otherwise(1).alias("outer"), (-samples).alias("inner")).alias("key"))


def frame_gate(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows in which every required column has a value other than an empty text or 0, the rest with the columns that lack one)."""
    absent = lambda c: ~holds((F.col(c).cast("string") != "") & ~F.col(c).cast("string").isin("0", "0.0", "false"))
    judged = df.withColumn("lacking", all_reasons([(absent(c), c) for c in required]))
    return judged.where(F.size("lacking") == 0).drop("lacking"), judged.where(F.size("lacking") > 0)


def policy_flags(owner: Column, path: Column, official: list[str], auxiliary: list[str]) -> Column:
    """The reasons for which a policy leaves a path out, as an array; none is an empty array."""
    parts = F.split(F.lower(path), "/")
    return all_reasons([(F.lower(owner).isin(official), "official_owner"), (F.arrays_overlap(parts, F.array(*map(F.lit, auxiliary))), "auxiliary_path")])


def repair_class(effect: Column, position: Column, controlled: Column) -> Column:
    """Five classes: what it would take to place a guard before the effect."""
    return (
        F.when(~holds(effect), "not_scored").when(holds(controlled), "controlled").when(position == "pre_effect_decidable", "placement_only").when(position == "post_effect_dependent", "requires_deferral").otherwise("manual_review")
    )


def hypothesis_status(accepted: Column, verdict: Column) -> Column:
    """What becomes of a model's finding: a decided one that is accepted stays a hypothesis."""
    return F.when(~holds(accepted), "rejected").when(verdict.isin("supported", "refuted"), "hypothesis_only").otherwise("no_claim")


def revalidated(claims: DataFrame, observed: DataFrame, keys: list[str], family: str) -> DataFrame:
    """claims with status: not_claimed without a family, confirmed if the family is among those observed for its key, else unconfirmed."""
    seen = observed.select(*keys, family).distinct().withColumn("__seen", F.lit(True))
    status = F.when(F.col(family).isNull(), "not_claimed").when(F.col("__seen"), "confirmed").otherwise("unconfirmed")
    return claims.join(seen, [*keys, family], "left").withColumn("status", status).drop("__seen")


def assembled(guards: DataFrame, effects: DataFrame, witnesses: DataFrame, unit: str, guard: str, effect: str) -> DataFrame:
    """(unit, guard, effects, witnessed, state) for each guard: its unit's effects matched with witnesses (unit, guard, effect, state).

    state is violation if a witness shows one, mediated if every effect of the unit has a mediating witness, no_effect without effects, else open.
    """
    every = guards.select(unit, guard).distinct().join(effects.select(unit, effect).distinct(), unit, "left")
    seen = witnesses.groupBy(unit, guard, effect).agg(some(F.col("state") == "violation").alias("__v"), some(F.col("state") == "mediated").alias("__m"))
    met = every.join(seen, [unit, guard, effect], "left").groupBy(unit, guard).agg(
        F.count(effect).alias("effects"), F.count("__v").alias("witnessed"), some(F.col("__v")).alias("__v"), F.count_if(holds(F.col("__m"))).alias("__m")
    )
    state = F.when(F.col("effects") == 0, "no_effect").when(F.col("__v"), "violation").when(F.col("__m") == F.col("effects"), "mediated").otherwise("open")
    return met.select(unit, guard, "effects", "witnessed", state.alias("state"))


def admitted_gold(df: DataFrame, verifier: str, label: str, registry: dict[str, Callable[[], Column]]) -> DataFrame:
    """df with admission: a label is admitted only if the registered verifier it names computes the same from the row's evidence."""
    computed = F.lit(None).cast("string")
    for name, make in registry.items():
        computed = F.when(F.col(verifier) == name, make()).otherwise(computed)
    status = F.when(~holds(F.col(verifier).isin(list(registry))), "unregistered").when(F.equal_null(computed, F.col(label)), "admitted").otherwise("mismatch")
    return df.withColumn("admission", status)
