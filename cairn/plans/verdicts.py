"""Queries on verdict rules, decoded records, inventories, closures and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import graph as G
from cairn.operators import metrics as M
from cairn.operators import records as R
from cairn.operators import sampling as S
from cairn.operators import verdicts as V
from cairn.operators import windows as W
from cairn.operators.joins import first_reason
from cairn.plans.base import REC, WIDE, arms, gathered_sql, records, table
from cairn.plans.graphs import _EDGES, _PATHS, _edges, deep_edges, multiples, shown, targets

TRI = {"present": "true", "absent": "false"}


def _wide(s, d):
    return arms(records(s, d))


def _tri(name):
    c = F.col(name)
    return F.when(c == "present", "true").when(c == "absent", "false").otherwise("unknown")


def _counts(df, *names):
    return df.groupBy(*names).agg(F.count("*").alias("n"))


def l_check(s, d):
    x = V.joint_claim({c: _tri(c) for c in ("length", "language", "marks")}, _tri("gold"))
    r = _wide(s, d).select(x.alias("x")).select("x.consistent", F.array_join("x.contradictions", ",").alias("contradictions"), "x.claim")
    return _counts(r, "consistent", "contradictions", "claim")


def l_actionable_effects(s, d):
    """Records that are good and not toxic, and all others: those without a label are among the others."""
    r = records(s, d)
    good, rest = V.split_by(r, (F.col("gold") == "present") & (F.col("toxic") == 0))
    side = lambda df, name: df.groupBy("source").agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "source", "n")
    return side(good, "actionable").unionByName(side(rest, "unknown"))


def _attested(s, d):
    effects = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    a = table(s, d, "orders").where("o_orderkey % 3 <> 0")
    key = F.when(F.col("o_orderkey") % 50 == 1, -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    customer = F.when(F.col("o_orderkey") % 7 == 1, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    digest = F.when(F.col("o_orderkey") % 11 == 1, "none").otherwise(F.sha2(F.col("o_orderkey").cast("string"), 256))
    verified = F.when(F.col("o_orderkey") % 13 != 1, F.col("o_totalprice") > 100000)
    a = a.select(key.alias("o_orderkey"), customer.alias("o_custkey"), digest.alias("evidence"), verified.alias("verified"))
    twice = a.unionByName(a.where("o_orderkey % 17 = 1"))
    return V.attached(effects, twice, "o_orderkey", ["o_custkey"], ["verified"], ["evidence"])


def l_attest_merge(s, d):
    return _counts(_attested(s, d)[0], "o_orderstatus", "verified")


def attestation_faults(s, d):
    return _counts(_attested(s, d)[1], "reason")


def l_observation(s, d):
    kind = F.when(F.col("event_type") == "error", "verdict").when(F.col("event_type") == "click", "attempt").when(F.col("event_type") == "purchase", "marker").otherwise("skip")
    e = table(s, d, "events").select("user_id", F.when(F.col("event_id") % 9 != 0, F.floor(F.col("event_id") / 400)).alias("invocation"), kind.alias("kind"), "value")
    return V.observations(e, "user_id", "invocation", "kind", F.col("user_id") % 10 != 0, F.col("value") > 5)


def l_fixture_pair(s, d):
    kind = F.element_at(F.array(*map(F.lit, ["verdict", "start", "select", "attempt", "marker", "note", "note"])), F.col("l_linenumber"))
    decision = F.when((F.col("l_linenumber") + F.col("l_orderkey")) % 2 == 0, "ALLOW").otherwise("DENY")
    both = F.explode(F.array(F.lit("ALLOW"), F.lit("DENY")))
    i = table(s, d, "lineitem").select("l_orderkey", kind.alias("kind"), F.when(F.col("l_linenumber") <= 4, F.lit(None)).otherwise(decision).alias("own"), both.alias("decision"))
    i = i.where("own is null or own = decision").withColumn("verdict", F.when(F.col("l_orderkey") % 8 == 0, "ALLOW").otherwise(F.col("decision")))
    return _counts(V.fixture_pairs(i, "l_orderkey", "decision", "kind", "verdict"), "fault")


def l_static_prediction(s, d):
    missing = F.filter(F.array(F.when(F.col("toxic").isNull(), "toxic"), F.when(F.col("n_chars") < 400, "size")), lambda x: x.isNotNull())
    x = V.gated_prediction(F.col("length") != "unknown", F.size(missing) == 0, F.lit("evidence_gate_not_ready"), missing, F.when(F.col("marks") != "unknown", F.col("marks") == "present"))
    return _counts(_wide(s, d).select(x.alias("x")).select("x.*"), "prediction", "status", "reason")


def l_dec_verify(s, d):
    label = F.when(F.col("gold") == "present", "VIOLATION").when(F.col("gold") == "absent", "CONFORMANT")
    x = V.proof_label(F.col("lang").isin("en", "de"), F.col("n_chars") > 500, label, F.coalesce("gold", F.lit("no_proof")))
    return _counts(_wide(s, d).select(x.alias("x")).select("x.*"), "label", "reason")


def l_pair_proof_reduce(s, d):
    label = F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.07), "violation").when(F.col("l_quantity") > 10, "conformant")
    x = V.reduce_pairs(table(s, d, "lineitem"), "l_orderkey", label, F.concat(F.col("l_returnflag"), F.lit("_"), F.col("l_linestatus")), (F.col("l_orderkey") % 5 == 0).cast("int"))
    return x.select("l_orderkey", "status", "label", "pairs", F.array_join("reasons", ",").alias("reasons"))


def l_critic_gate(s, d):
    expected = F.when(F.col("l_linenumber") == 7, "contradicted").otherwise("supported")
    analyst = F.when(F.col("l_quantity") < 40, expected).otherwise("unclear")
    critic = F.when(F.col("l_discount") < 0.095, expected).when(F.col("l_discount") < 0.1, "unclear")
    x = V.critic_gate(table(s, d, "lineitem"), "l_orderkey", "l_linenumber", expected, analyst, critic)
    return x.select("l_orderkey", "accepted", F.array_join(F.transform("corrections", lambda c: c.cast("string")), ",").alias("corrections"), F.array_join(F.transform("unresolved", lambda c: c.cast("string")), ",").alias("unresolved"))


def _scoped(s, d):
    r = _wide(s, d)
    scopes = r.groupBy("source", "lang").agg(F.count_distinct("doc_id").alias("scenarios")).select("source", "lang", "scenarios", F.when(F.col("lang") == "en", "open").otherwise("finite").alias("quantifier"), (F.col("scenarios") % 3 == 0).cast("int").alias("open_dimensions"))
    one = lambda df: df.withColumn("scope", F.concat_ws("/", "source", "lang"))
    # a scope's rows are verified where the language arm is not unknown
    return V.scoped_verdicts(one(r.where("n_chars > 20")).select("scope", "doc_id", F.when(F.col("marks") == "absent", "present").otherwise("absent").alias("label")), one(scopes), "scope", "doc_id", "label")


def l_scoped_finalize(s, d):
    hypothesis = F.when(F.col("lang") == "fr", "present").when(F.col("lang") == "es", "absent")
    return _scoped(s, d).withColumn("x", V.vetoed(F.col("verdict"), hypothesis)).select("scope", "reason", "x.prediction", "x.disagrees")


def l_four_arms(s, d):
    gold = F.coalesce("gold", F.lit("unknown"))
    x = V.four_arms(_wide(s, d), ["doc_id"], gold, F.col("n_chars") < 1000, F.when(F.col("doc_id") % 9 != 0, F.col("length")), F.when(F.col("doc_id") % 7 != 0, F.col("marks")))
    return _counts(x, "arm", "prediction", "status")


def l_assemble(s, d):
    o = table(s, d, "lineitem")
    guards, effects = o.where("l_linenumber <= 2").select("l_orderkey", F.col("l_linenumber").alias("guard")), o.where("l_linenumber > 2").select("l_orderkey", F.col("l_linenumber").alias("effect"))
    state = F.when(F.col("l_returnflag") == "R", "violation").otherwise("mediated")
    seen = o.where("l_linenumber > 2 and l_returnflag <> 'N'").select("l_orderkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("guard"), F.col("l_linenumber").alias("effect"), state.alias("state"))
    return _counts(V.assembled(guards, effects, seen, "l_orderkey", "guard", "effect"), "effects", "witnessed", "state")


_MARKERS = ["my_input_guardrail", "tool_output_guardrail", "task_guardrail", "Before_Model_Callback", "after_model_callback", "other", "wrap_tool_call"]
_FRAMEWORKS = ["crewai", "langchain", "google-adk"]


def _guards(s, d):
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
    return table(s, d, "part").select("p_partkey", pick(_FRAMEWORKS, F.col("p_size")).alias("framework"), pick(_MARKERS, F.col("p_partkey")).alias("marker"))


def f_lifecycle_class(s, d):
    return _counts(_guards(s, d).select("framework", "marker", V.lifecycle(F.col("framework"), F.col("marker")).alias("x")).select("framework", "marker", "x.*"), "framework", "marker", "position", "reason")


def l_guard_lifecycle(s, d):
    facts = s.createDataFrame([("langchain", "wrap_tool_call", "pre_effect_decidable"), ("crewai", "task_guardrail", "post_effect_dependent"), ("google-adk", "my_input_guardrail", "pre_effect_decidable")], "framework string, marker string, position string")
    return _counts(V.looked_up(_guards(s, d), facts, ["framework", "marker"], {"position": "unknown"}), "framework", "position")


def l_revalidate(s, d):
    r = records(s, d)
    claims = r.select("doc_id", F.when(F.col("toxic") == 1, "noise").when(F.col("toxic") == 0, "prose").alias("family"))
    noise = r.where(F.contains("text", F.lit("***"))).select("doc_id", F.lit("noise").alias("family"))
    prose = r.where(F.contains("text", F.lit(". "))).select("doc_id", F.lit("prose").alias("family"))
    return _counts(V.revalidated(claims, noise.unionByName(prose), ["doc_id"], "family"), "family", "status")


def f_adjudicate(s, d):
    return _counts(_wide(s, d).select(V.adjudicated(F.col("length") == "present", F.col("toxic") + 1).alias("status")), "status")


def f_priority_rank_key(s, d):
    from pyspark.sql import Window

    sizes = _counts(table(s, d, "documents"), "lang").withColumn("x", V.priority(F.col("lang"), F.col("n"), ["fr"], ["en", "fr"]))
    # one row for each name
    return sizes.select("lang", "n", F.col("x.support").alias("support"), F.row_number().over(Window.orderBy("x.key", "lang")).alias("rank"))


def f_static_frame_gate(s, d):
    good, rest = V.frame_gate(records(s, d), ["text", "lang", "gold", "toxic"])
    lacking = good.select(F.lit("").alias("lacking")).unionByName(rest.select(F.array_join("lacking", ",").alias("lacking")))
    return _counts(lacking, "lacking")


def f_repo_policy_flags(s, d):
    host, path = F.split_part(F.col("url"), F.lit("/"), F.lit(3)), F.regexp_replace("url", "^[a-z]+://[^/]*/?|[?#].*$", "")
    flags = V.policy_flags(F.split_part(host, F.lit("."), F.lit(1)), path, ["ththre", "the"], ["fr", "de"])
    return table(s, d, "pages").select("page_id", F.array_join(flags, ",").alias("flags"))


def f_repair_class(s, d):
    position = F.when(F.col("length") == "present", "pre_effect_decidable").when(F.col("length") == "absent", "post_effect_dependent")
    return _counts(_wide(s, d).select(V.repair_class(F.col("gold") == "present", position, F.col("marks") == "absent").alias("class")), "class")


def f_hypothesis(s, d):
    verdict = F.when(F.col("length") == "present", "supported").when(F.col("length") == "absent", "refuted").otherwise("unclear")
    return _counts(_wide(s, d).select(V.hypothesis_status(F.col("toxic") == 0, verdict).alias("status")), "status")


def id_gold_admit(s, d):
    own = _wide(s, d).withColumn("verifier", F.when(F.col("doc_id") % 10 == 0, "other").when(F.col("doc_id") % 2 == 0, "by_length").otherwise("by_marks"))
    registry = {"by_length": lambda: F.col("length"), "by_marks": lambda: F.col("marks")}
    return _counts(V.admitted_gold(own, "verifier", "gold", registry), "verifier", "admission")


_ITEM = "key bigint, items array<struct<line:int, flag:string, amount:double>>"
_RULES = [("amount", "item.amount >= 2"), ("flag", "trim(item.flag) <> ''"), ("line", "item.line between 1 and 7")]


def _units(s, d):
    """Orders as JSON texts; some are cut off, and some lines have no flag."""
    flag = F.when((F.col("l_orderkey") % 6 == 0) & (F.col("l_linenumber") == 2), " ").otherwise(F.col("l_returnflag"))
    item = F.struct(F.col("l_linenumber").alias("line"), flag.alias("flag"), F.col("l_quantity").alias("amount"))
    each = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_list(item).alias("items"))
    text = F.to_json(F.struct("key", "items"))
    return each.select("key", F.when(F.col("key") % 10 == 3, F.substring(text, 1, 12)).otherwise(text).alias("json"))


def u_decode_contracts(s, d):
    rows, down = R.decoded(_units(s, d), "json", _ITEM, "items", _RULES, ["key"])
    return rows.groupBy("flag").agg(F.count("*").alias("n"), F.count_distinct("key").alias("records")).select(F.concat(F.lit("rows "), F.col("flag")).alias("what"), "n", "records").unionByName(down.groupBy("reason").agg(F.count("*").alias("n"), F.count("*").alias("records")).select(F.concat(F.lit("down "), F.col("reason")).alias("what"), "n", "records"))


def u_decode_units(s, d):
    return _counts(R.isolated(_units(s, d), "json", _ITEM, "items", _RULES, ["key"]), "error", "flag")


def id_contract(s, d):
    return table(s, d, "documents").select("doc_id", R.record_id("record", F.col("source"), F.col("lang"), F.col("text")).alias("id"))


def id_citation_valid(s, d):
    own = table(s, d, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("digest"))
    changed = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0), F.sha2(F.col("digest"), 256)).otherwise(F.col("digest"))
    cited = own.select("conv_id", F.when(F.col("conv_id") % 7 == 0, F.col("turn") + 100).otherwise(F.col("turn")).alias("turn"), changed.alias("digest"))
    return R.citation_faults(cited, own, ["conv_id", "turn"], "digest").select("conv_id", "turn", "reason")


def id_tree_inventory(s, d):
    return R.tree_digest(table(s, d, "documents"), ["source"], "doc_id", "text")


def id_seal(s, d):
    return R.seal({"benchmark": (table(s, d, "benchmark"), "item_id"), "labels": (table(s, d, "labels"), "doc_id")})


def id_manifest_freeze(s, d):
    rows = table(s, d, "labels").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("evidence"))
    labels = table(s, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "present").when(F.col("quality") == 0, "absent").otherwise("unknown").alias("label"))
    return _counts(R.bound(R.frozen(rows, "doc_id", ["evidence"]), labels, "doc_id", "label", ["present", "absent", "unknown"]), "behavior_label")


def id_oracle_queue(s, d):
    census = table(s, d, "documents").select("doc_id", "source", "lang", F.lit(None).cast("string").alias("label"), F.lit("unverified").alias("state"))
    return R.label_free(census, ["doc_id", "source", "lang"], "label", "state")


def src_model_replay(s, d):
    c = table(s, d, "conversations")
    asks = c.where("role = 'user'").select("conv_id", "turn", "text")
    answers = c.where("role <> 'user'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    kept = asks.where("conv_id % 4 <> 0").join(answers, ["conv_id", "turn"])
    digest = F.when(F.col("conv_id") % 9 == 1, "x").otherwise(F.sha2("response", 256))
    return _counts(R.replayed(asks, kept.select(F.sha2("text", 256).alias("request_sha256"), "response", digest.alias("response_sha256")), "text"), "status")


def o_islice(s, d):
    sides = [table(s, d, "nation").select("n_name"), table(s, d, "region").select("r_name"), table(s, d, "orders").select("o_orderpriority").distinct()]
    return R.first_products(sides, ["n_name", "r_name", "o_orderpriority"], 256)


def o_min_counterexample(s, d):
    x = G.shortest_uncovered(deep_edges(s, d), s.range(1, 2), targets(s, 40, 61, 94, 148), multiples(s, d, 5))
    return x.select(F.col("node").alias("target"), F.col("paths").cast("long").alias("paths"), F.col("uncovered").cast("long").alias("uncovered"), shown("counterexample").alias("counterexample"))


def g_effect_reach(s, d):
    marks = table(s, d, "part").where("p_partkey % 97 = 0").select(F.col("p_partkey").alias("node"), F.concat(F.lit("effect"), (F.col("p_partkey") % 3).cast("string")).alias("effect"))
    return G.closure(_edges(s, d), marks, "effect")


def g_local_calls(s, d):
    return G.chains(_edges(s, d), s.range(1, 4)).select("root", "node", F.array_join(F.transform("chain", lambda c: c.cast("string")), ">").alias("chain"))


def _candidates(s, d):
    return table(s, d, "documents").join(table(s, d, "labels").select("doc_id", "toxic"), "doc_id", "left")


_OUT = [("toxic", "toxic = 1"), ("short", "n_chars < 300"), ("ambiguous", "doc_id % 6 = 0")]


def p_identity_freeze(s, d):
    chosen, _ = S.balanced(_candidates(s, d), "lang", "doc_id", [(F.expr(c), n) for n, c in _OUT], 8, "freeze")
    return chosen.select("doc_id", "lang", "rank")


def p_identity_exclusions(s, d):
    return S.balanced(_candidates(s, d), "lang", "doc_id", [(F.expr(c), n) for n, c in _OUT], 8, "freeze")[1]


def p_family_aware(s, d):
    return S.one_per_family(table(s, d, "documents"), "lang", "source", ["n_chars", "doc_id"], 3).select("doc_id", "lang", "source")


def a_wilson(s, d):
    each = records(s, d).where("gold is not null").groupBy("source").agg(F.count_if(F.col("gold") == "present").alias("k"), F.count("*").alias("n"))
    low, high = M.wilson(F.col("k") / F.col("n"), F.col("n"))
    return each.select("source", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def f_structured_redact(s, d):
    """Records whose text changes, by the digest of what is left."""
    # a generated row is computed once, where a filter and its column would each redact
    left = F.filter(F.array(X.redact_structured(F.col("text"))), lambda x: x != F.col("text"))
    return table(s, d, "documents").select("doc_id", F.explode(left).alias("left")).select("doc_id", F.sha2("left", 256).alias("digest"))


def p_round_robin(s, d):
    return W.family_round_robin(table(s, d, "documents").select("doc_id", "lang", "source", "n_chars"), "lang", "source", ["n_chars", "doc_id"], 15).select("doc_id", "lang", "source", "place")


def j_first_reasons(s, d):
    """Records by the first rule that leaves them out."""
    return _counts(_candidates(s, d).select(first_reason([(F.expr(c), n) for n, c in _OUT]).alias("reason")), "reason")


QUERIES = {f.__name__: f for f in (
    l_check, l_actionable_effects, l_attest_merge, attestation_faults, l_observation, l_fixture_pair, l_static_prediction, l_dec_verify, l_pair_proof_reduce, l_critic_gate, l_scoped_finalize, l_four_arms, l_assemble,
    f_lifecycle_class, l_guard_lifecycle, l_revalidate, f_adjudicate, f_priority_rank_key, f_static_frame_gate, f_repo_policy_flags, f_repair_class, f_hypothesis, id_gold_admit, u_decode_contracts, u_decode_units, id_contract,
    id_citation_valid, id_tree_inventory, id_seal, id_manifest_freeze, id_oracle_queue, src_model_replay, o_islice, o_min_counterexample, g_effect_reach, g_local_calls, p_identity_freeze, p_identity_exclusions, p_family_aware,
    j_first_reasons, a_wilson, f_structured_redact, p_round_robin,
)}

_T = "CASE {c} WHEN 'present' THEN 'true' WHEN 'absent' THEN 'false' ELSE 'unknown' END AS t_{c}"
_TRIS = ", ".join(_T.format(c=c) for c in ("length", "language", "marks", "gold"))
_SHA_EACH = "sha256({p}::VARCHAR||chr(0)||sha256({c})) AS dg"
_BODY = lambda cols: "||chr(0)||".join(f"coalesce({c}::VARCHAR, chr(1))" for c in cols)
_TREE = gathered_sql("{each}", "{k}", "{n}")
_GUARDS = f"g AS (SELECT p_partkey, {_FRAMEWORKS}[p_size%3+1] AS framework, {_MARKERS}[p_partkey%7+1] AS marker FROM part)"
_ATT = """a0 AS (SELECT CASE WHEN o_orderkey%50=1 THEN -o_orderkey ELSE o_orderkey END AS k, CASE WHEN o_orderkey%7=1 THEN o_custkey+1 ELSE o_custkey END AS c, CASE WHEN o_orderkey%11=1 THEN 'none' ELSE sha256(o_orderkey::VARCHAR) END AS e, CASE WHEN o_orderkey%13<>1 THEN o_totalprice>100000 END AS v FROM orders WHERE o_orderkey%3<>0),
a1 AS (SELECT k, any_value(c) AS c, any_value(e) AS e, any_value(v) AS v, count(*) AS m FROM (SELECT * FROM a0 UNION ALL SELECT * FROM a0 WHERE k%17=1) GROUP BY k),
a AS (SELECT a1.*, CASE WHEN m>1 THEN 'repeated' WHEN o_orderkey IS NULL THEN 'unknown' WHEN c<>o_custkey THEN 'other_o_custkey' WHEN v IS NULL THEN 'no_verified' WHEN e='none' THEN 'bad_evidence' END AS reason FROM a1 LEFT JOIN orders ON o_orderkey=k)"""
_UNITS = """u AS (SELECT l_orderkey AS k, l_orderkey%10=3 AS bad, CASE WHEN l_orderkey%6=0 AND l_linenumber=2 THEN ' ' ELSE l_returnflag END AS flag, CASE WHEN l_quantity<2 THEN 1 WHEN l_orderkey%6=0 AND l_linenumber=2 THEN 2 END AS rule FROM lineitem)"""
_NAMED = "CASE rule WHEN 1 THEN 'amount' WHEN 2 THEN 'flag' END"
_WHY = "CASE WHEN toxic=1 THEN 'toxic' WHEN n_chars<300 THEN 'short' WHEN doc_id%6=0 THEN 'ambiguous' END AS reason"


def _one_per_family_sql(strata):
    """Stratum by stratum: the first row of each family not taken before, and of these the first three."""
    steps, before = [], []
    for i, stratum in enumerate(strata):
        taken = f" AND source NOT IN ({' UNION ALL '.join(f'SELECT source FROM s{j}' for j in before)})" if before else ""
        steps.append(f"s{i} AS (SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS r FROM documents WHERE lang='{stratum}'{taken}) WHERE r=1 ORDER BY n_chars, doc_id LIMIT 3)")
        before.append(i)
    return "WITH " + ", ".join(steps).replace("SELECT doc_id, lang, source FROM (SELECT *", "SELECT doc_id, lang, source FROM (SELECT *") + " " + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in before)


_KEY = r"(?i)(\"[^\"\n]*(?:" + "|".join(X.SECRET_WORDS) + r")[^\"\n]*\"|[a-z0-9_.-]*(?:" + "|".join(X.SECRET_WORDS) + r")[a-z0-9_.-]*)"
_BEARER = X.BEARER
SQL = {
    "l_check": f"""WITH {WIDE}, t AS (SELECT {_TRIS} FROM wide), c AS (SELECT *, concat_ws(',', CASE WHEN t_gold='true' AND t_language='false' THEN 'language' END, CASE WHEN t_gold='true' AND t_length='false' THEN 'length' END, CASE WHEN t_gold='true' AND t_marks='false' THEN 'marks' END) AS contradictions FROM t)
SELECT contradictions='' AS consistent, contradictions, CASE WHEN contradictions<>'' OR NOT (t_length='true' AND t_language='true' AND t_marks='true') THEN 'unknown' WHEN t_gold='true' THEN 'present' WHEN t_gold='false' THEN 'absent' ELSE 'unknown' END AS claim, count(*) AS n FROM c GROUP BY ALL""",
    "l_actionable_effects": f"WITH {REC} SELECT CASE WHEN gold='present' AND toxic=0 THEN 'actionable' ELSE 'unknown' END AS side, source, count(*) AS n FROM rec GROUP BY ALL",
    "l_attest_merge": f"WITH {_ATT} SELECT o_orderstatus, v AS verified, count(*) AS n FROM orders LEFT JOIN (SELECT * FROM a WHERE reason IS NULL) ON k=o_orderkey GROUP BY ALL",
    "attestation_faults": f"WITH {_ATT} SELECT reason, count(*) AS n FROM a WHERE reason IS NOT NULL GROUP BY 1",
    "l_observation": """WITH e AS (SELECT user_id, CASE WHEN event_id%9<>0 THEN event_id//400 END AS i, event_type AS t, value FROM events),
g AS (SELECT user_id, i, bool_or(t<>'purchase') AS lg, bool_or(t='purchase') AS mk, count(*) FILTER (t NOT IN ('error','click','purchase')) AS sk, count(*) FILTER (t='purchase') AS c, count(*) FILTER (t='click') AS a, count(*) FILTER (t='error' AND value>5) AS d FROM e GROUP BY ALL),
u AS (SELECT user_id, sum(d)::BIGINT AS denials, sum(a)::BIGINT AS attempts, sum(c)::BIGINT AS commits, sum(sk) AS sk, count(*) FILTER (i IS NOT NULL AND lg)>0 AS named, coalesce(bool_and(lg=mk) FILTER (i IS NOT NULL), false) AS same, coalesce(bool_and(sk>0) FILTER (i IS NOT NULL AND lg), false) AS skipped FROM g GROUP BY 1)
SELECT user_id, CASE WHEN user_id%10<>0 THEN 'scored' ELSE 'error' END AS status, denials, attempts, commits, denials>0 AND commits>0 AS violation, (named AND same) OR (commits=0 AND attempts=0 AND sk=1 AND named AND skipped) AS correlated FROM u""",
    "l_fixture_pair": """WITH i AS (SELECT l_orderkey, l_linenumber AS k, unnest(['ALLOW','DENY']) AS dec, CASE WHEN l_linenumber>4 THEN CASE WHEN (l_linenumber+l_orderkey)%2=0 THEN 'ALLOW' ELSE 'DENY' END END AS own FROM lineitem),
r AS (SELECT l_orderkey, dec, count(*) FILTER (k=1) AS v, count(*) FILTER (k=1 AND (l_orderkey%8<>0 OR dec='ALLOW')) AS good, count(*) FILTER (k=5) AS m, bool_or(k=2) AS st, bool_or(k=2) AND bool_or(k=3) AND bool_or(k=4) AS tried FROM i WHERE own IS NULL OR own=dec GROUP BY 1,2),
f AS (SELECT l_orderkey, CASE WHEN v<>1 OR good<>1 THEN 'verdict' WHEN dec='ALLOW' AND m<>1 THEN 'allow_marker' WHEN dec='DENY' AND m>0 THEN 'deny_marker' WHEN (dec='ALLOW' AND NOT tried) OR (dec='DENY' AND NOT st) THEN 'events' END AS fault FROM r),
p AS (SELECT l_orderkey, CASE WHEN count(*)<>2 THEN 'pair' ELSE min(fault) END AS fault FROM f GROUP BY 1) SELECT fault, count(*) AS n FROM p GROUP BY 1""",
    "l_static_prediction": f"""WITH {WIDE}, m AS (SELECT *, concat_ws(',', CASE WHEN toxic IS NULL THEN 'toxic' END, CASE WHEN n_chars<400 THEN 'size' END) AS missing FROM wide),
x AS (SELECT *, CASE WHEN length='unknown' THEN 'static_certificate_unsupported' WHEN missing<>'' THEN 'evidence_gate_not_ready:'||missing WHEN marks='unknown' THEN 'certificate_without_issue_prediction' ELSE 'certificate_and_gate_verified' END AS reason FROM m)
SELECT CASE WHEN reason='certificate_and_gate_verified' THEN marks='present' END AS prediction, CASE WHEN reason='certificate_and_gate_verified' THEN 'known' ELSE 'unknown' END AS status, reason, count(*) AS n FROM x GROUP BY ALL""",
    "l_dec_verify": f"WITH {WIDE} SELECT CASE WHEN lang NOT IN ('en','de') THEN 'EXCLUDED' WHEN n_chars<=500 THEN 'UNKNOWN' WHEN gold='present' THEN 'VIOLATION' WHEN gold='absent' THEN 'CONFORMANT' ELSE 'UNKNOWN' END AS label, CASE WHEN lang NOT IN ('en','de') THEN 'other_protocol' WHEN n_chars<=500 THEN 'structure_unproven' ELSE coalesce(gold,'no_proof') END AS reason, count(*) AS n FROM wide GROUP BY ALL",
    "l_pair_proof_reduce": """WITH p AS (SELECT l_orderkey, CASE WHEN l_returnflag='R' AND l_discount>0.07 THEN 'violation' WHEN l_quantity>10 THEN 'conformant' END AS label, l_returnflag||'_'||l_linestatus AS reason FROM lineitem),
r AS (SELECT l_orderkey, string_agg(reason||'='||n, ',' ORDER BY reason||'='||n) AS reasons FROM (SELECT l_orderkey, reason, count(*) AS n FROM p WHERE label IS NULL GROUP BY 1,2) GROUP BY 1),
f AS (SELECT l_orderkey, CASE WHEN bool_or(coalesce(label='violation',false)) THEN 'violation' WHEN count(*) FILTER (label='conformant')=count(*) AND l_orderkey%5<>0 THEN 'conformant' END AS label, count(*) AS pairs FROM p GROUP BY 1)
SELECT l_orderkey, CASE WHEN label IS NULL THEN 'unknown' ELSE 'proved' END AS status, label, pairs, CASE WHEN label IS NULL THEN coalesce(reasons,'') END AS reasons FROM f LEFT JOIN r USING (l_orderkey)""",
    "l_critic_gate": """WITH c AS (SELECT l_orderkey, l_linenumber AS k, l_discount<0.095 AS good, l_quantity<40 AS was FROM lineitem)
SELECT l_orderkey, bool_and(good) AS accepted, coalesce(string_agg(k::VARCHAR, ',' ORDER BY k) FILTER (good AND NOT was),'') AS corrections, coalesce(string_agg(k::VARCHAR, ',' ORDER BY k) FILTER (NOT good),'') AS unresolved FROM c GROUP BY 1""",
    "l_scoped_finalize": f"""WITH {WIDE}, s AS (SELECT source, lang, count(DISTINCT doc_id) AS scenarios FROM wide GROUP BY 1,2),
r AS (SELECT source, lang, bool_or(marks='absent') AS hit, bool_and(marks<>'absent') AS clear, count(DISTINCT doc_id) AS n FROM wide WHERE n_chars>20 GROUP BY 1,2),
x AS (SELECT s.source, s.lang, CASE WHEN coalesce(hit,false) THEN 'positive_witness' WHEN s.lang='en' THEN 'open_domain' WHEN scenarios%3=0 THEN 'open_dimensions' WHEN coalesce(clear,false) AND coalesce(n,0)=scenarios THEN 'all_scenarios_absent' ELSE 'incomplete' END AS reason FROM s LEFT JOIN r USING (source, lang)),
v AS (SELECT *, CASE reason WHEN 'positive_witness' THEN 'present' WHEN 'all_scenarios_absent' THEN 'absent' ELSE 'unknown' END AS verdict, CASE lang WHEN 'fr' THEN 'present' WHEN 'es' THEN 'absent' END AS h FROM x)
SELECT source||'/'||lang AS scope, reason, CASE WHEN verdict<>'unknown' AND h<>verdict THEN 'unknown' ELSE verdict END AS prediction, coalesce(verdict<>'unknown' AND h<>verdict, false) AS disagrees FROM v""",
    "l_four_arms": f"""WITH {WIDE}, r AS (SELECT doc_id, coalesce(gold,'unknown') AS st, n_chars<1000 AS un, CASE WHEN doc_id%9<>0 THEN length END AS a, CASE WHEN doc_id%7<>0 THEN marks END AS c FROM wide),
q AS (SELECT *, CASE WHEN a IS NULL OR c IS NULL THEN NULL WHEN a=c THEN a ELSE 'unknown' END AS pair FROM r),
x AS (SELECT 'static' AS arm, st AS p, CASE WHEN un AND st='unknown' THEN 'unsupported' ELSE 'completed' END AS status FROM q UNION ALL SELECT 'llm_only', coalesce(pair,'unknown'), CASE WHEN pair IS NULL THEN 'error' ELSE 'completed' END FROM q
UNION ALL SELECT 'static_analyst', p, CASE WHEN a IS NULL THEN 'error' WHEN un AND p='unknown' THEN 'unsupported' ELSE 'completed' END FROM (SELECT *, CASE WHEN a IS NULL OR (st<>'unknown' AND a<>'unknown' AND a<>st) THEN 'unknown' ELSE st END AS p FROM q)
UNION ALL SELECT 'full', p, CASE WHEN pair IS NULL THEN 'error' WHEN un AND p='unknown' THEN 'unsupported' ELSE 'completed' END FROM (SELECT *, CASE WHEN pair IS NULL OR (st<>'unknown' AND pair<>'unknown' AND pair<>st) THEN 'unknown' ELSE st END AS p FROM q))
SELECT arm, p AS prediction, status, count(*) AS n FROM x GROUP BY ALL""",
    "l_assemble": """WITH g AS (SELECT DISTINCT l_orderkey, l_linenumber AS gd FROM lineitem WHERE l_linenumber<=2), e AS (SELECT l_orderkey, l_linenumber AS ef, bool_or(l_returnflag='R') AS v, bool_or(l_returnflag='A') AS m, bool_or(l_returnflag<>'N') AS w FROM lineitem WHERE l_linenumber>2 GROUP BY 1,2),
x AS (SELECT g.l_orderkey, gd, count(ef) AS effects, count(*) FILTER (w) AS witnessed, coalesce(bool_or(v),false) AS v, count(*) FILTER (m) AS m FROM g LEFT JOIN e USING (l_orderkey) GROUP BY 1,2)
SELECT effects, witnessed, CASE WHEN effects=0 THEN 'no_effect' WHEN v THEN 'violation' WHEN m=effects THEN 'mediated' ELSE 'open' END AS state, count(*) AS n FROM x GROUP BY ALL""",
    "f_lifecycle_class": f"""WITH {_GUARDS}, m(marker, position, reason) AS (VALUES
('my_input_guardrail', 'pre_effect_decidable', 'guard contract executes before protected tool dispatch'), ('wrap_tool_call', 'pre_effect_decidable', 'guard contract executes before protected tool dispatch'),
('tool_output_guardrail', 'post_effect_dependent', 'guard contract executes after protected tool or model output'), ('Before_Model_Callback', 'pre_effect_decidable', 'callback executes before model-driven tool selection'),
('after_model_callback', 'unknown_dynamic', 'after-model position alone does not establish ordering relative to tool effects'))
SELECT framework, marker, CASE WHEN framework='crewai' AND marker='task_guardrail' THEN 'post_effect_dependent' ELSE coalesce(position, 'unknown_dynamic') END AS position,
CASE WHEN framework='crewai' AND marker='task_guardrail' THEN 'CrewAI task guardrail validates task output after task execution' ELSE coalesce(reason, 'no pinned lifecycle contract matched the guard marker') END AS reason,
count(*) AS n FROM g LEFT JOIN m USING (marker) GROUP BY ALL""",
    "l_guard_lifecycle": f"WITH {_GUARDS} SELECT framework, CASE WHEN framework='langchain' AND marker='wrap_tool_call' THEN 'pre_effect_decidable' WHEN framework='crewai' AND marker='task_guardrail' THEN 'post_effect_dependent' WHEN framework='google-adk' AND marker='my_input_guardrail' THEN 'pre_effect_decidable' ELSE 'unknown' END AS position, count(*) AS n FROM g GROUP BY ALL",
    "l_revalidate": f"WITH {REC}, c AS (SELECT CASE toxic WHEN 1 THEN 'noise' WHEN 0 THEN 'prose' END AS family, contains(text,'***') AS noise, contains(text,'. ') AS prose FROM rec) SELECT family, CASE WHEN family IS NULL THEN 'not_claimed' WHEN (family='noise' AND noise) OR (family='prose' AND prose) THEN 'confirmed' ELSE 'unconfirmed' END AS status, count(*) AS n FROM c GROUP BY ALL",
    "f_adjudicate": f"WITH {WIDE} SELECT CASE WHEN length<>'present' THEN 'unknown_path' WHEN toxic+1>0 THEN 'auditable' ELSE 'no_effect' END AS status, count(*) AS n FROM wide GROUP BY 1",
    "f_priority_rank_key": "SELECT lang, n, CASE WHEN lang='fr' THEN 'partial' WHEN lang='en' THEN 'unsupported' ELSE 'discovery' END AS support, row_number() OVER (ORDER BY lang NOT IN ('en','fr'), -n, lang)::INTEGER AS rank FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)",
    "f_static_frame_gate": f"WITH {REC}, l AS (SELECT concat_ws(',', CASE WHEN coalesce(text,'')='' OR text IN ('0','0.0','false') THEN 'text' END, CASE WHEN coalesce(lang,'')='' THEN 'lang' END, CASE WHEN gold IS NULL THEN 'gold' END, CASE WHEN coalesce(toxic,0)=0 THEN 'toxic' END) AS lacking FROM rec) SELECT lacking, count(*) AS n FROM l GROUP BY 1",
    "f_repo_policy_flags": "WITH p AS (SELECT page_id, split_part(split_part(url,'/',3),'.',1) AS owner, string_split(lower(regexp_replace(regexp_replace(url,'^[a-z]+://[^/]*/?',''),'[?#].*$','')),'/') AS parts FROM pages) SELECT page_id, concat_ws(',', CASE WHEN lower(owner) IN ('ththre','the') THEN 'official_owner' END, CASE WHEN list_has_any(parts,['fr','de']) THEN 'auxiliary_path' END) AS flags FROM p",
    "f_repair_class": f"WITH {WIDE} SELECT CASE WHEN coalesce(gold,'')<>'present' THEN 'not_scored' WHEN marks='absent' THEN 'controlled' WHEN length='present' THEN 'placement_only' WHEN length='absent' THEN 'requires_deferral' ELSE 'manual_review' END AS class, count(*) AS n FROM wide GROUP BY 1",
    "f_hypothesis": f"WITH {WIDE} SELECT CASE WHEN toxic IS NULL OR toxic<>0 THEN 'rejected' WHEN length IN ('present','absent') THEN 'hypothesis_only' ELSE 'no_claim' END AS status, count(*) AS n FROM wide GROUP BY 1",
    "id_gold_admit": f"WITH {WIDE}, v AS (SELECT *, CASE WHEN doc_id%10=0 THEN 'other' WHEN doc_id%2=0 THEN 'by_length' ELSE 'by_marks' END AS verifier FROM wide) SELECT verifier, CASE WHEN verifier='other' THEN 'unregistered' WHEN gold IS NOT DISTINCT FROM CASE verifier WHEN 'by_length' THEN length ELSE marks END THEN 'admitted' ELSE 'mismatch' END AS admission, count(*) AS n FROM v GROUP BY ALL",
    "u_decode_contracts": f"WITH {_UNITS}, w AS (SELECT k, bool_or(bad) AS bad, min(rule) AS rule FROM u GROUP BY 1) SELECT 'rows '||flag AS what, count(*) AS n, count(DISTINCT k) AS records FROM u JOIN w USING (k) WHERE NOT w.bad AND w.rule IS NULL GROUP BY 1 UNION ALL SELECT 'down '||CASE WHEN bad THEN 'shape' ELSE {_NAMED} END, count(*), count(*) FROM w WHERE bad OR rule IS NOT NULL GROUP BY 1",
    "u_decode_units": f"WITH {_UNITS} SELECT error, flag, count(*) AS n FROM (SELECT DISTINCT ON (k) 'shape' AS error, NULL AS flag FROM u WHERE bad UNION ALL SELECT {_NAMED}, CASE WHEN rule IS NULL THEN flag END FROM u WHERE NOT bad) GROUP BY ALL",
    "id_contract": "SELECT doc_id, 'record:'||sha256(source||chr(0)||lang||chr(0)||text)[1:32] AS id FROM documents",
    "id_citation_valid": "WITH c AS (SELECT conv_id, CASE WHEN conv_id%7=0 THEN turn+100 ELSE turn END AS turn, turn AS was FROM conversations) SELECT conv_id, turn, CASE WHEN conv_id%7=0 THEN 'not_supplied' ELSE 'changed' END AS reason FROM c WHERE conv_id%7=0 OR (conv_id%5=0 AND was=0)",
    "id_tree_inventory": _TREE.format(k="source", n="files", each=f"SELECT source, {_SHA_EACH.format(p='doc_id', c='text')} FROM documents"),
    "id_seal": "WITH t AS ("
    + " UNION ALL ".join(
        "SELECT name, rows, digest FROM (" + _TREE.format(k="name", n="rows", each=f"SELECT '{name}' AS name, {_SHA_EACH.format(p=key, c=_BODY(cols))} FROM {name}") + ")" for name, key, cols in (("benchmark", "item_id", ["item_id", "text"]), ("labels", "doc_id", ["doc_id", "quality", "toxic"]))
    )
    + ") SELECT name, rows, digest, (SELECT sha256(string_agg(name||'='||digest, ',' ORDER BY name)) FROM t) AS seal_id FROM t",
    "id_manifest_freeze": "SELECT CASE quality WHEN 1 THEN 'present' WHEN 0 THEN 'absent' ELSE 'unknown' END AS behavior_label, count(*) AS n FROM labels GROUP BY 1",
    "id_oracle_queue": "SELECT doc_id, source, lang, 'unverified' AS runtime_state, NULL::VARCHAR AS behavior_label FROM documents",
    "src_model_replay": """WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE role='user'), k AS (SELECT a.text, a.conv_id%9=1 AS bad FROM a JOIN conversations c ON c.conv_id=a.conv_id AND c.turn=a.turn+1 AND c.role<>'user' WHERE a.conv_id%4<>0), o AS (SELECT text, count(*) AS m, bool_or(bad) AS bad FROM k GROUP BY 1)
SELECT CASE WHEN m IS NULL THEN 'missing' WHEN m>1 THEN 'ambiguous' WHEN bad THEN 'changed' ELSE 'replayed' END AS status, count(*) AS n FROM a LEFT JOIN o USING (text) GROUP BY 1""",
    "o_islice": "SELECT n_name, r_name, o_orderpriority FROM nation CROSS JOIN region CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) ORDER BY ALL LIMIT 256",
    # one step for each turn and stratum; idle counts the steps since a row was taken
    "p_round_robin": """WITH RECURSIVE s AS (SELECT list(DISTINCT lang ORDER BY lang) AS names FROM documents), best AS (SELECT lang, source, min({'n': n_chars, 'd': doc_id}) AS x FROM documents GROUP BY 1, 2),
r AS (SELECT 0 AS step, 0 AS idle, []::VARCHAR[] AS taken, NULL::BIGINT AS doc_id, NULL::VARCHAR AS lang, NULL::VARCHAR AS source, 0 AS place, names FROM s
UNION ALL SELECT step+1, CASE WHEN y IS NULL THEN idle+1 ELSE 0 END, CASE WHEN y IS NULL THEN taken ELSE list_append(taken, y.s) END, y.x.d, names[step%len(names)+1], y.s, CASE WHEN y IS NULL THEN place ELSE place+1 END, names
FROM (SELECT *, (SELECT min({'x': x, 's': b.source}) FROM best b WHERE b.lang=names[step%len(names)+1] AND NOT list_contains(taken, b.source)) AS y FROM r WHERE place<15 AND idle<len(names)))
SELECT doc_id, lang, source, place FROM r WHERE doc_id IS NOT NULL""",
    "o_min_counterexample": f"WITH RECURSIVE {_PATHS}, c AS (SELECT path, len(list_filter(path, lambda x: x%5=0))>0 AS covered FROM p WHERE path[-1] IN (40,61,94,148)) SELECT path[-1] AS target, count(*) AS paths, count(*) FILTER (NOT covered) AS uncovered, array_to_string((min({{'n': len(path), 'p': path}}) FILTER (NOT covered)).p, '>') AS counterexample FROM c GROUP BY 1",
    "g_effect_reach": f"WITH RECURSIVE {_EDGES}, r AS (SELECT p_partkey AS node, 'effect'||(p_partkey%3) AS effect, 0 AS depth FROM part WHERE p_partkey%97=0 UNION SELECT src, effect, depth+1 FROM r JOIN edges ON dst=node WHERE depth<30) SELECT node, effect, min(depth) AS depth FROM r GROUP BY 1,2",
    "g_local_calls": f"WITH RECURSIVE {_EDGES}, r AS (SELECT i AS root, i AS node, [i] AS chain FROM unnest([1::BIGINT,2,3]) t(i) UNION ALL SELECT root, dst, list_append(chain,dst) FROM r JOIN edges ON src=node WHERE NOT list_contains(chain,dst)) SELECT root, node, array_to_string((min({{'n': len(chain), 'c': chain}})).c, '>') AS chain FROM r GROUP BY 1,2",
    "p_identity_freeze": f"WITH c AS (SELECT d.*, {_WHY} FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT doc_id, lang, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('freeze'||chr(0)||lang||chr(0)||doc_id::VARCHAR), doc_id) AS r FROM c WHERE reason IS NULL) WHERE r<=8",
    "p_identity_exclusions": f"WITH c AS (SELECT {_WHY} FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT reason, count(*) AS n FROM c WHERE reason IS NOT NULL GROUP BY 1",
    "p_family_aware": _one_per_family_sql(["de", "en", "es", "fr"]),
    "j_first_reasons": f"WITH c AS (SELECT {_WHY} FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT reason, count(*) AS n FROM c GROUP BY 1",
    "a_wilson": f"WITH {REC}, g AS (SELECT source, count(*) FILTER (gold='present') AS k, count(*) AS n, count(*) FILTER (gold='present')/count(*)::DOUBLE AS p FROM rec WHERE gold IS NOT NULL GROUP BY 1), w AS (SELECT *, (p+1.96*1.96/(2*n))/(1+1.96*1.96/n) AS c, 1.96/(1+1.96*1.96/n)*sqrt(p*(1-p)/n+1.96*1.96/(4*n*n)) AS h FROM g) SELECT source, k, n, round(greatest(0,least(p,c-h)),6) AS low, round(least(1,greatest(p,c+h)),6) AS high FROM w",
    # a value that is true, false or null stays: here a mark is put before it and taken away again
    "f_structured_redact": rf"""WITH a AS (SELECT doc_id, text, regexp_replace(text,'-----BEGIN [A-Z0-9 ]+-----[^-]*(?:-[^-]+)*-----END [A-Z0-9 ]+-----','[MASKED]','g') AS t FROM documents),
b AS (SELECT doc_id, text, regexp_replace(regexp_replace(t,'{_KEY}(\s*[:=]\s*)"(?:[^"\\\n]|\\.)*"','\1\2"[MASKED]"','g'),'{_KEY}(\s*[:=]\s*)''[^''\n]*''','\1\2''[MASKED]''','g') AS t FROM a),
c AS (SELECT doc_id, text, regexp_replace(t,'{_KEY}([ \t]*[:=][ \t]*)(true|false|null)\b','\1\2{{\3','g') AS t FROM b),
e AS (SELECT doc_id, text, regexp_replace(regexp_replace(t,'{_KEY}([ \t]*[:=][ \t]*)([^\s"''\[{{,}}\]][^\n,}}\]]*)','\1\2[MASKED]','g'),'{_KEY}([ \t]*[:=][ \t]*)\{{(true|false|null)\b','\1\2\3','g') AS t FROM c),
f AS (SELECT doc_id, text, regexp_replace(t,'{_BEARER}','\1[MASKED]','g') AS t FROM e) SELECT doc_id, sha256(t) AS digest FROM f WHERE t<>text""",
}
