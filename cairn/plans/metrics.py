"""Queries on counts, confusion, weighted metrics, agreement and bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import lattices as L
from cairn.operators import metrics as M
from cairn.operators import windows as W
from cairn.plans.base import ARMS, PRED, REC, WIDE, arms, predictions, records, rounded, table

RATIOS = ["precision", "recall", "coverage", "decided_accuracy", "selective_risk"]


def confusion_by_arm(s, d):
    return rounded(M.confusion(predictions(s, d), ["arm"]), *RATIOS)


def confusion_by_arm_and_stratum(s, d):
    return rounded(M.confusion(predictions(s, d), ["arm", "lang"]), *RATIOS)


def a_confusion_fnabst(s, d):
    return rounded(M.confusion_missed(predictions(s, d), ["arm"]), "precision", "recall")


def a_truth_matrix(s, d):
    return M.truth_matrix(predictions(s, d))


def a_count_by(s, d):
    return M.count_by(predictions(s, d).where("arm = 'length'"), "prediction", M.LABELS)


def a_count_pivot(s, d):
    return predictions(s, d).where("arm = 'marks'").groupBy("source").pivot("prediction", M.LABELS).agg(F.count(F.lit(1))).na.fill(0)


def strata_marginals(s, d):
    return M.marginals(records(s, d).withColumn("label", F.coalesce("gold", F.lit("unknown"))), ["lang", "source", "toxic"], "label")


def a_explode_count(s, d):
    reasons = F.filter(F.array(F.when(F.col("n_chars") < 300, "short"), F.when(F.contains("text", F.lit("***")), "marked"), F.when(F.col("gold").isNull(), "unlabelled")), lambda x: x.isNotNull())
    return records(s, d).select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def a_count_distinct(s, d):
    return records(s, d).groupBy("lang").agg(F.count_distinct("source").alias("sources"), F.count_distinct("text").alias("texts"))


def a_conditional_sum(s, d):
    return predictions(s, d).groupBy("arm").agg(F.count_if(F.col("prediction") == "present").alias("present"), F.sum(F.when(F.col("prediction") == "unknown", F.col("n_chars")).otherwise(0)).alias("undecided_chars"))


def a_group_flags(s, d):
    return records(s, d).groupBy("source").agg(F.bool_or(F.coalesce(F.col("gold") == "absent", F.lit(False))).alias("some_absent"), F.bool_and(F.coalesce(F.col("gold") == "present", F.lit(False))).alias("all_present"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


def cluster_bounds(s, d):
    return rounded(M.cluster_bounds(records(s, d), "source", "gold"), "lower", "upper")


def ident_bounds(s, d):
    return rounded(M.bounds(records(s, d), ["lang"], "gold"), "coverage", "lower", "upper", "decided_share")


def a_arm_compare(s, d):
    p = predictions(s, d).groupBy("arm").agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("records"), F.sha2(F.array_join(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))), ","), 256).alias("inventory"))
    return p.withColumn("comparable", F.col("rows") == F.col("records"))


def a_fault_summary(s, d):
    p = predictions(s, d).withColumn("w", 1.0 / (1 + F.col("doc_id") % 4))
    g, x = F.col("gold"), F.col("prediction")
    cells = {"tp": (g == "present") & (x == "present"), "fp": (g == "absent") & (x == "present"), "fn": (g == "present") & (x != "present"), "tn": (g == "absent") & (x == "absent")}
    return p.groupBy("arm").agg(*[F.count_if(c).alias(n) for n, c in cells.items()], *[F.round(F.sum(F.when(c, F.col("w")).otherwise(0.0)), 8).alias(f"w_{n}") for n, c in cells.items()])


def _sample(s, d):
    return W.hash_sample(arms(records(s, d)), "lang", "doc_id", 60, "s1")


def ipw_metrics(s, d):
    p = _sample(s, d).withColumn("prediction", F.col("length"))
    out = M.weighted_metrics(p, ["lang"], 1 / F.col("probability"))
    names = ["precision", "recall", "decision_coverage", "oracle_coverage", "effective_n"]
    low, high = M.wilson(F.col("precision"), F.col("effective_n"))
    return rounded(out.withColumns({"low": low, "high": high}).select("lang", *names, "low", "high"), *names, "low", "high", places=6)


def kappa(s, d):
    both = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(M.kappa(both, ["lang"], "quality", "toxic"), "agreement", "kappa")


def source_quantiles(s, d):
    return rounded(M.quartiles(table(s, d, "documents"), ["source"], "n_chars"), "q1", "median", "q3", places=4)


def bootstrap_ci(s, d):
    p = predictions(s, d).where("arm = 'language' and gold is not null and prediction <> 'unknown'")
    return rounded(M.cluster_bootstrap(p, "source", (F.col("gold") == F.col("prediction")).cast("int"), F.lit(1)), "point", "lower", "upper", places=6)


def a_argmin_minN(s, d):
    cells = M.bounds(records(s, d), ["source"], "gold").where("n >= 10")
    return rounded(cells.agg(F.min_by(F.struct("source", "n", "coverage"), F.struct("coverage", "source")).alias("m")).select("m.*"), "coverage")


def a_parent_rollup(s, d):
    children = records(s, d).where("toxic is not null").select("source", "gold")
    parents = table(s, d, "documents").select("source").distinct()
    rolled = children.groupBy("source").agg(M.rollup_label(F.col("gold")).alias("label"), F.count("*").alias("children"))
    return parents.join(rolled, "source", "left").withColumn("children", F.coalesce("children", F.lit(0)).cast("long"))


def a_usage_sum(s, d):
    return records(s, d).groupBy("source").agg(M.sum_or_null(F.col("toxic").cast("long")).alias("used"), F.count("*").alias("calls"))


def a_health_rollup(s, d):
    done = F.count_if(F.col("gold").isNotNull())
    return records(s, d).groupBy("source").agg(F.when(done == F.count("*"), "completed").when(done > 0, "partial").otherwise("error").alias("health"))


def a_family_counts(s, d):
    fam = table(s, d, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("members"))
    return fam.agg(F.count("*").alias("families"), F.sum("members").alias("members")).withColumn("duplicates", F.col("members") - F.col("families"))


def a_coverage_summary(s, d):
    targets = s.createDataFrame([(x,) for x in ("de", "en", "es", "fr", "it")], "lang string")
    found = records(s, d).groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))
    return targets.join(found, "lang", "left").select("lang", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("sources", F.lit(0)).cast("long").alias("sources"))


def a_signature_inventory(s, d):
    inv = table(s, d, "documents").groupBy("lang", F.substring_index("text", " ", 1).alias("call")).agg(F.count("*").alias("occurrences"), F.count_distinct("source").alias("repositories"))
    return W.globally_numbered(inv, [F.desc("repositories"), F.desc("occurrences"), F.col("lang"), F.col("call")])


def l_ensemble_agree(s, d):
    p = arms(records(s, d)).withColumns({"all_three": L.agree_or_unknown(*map(F.col, ARMS)), "without_marks": L.agree_or_unknown(F.col("length"), F.col("language"))})
    long = p.select("doc_id", "gold", "all_three", "without_marks").unpivot(["doc_id", "gold"], ["all_three", "without_marks"], "arm", "prediction")
    return rounded(M.confusion(long, ["arm"]), *RATIOS)


def a_counterfactual_pairs(s, d):
    p = predictions(s, d).where("arm in ('length', 'language')").groupBy("doc_id", "lang").pivot("arm", ["length", "language"]).agg(F.first("prediction"))
    return p.groupBy("lang").agg(F.count("*").alias("pairs"), F.count_if(F.col("length") != F.col("language")).alias("flips"))


def a_bidirectional(s, d):
    each = records(s, d).groupBy("source").agg(F.count_if(F.col("gold") == "present").alias("present"), F.count_if(F.col("gold") == "absent").alias("absent"))
    reasons = F.array_join(F.filter(F.array(F.when(F.col("present") == 0, "no_present"), F.when(F.col("absent") == 0, "no_absent")), lambda x: x.isNotNull()), ",")
    return each.withColumns({"reasons": reasons, "eligible": (F.col("present") > 0) & (F.col("absent") > 0)})


def a_repo_rollup(s, d):
    each = predictions(s, d).where("arm = 'length'").groupBy("source", "prediction").agg(F.count("*").alias("n"))
    entry = F.concat_ws(":", "prediction", F.col("n").cast("string"))
    return each.groupBy("source").agg(F.sum("n").alias("observations"), F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("histogram"))


def a_iteration_consensus(s, d):
    each = predictions(s, d).groupBy("doc_id").agg(F.count_distinct(F.when(F.col("prediction") != "unknown", F.col("prediction"))).alias("k"), F.count_if(F.col("prediction") != "unknown").alias("passes"))
    status = F.when(F.col("passes") == 0, "insufficient").when(F.col("k") > 1, "conflict").when(F.col("passes") == 1, "single_pass").otherwise("stable")
    return each.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def a_final_tables(s, d):
    """Figures of several stages as one long table."""
    rec, pred = records(s, d), predictions(s, d)
    parts = [
        rec.agg(F.count("*").alias("value")).select(F.lit("records").alias("figure"), "value"),
        rec.where("gold is not null").agg(F.count("*").alias("value")).select(F.lit("labelled"), "value"),
        rec.agg(F.count_distinct("source").alias("value")).select(F.lit("repositories"), "value"),
        pred.where("prediction <> 'unknown'").groupBy("arm").agg(F.count("*").alias("value")).select(F.concat(F.lit("decided_"), "arm"), "value"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def a_site_counts(s, d):
    return records(s, d).groupBy("lang").agg(F.count("*").alias("sites"), F.count_distinct("source").alias("repositories"), F.count_if(F.col("gold").isNotNull()).alias("known"), F.count_if(F.col("n_chars") > 2000).alias("long_sites"), F.max("n_chars").alias("longest"))


def a_tool_evidence(s, d):
    x = records(s, d).groupBy("source").agg(F.count_if(F.col("gold").isNotNull()).alias("resolved"), F.count_if(F.col("gold").isNull()).alias("unresolved"), F.array_join(F.array_sort(F.collect_set("gold")), ",").alias("effects"))
    return x.withColumn("status", F.when(F.col("resolved") == 0, "unknown").when(F.col("unresolved") == 0, "complete").otherwise("partial"))


def a_review_claims(s, d):
    expected = records(s, d).where("gold is not null").select("doc_id", "gold")
    actual = arms(records(s, d)).where("n_chars % 3 <> 0").select("doc_id", F.col("length").alias("claim"))
    j = expected.join(actual, "doc_id", "left")
    slot = F.when(F.col("gold") == "absent", "negative_control").otherwise("substantive")
    return j.groupBy(slot.alias("slot")).agg(F.count("*").alias("expected"), F.count("claim").alias("answered"), F.count_if(F.col("claim") == F.col("gold")).alias("matching"), F.count_if(F.col("claim") == "unknown").alias("unknown"))


def a_review_diagnostics(s, d):
    p = predictions(s, d)
    pattern = F.when(F.col("prediction") == "unknown", "abstained").when(F.col("gold").isNull(), "no_gold").when(F.col("prediction") == F.col("gold"), "match").otherwise("mismatch")
    return p.groupBy("arm", pattern.alias("pattern")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    confusion_by_arm, confusion_by_arm_and_stratum, a_confusion_fnabst, a_truth_matrix, a_count_by, a_count_pivot, strata_marginals, a_explode_count, a_count_distinct, a_conditional_sum,
    a_group_flags, cluster_bounds, ident_bounds, a_arm_compare, a_fault_summary, ipw_metrics, kappa, source_quantiles, bootstrap_ci, a_argmin_minN, a_parent_rollup, a_usage_sum, a_health_rollup,
    a_family_counts, a_coverage_summary, a_signature_inventory, l_ensemble_agree, a_counterfactual_pairs, a_bidirectional, a_repo_rollup, a_iteration_consensus, a_final_tables, a_site_counts,
    a_tool_evidence, a_review_claims, a_review_diagnostics,
)}

_CELLS = """count(*) FILTER (gold='present' AND prediction='present') AS tp, count(*) FILTER (gold='absent' AND prediction='present') AS fp,
count(*) FILTER (gold='present' AND prediction='absent') AS fn, count(*) FILTER (gold='absent' AND prediction='absent') AS tn,
count(*) FILTER (prediction='unknown') AS abstained, count(*) FILTER (gold='present') AS positives, count(*) AS n"""
_RATIOS = """round(tp/nullif(tp+fp,0)::DOUBLE,8) AS precision, round(tp/nullif(positives,0)::DOUBLE,8) AS recall, round((tp+fp+fn+tn)/nullif(n,0)::DOUBLE,8) AS coverage,
round((tp+tn)/nullif(tp+fp+fn+tn,0)::DOUBLE,8) AS decided_accuracy, round((fp+fn)/nullif(tp+fp+fn+tn,0)::DOUBLE,8) AS selective_risk"""


def _confusion(ctes: str, source: str, by: str) -> str:
    return f"WITH {ctes}, c AS (SELECT {by}, {_CELLS} FROM {source} WHERE gold IN ('present','absent') GROUP BY {by}) SELECT *, {_RATIOS} FROM c"


_W = {"tp": "gold='present' AND prediction='present'", "fp": "gold='absent' AND prediction='present'", "fn": "gold='present' AND prediction<>'present'", "tn": "gold='absent' AND prediction='absent'"}
SQL = {
    "bootstrap_ci": f"""WITH {PRED}, s AS (SELECT source, sum((gold=prediction)::INTEGER)::DOUBLE AS a, count(*)::DOUBLE AS b FROM pred WHERE arm='language' AND gold IS NOT NULL AND prediction<>'unknown' GROUP BY 1),
u AS (SELECT i, a, b, ('0x'||sha256('bootstrap'||chr(0)||i||chr(0)||source)[1:12])::BIGINT AS u FROM s, range(200) r(i)),
x AS (SELECT i, sum(a*w)/nullif(sum(b*w),0) AS r FROM (SELECT i, a, b, {"+".join(f"(u>={step})::INTEGER" for step in M.poisson_steps())} AS w FROM u) GROUP BY 1)
SELECT (SELECT round(sum(a)/sum(b),6) FROM s) AS point, round(quantile_cont(r,0.025),6) AS lower, round(quantile_cont(r,0.975),6) AS upper FROM x""",
    "confusion_by_arm": _confusion(PRED, "pred", "arm"),
    "confusion_by_arm_and_stratum": _confusion(PRED, "pred", "arm, lang"),
    "a_confusion_fnabst": f"WITH {PRED}, c AS (SELECT arm, {', '.join(f'count(*) FILTER ({v}) AS {k}' for k, v in _W.items())} FROM pred WHERE gold IS NOT NULL GROUP BY arm) SELECT *, round(tp/nullif(tp+fp,0)::DOUBLE,8) AS precision, round(tp/nullif(tp+fn,0)::DOUBLE,8) AS recall FROM c",
    "a_truth_matrix": f"WITH {PRED}, v(x) AS (VALUES ('present'),('absent'),('unknown')), k AS (SELECT coalesce(gold,'unknown') AS truth, prediction, count(*) AS n FROM pred GROUP BY ALL) SELECT a.x AS truth, b.x AS prediction, coalesce(n,0)::BIGINT AS n FROM v a CROSS JOIN v b LEFT JOIN k ON k.truth=a.x AND k.prediction=b.x",
    "a_count_by": f"WITH {WIDE}, v(prediction) AS (VALUES ('present'),('absent'),('unknown')) SELECT v.prediction, count(doc_id) AS n FROM v LEFT JOIN wide ON length = v.prediction GROUP BY 1",
    "a_count_pivot": f"WITH {WIDE} SELECT source, count(*) FILTER (marks='present') AS present, count(*) FILTER (marks='absent') AS absent, count(*) FILTER (marks='unknown') AS unknown FROM wide GROUP BY 1",
    "strata_marginals": f"WITH {REC}, r AS (SELECT *, coalesce(gold,'unknown') AS label FROM rec) SELECT 'lang' AS field, lang AS key, label, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'source', source, label, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'toxic', toxic::VARCHAR, label, count(*) FROM r GROUP BY ALL",
    "a_explode_count": f"WITH {REC} SELECT reason, count(*) AS n FROM (SELECT 'short' AS reason FROM rec WHERE n_chars<300 UNION ALL SELECT 'marked' FROM rec WHERE contains(text,'***') UNION ALL SELECT 'unlabelled' FROM rec WHERE gold IS NULL) GROUP BY 1",
    "a_count_distinct": "SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts FROM documents GROUP BY 1",
    "a_conditional_sum": f"WITH {PRED} SELECT arm, count(*) FILTER (prediction='present') AS present, sum(CASE WHEN prediction='unknown' THEN n_chars ELSE 0 END)::BIGINT AS undecided_chars FROM pred GROUP BY 1",
    "a_group_flags": f"WITH {REC} SELECT source, bool_or(coalesce(gold='absent',false)) AS some_absent, bool_and(coalesce(gold='present',false)) AS all_present, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM rec GROUP BY 1",
    "cluster_bounds": f"WITH {REC}, e AS (SELECT source, bool_or(coalesce(gold='present',false)) AS s, bool_or(coalesce(gold<>'absent',true)) AS m FROM rec GROUP BY 1), c AS (SELECT count(*) AS clusters, count(*) FILTER (s) AS with_positive, count(*) FILTER (m) AS with_possible FROM e) SELECT *, round(with_positive/clusters::DOUBLE,8) AS lower, round(with_possible/clusters::DOUBLE,8) AS upper FROM c",
    "ident_bounds": f"WITH {REC}, c AS (SELECT lang, count(*) AS n, count(*) FILTER (gold='present') AS positive, count(*) FILTER (gold='absent') AS negative FROM rec GROUP BY 1) SELECT *, round((positive+negative)/n::DOUBLE,8) AS coverage, round(positive/n::DOUBLE,8) AS lower, round((n-negative)/n::DOUBLE,8) AS upper, round(positive/nullif(positive+negative,0)::DOUBLE,8) AS decided_share FROM c",
    "a_arm_compare": f"WITH {PRED} SELECT arm, count(*) AS rows, count(DISTINCT doc_id) AS records, sha256(string_agg(DISTINCT doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR)) AS inventory, count(*)=count(DISTINCT doc_id) AS comparable FROM pred GROUP BY 1",
    "a_fault_summary": f"WITH {PRED}, w AS (SELECT *, 1.0::DOUBLE/(1+doc_id%4) AS w FROM pred) SELECT arm, {', '.join(f'count(*) FILTER ({v}) AS {k}' for k, v in _W.items())}, {', '.join(f'round(sum(CASE WHEN {v} THEN w ELSE 0 END),8) AS w_{k}' for k, v in _W.items())} FROM w GROUP BY 1",
    "ipw_metrics": f"""WITH {WIDE}, k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('s1'||chr(0)||lang||chr(0)||doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS m FROM wide),
w AS (SELECT *, length AS prediction, 1/(least(60,m)/m::DOUBLE) AS w FROM k WHERE r<=60),
c AS (SELECT lang, sum(CASE WHEN gold='present' AND prediction='present' THEN w ELSE 0 END) AS tp, sum(CASE WHEN gold='absent' AND prediction='present' THEN w ELSE 0 END) AS fp, sum(CASE WHEN gold='present' AND prediction<>'present' THEN w ELSE 0 END) AS fn,
sum(CASE WHEN gold IS NOT NULL AND prediction<>'unknown' THEN w ELSE 0 END) AS decided, sum(CASE WHEN gold IS NOT NULL THEN w ELSE 0 END) AS known, sum(w) AS weight, sum(w*w) AS squares FROM w GROUP BY 1),
q AS (SELECT lang, tp/nullif(tp+fp,0) AS precision, tp/nullif(tp+fn,0) AS recall, decided/nullif(known,0) AS decision_coverage, known/weight AS oracle_coverage, weight*weight/squares AS effective_n FROM c),
z AS (SELECT *, (precision+3.8416/(2*effective_n))/(1+3.8416/effective_n) AS centre, 1.96/(1+3.8416/effective_n)*sqrt(precision*(1-precision)/effective_n+3.8416/(4*effective_n*effective_n)) AS half FROM q)
SELECT lang, round(precision,6) AS precision, round(recall,6) AS recall, round(decision_coverage,6) AS decision_coverage, round(oracle_coverage,6) AS oracle_coverage, round(effective_n,6) AS effective_n,
CASE WHEN precision IS NOT NULL THEN round(greatest(0.0,least(precision,centre-half)),6) END AS low, CASE WHEN precision IS NOT NULL THEN round(least(1.0,greatest(precision,centre+half)),6) END AS high FROM z""",
    "kappa": """WITH b AS (SELECT lang, quality::VARCHAR AS a, toxic::VARCHAR AS b FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL), t AS (SELECT lang, count(*) AS n, count(*) FILTER (a=b) AS same FROM b GROUP BY 1),
ca AS (SELECT lang, a AS v, count(*) AS ca FROM b GROUP BY ALL), cb AS (SELECT lang, b AS v, count(*) AS cb FROM b GROUP BY ALL), p AS (SELECT lang, sum(ca*cb) AS product FROM ca JOIN cb USING (lang, v) GROUP BY 1)
SELECT lang, n, round(same/n::DOUBLE,8) AS agreement, round((same/n::DOUBLE-coalesce(product,0)/(n*n)::DOUBLE)/nullif(1-coalesce(product,0)/(n*n)::DOUBLE,0),8) AS kappa FROM t LEFT JOIN p USING (lang)""",
    "source_quantiles": "SELECT source, count(n_chars) AS n, round(quantile_cont(n_chars,0.25),4) AS q1, round(quantile_cont(n_chars,0.5),4) AS median, round(quantile_cont(n_chars,0.75),4) AS q3 FROM documents GROUP BY 1",
    "a_argmin_minN": f"WITH {REC}, c AS (SELECT source, count(*) AS n, round(count(gold)/count(*)::DOUBLE,8) AS coverage FROM rec GROUP BY 1 HAVING count(*)>=10) SELECT * FROM c ORDER BY coverage, source LIMIT 1",
    "a_parent_rollup": f"WITH {REC}, c AS (SELECT source, CASE WHEN bool_or(coalesce(gold='present',false)) THEN 'present' WHEN bool_and(coalesce(gold='absent',false)) THEN 'absent' ELSE 'unknown' END AS label, count(*) AS children FROM rec WHERE toxic IS NOT NULL GROUP BY 1) SELECT p.source, label, coalesce(children,0)::BIGINT AS children FROM (SELECT DISTINCT source FROM documents) p LEFT JOIN c USING (source)",
    "a_usage_sum": f"WITH {REC} SELECT source, CASE WHEN count(*)=count(toxic) THEN sum(toxic)::BIGINT END AS used, count(*) AS calls FROM rec GROUP BY 1",
    "a_health_rollup": f"WITH {REC} SELECT source, CASE WHEN count(gold)=count(*) THEN 'completed' WHEN count(gold)>0 THEN 'partial' ELSE 'error' END AS health FROM rec GROUP BY 1",
    "a_family_counts": "SELECT count(*) AS families, sum(n)::BIGINT AS members, (sum(n)-count(*))::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text)",
    "a_coverage_summary": "SELECT v.lang, count(doc_id) AS n, count(DISTINCT source) AS sources FROM (VALUES ('de'),('en'),('es'),('fr'),('it')) v(lang) LEFT JOIN documents d ON d.lang=v.lang GROUP BY 1",
    "a_signature_inventory": "WITH i AS (SELECT lang, split_part(text,' ',1) AS call, count(*) AS occurrences, count(DISTINCT source) AS repositories FROM documents GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY repositories DESC, occurrences DESC, lang, call) AS rank FROM i",
    "l_ensemble_agree": _confusion(WIDE + ", e AS (SELECT doc_id, gold, 'all_three' AS arm, CASE WHEN length<>'unknown' AND length=language AND length=marks THEN length ELSE 'unknown' END AS prediction FROM wide UNION ALL SELECT doc_id, gold, 'without_marks', CASE WHEN length<>'unknown' AND length=language THEN length ELSE 'unknown' END FROM wide)", "e", "arm"),
    "a_counterfactual_pairs": f"WITH {WIDE} SELECT lang, count(*) AS pairs, count(*) FILTER (length<>language) AS flips FROM wide GROUP BY 1",
    "a_bidirectional": f"WITH {REC}, c AS (SELECT source, count(*) FILTER (gold='present') AS present, count(*) FILTER (gold='absent') AS absent FROM rec GROUP BY 1) SELECT *, concat_ws(',', CASE WHEN present=0 THEN 'no_present' END, CASE WHEN absent=0 THEN 'no_absent' END) AS reasons, present>0 AND absent>0 AS eligible FROM c",
    "a_repo_rollup": f"WITH {WIDE}, e AS (SELECT source, length AS prediction, count(*) AS n FROM wide GROUP BY ALL) SELECT source, sum(n)::BIGINT AS observations, string_agg(prediction||':'||n::VARCHAR, ',' ORDER BY prediction||':'||n::VARCHAR) AS histogram FROM e GROUP BY 1",
    "a_iteration_consensus": f"WITH {PRED}, e AS (SELECT doc_id, count(DISTINCT nullif(prediction,'unknown')) AS k, count(nullif(prediction,'unknown')) AS passes FROM pred GROUP BY 1) SELECT CASE WHEN passes=0 THEN 'insufficient' WHEN k>1 THEN 'conflict' WHEN passes=1 THEN 'single_pass' ELSE 'stable' END AS status, count(*) AS n FROM e GROUP BY 1",
    "a_final_tables": f"WITH {PRED} SELECT 'records' AS figure, count(*) AS value FROM rec UNION ALL SELECT 'labelled', count(gold) FROM rec UNION ALL SELECT 'repositories', count(DISTINCT source) FROM rec UNION ALL SELECT 'decided_'||arm, count(*) FROM pred WHERE prediction<>'unknown' GROUP BY arm",
    "a_site_counts": f"WITH {REC} SELECT lang, count(*) AS sites, count(DISTINCT source) AS repositories, count(gold) AS known, count(*) FILTER (n_chars>2000) AS long_sites, max(n_chars) AS longest FROM rec GROUP BY 1",
    "a_tool_evidence": f"WITH {REC} SELECT source, count(gold) AS resolved, count(*)-count(gold) AS unresolved, coalesce(string_agg(DISTINCT gold, ',' ORDER BY gold),'') AS effects, CASE WHEN count(gold)=0 THEN 'unknown' WHEN count(gold)=count(*) THEN 'complete' ELSE 'partial' END AS status FROM rec GROUP BY 1",
    "a_review_claims": f"WITH {WIDE}, j AS (SELECT gold, CASE WHEN n_chars%3<>0 THEN length END AS claim FROM wide WHERE gold IS NOT NULL) SELECT CASE WHEN gold='absent' THEN 'negative_control' ELSE 'substantive' END AS slot, count(*) AS expected, count(claim) AS answered, count(*) FILTER (claim=gold) AS matching, count(*) FILTER (claim='unknown') AS unknown FROM j GROUP BY 1",
    "a_review_diagnostics": f"WITH {PRED} SELECT arm, CASE WHEN prediction='unknown' THEN 'abstained' WHEN gold IS NULL THEN 'no_gold' WHEN prediction=gold THEN 'match' ELSE 'mismatch' END AS pattern, count(*) AS n FROM pred GROUP BY ALL",
}
