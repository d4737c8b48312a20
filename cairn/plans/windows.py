"""Queries on windows, samples, splits, identities and lattices."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import identity as I
from cairn.operators import intervals as V
from cairn.operators import lattices as L
from cairn.operators import sampling as S
from cairn.operators import windows as W
from cairn.plans.base import REC, WIDE, arms, gathered_sql, records, table


def _docs(s, d):
    return table(s, d, "documents")


def stratified_sample(s, d):
    return W.hash_sample(_docs(s, d), "lang", "doc_id", 25, "seed").select("doc_id", "lang", F.round("probability", 8).alias("probability"))


def hash_split(s, d):
    return W.fraction_split(_docs(s, d), "lang", "doc_id", 0.2, 3, "split").select("doc_id", "lang", "side")


def cumulative_split(s, d):
    return W.cumulative_split(_docs(s, d), "source", 0.6, "fam").select("doc_id", "source", "side")


def w_rank_number(s, d):
    sizes = _docs(s, d).groupBy("source").agg(F.count("*").alias("n"))
    return W.globally_numbered(sizes, [F.desc("n"), F.col("source")])


def round_robin(s, d):
    return W.round_robin(_docs(s, d), "lang", "doc_id").select("doc_id", "lang", "turn", "place")


def line_islands(s, d):
    i = table(s, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 60).alias("start"), (F.col("l_partkey") % 60 + F.col("l_linenumber")).alias("end"))
    return W.merge_ranges(i, ["l_orderkey"])


def w_consecutive_ranges(s, d):
    return W.runs_of_numbers(table(s, d, "lineitem"), ["l_orderkey"], "l_linenumber")


def w_nonoverlap_spans(s, d):
    start = F.col("l_partkey") % 60
    spans = table(s, d, "lineitem").select("l_orderkey", start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end")).distinct()
    kept = V.nonoverlapping(spans, ["l_orderkey"], "start", "end")
    return kept.groupBy("l_orderkey").agg(F.count("*").cast("int").alias("spans"), F.count_if("kept").cast("int").alias("kept"))


def w_context_window(s, d):
    lines = _docs(s, d).select("doc_id", F.split("text", "\n").alias("lines"))
    hits = lines.select("doc_id", "lines", F.posexplode("lines").alias("at", "body")).where(F.contains("body", F.lit("@")))
    return hits.select("doc_id", (F.col("at") + 1).alias("line"), F.sha2(F.array_join(X.context(F.col("lines"), F.col("at") + 1, 2), "\n"), 256).alias("context"))


def w_shingles(s, d):
    words = _docs(s, d).select("doc_id", X.tokens(F.col("text")).alias("words"))
    return words.select("doc_id", F.size(X.word_runs(F.col("words"), 5)).alias("runs"))


def w_prefix_len(s, d):
    n = F.col("n_chars")
    return _docs(s, d).select("doc_id", (n - F.floor((9 * n + 9) / 10) + 1).alias("prefix"))


def w_representative(s, d):
    rank = W.hash_rank("rep", "doc_id")
    return _docs(s, d).groupBy(F.sha2("text", 256)).agg(F.min_by("doc_id", F.struct(rank, "doc_id")).alias("doc_id"), F.count("*").alias("members")).where("members > 1").select("doc_id", "members")


def w_dup_count(s, d):
    """Numbers of copies, counted by digest; texts that stand once, and all rows of one that does not, never meet."""
    rows = _docs(s, d).select("doc_id", F.sha2("text", 256).alias("digest"))
    often = rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(often, rows["digest"].eqNullSafe(often["digest"]), "left").select("doc_id", F.coalesce("n", F.lit(1).cast("long")).alias("copies"))


def w_bounded_siblings(s, d):
    p = table(s, d, "part").select("p_partkey", "p_brand")
    matched = p.where("p_partkey % 50 = 0").select("p_brand").distinct()
    near = W.budgeted(p.join(matched, "p_brand", "left_semi"), ["p_brand"], ["p_partkey"], 3).select("p_partkey", "p_brand")
    return near.union(p.where("p_partkey % 50 = 0")).distinct()


def o_budget_limit(s, d):
    return W.budgeted(_docs(s, d), ["source"], [F.desc("n_chars"), "doc_id"], 5).select("doc_id", "source", "truncated")


def o_total_order(s, d):
    r = records(s, d).withColumn("order", F.coalesce("toxic", F.lit(-1)))
    return W.globally_numbered(r.select("doc_id", "lang", "order"), ["lang", "order", "doc_id"]).drop("order")


def o_first_alpha_cap(s, d):
    return W.numbered(_docs(s, d).select("source", "lang").distinct(), ["lang"], ["source"]).where("rank <= 4").select("lang", "source", F.sha2(F.concat_ws(":", "lang", "source"), 256).alias("digest"))


def a_max_score_ties(s, d):
    return W.top_with_ties(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], "l_quantity")


def clustered_sample(s, d):
    out = S.clustered(arms(records(s, d)), "source", "lang", "length", "doc_id", 8, 4, "two")
    return out.select("doc_id", "source", "length", F.round("probability", 8).alias("probability"))


def p_multiarm(s, d):
    out = S.multi_arm(arms(records(s, d)), ["length", "language", "marks"], "doc_id", 5, "arms")
    return out.select("doc_id", "vector", F.round("probability", 8).alias("probability"))


def greedy_family_first(s, d):
    return S.greedy_families(_docs(s, d).withColumn("family", F.sha2("text", 256)), "lang", "family", "doc_id", 20, "greedy").select("doc_id", "lang")


def p_floor_gate(s, d):
    return _docs(s, d).groupBy("source").agg(F.count("*").alias("n")).withColumn("enough", F.col("n") >= 40)


def id_digest(s, d):
    """Digests of records as canonical JSON, of several keys out of order, nested and beyond ASCII, in three forms."""
    inner = F.concat(F.lit('{"z" : ['), F.col("event_id").cast("string"), F.lit(', null,true], "a":"é \\u00fc, x: '), "event_type", F.lit('"}'))
    text = F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(', "props":'), "props", F.lit(' ,"inner": '), inner, F.lit("}"))
    forms = (("digest", {}), ("ascii_digest", {"ascii_only": True}), ("spaced_digest", {"ascii_only": True, "spaced": True}))
    # a generated row is computed once, so that the three forms come from one canonical text
    digests = lambda j: F.struct(*[F.sha2(I.json_form(j, **how), 256).alias(name) for name, how in forms])
    return table(s, d, "events").select("event_id", F.inline(F.transform(F.array(I.canonical_json(text)), digests)))


def id_file_sha(s, d):
    return _docs(s, d).select("doc_id", F.sha2("text", 256).alias("sha256"))


def id_node(s, d):
    return _docs(s, d).select("doc_id", I.text_digest(F.col("source"), F.col("lang"), F.col("doc_id")).alias("node"))


def id_git_blob(s, d):
    return _docs(s, d).select("doc_id", I.git_blob(F.col("text")).alias("blob"))


def id_set_identity(s, d):
    return I.set_digest(_docs(s, d), ["source"], F.col("doc_id").cast("string"), "identity")


def id_source_inventory(s, d):
    entry = F.concat_ws(":", F.octet_length("text").cast("string"), F.sha2("text", 256))
    sizes = _docs(s, d).groupBy("source").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"))
    return sizes.join(I.set_digest(_docs(s, d), ["source"], entry, "digest"), "source")


def id_evidence_key(s, d):
    tuples = F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")))), ",")
    keys = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sha2(tuples, 256).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("orders"), F.min("l_orderkey").alias("first"))


def id_span_verify(s, d):
    return _docs(s, d).select("doc_id", I.span_digest(F.col("text"), F.lit(1), F.lit(2)).alias("digest"))


def id_drift_check(s, d):
    planned = _docs(s, d).select("doc_id", F.sha2(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("planned"))
    now = _docs(s, d).select("doc_id", F.sha2("text", 256).alias("now"))
    return planned.join(now, "doc_id").where("planned <> now").select("doc_id")


def lattice_truth_table(s, d):
    return L.truth_table(s)


def l_pivotal(s, d):
    return L.pivotal(s).groupBy("outcome", F.array_join("pivotal", ",").alias("pivotal")).agg(F.count("*").alias("n"))


def l_logical_verdict(s, d):
    state = F.when(F.col("l_returnflag") == "A", "blocked").when(F.col("l_returnflag") == "R", "present").otherwise("unknown")
    each = table(s, d, "lineitem").groupBy("l_orderkey").agg(L.verdict_of(state).alias("verdict"))
    return each.groupBy("verdict").agg(F.count("*").alias("n"))


def l_disposition(s, d):
    """Labels in both modes: an exclusion is a recorded fact, agreement and a single role are not."""
    r = arms(records(s, d))
    agreed = (F.col("length") == F.col("marks")) & (F.col("length") != "unknown")
    rules = [(F.col("toxic") == 1, "excluded", "exclusion", True), (agreed, "agreed", "consensus", False), (F.col("language") != "unknown", "single", "role", False)]
    modes = F.array(*[F.struct(F.lit(name).alias("mode"), L.disposition(rules, strict).alias("x")) for name, strict in (("release", False), ("strict", True))])
    return r.select(F.explode(modes).alias("m")).select("m.mode", "m.x.*").groupBy("mode", "label", "authority", "candidate").agg(F.count("*").alias("n"))


def l_scope_admit(s, d):
    g = records(s, d).groupBy("source").agg(F.bool_or(F.coalesce(F.col("gold") == "absent", F.lit(False))).alias("hit"), F.bool_and(F.coalesce(F.col("gold") == "present", F.lit(False))).alias("clear"), F.count("*").alias("n"))
    quantifier = F.when(F.col("n") % 2 == 0, "finite").otherwise("open")
    return g.select("source", L.scope_verdict(F.col("hit"), F.col("clear"), quantifier, F.col("n") > 10).alias("verdict"))


def l_actionable(s, d):
    r = records(s, d)
    missing = F.array_join(F.filter(F.array(F.when(F.col("gold").isNull(), "gold"), F.when(F.col("toxic").isNull(), "toxic"), F.when(F.col("n_chars") < 200, "size")), lambda x: x.isNotNull()), ",")
    return r.select(missing.alias("missing")).groupBy((F.col("missing") == "").alias("actionable"), "missing").agg(F.count("*").alias("n"))


def trace_audit(s, d):
    """Users whose trace holds an error before a purchase."""
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.struct("ts", "event_id")))
    e = table(s, d, "events").groupBy("user_id").agg(first("error").alias("e"), first("purchase").alias("p"))
    return e.select("user_id", F.col("e").isNotNull().alias("denied"), F.col("p").isNotNull().alias("committed"), F.coalesce(F.col("e") < F.col("p"), F.lit(False)).alias("error_first"))


def a_cell_counts(s, d):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return table(s, d, "events").groupBy("user_id").agg(n("error").alias("errors"), n("purchase").alias("purchases"), F.count("*").alias("total"))


def a_label_rule(s, d):
    c = a_cell_counts(s, d)
    label = F.when(F.col("total") < 5, "unknown").when((F.col("errors") >= 1) & (F.col("purchases") >= 1), "present").otherwise("absent")
    return c.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def turn_pairs(s, d):
    """Each user turn with the hash of the turns within one of it."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-1, 1)
    near = F.sha2(F.array_join(F.collect_list("text").over(w), "\n"), 256)
    return table(s, d, "conversations").withColumn("context", near).where("role = 'user'").select("conv_id", "turn", "context")


QUERIES = {f.__name__: f for f in (
    stratified_sample, hash_split, cumulative_split, w_rank_number, round_robin, line_islands, w_consecutive_ranges, w_nonoverlap_spans, w_context_window, w_shingles, w_prefix_len, w_representative, w_dup_count,
    w_bounded_siblings, o_budget_limit, o_total_order, o_first_alpha_cap, a_max_score_ties, clustered_sample, p_multiarm, greedy_family_first, p_floor_gate, id_digest, id_file_sha, id_node, id_git_blob, id_set_identity,
    id_source_inventory, id_evidence_key, id_span_verify, id_drift_check, lattice_truth_table, l_pivotal, l_logical_verdict, l_disposition, l_scope_admit, l_actionable, trace_audit, a_cell_counts, a_label_rule, turn_pairs,
)}

_FACTS = ", ".join(f"f{i}.v AS {f}" for i, f in enumerate(L.FACTS))
_ALL = " CROSS JOIN ".join(f"(VALUES ('true'),('false'),('unknown')) f{i}(v)" for i in range(6))
_TRUTH = f"""t AS (SELECT {_FACTS} FROM {_ALL}), o AS (SELECT *, CASE WHEN guarded='false' AND denies='true' THEN 'unknown' WHEN reachable='false' OR commits='false' THEN 'absent'
WHEN reachable='true' AND commits='true' AND guarded='true' AND denies='true' AND dominates='true' AND same_resource='true' THEN 'blocked'
WHEN reachable='true' AND commits='true' AND (guarded='false' OR denies='false' OR dominates='false' OR same_resource='false') THEN 'present' ELSE 'unknown' END AS outcome FROM t)"""
_SET = gathered_sql("SELECT source, sha256({v}) AS dg FROM documents", "source")
_HASH = "sha256('{seed}'||chr(0)||{s}||chr(0)||doc_id::VARCHAR)"


def _pivot_sql(fact):
    """Rows in which fact is unknown and two completions that differ in it alone have different outcomes."""
    rest = [f for f in L.FACTS if f != fact]
    fits = " AND ".join(f"(o.{f}='unknown' OR o.{f}=k.{f})" for f in rest)
    keys = ", ".join(f"o.{f}" for f in L.FACTS)
    return f"p_{fact} AS (SELECT DISTINCT {', '.join(L.FACTS)}, fact FROM (SELECT {keys}, '{fact}' AS fact FROM o JOIN k ON {fits} WHERE o.{fact}='unknown' GROUP BY {keys}, {', '.join('k.' + f for f in rest)} HAVING count(DISTINCT k.outcome)>1))"


def _greedy_sql(strata, k):
    """Stratum by stratum in hash order: the first record of each text not taken before, and of these the first k."""
    steps = []
    for i, stratum in enumerate(strata):
        taken = f" AND text NOT IN ({' UNION ALL '.join(f'SELECT text FROM s{j}' for j in range(i))})" if i else ""
        steps.append(f"s{i} AS (SELECT doc_id, lang, text FROM (SELECT *, {_HASH.format(seed='greedy', s='lang')} AS h, row_number() OVER (PARTITION BY text ORDER BY {_HASH.format(seed='greedy', s='lang')}, doc_id) AS r FROM documents WHERE lang='{stratum}'{taken}) WHERE r=1 ORDER BY h, doc_id LIMIT {k})")
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT doc_id, lang FROM s{i}" for i in range(len(strata)))


SQL = {
    "stratified_sample": f"WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_HASH.format(seed='seed', s='lang')}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, round(least(25,n)/n::DOUBLE,8) AS probability FROM k WHERE r<=25",
    "hash_split": f"WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_HASH.format(seed='split', s='lang')}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, CASE WHEN r<=least(greatest(3,floor(n*0.2)),n-1) THEN 'development' ELSE 'confirmation' END AS side FROM k",
    "cumulative_split": "WITH f AS (SELECT source, count(*) AS size FROM documents GROUP BY 1), c AS (SELECT source, coalesce(sum(size) OVER (ORDER BY sha256('fam'||chr(0)||source), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before, sum(size) OVER () AS total FROM f) SELECT doc_id, source, CASE WHEN before<total*0.6 THEN 'development' ELSE 'confirmation' END AS side FROM documents JOIN c USING (source)",
    "w_rank_number": "SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS rank FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)",
    "round_robin": "WITH t AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents) SELECT *, row_number() OVER (ORDER BY turn, lang) AS place FROM t",
    "line_islands": "WITH i AS (SELECT l_orderkey, l_partkey%60 AS s, l_partkey%60+l_linenumber AS e FROM lineitem), m AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s>reach+1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT l_orderkey, min(s) AS start, max(e) AS \"end\", count(*) AS parts FROM g GROUP BY l_orderkey, g",
    "w_consecutive_ranges": "WITH n AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), g AS (SELECT *, l_linenumber-row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM n) SELECT l_orderkey, min(l_linenumber) AS start, max(l_linenumber) AS \"end\" FROM g GROUP BY l_orderkey, g",
    "w_shingles": r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text,'\s+'), lambda x: x<>'') AS t FROM documents), r AS (SELECT doc_id, count(DISTINCT run) AS n FROM (SELECT doc_id, unnest(list_transform(range(1,len(t)-3), lambda i: array_to_string(t[i:i+4],' '))) AS run FROM w WHERE len(t)>=5) GROUP BY 1) SELECT doc_id, coalesce(n,0)::INTEGER AS runs FROM documents LEFT JOIN r USING (doc_id)",
    "w_prefix_len": "SELECT doc_id, n_chars-(9*n_chars+9)//10+1 AS prefix FROM documents",
    "w_representative": "SELECT doc_id, members FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS members, row_number() OVER (PARTITION BY text ORDER BY sha256('rep'||chr(0)||doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE members>1 AND r=1",
    "w_dup_count": "SELECT doc_id, count(*) OVER (PARTITION BY text) AS copies FROM documents",
    "w_bounded_siblings": "WITH m AS (SELECT DISTINCT p_brand FROM part WHERE p_partkey%50=0), r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part WHERE p_brand IN (SELECT p_brand FROM m)) SELECT p_partkey, p_brand FROM r WHERE r<=3 UNION SELECT p_partkey, p_brand FROM part WHERE p_partkey%50=0",
    "o_budget_limit": "SELECT doc_id, source, truncated FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source)>5 AS truncated, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r<=5",
    "o_total_order": f"WITH {REC} SELECT doc_id, lang, row_number() OVER (ORDER BY lang, coalesce(toxic,-1), doc_id) AS rank FROM rec",
    "o_first_alpha_cap": "SELECT lang, source, sha256(lang||':'||source) AS digest FROM (SELECT DISTINCT lang, source FROM documents) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY source)<=4",
    "a_max_score_ties": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC)=1",
    "clustered_sample": f"""WITH {WIDE}, s AS (SELECT source, CASE WHEN count(DISTINCT lang)>1 THEN 'mixed' ELSE min(lang) END AS stratum FROM wide GROUP BY 1),
k AS (SELECT source, least(8,count(*) OVER (PARTITION BY stratum))/(count(*) OVER (PARTITION BY stratum))::DOUBLE AS p1, row_number() OVER (PARTITION BY stratum ORDER BY sha256('two'||chr(0)||stratum||chr(0)||source), source) AS r FROM s),
x AS (SELECT doc_id, w.source, length, p1, row_number() OVER (PARTITION BY w.source, length ORDER BY sha256('two'||chr(0)||length||chr(0)||doc_id::VARCHAR), doc_id) AS r2, count(*) OVER (PARTITION BY w.source, length) AS n FROM wide w JOIN k ON k.source=w.source AND k.r<=8)
SELECT doc_id, source, length, round(p1*least(4,n)/n,8) AS probability FROM x WHERE r2<=4""",
    "p_multiarm": f"""WITH {WIDE}, v AS (SELECT doc_id, '["'||length||'","'||language||'","'||marks||'"]' AS vector FROM wide), k AS (SELECT *, row_number() OVER (PARTITION BY vector ORDER BY {_HASH.format(seed='arms', s='vector')}, doc_id) AS r, count(*) OVER (PARTITION BY vector) AS n FROM v) SELECT doc_id, vector, round(least(5,n)/n::DOUBLE,8) AS probability FROM k WHERE r<=5""",
    "greedy_family_first": _greedy_sql(["de", "en", "es", "fr"], 20),
    # of the 64 completions, an unknown fact matters if two that differ in it alone and in the unknown facts' other values fixed give two outcomes
    "l_pivotal": f"WITH {_TRUTH}, k AS (SELECT * FROM o WHERE " + " AND ".join(f"{f}<>'unknown'" for f in L.FACTS) + "), " + ", ".join(_pivot_sql(f) for f in L.FACTS)
    + ", x AS (" + " UNION ALL ".join(f"SELECT * FROM p_{f}" for f in L.FACTS) + f"), l AS (SELECT {', '.join(L.FACTS)}, string_agg(fact, ',' ORDER BY fact) AS pivotal FROM x GROUP BY ALL) SELECT outcome, coalesce(pivotal,'') AS pivotal, count(*) AS n FROM o LEFT JOIN l USING ({', '.join(L.FACTS)}) GROUP BY ALL",
    "w_nonoverlap_spans": """WITH RECURSIVE s AS (SELECT DISTINCT l_orderkey AS k, l_partkey%60 AS a, l_partkey%60+l_quantity::BIGINT AS b FROM lineitem), n AS (SELECT k, count(*) AS spans FROM s GROUP BY 1),
r AS (SELECT k, min(a) AS a, (arg_max(b, -a*1000+b)) AS b, 1 AS kept FROM s GROUP BY k UNION ALL SELECT k, a, b, kept FROM (SELECT s.k, s.a, s.b, r.kept+1 AS kept, row_number() OVER (PARTITION BY s.k ORDER BY s.a, s.b DESC) AS q FROM r JOIN s ON s.k=r.k AND s.a>=r.b) WHERE q=1)
SELECT k AS l_orderkey, spans::INTEGER AS spans, max(kept)::INTEGER AS kept FROM r JOIN n USING (k) GROUP BY ALL""",
    "w_context_window": r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), h AS (SELECT doc_id, lines, unnest(range(1, len(lines)+1)) AS pos FROM l)
SELECT doc_id, pos::INTEGER AS line, sha256(array_to_string(list_filter(list_transform(lines[greatest(1, pos-2):pos+2], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x<>''), chr(10))) AS context FROM h WHERE contains(lines[pos], '@')""".replace("\\\\", "\\"),
    "p_floor_gate": "SELECT source, count(*) AS n, count(*)>=40 AS enough FROM documents GROUP BY 1",
    # the text that the keys' order gives, written down
    "id_digest": r"""WITH t AS (SELECT event_id, '{"inner":{"a":"é ü, x: '||event_type||'","z":['||event_id||',null,true]},"props":{"k":'||json_extract_string(props, '$.k')||'},"user":'||user_id||'}' AS t,
'{"inner": {"a": "\u00e9 \u00fc, x: '||event_type||'", "z": ['||event_id||', null, true]}, "props": {"k": '||json_extract_string(props, '$.k')||'}, "user": '||user_id||'}' AS s FROM events)
SELECT event_id, sha256(t) AS digest, sha256(replace(replace(t, 'é', '\u00e9'), 'ü', '\u00fc')) AS ascii_digest, sha256(s) AS spaced_digest FROM t""",
    "id_file_sha": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "id_node": "SELECT doc_id, sha256(source||chr(0)||lang||chr(0)||doc_id::VARCHAR) AS node FROM documents",
    "id_git_blob": "SELECT doc_id, sha1('blob '||strlen(text)::VARCHAR||chr(0)||text) AS blob FROM documents",
    "id_set_identity": "SELECT source, digest AS identity FROM (" + _SET.format(v="doc_id::VARCHAR") + ")",
    "id_source_inventory": "SELECT source, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, any_value(digest) AS digest FROM documents JOIN (" + _SET.format(v="strlen(text)::VARCHAR||':'||sha256(text)") + ") USING (source) GROUP BY 1",
    "id_evidence_key": "WITH k AS (SELECT l_orderkey, sha256(string_agg(l_returnflag||'|'||l_linestatus||'|'||l_linenumber::VARCHAR, ',' ORDER BY l_returnflag||'|'||l_linestatus||'|'||l_linenumber::VARCHAR)) AS key FROM lineitem GROUP BY 1) SELECT key, count(*) AS orders, min(l_orderkey) AS first FROM k GROUP BY 1",
    "id_span_verify": "SELECT doc_id, sha256(array_to_string(string_split(text,chr(10))[1:2],chr(10))) AS digest FROM documents",
    "id_drift_check": "SELECT doc_id FROM documents WHERE doc_id%9=0",
    "lattice_truth_table": f"WITH {_TRUTH} SELECT * FROM o",
    "l_logical_verdict": "SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN bool_or(l_returnflag='R') THEN 'present' WHEN bool_and(l_returnflag='A') THEN 'blocked' ELSE 'unknown' END AS verdict FROM lineitem GROUP BY l_orderkey) GROUP BY 1",
    "l_disposition": f"""WITH {WIDE}, x AS (SELECT coalesce(toxic=1, false) AS fact, CASE WHEN toxic=1 THEN 'excluded' WHEN length=marks AND length<>'unknown' THEN 'agreed' WHEN language<>'unknown' THEN 'single' ELSE 'unknown' END AS label FROM wide),
y AS (SELECT 'release' AS mode, label, NULL::VARCHAR AS candidate FROM x UNION ALL SELECT 'strict', CASE WHEN fact THEN label ELSE 'unknown' END, CASE WHEN NOT fact AND label<>'unknown' THEN label END FROM x)
SELECT mode, label, CASE label WHEN 'excluded' THEN 'exclusion' WHEN 'agreed' THEN 'consensus' WHEN 'single' THEN 'role' ELSE 'none' END AS authority, candidate, count(*) AS n FROM y GROUP BY ALL""",
    "l_scope_admit": f"WITH {REC} SELECT source, CASE WHEN bool_or(coalesce(gold='absent',false)) THEN 'present' WHEN count(*)%2=0 AND count(*)>10 AND bool_and(coalesce(gold='present',false)) THEN 'absent' ELSE 'unknown' END AS verdict FROM rec GROUP BY 1",
    "l_actionable": f"WITH {REC}, m AS (SELECT concat_ws(',', CASE WHEN gold IS NULL THEN 'gold' END, CASE WHEN toxic IS NULL THEN 'toxic' END, CASE WHEN n_chars<200 THEN 'size' END) AS missing FROM rec) SELECT missing='' AS actionable, missing, count(*) AS n FROM m GROUP BY ALL",
    "trace_audit": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) SELECT user_id, bool_or(event_type='error') AS denied, bool_or(event_type='purchase') AS committed, coalesce(min(r) FILTER (event_type='error')<min(r) FILTER (event_type='purchase'),false) AS error_first FROM r GROUP BY 1",
    "a_cell_counts": "SELECT user_id, count(*) FILTER (event_type='error') AS errors, count(*) FILTER (event_type='purchase') AS purchases, count(*) AS total FROM events GROUP BY 1",
    "a_label_rule": "SELECT CASE WHEN t<5 THEN 'unknown' WHEN e>=1 AND p>=1 THEN 'present' ELSE 'absent' END AS label, count(*) AS n FROM (SELECT count(*) AS t, count(*) FILTER (event_type='error') AS e, count(*) FILTER (event_type='purchase') AS p FROM events GROUP BY user_id) GROUP BY 1",
    "turn_pairs": "SELECT conv_id, turn, context FROM (SELECT conv_id, turn, role, sha256(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING),chr(10))) AS context FROM conversations) WHERE role='user'",
}
