"""Hand-computed cases of the rules that are easy to get wrong."""

import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import checks as C
from cairn.operators import graph as G
from cairn.operators import identity as I
from cairn.operators import intervals
from cairn.operators import joins as J
from cairn.operators import lattices as L
from cairn.operators import metrics as M
from cairn.operators import records as R
from cairn.operators import sampling as S
from cairn.operators import windows as W
from cairn.sources import code_trees, commits, json_tables


def one(df):
    return df.first().asDict()


def nine(spark):
    return spark.createDataFrame([(g, p) for g in ("present", "absent", None) for p in ("present", "absent", "unknown")], "gold string, prediction string")


def test_three_confusions(spark):
    c = one(M.confusion(nine(spark), []))
    assert (c["tp"], c["fp"], c["fn"], c["tn"], c["abstained"], c["positives"]) == (1, 1, 1, 1, 2, 3)
    assert c["recall"] == pytest.approx(1 / 3) and c["coverage"] == pytest.approx(4 / 6)
    m = one(M.confusion_missed(nine(spark), []))
    assert (m["fn"], m["tn"]) == (2, 1) and m["recall"] == pytest.approx(1 / 3)
    assert {(r.truth, r.prediction): r.n for r in M.truth_matrix(nine(spark)).collect()}[("unknown", "unknown")] == 1


def test_empty_denominators_are_null(spark):
    c = one(M.confusion(spark.createDataFrame([("absent", "unknown")], "gold string, prediction string"), []))
    assert c["precision"] is None and c["recall"] is None and c["decided_accuracy"] is None


def test_quartiles_kappa_wilson(spark):
    q = one(M.quartiles(spark.createDataFrame([(1,), (2,), (4,), (8,)], "v int"), [], "v"))
    assert (q["q1"], q["median"], q["q3"]) == (1.75, 3.0, 5.0)
    same = spark.createDataFrame([("x", "x")] * 3, "a string, b string")
    assert one(M.kappa(same, [], "a", "b"))["kappa"] is None
    for p in (0.0, 1.0, 0.5):
        low, high = M.wilson(F.lit(p), F.lit(10.0))
        r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
        assert 0 <= r.l <= p <= r.h <= 1


def test_rollup_and_sums(spark):
    rows = [("a", "present"), ("a", "absent"), ("b", "absent"), ("c", None), ("c", "absent")]
    out = spark.createDataFrame(rows, "k string, label string").groupBy("k").agg(M.rollup_label(F.col("label")).alias("l"))
    assert {r.k: r.l for r in out.collect()} == {"a": "present", "b": "absent", "c": "unknown"}
    assert one(spark.createDataFrame([(1,), (None,)], "x long").agg(M.sum_or_null(F.col("x")).alias("s")))["s"] is None


def test_bootstrap_repeats(spark):
    df = spark.createDataFrame([(c, i % 2) for c in "abcd" for i in range(5)], "c string, v int")
    a, b = (one(M.cluster_bootstrap(df, "c", F.col("v"), F.lit(1), 50)) for _ in range(2))
    assert a == b and a["lower"] <= a["point"] <= a["upper"]


def test_ranges_and_spans(spark):
    df = spark.createDataFrame([(1, 3), (4, 6), (8, 9)], "start int, end int").withColumn("k", F.lit(1))
    assert {(r.start, r.end, r.parts) for r in W.merge_ranges(df, ["k"]).collect()} == {(1, 6, 2), (8, 9, 1)}
    spans = spark.createDataFrame([([(0, 5), (0, 9), (4, 6), (9, 11)],)], "s array<struct<start:int,end:int>>")
    assert [tuple(x) for x in spans.select(W.outer_spans(F.col("s")).alias("o")).first().o] == [(0, 9), (9, 11)]


def test_innermost_tie_goes_to_the_smaller_name(spark):
    spans = spark.createDataFrame([(1, 9, "outer"), (3, 5, "b"), (4, 6, "a")], "start int, end int, name string").withColumn("path", F.lit("p"))
    points = spark.createDataFrame([(1, 4), (2, 20)], "id int, line int").withColumn("path", F.lit("p"))
    assert {r.id: r.name for r in intervals.innermost(points, spans, ["path"], "line", ["id"]).collect()} == {1: "a", 2: None}


def test_similarity_boundary(spark):
    base = [f"t{i}" for i in range(60)]
    sets = {"a": base[:57], "b": base[:54] + ["x1", "x2", "x3"], "c": base[:53] + ["y1", "y2", "y3", "y4"], "d": base[:20]}
    tokens = spark.createDataFrame([(k, t) for k, v in sets.items() for t in v], "id string, token string")
    assert {(r.a, r.b, r.common, r.total) for r in J.similar_sets(tokens, 90, 40).collect()} == {("a", "b", 54, 60)}


def test_samples(spark):
    df = spark.createDataFrame([("x", i) for i in range(2)] + [("y", i) for i in range(10)], "s string, id int")
    got = W.hash_sample(df, "s", "id", 5, "k").groupBy("s").agg(F.count("*").alias("n"), F.sum(1 / F.col("probability")).alias("w")).collect()
    assert {(r.s, r.n, r.w) for r in got} == {("x", 2, 2.0), ("y", 5, 10.0)}
    lone = W.fraction_split(spark.createDataFrame([("x", 1)], "s string, id int"), "s", "id", 0.5, 1, "k")
    assert lone.first().side == "confirmation"
    fam = spark.createDataFrame([("p", "f", 1), ("q", "f", 2), ("q", "g", 3)], "s string, fam string, id int")
    chosen = S.greedy_families(fam, "s", "fam", "id", 1, "k").collect()
    assert {r.s: r.fam for r in chosen} == {"p": "f", "q": "g"}


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(1000, 1000 + i) for i in range(1, 60)], "src long, dst long")
    out = {r.node: r.component for r in G.connected_components(chain).collect()}
    assert {out[i] for i in range(151)} == {0} and {out[1000 + i] for i in range(60)} == {1000}
    assert G.connected_components(chain.where("src < 0")).count() == 0


def test_graph_errors(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (5, 6), (6, 5)], "src long, dst long")
    assert {tuple(r.path) for r in G.simple_paths(e, spark.range(1, 2), spark.range(4, 5)).collect()} == {(1, 2, 4), (1, 3, 4)}
    assert {r.node for r in G.on_cycles(e).collect()} == {5, 6}
    with pytest.raises(ValueError):
        G.simple_paths(e, spark.range(1, 2), spark.range(4, 5), max_paths=1)


def test_checks(spark):
    a = spark.createDataFrame([(1,), (2,)], "id int")
    with pytest.raises(ValueError):
        J.strict_one_to_one(a, a.where("id = 1"), ["id"])
    with pytest.raises(ValueError):
        J.strict_one_to_one(a.union(a), a, ["id"])
    k = spark.range(1).select(C.key_closure(F.lit('{"b":1,"z":2}'), ["a", "b"]).alias("k")).first().k
    assert k.missing == ["a"] and k.unknown == ["z"]
    paths = spark.createDataFrame([("a/b.py",), ("/a",), ("a/../b",), ("a//b",), ("a\\b",), (None,)], "p string")
    assert [r[0] for r in paths.select(C.safe_path(F.col("p"))).collect()] == [True, False, False, False, False, False]


def test_three_valued_lattice(spark):
    table = {tuple(r[f] for f in L.FACTS): r.outcome for r in L.truth_table(spark).collect()}
    assert len(table) == 729 and table[("true",) * 6] == "blocked"
    assert table[("true", "false", "true", "true", "true", "true")] == "unknown"
    assert table[("true", "false", "false", "unknown", "unknown", "true")] == "present"
    p = {tuple(r[f] for f in L.FACTS): r.pivotal for r in L.pivotal(spark).collect()}
    assert p[("true", "true", "true", "true", "true", "unknown")] == ["commits"]


def test_masks_and_context(spark):
    text = "api_key = abcd1234 Authorization: Bearer abcdefgh.ijk " + "a1" * 20
    r = spark.createDataFrame([(text,)], "t string").select(X.mask_secrets(F.col("t")).alias("m"), X.mask_counts(F.col("t")).alias("c")).first()
    assert "abcd1234" not in r.m and "a1a1" not in r.m and tuple(r.c) == (1, 1, 1)
    assert spark.range(1).select(X.strip(F.lit("  x  ")).alias("s")).first().s == "x"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "u1.json").write_text(json.dumps({"unit": "a", "state": "completed"}, indent=1))
    (tmp_path / "in" / "u2.json").write_text(json.dumps({"unit": "b", "state": "failed"}, indent=1))
    assert [(r.unit, r.file) for r in json_tables.read_completed(spark, str(tmp_path / "in"), "unit string, state string").collect()] == [("a", "u1.json")]
    with pytest.raises(FileNotFoundError):
        json_tables.read_named(spark, {"x": str(tmp_path / "none")}, {"x": "a int"})
    manifest = commits.write_run(spark.range(3), {"seed": 1}, str(tmp_path / "run"))
    assert len(manifest["result_sha256"]) == 64
    with pytest.raises(Exception, match="exist"):
        json_tables.write_once(spark.range(1), str(tmp_path / "run" / "RESULT"))
    nb = {"cells": [{"cell_type": "markdown", "source": "x"}, {"cell_type": "code", "source": ["a = 1\n", "b"]}, {"cell_type": "code", "source": "c"}]}
    got = json_tables.notebook_cells(spark.createDataFrame([("p", json.dumps(nb))], "path string, content string")).collect()
    assert [(r.cell, r.source) for r in got] == [(1, "a = 1\nb"), (2, "c")]
    for name in ("m.py", "test_m.py", "vendor/v.py"):
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("import os\n")
    assert [r.path for r in code_trees.read_tree(spark, str(tmp_path / "src")).select("path").collect()] == ["m.py"]


def test_verified_reads_and_sidecars(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"unit": "a"}')
    digest = hashlib.sha256(b'{"unit": "a"}').hexdigest()
    plan = lambda d: spark.createDataFrame([("a.json", d)], "path string, sha256 string")
    assert [tuple(r) for r in json_tables.read_verified(spark, str(folder), plan(digest), "unit string").collect()] == [("a.json", "a")]
    with pytest.raises(ValueError, match="differ"):
        json_tables.read_verified(spark, str(folder), plan("0" * 64), "unit string")
    spark.range(2).write.json(str(tmp_path / "run" / "RESULT"))
    assert set(commits.add_sidecar(spark, {"seed": 1}, str(tmp_path / "run"))) == {"plan_sha256", "result_sha256"}
    with pytest.raises(Exception, match="exist"):
        commits.add_sidecar(spark, {"seed": 1}, str(tmp_path / "run"))


def test_imports_packages_and_configs(spark):
    files = lambda *rows: spark.createDataFrame([(p, bytearray(t.encode())) for p, t in rows], "path string, content binary")
    found = lambda text, language: {r.module for r in code_trees.imported_modules(files(("f", text)), language).collect()}
    assert found("import a from 'x/y'\nimport \"side\"\nexport * from 'z'\nconst q = require('r'); await import('d')\n/* import 'no' */", "typescript") == {"x/y", "side", "z", "r", "d"}
    assert found("import java.util.List;\nimport static a.B.*;\nclass X {}", "java") == {"java.util.List", "a.B.*"}
    assert found("import kotlin.io.path\nimport a.b.C as D", "kotlin") == {"kotlin.io.path", "a.b.C"}
    assert found("global using System;\nusing X = A.B;\nusing static M.N;\nusing (var f = Open()) {}\nusing var g = f;", "csharp") == {"System", "A.B", "M.N"}
    toml = '[tool.setuptools.packages.find]\nwhere = ["src", "src"]\n[[tool.poetry.packages]]\ninclude = "p"\nfrom = "lib"\n[tool.hatch.build.targets.wheel]\npackages = 3'
    roots = {tuple(r) for r in code_trees.package_roots(files(("p.toml", toml), ("q.toml", "= broken"))).collect()}
    assert roots == {("p.toml", "setuptools.find", "src", None), ("p.toml", "poetry.packages", "lib", None), ("p.toml", "hatch.wheel", None, "not_names"), ("q.toml", "file", None, "not_toml")}
    rows = {tuple(r) for r in code_trees.config_values(files(("a.json", '{"x": {"y": [1, null]}}'), ("b.toml", 'k = "v"'), ("c.json", "{"), ("d.json", " " * 50)), 40).collect()}
    assert rows == {("a.json", "x.y.0", "1", None), ("a.json", "x.y.1", None, None), ("b.toml", "k", "v", None), ("c.json", None, None, "JSONDecodeError"), ("d.json", None, None, "too_large")}


def test_structured_redaction(spark):
    texts = {
        '{"api_key": "a\\"b", "n": 1, "is_token": true}': '{"api_key": "[MASKED]", "n": 1, "is_token": true}',
        "password: hunter2 # x\nuser: me": "password: [MASKED]\nuser: me",
        "my_secret = 'q w'\n": "my_secret = '[MASKED]'\n",
        "-----BEGIN RSA PRIVATE KEY-----\nAB-C\n-----END RSA PRIVATE KEY-----\nrest": "[MASKED]\nrest",
        "Authorization: Bearer abc.def": "Authorization: Bearer [MASKED]",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.m for r in df.select("t", X.redact_structured(F.col("t")).alias("m")).collect()} == texts


def test_global_numbers_and_turns(spark):
    rows = [("a", i, f"f{i % 3}") for i in range(50)] + [("b", i, f"f{i % 5}") for i in range(7)] + [("c", 1, "g")]
    df = spark.createDataFrame(rows, "s string, k int, f string").repartition(5)
    assert {(r.s, r.k): r.rank for r in W.globally_numbered(df, ["s", "k"]).collect()} == {(s, k): n for n, (s, k, _) in enumerate(sorted(rows), 1)}
    turns = sorted((k, s) for s, k in [(s, sorted(x[1] for x in rows if x[0] == s).index(k) + 1) for s, k, _ in rows])
    assert sorted((r.turn, r.s, r.place) for r in W.round_robin(df, "s", "k").collect()) == [(t, s, n) for n, (t, s) in enumerate(turns, 1)]
    queues, taken, chosen = {s: sorted(x for x in rows if x[0] == s) for s in "abc"}, set(), []
    while len(chosen) < 6 and any(queues.values()):
        for s in "abc":
            while queues[s] and queues[s][0][2] in taken:
                queues[s].pop(0)
            if queues[s] and len(chosen) < 6:
                chosen.append(queues[s].pop(0))
                taken.add(chosen[-1][2])
    got = W.family_round_robin(df, "s", "f", ["k"], 6).orderBy("place").collect()
    assert [(r.s, r.k, r.f) for r in got] == chosen


def test_decoded_records_count_in_full_or_not_at_all(spark):
    rows = [(1, '{"items": [{"a": 1}, {"a": 2}]}'), (2, '{"items": [{"a": 1}, {"a": -2}]}'), (3, "{"), (4, '{"items": []}'), (5, '{"items": [{"a": null}]}')]
    df = spark.createDataFrame(rows, "id int, j string")
    good, down = R.decoded(df, "j", "items array<struct<a:int>>", "items", [("positive", "item.a > 0")], ["id"])
    assert {tuple(r) for r in good.collect()} == {(1, 1), (1, 2)} and {tuple(r) for r in down.collect()} == {(2, "positive"), (3, "shape"), (5, "positive")}
    each = R.isolated(df, "j", "items array<struct<a:int>>", "items", [("positive", "item.a > 0")], ["id"]).collect()
    assert {(r.id, r.a, r.error) for r in each} == {(1, 1, None), (1, 2, None), (2, 1, None), (2, None, "positive"), (3, None, "shape"), (5, None, "positive")}


def test_strict_dispositions_need_a_mechanical_witness(spark):
    rows = [(1, True, True, True), (2, False, True, True), (3, False, False, True), (4, False, False, False), (5, None, True, False)]
    df = spark.createDataFrame(rows, "id int, fact boolean, agree boolean, role boolean")
    rules = [(F.col("agree") & (F.col("id") == 9), "never", "early", False), (F.col("fact"), "excluded", "probe", True), (F.col("agree"), "present", "consensus", False), (F.col("role"), "absent", "role", False)]
    told = lambda strict: {r.id: tuple(r.x) for r in df.select("id", L.disposition(rules, strict).alias("x")).collect()}
    assert told(False) == {1: ("excluded", "probe", None), 2: ("present", "consensus", None), 3: ("absent", "role", None), 4: ("unknown", "none", None), 5: ("present", "consensus", None)}
    assert told(True) == {1: ("excluded", "probe", None), 2: ("unknown", "none", "present"), 3: ("unknown", "none", "absent"), 4: ("unknown", "none", None), 5: ("unknown", "none", "present")}


def test_canonical_json_as_python_writes_it(spark):
    import random

    rng = random.Random(4)
    alphabet = 'ab"\\/:,{}[] \n\t\b\f\r\x01\x0b\x1f\x7féü漢 😀ﬁ.e1'

    def value(depth):
        kind = rng.randrange(8 if depth < 4 else 5)
        if kind >= 6:
            return {"".join(rng.choices(alphabet.replace("😀", ""), k=rng.randrange(4))): value(depth + 1) for _ in range(rng.randrange(5))}
        if kind == 5:
            return [value(depth + 1) for _ in range(rng.randrange(3))]
        return [None, rng.random() < 0.5, rng.randrange(-(10**18), 10**18), "".join(rng.choices(alphabet, k=rng.randrange(12))), rng.randrange(-5, 5)][kind]

    values = [value(0) for _ in range(300)]
    rows = [(i, json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, t string")
    for ascii_only in (False, True):
        for spaced in (False, True):
            got = {r.i: r.j for r in df.select("i", I.canonical_json(F.col("t"), ascii_only, spaced).alias("j")).collect()}
            separators = (", ", ": ") if spaced else (",", ":")
            assert got == {i: json.dumps(v, sort_keys=True, separators=separators, ensure_ascii=ascii_only) for i, v in enumerate(values)}
    odd = spark.createDataFrame([('{"a":1,"a":2}',), ("{",), ("[1.0]",), ("1e3",), (None,), ('{"1.5":"2e9"}',)], "t string")
    assert [r[0] for r in odd.select(I.canonical_json(F.col("t"))).collect()] == [None] * 5 + ['{"1.5":"2e9"}']


def test_masks_of_long_runs_take_linear_time(spark):
    """A run of 200,000 signs that may stand before a secret's word, with the word at the end of one and none in the other."""
    rows = [(0, "a." * 100_000 + "token=abc,x"), (1, "a." * 100_000 + " nothing here, tokens none")]
    began = time.monotonic()
    out = spark.createDataFrame(rows, "id int, t string").select("id", X.mask_secrets(F.col("t")).alias("m"), X.mask_counts(F.col("t")).alias("c"), X.redact_structured(F.col("t")).alias("r")).orderBy("id").collect()
    assert time.monotonic() - began < 30
    assert out[0].m == out[0].r == "a." * 100_000 + "token=[MASKED],x" and tuple(out[0].c) == (1, 0, 0)
    assert out[1].m == out[1].r == rows[1][1] and tuple(out[1].c) == (0, 0, 0)


def test_three_forms_of_a_record_come_from_one_parsed_text(spark, tmp_path):
    from cairn.plans.windows import id_digest

    values = {1: 3, 2: 'x:,\\" \x1f\U0001f600'}
    rows = [(i, 2, "kind", json.dumps({"k": k})) for i, k in values.items()]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").write.parquet(str(tmp_path / "events.parquet"))
    found = id_digest(spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson(") == 1
    got = {r.event_id: r for r in found.collect()}
    for i, k in values.items():
        record = {"inner": {"a": "é ü, x: kind", "z": [i, None, True]}, "props": {"k": k}, "user": 2}
        for name, how in (("digest", {"ensure_ascii": False, "separators": (",", ":")}), ("ascii_digest", {"separators": (",", ":")}), ("spaced_digest", {})):
            assert got[i][name] == hashlib.sha256(json.dumps(record, sort_keys=True, **how).encode()).hexdigest(), (i, name)
