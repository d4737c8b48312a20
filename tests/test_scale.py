"""Operators that must spread one hot key over many tasks, against brute force on small tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import graph as G
from cairn.operators import intervals
from cairn.operators import joins as J
from cairn.operators import metrics as M
from cairn.operators import shared
from cairn.operators import windows as W


@pytest.fixture
def parts(spark):
    """More and smaller partitions than small tables get by themselves."""
    names = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def spans_of(rng, n, key):
    start = rng.integers(0, 400, n)
    size = np.where(rng.random(n) < 0.1, rng.integers(0, 400, n), rng.integers(0, 12, n))
    return [(key, int(a), int(a + d), f"s{i}") for i, (a, d) in enumerate(zip(start, size, strict=True))]


@pytest.mark.parametrize(("most", "each"), [(1_000_000, 0), (3, 0), (3, 100), (3, 10**6)])
def test_interval_joins(spark, parts, monkeypatch, most, each):
    monkeypatch.setattr(intervals, "MOST", most)
    monkeypatch.setattr(intervals, "EACH", each)
    monkeypatch.setattr(intervals, "PAIRS", 100)
    rng = np.random.default_rng(1)
    a = spans_of(rng, 250, "hot") + spans_of(rng, 20, "x") + [("y", 5, 5, "one"), ("y", 9, 3, "inverted"), (None, 1, 9, "no key"), ("y", None, 3, "no start"), ("hot", 0, 1000, "all"), ("hot", 0, 1000, "all")]
    b = spans_of(rng, 200, "hot") + spans_of(rng, 20, "z") + [("y", 5, 9, "b"), ("y", 1, 5, "c"), ("hot", 10, 12, "twice"), ("hot", 10, 12, "twice")]
    left = spark.createDataFrame(a, "k string, a_start long, a_end long, a string").repartition(3)
    right = spark.createDataFrame(b, "k string, b_start long, b_end long, b string").repartition(3)
    got = sorted(map(tuple, intervals.range_overlap(left, right, ["k"]).select("k", "a_start", "a_end", "a", "b_start", "b_end", "b").collect()))
    good = lambda x: None not in x[:3] and x[1] <= x[2]
    want = sorted((*x, *y[1:]) for x in a if good(x) for y in b if good(y) and x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    assert got == want and len(got) > 2000
    points = [(i, k, int(p)) for i, (k, p) in enumerate([("hot", x) for x in rng.integers(-20, 450, 300)] + [("x", x) for x in range(0, 60, 7)] + [("none", 3)])] + [(900, None, 3), (901, "hot", None)]
    frame = spark.createDataFrame(points, "id int, k string, at long").repartition(4)
    spans = spark.createDataFrame(a, "k string, start long, end long, name string")
    got = {r.id: r.name for r in intervals.innermost(frame, spans, ["k"], "at", ["id"]).collect()}
    best = lambda k, p: min(((x[2] - x[1], x[3]) for x in a if good(x) and x[0] == k and x[1] <= p <= x[2]), default=(0, None))[1]
    assert got == {i: best(k, p) if p is not None else None for i, k, p in points}


def test_a_hot_key_of_intervals_is_many_tasks(spark, parts):
    """One key with 200,000 intervals: no task takes more than a few parts' rows."""
    n = 200_000
    a = spark.range(n).select(F.lit("hot").alias("k"), (F.col("id") * 10).alias("a_start"), (F.col("id") * 10 + 14).alias("a_end"), F.col("id").alias("a"))
    b = a.select("k", F.col("a_start").alias("b_start"), F.col("a_end").alias("b_end"), F.col("a").alias("b"))
    rows, borders = intervals._events(a, b, ["k"], "a_start", "b_start", "b_end")
    dealt = intervals._dealt(rows, intervals._reaching(rows, borders)).groupBy("cell").count()
    assert dealt.count() == 9 and dealt.agg(F.max("count")).first()[0] < 3 * 2 * n / 9
    assert intervals.range_overlap(a, b, ["k"]).count() == 3 * n - 2


def deep(spark):
    """A ladder of ten steps, each with two ways, over a chain, and a dead end that many paths run into."""
    edges = [(3 * i, 3 * i + k) for i in range(10) for k in (1, 2)] + [(3 * i + k, 3 * i + 3) for i in range(10) for k in (1, 2)]
    return spark.createDataFrame([*edges, *[(3 * i, 1000) for i in range(10)], (1000, 1001), (70, 71), (71, 72)], "src long, dst long")


def one(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node long")


def test_paths_of_any_depth(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(4, 2)], "src long, dst long")
    got = {tuple(r.path) for r in G.simple_paths(chain, one(spark, 1), one(spark, 10, 16, 20)).collect()}
    assert got == {tuple(range(1, n + 1)) for n in (10, 16, 20)}
    with pytest.raises(ValueError):
        G.simple_paths(deep(spark), one(spark, 0), one(spark, 30), max_paths=1000)


def test_counts_of_paths_without_listing_them(spark):
    counts = G.path_counts(deep(spark), one(spark, 0), one(spark, 30, 15, 1001, 72), one(spark, 16, 4)).collect()
    got = {r.node: (int(r.paths), int(r.mediated)) for r in counts}
    # 4 is one of two ways of the second step, 16 of the sixth
    assert got == {30: (2**10, 2**10 - 2**8), 15: (2**5, 2**4), 1001: (2**10 - 1, sum(2**i - (2**i // (2 if i > 1 else 1) // (2 if i > 5 else 1)) for i in range(10)))}
    first = {(r.node, r.rank): r.path for r in G.first_paths(deep(spark), one(spark, 0), one(spark, 30, 6, 72), 3).collect()}
    assert [first[6, k] for k in (1, 2, 3)] == [[0, 1, 3, 4, 6], [0, 1, 3, 5, 6], [0, 2, 3, 4, 6]]
    assert first[30, 1] == sorted({*range(0, 31, 3), *range(1, 30, 3)}) and len(first) == 6
    bare = {r.node: (int(r.paths), int(r.uncovered), r.counterexample) for r in G.shortest_uncovered(deep(spark), one(spark, 0), one(spark, 6, 3, 0), one(spark, 1, 4)).collect()}
    assert bare == {6: (4, 1, [0, 2, 3, 5, 6]), 3: (2, 1, [0, 2, 3]), 0: (1, 1, [0])}
    with pytest.raises(ValueError):
        G.path_counts(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"), one(spark, 1), one(spark, 2), one(spark, 9))


def test_paths_do_not_follow_edges_that_lead_to_no_target(spark):
    """A cycle behind the targets and one beside the sources change no path to a target."""
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 4), (8, 9), (9, 8), (0, 8)], "src long, dst long")
    assert [(r.node, int(r.paths), int(r.mediated)) for r in G.path_counts(edges, one(spark, 0), one(spark, 3), one(spark, 1)).collect()] == [(3, 2, 1)]
    assert [(r.node, r.path) for r in G.first_paths(edges, one(spark, 0), one(spark, 3), 1).collect()] == [(3, [0, 1, 3])]
    assert [(r.node, int(r.paths), int(r.uncovered), r.counterexample) for r in G.shortest_uncovered(edges, one(spark, 0), one(spark, 3), one(spark, 1)).collect()] == [(3, 2, 1, [0, 2, 3])]
    with pytest.raises(ValueError):
        G.path_counts(edges, one(spark, 0), one(spark, 5), one(spark, 1))


def skewed(spark, n=3000):
    """Nine of ten rows in one stratum, some in none."""
    rng = np.random.default_rng(2)
    rows = [(i, None if i % 97 == 0 else "hot" if i % 10 else f"s{i % 7}", int(rng.integers(0, 50))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, s string, v int").repartition(6)


def test_samples_of_a_hot_stratum(spark, parts):
    rows, df = skewed(spark)
    groups = {}
    for i, s, _ in rows:
        groups.setdefault(s, []).append(i)
    digest = lambda seed, s, i: hashlib.sha256("\x00".join([seed, *([s] if s is not None else []), str(i)]).encode()).hexdigest()
    order = {s: sorted(ids, key=lambda i: (digest("x", s, i), i)) for s, ids in groups.items()}
    got = W.hash_sample(df, "s", "id", 20, "x")
    assert {(r.s, r.id, round(r.probability, 9)) for r in got.collect()} == {(s, i, round(min(20, len(ids)) / len(ids), 9)) for s, ids in order.items() for i in ids[:20]}
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    split = {r.id: r.side for r in W.fraction_split(df, "s", "id", 0.25, 3, "x").collect()}
    cut = {s: min(max(3, len(ids) // 4), len(ids) - 1) for s, ids in order.items()}
    assert split == {i: "development" if k < cut[s] else "confirmation" for s, ids in order.items() for k, i in enumerate(ids)}
    few, many = ({(r.s, r.id, r["rank"]) for r in W.first_rows(df, ["s"], [F.desc("v"), "id"], k).collect()} for k in (7, 1500))
    by = {s: sorted((-v, i) for i, t, v in rows if t == s) for s in groups}
    assert few == {(s, i, k) for s, x in by.items() for k, (_, i) in enumerate(x[:7], 1)} and many == {(s, i, k) for s, x in by.items() for k, (_, i) in enumerate(x[:1500], 1)}
    told = {(r.id, r.truncated) for r in W.budgeted(df, ["s"], ["id"], 5).collect()}
    assert told == {(i, len(ids) > 5) for ids in groups.values() for i in sorted(ids)[:5]}
    turns = W.round_robin(df, "s", "id").collect()
    assert sorted((r.place, r.turn, r.s or "", r.id) for r in turns) == [(p, *x) for p, x in enumerate(sorted((k, s or "", i) for s, ids in groups.items() for k, i in enumerate(sorted(ids), 1)), 1)]


def test_quantiles_of_a_hot_group(spark, parts):
    rows, df = skewed(spark)
    shares = {"low": 0.0, "q": 0.37, "median": 0.5, "top": 1.0}
    with_nulls = df.withColumn("v", F.when(F.col("id") % 11 > 0, F.col("v"))).unionByName(spark.createDataFrame([(9000, "empty", None), (9001, "single", 5)], "id long, s string, v int"))
    got = {r.s: (r.n, *(None if r[c] is None else round(r[c], 9) for c in shares)) for r in M.quantiles(with_nulls, ["s"], "v", shares).collect()}
    values = {}
    for i, s, v in [*rows, (9001, "single", 5)]:
        values.setdefault(s, []).extend([v] if i % 11 else [])
    want = {s: (len(v), *(round(float(np.quantile(v, q)), 9) for q in shares.values())) for s, v in values.items()} | {"empty": (0, *[None] * len(shares))}
    assert got == want


def test_bootstrap_weights(spark):
    steps = M.poisson_steps()
    share = np.diff([0, *steps, 16**12]) / 16**12
    assert abs(share[:4] - np.exp(-1) / np.array([1, 1, 2, 6])).max() < 1e-9
    df = spark.range(4000).select((F.col("id") % 400).alias("c"), (F.col("id") % 3 == 0).cast("int").alias("hit"))
    r = M.cluster_bootstrap(df, "c", F.col("hit"), F.lit(1)).first()
    assert abs(r.point - 1334 / 4000) < 1e-9 and r.lower < r.point < r.upper and r.upper - r.lower < 0.02


@pytest.mark.parametrize("chunk", [2048, 3])
@pytest.mark.parametrize("percent", [60, 90])
def test_similar_sets_with_hot_tokens(spark, parts, chunk, percent):
    """Sets whose first tokens are the same for many of them, of different sizes, with near copies and equal sets."""
    rng = np.random.default_rng(percent)
    sets = {}
    for i in range(60):
        n = int(rng.integers(4, 30))
        sets[i] = set(rng.choice(25, min(n, 25), replace=False).tolist())
        if i % 3 == 1:  # a near copy of the last
            sets[i] = (sets[i - 1] | {int(rng.integers(0, 25))}) - {int(rng.integers(0, 25))}
        if i % 10 == 9:
            sets[i] = set(sets[i - 4])
    tokens = spark.createDataFrame([(i, int(t)) for i, s in sets.items() for t in s], "id long, token long")
    first = {}
    for i, s in sets.items():
        first.setdefault(frozenset(s), i)
    kept = {i: s for s, i in first.items() if len(s) >= 5}
    want = {(a, b, len(x & y), len(x | y)) for a, x in kept.items() for b, y in kept.items() if a < b and 100 * len(x & y) >= percent * len(x | y)}
    got = [tuple(r) for r in J.similar_sets(tokens, percent, 5, chunk=chunk).collect()]
    assert set(got) == want and len(got) == len(want) > 5


def test_spans_that_do_not_overlap(spark, parts):
    rng = np.random.default_rng(4)
    rows = [(k, s, e, n) for k, s, e, n in spans_of(rng, 900, "hot") + spans_of(rng, 30, "x") + [("z", 5, 5, "a"), ("z", 5, 5, "b"), ("z", 5, 9, "c"), (None, 1, 2, "d"), ("z", None, 2, "e"), ("z", 7, None, "f")]]
    want = set()
    for key in ("hot", "x", "z"):
        reach = float("-inf")
        for k, s, e, n in sorted((r for r in rows if r[0] == key and None not in r), key=lambda r: (r[1], -r[2])):
            if s >= reach:
                want.add((k, s, e))
                reach = e
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    got = intervals.nonoverlapping(spark.createDataFrame(rows, "k string, start long, end long, name string").repartition(5), ["k"], "start", "end").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) and {tuple(r)[:3] for r in got if r.kept} == want
    assert sum(r.kept for r in got if r.k == "hot") == sum(w[0] == "hot" for w in want)


def test_sets_are_joined_without_a_shuffle_of_their_tokens(spark, monkeypatch):
    """Common tokens come last, sets of a row each are not gathered again, and the pairs are those of brute force."""
    rng = np.random.default_rng(4)
    base = [sorted(set(rng.integers(0, 4000, 30).tolist()) | set(range(5000, 5010))) for _ in range(40)]
    sets = {i: sorted(set(base[i % 40]) - {base[i % 40][i // 40]} | ({9000 + i} if i % 3 else set())) for i in range(200)}
    sets |= {200 + i: sets[i] for i in range(20)}
    monkeypatch.setattr(J, "EVERY", 2)
    frame = spark.createDataFrame([(i, t) for i, t in sets.items()], "id long, tokens array<long>")
    kept, member = J.distinct_sets(frame, 5)
    assert "tokens" not in "".join(x for x in kept._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)
    firsts = {r.id: r.a for r in member.collect()}
    assert firsts == {i: min(j for j, u in sets.items() if u == t) for i, t in sets.items()}
    got = sorted(tuple(r) for r in J.similar_of(kept, 80, chunk=16).collect())
    own = sorted(set(firsts.values()))
    pairs = ((a, b, len(set(sets[a]) & set(sets[b])), len(set(sets[a]) | set(sets[b]))) for a in own for b in own if a < b)
    assert got == [p for p in pairs if p[2] * 100 >= 80 * p[3]] and len(got) > 100


def test_similar_sets_write_and_join_few_tokens(spark, monkeypatch):
    """Of every set only its first tokens are written, and sets that share one rare token but no more are not compared whole."""
    rng = np.random.default_rng(7)
    sets = {i: sorted({i // 10, *rng.choice(1 << 40, 60, replace=False).tolist()}) for i in range(600)}
    sets |= {600 + i: sorted({*sets[i][:-2], (1 << 41) + i}) for i in range(0, 600, 30)} | {700: sets[3]}
    seen = {}

    class Noted(shared.Staged):
        def __init__(self, df, name="stage", partition_by=None):
            super().__init__(df, name, partition_by)
            lists = [F.coalesce(F.sum(F.size(f.name)), F.lit(0)) for f in df.schema if f.dataType.simpleString() == "array<bigint>"]
            seen[name] = (df.columns, self.df.count(), sum(self.df.agg(*lists).first()) if lists else 0)

    monkeypatch.setattr(shared, "Staged", Noted)
    monkeypatch.setattr(J, "Staged", Noted)
    frame = spark.createDataFrame([(i, t) for i, t in sets.items()], "id long, tokens array<long>")
    got = sorted(tuple(r) for r in J.similar_of(J.distinct_sets(frame, 5)[0], 90).collect())
    own = {i: set(t) for i, t in sets.items() if i != 700}
    assert got == [(a, b, len(x & y), len(x | y)) for a, x in own.items() for b, y in own.items() if a < b and 100 * len(x & y) >= 90 * len(x | y)] and len(got) >= 20
    assert sum(longs for _, _, longs in seen.values()) < sum(map(len, sets.values())) / 3
    assert min(rows for columns, rows, _ in seen.values() if columns == ["a", "b"]) < 2 * len(got)


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_near_copies(spark, parts, monkeypatch, small):
    """Pairs of sets and members in one, with sets, tokens and pairs broadcast or joined."""
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "EVERY", 1)
    rng = np.random.default_rng(8)
    base = [sorted(set(rng.integers(0, 60, 9).tolist()) | set(rng.integers(-5000, 5000, 40).tolist())) for _ in range(30)]
    sets = {i: sorted(set(base[i % 30]) - {base[i % 30][i // 30]}) for i in range(150)} | {150: base[0][:4], 151: [], 152: None}
    sets |= {160 + i: sets[i] for i in range(0, 150, 7)}
    frame = spark.createDataFrame([(f"k{i:03}", t) for i, t in sets.items()], "id string, tokens array<long>").repartition(5)
    pairs, member = J.near_copies(frame, 90, 5, chunk=8)
    kept = {i: t for i, t in sets.items() if t and len(t) >= 5}
    first = {i: min(j for j, u in kept.items() if u == t) for i, t in kept.items()}
    assert {(r.id, r.a) for r in member.collect()} == {(f"k{i:03}", f"k{a:03}") for i, a in first.items()}
    own = {i: set(kept[i]) for i in first.values()}
    want = sorted((f"k{a:03}", f"k{b:03}", len(x & y), len(x | y)) for a, x in own.items() for b, y in own.items() if a < b and 100 * len(x & y) >= 90 * len(x | y))
    assert sorted(map(tuple, pairs.collect())) == want and len(want) > 50


def test_components_of_near_copies_make_the_sets_once(spark, monkeypatch):
    """Pairs and members come from one pass over the texts."""
    from cairn.plans import graphs, joins

    calls, made = [], joins._sets
    monkeypatch.setattr(joins, "_sets", lambda s, d: calls.append(d) or made(s, d))
    got = {r.status: r.n for r in graphs.near_copy_components(spark, "/root/testdata/sf0.001").collect()}
    assert len(calls) == 1 and sum(got.values()) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
