"""Hard negatives, fingerprints and resampling: brute force, odd rows, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import one_permutation, position_ngrams, vector_approximation
from cairn.llm.q11 import query as q11

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def negatives_of(rows):
    """By definition, from (vec_id, embedding, label); rows of one id count once."""
    clean = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(256 * x) >= 2**27 for x in v):
            continue
        moved = (label + 1) % 10 if i % 7 == 0 else label
        one = (moved, [math.floor(256 * float(np.float32(x))) for x in v])
        clean[i] = min(clean.get(i, one), one)
    out = []
    for a, (label, v) in clean.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(v, u, strict=True)) for i, (_, u) in clean.items() if i != a and len(u) == len(v)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if clean[i][0] == label][:5]:
            inside = [i for i in order if clean[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:10]
            out += [(a, p, r, n, score[p], score[n]) for r, n in enumerate(inside, 1)]
    return sorted(out)


def run_q11(spark, tmp_path, rows, schema=EMBEDDINGS):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(map(tuple, q11(spark, str(tmp_path)).collect()))


@pytest.mark.parametrize("rows_of_block", [2048, 37])
def test_hard_negatives(spark, tmp_path, monkeypatch, rows_of_block):
    monkeypatch.setattr(vector_approximation, "ROWS", rows_of_block)
    rng = np.random.default_rng(11)
    v = rng.standard_normal((700, 12))
    rows = [(i, (x / np.linalg.norm(x)).tolist(), int(rng.integers(0, 10))) for i, x in enumerate(v)]
    hot = rows[5][1]
    rows += [(700 + i, hot, 3) for i in range(120)] + [(900 + i, hot, 4) for i in range(60)]  # ties of score
    rows += [(1000, None, 1), (1001, [0.5, None], 1), (1002, [float("nan")] * 12, 1), (1003, [float("inf")] * 12, 2), (1100, rows[3][1], None), (None, rows[3][1], 1)]
    rows += [(1200, [0.0] * 12, 2), (1201, [], 2), (1202, [], 3), (1300, [], 2), (1203, [1e30] * 12, 2)]
    rows += [(1400 + i, [0.25, -0.5, 0.125], i % 3) for i in range(9)] + [(1500, [0.5, -0.25, 0.5], 0)]
    rows += rows[:50] + [(100, [0.1] * 12, 9)]  # repeated rows, and a key with two rows
    got = run_q11(spark, tmp_path, rows)
    assert got == negatives_of(rows) and len(got) > 300


def test_hard_negatives_of_little(spark, tmp_path):
    assert run_q11(spark, tmp_path / "a", []) == []
    assert run_q11(spark, tmp_path / "b", [(0, [1.0, 0.0], 1)]) == []
    one = [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 2), (2, [0.5, 0.0], 2)]  # 0 moves to label 2
    assert run_q11(spark, tmp_path / "c", one) == []
    assert run_q11(spark, tmp_path / "d", [*one, (3, [0.5, 0.5], 1)]) == [(0, 1, 1, 3, 65536, 32768)]


def test_bounds_hold(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-300, 300, (500, 9))
    vectors[:, 4] = rng.integers(0, 3, 500)
    cells, low, high = vector_approximation.approximated(vectors)
    block = vector_approximation.Block(9, *(x.tobytes() for x in (np.arange(500), np.zeros(500, int), vectors.astype(np.int32), np.ascontiguousarray(cells.T), low, high)))
    anchors = rng.integers(-300, 300, (7, 9))
    lower, upper = block.bounds(block.tables(anchors), 0, 500)
    exact = vectors @ anchors.T
    assert (lower <= exact).all() and (exact <= upper).all() and (upper - lower).mean() < exact.std()


DOCUMENTS = "doc_id long, text string, fingerprint string, N_CHARS int"
WORDS = "the of river stone quiet lamp copper window morning seven garden letter bridge silver cloud winter paper road music".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


def shingles(text, width=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark):
    rng = np.random.default_rng(12)
    long = prose(rng, 60_000)
    texts = [None, "", "  \n", "one", "é漢字𝔘 x", "a b c d", *[prose(rng, int(n)) for n in rng.integers(1, 700, 60)], long, long, prose(rng, 200)]
    order = rng.permutation(len(texts))
    rows = [(int(3 * i), texts[i], "x", 1) for i in order]
    rows += [(7, "same key " * 30, None, None), (7, "same key " * 30, None, None), (None, "a null key comes last of all", None, None)]
    got = one_permutation.near_edits(spark.createDataFrame(rows, DOCUMENTS).repartition(5)).collect()
    assert len(got) == len(rows)
    by = sorted(((i, t or "") for i, t, *_ in rows), key=lambda x: (x[0] is None, -(x[0] or 0)))
    want = Counter()
    for (i, t), (_, after) in zip(by, by[1:] + by[:1], strict=True):
        half = len(t) // 2
        want[i, len(t), t[: len(t) - half] + after[:half], after] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_text, r.next_text) for r in got) == want
    for r in got:
        assert (r.fingerprint == "") == (not shingles(r.text)) and len(r.fingerprint) in (0, 256)
        assert abs(r.near_edited - jaccard(r.text, r.edited_text)) < 0.2 and abs(r.near_next - jaccard(r.text, r.next_text)) < 0.2
        assert r.text != r.edited_text or r.near_edited == 1.0
    errors = [r.near_edited - jaccard(r.text, r.edited_text) for r in got if len(shingles(r.text)) > 30]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    prints = {}
    for r in got:
        assert prints.setdefault(r.text, r.fingerprint) == r.fingerprint


@pytest.mark.parametrize("n", [3, 30, 300])
def test_likeness_has_no_bias(spark, n):
    """Sets of n to 2 n words with a third in common, so that nearly all bins, some or few have to be filled."""
    rng = np.random.default_rng(n)
    pairs = []
    for _ in range(150):
        w = [f"w{x}" for x in rng.integers(0, 1 << 60, 3 * n + 4)]
        pairs.append((" ".join(w[: 2 * n + 4]), " ".join(w[n:])))  # 2 n shingles each, n of them shared
    prints = spark.createDataFrame(pairs, "a string, b string").select(*[one_permutation.fingerprint(F.col(c)).alias(c) for c in "ab"])
    found = [r[0] for r in prints.select(one_permutation.likeness(F.col("a"), F.col("b"))).collect()]
    assert abs(np.mean(found) - 1 / 3) < 0.03


def test_fingerprints_of_little(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert one_permutation.near_edits(empty).count() == 0
    alone = one_permutation.near_edits(spark.createDataFrame([(5, "abcd efgh", None, None)], DOCUMENTS)).first()
    assert (alone.edited_text, alone.next_text) == ("abcd abcd", "abcd efgh") and alone.near_next == 1.0
    kept = one_permutation.with_fingerprints(spark.createDataFrame([(5, None, "x", 2)], DOCUMENTS), name="n_chars")
    assert kept.columns == ["doc_id", "text", "fingerprint", "n_chars"] and tuple(kept.first()) == (5, None, "x", "")


def resampled(docs, target, percent=25, least=20):
    def grams(text):
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        return len(w), [zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    rows = [(k, *grams(t)) for k, t in docs]
    s, t = Counter(b for r in rows for b in r[2]), Counter(b for x in target for b in grams(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in s}
    out = []
    for k, n, found in rows:
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        # a null key is left out of what is hashed
        h = int(hashlib.sha256(f"7:{k}".encode() if k is not None else b"7").hexdigest()[:8], 16)
        out.append((k, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    order = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    k = percent * len(order) // 100
    return Counter([(*r[:4], i if i <= k else None) for i, r in enumerate(order, 1)] + [(*r[:4], None) for r in out if r[4] < least])


def test_resampling(spark):
    rng = np.random.default_rng(13)
    docs = [(i, prose(rng, int(n)) + " Straße ÉCOLE 42x!") for i, n in enumerate(rng.integers(0, 120, 200))]
    docs += [(500, None), (501, ""), (502, "..."), (503, "A-b,C"), (504, prose(rng, 30_000)), (None, prose(rng, 40)), (505, "İ K ſ " * 20)]
    docs += docs[:20] + [(505, "x y " * 30)]  # repeated rows and keys
    target = [prose(rng, 50), None, "", "copper window copper window Straße"]
    frame = spark.createDataFrame([(k, t, 1, "no") for k, t in docs], "doc_id long, text string, row int, RANK string").repartition(4)
    for wanted in (target, []):
        got = position_ngrams.resample(frame, spark.createDataFrame([(t, 0) for t in wanted], "text string, score int")).collect()
        assert Counter(map(tuple, got)) == resampled(docs, wanted)
    assert position_ngrams.resample(frame.limit(0), frame).count() == 0


def test_resampling_by_longer_runs(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a")], "doc_id long, text string")
    got = {r.doc_id: r.n_features for r in position_ngrams.resample(docs, docs, orders=3, least_words=1, percent=100).collect()}
    assert got == {1: 9, 2: 1}
