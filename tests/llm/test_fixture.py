"""All numbered queries on one small fixture: texts beyond a slice of the kernels, nulls, empty and repeated texts, planted vectors and passages.

Queries with SQL are compared with DuckDB on it; the others with plain Python or what the fixture plants.
"""

import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cairn.llm import queries as llm

WORDS = "the of and river stone quiet lamp copper window morning seven garden letter bridge silver cloud winter paper road music".split()
TABLES = ("documents", "embeddings", "benchmark", "labels")


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    rng = np.random.default_rng(21)
    item = "Which quiet bridge crosses the copper river near the old mill of Harrow? The answer is the seven stone bridge."
    long = prose(rng, 260_000)  # over 1 MB
    passage = prose(rng, 70)
    texts = [None, "", " \n ", "one", "Two words", long, long[:-300] + " token=abcdefgh12345 mail me@host.example.org " + prose(rng, 50), prose(rng, 60) + " " + passage, passage + " " + prose(rng, 30)]
    texts += [prose(rng, 200) + " " + item + " " + prose(rng, 100), "Released under the MIT License.", "Straße ÉCOLE 漢字 " * 40]
    texts += [prose(rng, int(n)) for n in rng.integers(5, 200, 25)]
    texts += [texts[-1], texts[-1], texts[20] + " more"]
    n = len(texts)
    folder = tmp_path_factory.mktemp("tables")
    put = lambda name, columns: pq.write_table(pa.table(columns), folder / f"{name}.parquet", row_group_size=7)
    put("documents", {"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(["en"] * n), "source": pa.array(["hot"] * n), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())})
    put("benchmark", {"item_id": pa.array([0, 1, 2], pa.int64()), "text": pa.array([item, None, ""], pa.string())})
    put("labels", {"doc_id": pa.array(range(n), pa.int64()), "quality": pa.array([int(len(t or "") > 300) for t in texts], pa.int32()), "toxic": pa.array([0] * n, pa.int32())})
    base = rng.standard_normal((40, 64))
    near = base[:20] + 0.25 * rng.standard_normal((20, 64)) * np.linspace(0.2, 1.6, 20)[:, None]
    hot = np.tile(base[30], (60, 1)) + 0.02 * rng.standard_normal((60, 64))
    v = np.concatenate([base, near, hot, np.zeros((1, 64))])
    v[:100] /= np.linalg.norm(v[:100], axis=1)[:, None]
    vectors = [x.astype(np.float32).tolist() for x in v] + [None, [float("nan")] * 64, [None] * 64]
    m = len(vectors)
    put("embeddings", {"vec_id": pa.array(range(m), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([None if i == 7 else i % 4 for i in range(m)], pa.int32())})
    return str(folder), texts


SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, tables, name):
    folder, _ = tables
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = c.execute(SQL[name])
    names = [x[0] for x in found.description]
    want = sorted(map(repr, found.fetchall()))
    got = sorted(repr(tuple(r)) for r in llm.queries()[name](spark, folder).select(names).collect())
    assert got == want
    if name == "op2_lattice":
        assert sum("False" in x for x in got) >= 70  # the planted links are there


def rows(spark, tables, name):
    return llm.queries()[name](spark, tables[0]).collect()


def test_packing(spark, tables):
    import zlib

    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in enumerate(tables[1])}
    got = sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows(spark, tables, "op1_packing"))
    assert {d: sum(r[2] for r in got if r[0] == d) for d in ids} == {d: len(x) for d, x in ids.items()}
    assert all(crc == zlib.crc32(np.array(ids[d][a : a + n], "<u4").tobytes()) and total == len(ids[d]) for d, a, n, crc, total in got)


def test_token_counts(spark, tables):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows(spark, tables, "op10_token_counts")} == {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in enumerate(tables[1])}


def test_repeats(spark, tables):
    raw = [(t or "").encode() for t in tables[1]]
    seen, twice = set(), set()
    for t in raw:
        for p in range(len(t) - 199):
            h = hash(t[p : p + 200])
            (twice if h in seen else seen).add(h)
    want = {}
    for i, t in enumerate(raw):
        gone = np.zeros(len(t) + 1, int)
        for p in range(len(t) - 199):
            if hash(t[p : p + 200]) in twice:
                gone[p] += 1
                gone[p + 200 if p + 200 < len(t) else len(t)] -= 1
        covered = np.cumsum(gone)[: len(t)] > 0
        left = np.frombuffer(t, np.uint8)[~covered].tobytes()
        want[i] = (len(t), int(covered.sum()), hashlib.sha256(left).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in rows(spark, tables, "op7_repeats")} == want


def test_decontamination_finds_the_planted_item(spark, tables):
    assert {(r.doc_id, r.item_id) for r in rows(spark, tables, "op4_decontamination")} == {(9, 0)}


def test_scans(spark, tables):
    texts = tables[1]
    secrets = {r.doc_id: (r.n_assign, r.spans) for r in rows(spark, tables, "op6_secrets")}
    at = texts[6].index("token=")
    assert secrets[6][0] == 1 and f"assign:{at}:{at + len('token=abcdefgh12345')}" in secrets[6][1] and sum(n for n, _ in secrets.values()) == 1
    mails = {r.doc_id: r.n_email for r in rows(spark, tables, "op3_pii")}
    assert mails[6] == 1 and sum(mails.values()) == 1 and len(mails) == len(texts)
    assert {(r.doc_id, r.family) for r in rows(spark, tables, "op9_licenses")} == {(10, "mit")}


def test_quality_scores_every_document(spark, tables):
    got = {r.doc_id: r.score for r in rows(spark, tables, "op8_quality")}
    assert set(got) == set(range(len(tables[1]))) and all(0 <= x <= 1 for x in got.values())


def test_fingerprints(spark, tables):
    texts = [t or "" for t in tables[1]]
    got = {r.doc_id: r for r in rows(spark, tables, "op12_fingerprints")}
    order = sorted(got, reverse=True)
    for d, after in zip(order, order[1:] + order[:1], strict=True):
        half = len(texts[d]) // 2
        assert got[d].edited_sha256 == hashlib.sha256((texts[d][: len(texts[d]) - half] + texts[after][:half]).encode()).hexdigest()
    assert got[6].near_next > 0.95  # the two long texts
