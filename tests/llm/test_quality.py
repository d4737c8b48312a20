"""Held-out figures of the quality classifier, on the driver's smaller tables."""

import zlib

import numpy as np

from cairn.llm.q8 import query

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").where("quality in (0, 1)").collect()}
    rows = query(spark, DIR).select("doc_id", "held_out", "score", "predicted").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(labels[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    y, score, told = (np.array(x) for x in zip(*held, strict=True))
    good, bad = score[y == 1], score[y == 0]
    auc = np.mean((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :]))
    print("held out", len(y), "AUC", round(float(auc), 4), "accuracy", round(float(np.mean(told == y)), 4))
    assert len(y) >= 50 and auc >= 0.95 and np.mean(told == y) >= 0.9
