"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)), the identity that
makes the pairwise term linear in the non-zero features. Features are computed in Arrow functions; the
model is fitted on a bounded sample of labelled rows and travels with the scoring function.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import kernels as K
from cairn.llm.spans import free_names

WORDS = 1 << 12
BINS = 16
FACTORS = 8
# The largest number of labelled documents that the model is fitted on.
SAMPLE = 12_000
EPOCHS = 8
HOLDOUT = 5
THRESHOLD = 0.3

_upper = np.zeros(256, bool)
_upper[65:91] = True
_lower = np.zeros(256, bool)
_lower[97:123] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
_high = np.zeros(256, bool)
_high[128:] = True
_line = np.zeros(256, bool)
_line[10] = True
_stop = np.zeros(256, bool)
_stop[[46, 44, 63, 59, 58]] = True
_sign = ~(_upper | _lower | _digit | _high | K.SPACE | _stop)
CLASSES = [_upper, _lower, _digit, _high, _line, _stop, _sign, K.SPACE]
N_STATS = len(CLASSES) + 5
# The metadata: the class of the number of characters that the table gives (n_chars), 0 where it gives none.
META = WORDS + N_STATS * BINS
N_FEATURES = META + BINS


def per_text(data: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def size_class(n_chars: pa.Array | None, n_docs: int) -> np.ndarray:
    """Bins of the given numbers of characters, by their logarithm; 0 for none or a negative one."""
    if n_chars is None:
        return np.zeros(n_docs, np.int64)
    n = np.maximum(n_chars.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False), -1)
    return np.where(n < 0, 0, np.minimum(1 + (0.75 * np.log2(n + 1.5)).astype(np.int64), BINS - 1))


def features(data: np.ndarray, offsets: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value), sorted by document. Word values are relative counts, so whole texts of any length count alike."""
    n_docs = len(offsets) - 1
    size = np.diff(offsets)
    code, doc, start, end = K.words(data, offsets)
    bucket = (code >> np.uint64(20)).astype(np.int64) & (WORDS - 1)
    pair, times = np.unique(doc * WORDS + bucket, return_counts=True)
    n_words = np.bincount(doc, minlength=n_docs)
    distinct = np.bincount(np.unique(doc.astype(np.uint64) << np.uint64(40) | code >> np.uint64(24)) >> np.uint64(40), minlength=n_docs)
    length = np.bincount(doc, weights=end - start, minlength=n_docs)
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, doc, end - start)
    parts = np.maximum(size, 1)
    stats = [np.sqrt(per_text(data, offsets, c[data]) / parts) for c in CLASSES]
    words = np.maximum(n_words, 1)
    stats += [np.log1p(size) / 14, np.log1p(n_words) / 12, distinct / words, np.minimum(length / words / 16, 1), np.log1p(longest) / 8]
    bins = np.clip((np.array(stats).T * BINS).astype(np.int64), 0, BINS - 1) + np.arange(N_STATS) * BINS + WORDS
    x_doc = pair // WORDS
    at = np.concatenate([x_doc, np.repeat(np.arange(n_docs), N_STATS), np.arange(n_docs)])
    which = np.concatenate([pair % WORDS, bins.ravel(), META + meta])
    value = np.concatenate([np.sqrt(times / words[x_doc]), np.full(n_docs * (N_STATS + 1), 0.5)])
    order = np.argsort(at, kind="stable")
    return at[order], which[order], value[order]


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, at: np.ndarray, which: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
        """Every document has its statistics features, so each has a run of rows."""
        begin = np.searchsorted(at, np.arange(n_docs))
        vx = self.factor[which] * value[:, None]
        total, squares = np.add.reduceat(vx, begin, axis=0), np.add.reduceat(vx * vx, begin, axis=0)
        return self.bias + np.add.reduceat(self.weight[which] * value, begin) + 0.5 * (total * total - squares).sum(1)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, seed: int = 11) -> Model:
    """Logistic loss, Adagrad steps over shuffled batches of documents; rows are (feature, value) of a document."""
    rng = np.random.Generator(np.random.PCG64(seed))
    model = Model(0.0, np.zeros(N_FEATURES), rng.normal(0, 0.02, (N_FEATURES, FACTORS)))
    if not len(rows) or label.min() == label.max():
        model.factor[:] = 0
        model.bias = 0.0 if not len(rows) else float(np.log((label.mean() + 0.01) / (1.01 - label.mean())))
        return model
    model.bias = float(np.log(label.mean() / (1 - label.mean())))
    seen_w, seen_v, seen_b = np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, FACTORS), 1e-6), 1e-6
    for epoch in range(EPOCHS):
        rate = 0.1 / (1 + epoch)
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 64):
            batch = order[lo : lo + 64]
            which = np.concatenate([rows[i][0] for i in batch])
            value = np.concatenate([rows[i][1] for i in batch]).astype(float)
            at = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            begin = np.searchsorted(at, np.arange(len(batch)))
            vx = model.factor[which] * value[:, None]
            total = np.add.reduceat(vx, begin, axis=0)
            z = model.bias + np.add.reduceat(model.weight[which] * value, begin) + 0.5 * (total * total - np.add.reduceat(vx * vx, begin, axis=0)).sum(1)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[batch]
            push = error[at] * value
            touched, place = np.unique(which, return_inverse=True)
            grad_w = np.bincount(place, push) / len(batch) + 1e-5 * model.weight[touched]
            grad_v = np.stack([np.bincount(place, push * (total[at, f] - vx[:, f])) for f in range(FACTORS)], 1) / len(batch) + 1e-4 * model.factor[touched]
            seen_w[touched] += grad_w**2
            seen_v[touched] += grad_v**2
            seen_b += error.mean() ** 2
            model.weight[touched] -= rate * grad_w / np.sqrt(seen_w[touched])
            model.factor[touched] -= 0.3 * rate * grad_v / np.sqrt(seen_v[touched])
            model.bias -= rate * error.mean() / np.sqrt(seen_b)
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo HOLDOUT; 0 rows, and rows without an id, are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HOLDOUT, F.lit(0))


def given_size(docs: DataFrame) -> Column:
    """The column n_chars, or null where docs has none that is a number."""
    whole = "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, T.IntegralType)
    return F.col("n_chars").cast("long") if whole else F.lit(None).cast("long")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most sample labelled documents, those with the smallest hash of the id, outside the held-out fold."""
    usable = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0)).select("doc_id", "quality")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    picked = docs.select("doc_id", "text", given_size(docs).alias("n")).join(F.broadcast(chosen), "doc_id").select("text", "quality", "n")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(0))
            quality = batch.column(1).cast(pa.int32())
            for i, j in K.slices(offsets):
                at, which, value = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size_class(batch.column(2).slice(i, j - i), j - i))
                bounds = pa.array(K.per_document(at, j - i), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [quality.slice(i, j - i), pa.ListArray.from_arrays(bounds, pa.array(which, pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(value, pa.float32()))],
                    ["quality", "which", "value"],
                )

    got = picked.mapInArrow(extract, "quality int, which array<int>, value array<float>").toArrow()
    label = got["quality"].to_numpy()
    # views of what has arrived: about 8 bytes for each feature of a sampled text
    rows = [(w.values.to_numpy(), v.values.to_numpy()) for w, v in zip(got["which"], got["value"], strict=True)]
    # the order in which executors answer must not change the model
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i][0]), hashlib.sha256(rows[i][0].tobytes() + rows[i][1].tobytes()).digest(), int(label[i])))
    return fit([rows[i] for i in order], label[order].astype(float))


def with_scores(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a column score: the probability of label 1. Nulls and empty texts are scored as texts without words.

    A column of docs named like the new one, in any case, is replaced. A text is held whole by its task, with about 100 bytes for each of its words.
    """
    columns = [c for c in docs.columns if c.lower() != name.lower()]
    at_text = columns.index(text)
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(name, T.DoubleType())])
    given, = free_names(docs, "given")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(at_text))
            score = np.zeros(batch.num_rows)
            for i, j in K.slices(offsets):
                found = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size_class(batch.column(len(columns)).slice(i, j - i), j - i))
                score[i:j] = 1 / (1 + np.exp(-np.clip(model.logits(*found, j - i), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(score)], [*columns, name])

    return docs.select(*columns, given_size(docs).alias(given)).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """docs with score, held_out and predicted (1 if score >= threshold).

    Repeated rows are scored each; a repeated label row counts as often as it stands. Without any usable
    label every score is 0.5. Columns of docs named like a new one, in any case, are replaced; an empty table gives no rows.
    """
    model = train(docs, labels, sample)
    out = with_scores(docs.select([c for c in docs.columns if c.lower() not in ("held_out", "predicted")]), model)
    return out.withColumns({"held_out": fold(F.col("doc_id")) == 0, "predicted": (F.col("score") >= threshold).cast("int")})


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents predicted as good, with their own columns, whatever their names."""
    score, = free_names(docs, "score")
    return with_scores(docs, train(docs, labels), name=score).where(F.col(score) >= threshold).select(docs.columns)
