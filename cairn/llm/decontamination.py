"""Benchmark decontamination: every training passage queries a BM25 inverted index of the test items.

A passage is a window of words; windows overlap by half, so an item of up to half a window lies whole in
one. Weights are divided by the score of an item against itself, so one threshold holds for all items.
An item's lightest terms, MINOR of its weight, cannot lift it over the threshold alone: postings of the
other, essential terms are summed for many passages at once, and only passages that could hold an item go
to block-max WAND, which skips the blocks of a posting list that cannot lift an item over the threshold.
What is retrieved is verified
on five-word runs of the item's question (all sentences but the last) and answer (the last one); both must
be there. A part of fewer words is one run of all its words.

Documents are mapped, never shuffled. The index of at most SHARD_WORDS item words goes to the tasks; a
larger benchmark is cut into shards, and each shard is one more map over the documents. Document
frequencies, the number of items and their mean length are those of the whole benchmark in every shard.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import kernels as K
from cairn.operators.shared import Staged

U64 = np.uint64
K1, B = 1.2, 0.75
BLOCK = 16
PASSAGE = 128
RUN = 5
THETA = 0.5
MINOR = 0.1
# A retrieved item is found if both parts have this share of their runs in the passage.
SHARE = 0.5
SHARD_WORDS = 2_000_000
GAP = np.ones(128, bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
GAP = np.concatenate([GAP, np.zeros(128, bool)])
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def parts(text: str) -> tuple[str, str]:
    """(question, answer) of an item: all sentences but the last, and the last; one sentence is both."""
    sentences = [x for x in SENTENCE.split(text.strip()) if re.search(r"\w", x)]
    return (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (text, text)


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = K.text_bytes(pa.array(texts, pa.string()))
    code, doc, _, _ = K.words(data, offsets, GAP)
    return code, doc


def run_sets(texts: list[str]) -> list[tuple[int, np.ndarray]]:
    """(words in a run, distinct runs) of each text: RUN words, or all of a shorter text."""
    code, doc = terms(texts)
    bounds = K.per_document(doc, len(texts))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        width = min(RUN, b - a)
        out.append((width, runs_of(code[a:b], width)))
    return out


def runs_of(code: np.ndarray, width: int) -> np.ndarray:
    """The distinct runs of width words; none in a shorter text or for a width of 0."""
    return np.unique(K.shingles(code, np.zeros(len(code), np.int64), 1, width)[0]) if 0 < width <= len(code) else np.zeros(0, U64)


@dataclass
class Statistics:
    """Number and mean length of all items, and the document frequencies of terms, in the order of their codes."""

    items: int
    mean: float
    code: np.ndarray
    df: np.ndarray


@dataclass
class Index:
    """Posting lists in term order: items, normalised weights, and the largest weight of each block and term."""

    ids: list
    term: np.ndarray
    start: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    block_start: np.ndarray
    block_max: np.ndarray
    most: np.ndarray
    major_start: np.ndarray
    major_item: np.ndarray
    major_weight: np.ndarray
    question: list[tuple[int, np.ndarray]]
    answer: list[tuple[int, np.ndarray]]
    passage: int

    def lists(self) -> tuple[list, ...]:
        """The posting lists as Python lists, in which single look-ups are quick."""
        if not hasattr(self, "_lists"):
            self._lists = tuple(x.tolist() for x in (self.start, self.item, self.weight, self.block_start, self.block_max, self.most))
        return self._lists


def width_of(words: int) -> int:
    """Words of the windows in which an item of so many words is sought: PASSAGE, or twice the next power of two for a longer item."""
    return max(PASSAGE, 2 << max(0, words - 1).bit_length())


def statistics(texts: list[str]) -> Statistics:
    code, at = terms(texts)
    pair = np.unique(np.stack([code, at.astype(U64)]), axis=1)
    term, df = np.unique(pair[0], return_counts=True)
    return Statistics(len(texts), len(code) / len(texts) if texts else 1.0, term, df)


def by_width(ids: list, texts: list[str], whole: Statistics | None = None) -> list[Index]:
    """An index for each width of window that the items ask for, all with the same statistics, so no item changes how another is sought."""
    code, at = terms(texts)
    widths = [width_of(n) for n in np.bincount(at, minlength=len(texts)).tolist()]
    whole = whole or statistics(texts)
    of = {w: [k for k, x in enumerate(widths) if x == w] for w in sorted(set(widths))}
    return [build([ids[k] for k in held], [texts[k] for k in held], whole) for held in of.values()]


def build(ids: list, texts: list[str], whole: Statistics | None = None) -> Index:
    """The index of some items, sought in the windows of the longest; whole has the statistics of the benchmark, where these are not all of its items."""
    code, at = terms(texts)
    n = len(texts)
    order = np.lexsort((at, code))
    code, at = code[order], at[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (at[1:] != at[:-1])
    first = np.flatnonzero(fresh)
    tf = np.diff(np.append(first, len(code)))
    code, item = code[first], at[first]
    term, start = np.unique(code, return_index=True)
    start = np.append(start, len(code))
    df = np.diff(start)
    size = np.bincount(at, minlength=n)
    if whole is None:
        whole = Statistics(n, float(size.mean()) if n else 1.0, term, df)
    among = whole.df[np.searchsorted(whole.code, term)]
    idf = np.log1p((whole.items - among + 0.5) / (among + 0.5))
    norm = K1 * (1 - B + B * size / max(1.0, whole.mean))
    weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[item])
    weight /= np.bincount(item, weights=weight, minlength=n)[item]
    blocks = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(start[:-1], start[1:], strict=True)]) if len(term) else np.zeros(0, int)
    block_start = np.searchsorted(blocks, start)
    block_max = np.maximum.reduceat(weight, blocks) if len(blocks) else np.zeros(0)
    most = np.maximum.reduceat(weight, start[:-1]) if len(term) else np.zeros(0)
    # an item's terms from the lightest on, until MINOR of its weight is passed
    light = np.lexsort((weight, item))
    summed = np.cumsum(weight[light])
    opens = np.searchsorted(item[light], np.arange(n))
    before = np.concatenate([[0.0], summed])[opens]
    major = np.zeros(len(weight), bool)
    major[light] = summed - before[item[light]] > MINOR
    major_start = np.concatenate([[0], np.cumsum(major)])[start]
    split = [parts(x) for x in texts]
    return Index(ids, term, start, item, weight, block_start, block_max, most, major_start, item[major], weight[major], run_sets([q for q, _ in split]), run_sets([a for _, a in split]), width_of(int(size.max(initial=0))))


def wand(index: Index, query: np.ndarray, theta: float) -> list[tuple[int, float]]:
    """All (item, score) with a score of theta or more for the distinct term numbers of a passage, by block-max WAND."""
    start, item, weight, block_start, block_max, most = index.lists()
    out = []
    # item under the cursor, cursor, end, term
    cursors = sorted([item[start[t]], start[t], start[t + 1], t] for t in query.tolist())
    while True:
        bound, pivot = 0.0, -1
        for k, x in enumerate(cursors):
            bound += most[x[3]]
            if bound >= theta:
                pivot = k
                break
        if pivot < 0:
            return out
        target = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
            pivot += 1
        # the blocks that would hold the target
        bound, onward = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 62
        for x in cursors[: pivot + 1]:
            x[1] = bisect_left(item, target, x[1], x[2])
            if x[1] < x[2]:
                x[0] = item[x[1]]
                block = (x[1] - start[x[3]]) // BLOCK
                bound += block_max[block_start[x[3]] + block]
                onward = min(onward, item[min(start[x[3]] + (block + 1) * BLOCK, x[2]) - 1] + 1)
        if bound < theta:
            # no item up to the nearest block end, or before the next list begins, can reach theta
            onward = max(onward, target + 1)
        else:
            score = sum(weight[x[1]] for x in cursors[: pivot + 1] if x[1] < x[2] and x[0] == target)
            if score >= theta:
                out.append((target, score))
            onward = target + 1
        for x in cursors[: pivot + 1]:
            if x[1] < x[2] and x[0] < onward:
                x[1] = bisect_left(item, onward, x[1], x[2])
                if x[1] < x[2]:
                    x[0] = item[x[1]]
        cursors = sorted(x for x in cursors if x[1] < x[2])


def hopeful(index: Index, place: np.ndarray, known: np.ndarray, doc: np.ndarray, begin: np.ndarray, windows: np.ndarray, step: int, theta: float) -> np.ndarray:
    """Numbers of the windows whose essential terms leave theta in reach for an item."""
    # a window is two steps; every document has one step more than it has windows
    base = np.cumsum(windows + 1) - (windows + 1)
    at = np.flatnonzero(known)
    half = base[doc[at]] + np.minimum((at - begin[doc[at]]) // step, windows[doc[at]])
    pair = np.unique(half * len(index.term) + place[at])
    half, term = pair // len(index.term), pair % len(index.term)
    count = index.major_start[term + 1] - index.major_start[term]
    rows = np.repeat(index.major_start[term] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    key, back = np.unique(np.repeat(half, count) * len(index.ids) + index.major_item[rows], return_inverse=True)
    if not len(key):
        return np.zeros(0, np.int64)
    value = np.bincount(back, weights=index.major_weight[rows])
    nxt = np.searchsorted(key, key + len(index.ids))
    there = key[np.minimum(nxt, len(key) - 1)] == key + len(index.ids)
    after = np.where(there, value[np.minimum(nxt, len(key) - 1)], 0.0)
    prior = np.zeros(len(key))
    prior[nxt[there]] = value[there]
    half = key // len(index.ids)
    owner = np.searchsorted(base, half, "right") - 1
    local = half - base[owner]
    least = theta - MINOR - 1e-9
    opened = np.cumsum(windows) - windows
    forth = (value + after >= least) & (local < windows[owner])
    back = (value + prior >= least) & (local > 0)
    return np.unique(np.concatenate([(opened[owner] + local)[forth], (opened[owner] + local - 1)[back]]))


def found_in(index: Index, data: np.ndarray, offsets: np.ndarray, theta: float, tokens: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int, float, float, float]]:
    """(document, item, first word of the passage, score, question share, answer share) of what is verified, best passage of each pair.

    tokens are codes and documents of the words, where the caller has them.
    """
    if not len(index.term):
        return []
    code, doc = tokens or K.words(data, offsets, GAP)[:2]
    if not len(code):
        return []
    place = np.minimum(np.searchsorted(index.term, code), len(index.term) - 1)
    known = index.term[place] == code
    step = index.passage // 2
    begin = K.per_document(doc, len(offsets) - 1)
    count = np.diff(begin)
    windows = np.where(count > 0, np.maximum(1, -(-(count - step) // step)), 0)
    of = np.repeat(np.arange(len(count)), windows)
    first = begin[of] + (np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)) * step
    last = np.minimum(first + index.passage, begin[of + 1])
    best: dict[tuple[int, int], tuple] = {}
    for w in hopeful(index, place, known, doc, begin, windows, step, theta):
        a, b = int(first[w]), int(last[w])
        query = np.unique(place[a:b][known[a:b]])
        hits = wand(index, query, theta)
        if not hits:
            continue
        runs: dict[int, np.ndarray] = {}
        for item, score in hits:
            shares = []
            for width, wanted in (index.question[item], index.answer[item]):
                if width not in runs:
                    runs[width] = runs_of(code[a:b], width)
                shares.append(_share(wanted, runs[width]))
            if min(shares) >= SHARE:
                key = (int(of[w]), item)
                row = (*key, a - int(begin[of[w]]), score, shares[0], shares[1])
                if key not in best or (row[3], -row[2]) > (best[key][3], -best[key][2]):
                    best[key] = row
    return [best[k] for k in sorted(best)]


def _share(runs: np.ndarray, there: np.ndarray) -> float:
    return len(np.intersect1d(runs, there, assume_unique=True)) / len(runs) if len(runs) else 0.0


def found_by_any(indexes: list[Index], data: np.ndarray, offsets: np.ndarray, theta: float) -> Iterator[tuple]:
    """What each index finds: (document, item id, first word, score, question share, answer share)."""
    tokens = K.words(data, offsets, GAP)[:2]
    for index in indexes:
        for row in found_in(index, data, offsets, theta, tokens):
            yield row[0], index.ids[row[1]], *row[2:]


def indexes(benchmark: DataFrame, shard_words: int = SHARD_WORDS) -> Iterator[list[Index]]:
    """The indexes of each shard of items; a shard has about shard_words words, so its size is bounded."""
    items = benchmark.where("text is not null and trim(text) <> ''").select("item_id", "text")
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    shards = -(-int(words) // shard_words)
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, shards))).cast("int"))
    counted = Staged(postings(items), "postings").df if shards > 1 else None
    frequency = counted.where("code is not null").groupBy("code").agg(F.count("*").alias("df")) if shards > 1 else None
    for s in range(shards):
        rows = items.where(F.col("shard") == s).collect()
        rows.sort(key=lambda r: (str(r["item_id"]), r["text"]))
        if not rows:
            continue
        whole = None
        if shards > 1:
            n, mean = counted.where("code is null").agg(F.count("*"), F.avg("words")).first()
            own = frequency.join(counted.where((F.col("shard") == s) & F.col("code").isNotNull()).select("code").distinct(), "code").toArrow()
            code = own.column("code").to_numpy().view(U64)
            order = np.argsort(code)
            whole = Statistics(n, mean, code[order], own.column("df").to_numpy()[order])
        yield by_width([r["item_id"] for r in rows], [r["text"] for r in rows], whole)


def postings(items: DataFrame) -> DataFrame:
    """(shard, code) of each distinct term of each item, and (shard, words) of each item, with no code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, at = terms(batch.column(1).to_pylist())
            pair = np.unique(np.stack([at.astype(U64), code]), axis=1)
            shard = batch.column(0).to_numpy()
            size = np.bincount(at, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([shard[pair[0].astype(np.int64)], shard])), pa.concat_arrays([pa.array(pair[1].view(np.int64)), pa.nulls(len(shard), pa.int64())]), pa.concat_arrays([pa.nulls(pair.shape[1], pa.int64()), pa.array(size)])],
                ["shard", "code", "words"],
            )

    return items.select("shard", "text").mapInArrow(run, "shard int, code long, words long")


def leaks(docs: DataFrame, benchmark: DataFrame, theta: float = THETA, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, item_id, passage, score, question_share, answer_share) of each document and item found in it.

    passage is the first word of the best window, the first of equal ones. Null and empty texts hold no item, and items without a
    text are found nowhere; an item of one word is found wherever that word stands; repeated rows are searched each, and repeated items found each; empty tables
    give no rows; other columns are not read. A text is held whole by its task, with about 60 bytes for each of its words.
    """
    ids, items = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = T.StructType([T.StructField("doc_id", ids), T.StructField("item_id", items), T.StructField("passage", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("score", "question_share", "answer_share")])
    out = None
    for shard in indexes(benchmark, shard_words):

        def run(batches: Iterator[pa.RecordBatch], shard: list[Index] = shard) -> Iterator[pa.RecordBatch]:
            kind = pa.array([x for index in shard for x in index.ids]).type
            for batch in batches:
                data, offsets = K.text_bytes(batch.column(1))
                for i, j in K.slices(offsets):
                    rows = sorted(found_by_any(shard, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], theta), key=lambda r: (r[0], r[2]))
                    if rows:
                        doc, item, *rest = zip(*rows, strict=True)
                        columns = [batch.column(0).take(pa.array(np.array(doc) + i)), pa.array(item, kind), *(pa.array(np.array(c)) for c in rest)]
                        yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, theta: float = THETA, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of docs in which no item is found, with their own columns, whatever their names."""
    at_text = docs.columns.index("text")
    for shard in indexes(benchmark, shard_words):

        def run(batches: Iterator[pa.RecordBatch], shard: list[Index] = shard) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = K.text_bytes(batch.column(at_text))
                clean = np.ones(batch.num_rows, bool)
                for i, j in K.slices(offsets):
                    for row in found_by_any(shard, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], theta):
                        clean[i + row[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
