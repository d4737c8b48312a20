"""Hard-negative mining with a vector-approximation file.

Vectors of whole numbers are packed into blocks of ROWS rows, sorted by label. In each block every dimension's values are cut
into at most CELLS cells of about as many rows, and a row is approximated by its cells' numbers. For an anchor, the least
and the most that a cell can add to the score form a table for each dimension; looking up a row's cells and summing gives
bounds of its score, and exact scores are computed only of rows whose bounds allow them into the anchor's result. All
blocks are scanned for the stated anchors: first for positives, then for the windows that these open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.shared import staged

ROWS, CELLS = 2048, 64
# Components of a scan's group of blocks, of its share of the anchors, and of anchors that are bounded together (at most 128).
GROUP, SHARE, TOGETHER = 1 << 24, 1 << 20, 1 << 16
# Components beyond this could overflow a 64-bit score of a few hundred dimensions.
LARGEST = 1 << 27
FILE = "block long, components long, dims int, ids binary, labels binary, vectors binary, cells binary, low binary, high binary"
ANCHORS = "anchor_id long, label long, dims int, vector binary"
FOUND = "anchor_id long, slot int, row_id long, score long"


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double; null where a component is null, not finite or too large."""
    as_double = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * scale) < LARGEST, F.lit(False)))
    return F.when(fits & vector.isNotNull(), as_double)


def approximated(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell of each row and dimension, least and greatest value of each dimension and cell).

    Cells end between different values, after about as many rows each; an unused cell has the values of the last.
    """
    n, dims = vectors.shape
    cells = np.zeros((n, dims), np.uint8)
    low, high = np.zeros((dims, CELLS), np.int64), np.zeros((dims, CELLS), np.int64)
    for d in range(dims):
        values, place, count = np.unique(vectors[:, d], return_inverse=True, return_counts=True)
        number = (np.cumsum(count) - count) * CELLS // n if len(values) > CELLS else np.arange(len(values))
        cells[:, d] = number[place]
        first = np.searchsorted(number, np.arange(CELLS))  # of a cell without values: the first value behind
        last = np.searchsorted(number, np.arange(CELLS), "right") - 1
        low[d] = values[np.minimum(first, len(values) - 1)]
        high[d] = values[np.maximum(last, 0)]
    return cells, low, high


def packed(rows: DataFrame) -> DataFrame:
    """The file: rows (id, label, vector of whole numbers) in blocks of one number of dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def block(dims: int) -> pa.RecordBatch:
            nonlocal made
            ids, labels, vectors = (np.concatenate(x) for x in zip(*held.pop(dims), strict=True))
            order = np.lexsort((ids, labels))
            ids, labels, vectors = ids[order], labels[order], vectors[order]
            cells, low, high = approximated(vectors)
            made += 1
            # by dimension, as they are looked up
            values = [part << 32 | made, len(ids) * dims, dims, *(x.tobytes() for x in (ids, labels, vectors.astype(np.int32), np.ascontiguousarray(cells.T), low, high))]
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], FIELDS)

        for batch in batches:
            column = batch.column(2)
            ends = column.offsets.to_numpy() - column.offsets[0].as_py()
            flat = column.flatten().to_numpy()
            ids, labels, size = batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.diff(ends)
            for dims in np.unique(size).tolist():
                of = np.flatnonzero(size == dims)
                vectors = flat[ends[of][:, None] + np.arange(dims)]
                for lo in range(0, len(of), ROWS):
                    some = of[lo : lo + ROWS]
                    held.setdefault(dims, []).append((ids[some], labels[some], vectors[lo : lo + ROWS]))
                    if sum(len(x[0]) for x in held[dims]) >= ROWS:
                        yield block(dims)
        for dims in list(held):
            yield block(dims)

    return rows.select("id", "label", "vector").mapInArrow(run, FILE)


FIELDS = [x.split()[0] for x in FILE.split(", ")]


class Block:
    """A block of the file with the lookups of its bounds."""

    def __init__(self, dims: int, ids: bytes, labels: bytes, vectors: bytes, cells: bytes, low: bytes, high: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.vectors = np.frombuffer(vectors, np.int32).reshape(len(self.ids), dims)
        self.cells = np.frombuffer(cells, np.uint8).reshape(dims, len(self.ids))
        self.low, self.high = (np.frombuffer(x, np.int64).reshape(dims, CELLS) for x in (low, high))

    def tables(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(dimension, cell, anchor): the least and the most that a cell adds to an anchor's score."""
        one, other = self.low[:, :, None] * anchors.T[:, None, :], self.high[:, :, None] * anchors.T[:, None, :]
        low, high = np.minimum(one, other), np.maximum(one, other)
        most = max((int(np.abs(x).max(axis=(1, 2)).sum()) for x in (low, high)), default=0) if anchors.size else 0
        kind = np.int32 if most < 1 << 31 else np.int64
        return low.astype(kind), high.astype(kind)

    def bounds(self, tables: tuple[np.ndarray, np.ndarray], a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor): lower and upper bounds of the scores of rows a to b."""
        out = []
        for table in tables:
            total = np.zeros((b - a, table.shape[2]), table.dtype)
            for d in range(len(table)):
                total += table[d].take(self.cells[d, a:b], axis=0)
            out.append(total)
        return out[0], out[1]

    def scores(self, rows: np.ndarray, anchors: np.ndarray, columns: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        for lo in range(0, len(rows), 1 << 14):
            r, c = rows[lo : lo + (1 << 14)], columns[lo : lo + (1 << 14)]
            out[lo : lo + len(r)] = np.einsum("ij,ij->i", self.vectors[r].astype(np.int64), anchors[c])
        return out


def best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, id): of each query's rows the k of the highest scores, ties by smaller id."""
    query, score, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return query[rank < k], score[rank < k], ids[rank < k]


class Anchors:
    """Anchors of one number of dimensions, with the rows found for each of their slots so far."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, slots: int, k: int):
        self.ids, self.labels, self.vectors, self.slots, self.k = ids, labels, vectors, slots, k
        none = np.zeros(0, np.int64)
        self.found = (none, none, none)
        self.least = np.full(len(ids) * slots, np.iinfo(np.int64).min)

    def parts(self, of: np.ndarray) -> Iterator[np.ndarray]:
        """Anchors (numbers) in parts whose tables stay small."""
        n = max(1, min(128, TOGETHER // max(1, self.vectors.shape[1])))
        return (of[lo : lo + n] for lo in range(0, len(of), n))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Keep the k best of each slot; least is the worst of a full slot, and nothing below can enter it."""
        self.found = best([self.found, (query, score, ids)], self.k)
        count = np.bincount(self.found[0], minlength=len(self.least))
        full = np.flatnonzero(count >= self.k)
        self.least[full] = self.found[1][np.searchsorted(self.found[0], full, "right") - 1]


def positives_in(block: Block, anchors: Anchors) -> None:
    """Rows of the anchors' own labels that may be among their k best."""
    for label in np.unique(anchors.labels).tolist():
        a, b = np.searchsorted(block.labels, [label, label + 1])
        if a == b:
            continue
        of = np.flatnonzero(anchors.labels == label)
        for some in anchors.parts(of):
            low, high = block.bounds(block.tables(anchors.vectors[some]), a, b)
            own = block.ids[a:b, None] == anchors.ids[some]
            low[own] = np.iinfo(low.dtype).min
            least = anchors.least[some]
            if b - a > anchors.k:  # k rows reach this at least
                least = np.maximum(least, np.partition(low, b - a - anchors.k, axis=0)[b - a - anchors.k])
            row, column = np.nonzero((high >= least) & ~own)
            anchors.add(some[column], block.scores(row + a, anchors.vectors, some[column]), block.ids[a:b][row])


def negatives_in(block: Block, anchors: Anchors, floor: np.ndarray, ceiling: np.ndarray) -> None:
    """Rows of other labels that may be among the k best of a slot: scores from floor to ceiling (anchor, slot), an empty window where floor is above."""
    for some in anchors.parts(np.arange(len(anchors.ids))):
        low, high = block.bounds(block.tables(anchors.vectors[some]), 0, len(block.ids))
        other = block.labels[:, None] != anchors.labels[some]
        least = np.maximum(floor[some], anchors.least.reshape(-1, anchors.slots)[some])
        open_ = least <= ceiling[some]
        # one pass over the rows for all windows of an anchor
        under, over = np.where(open_, least, np.iinfo(np.int64).max).min(axis=1), np.where(open_, ceiling[some], np.iinfo(np.int64).min).max(axis=1)
        row, column = np.nonzero((high >= under) & (low <= over) & other)
        may = open_[column] & (high[row, column][:, None] >= least[column]) & (low[row, column][:, None] <= ceiling[some][column])
        row, column = row[may.any(axis=1)], column[may.any(axis=1)]
        score = block.scores(row, anchors.vectors, some[column])
        for slot in range(anchors.slots):
            inside = (score >= least[column, slot]) & (score <= ceiling[some[column], slot])
            anchors.add(some[column[inside]] * anchors.slots + slot, score[inside], block.ids[row[inside]])


def blocks_of(table: pa.Table) -> Iterator[tuple[int, Block]]:
    """The blocks of a group, one after the other."""
    for row in table.select(FIELDS).to_batches(max_chunksize=1):
        for values in zip(*(row.column(c) for c in FIELDS[2:]), strict=True):
            dims, *parts = (x.as_py() for x in values)
            yield dims, Block(dims, *parts)


def scanned(file: DataFrame, anchors: DataFrame, slots: int, k: int, ratios: tuple[int, int, int] | None = None) -> DataFrame:
    """(anchor_id, slot, row_id, score): for each anchor and slot, the k best rows of each group of blocks, or more.

    Without ratios the rows are positives, with one slot. With ratios (least, most, of), anchors have the scores of their
    positives, one for each slot, and rows are those of other labels with least * p <= of * score <= most * p. Every group of
    about GROUP components meets every share of about SHARE components of anchors in a task of its own: work grows with anchors
    times rows, as it must, and what a task holds does not.
    """
    spark = file.sparkSession
    n_blocks, components = file.agg(F.count("*"), F.coalesce(F.sum("components"), F.lit(0))).first()
    wanted_components = anchors.agg(F.coalesce(F.sum("dims"), F.lit(0))).first()[0]
    n_groups = max(min(n_blocks, 4 * spark.sparkContext.defaultParallelism), -(-components // GROUP), 1)
    n_shares = max(-(-wanted_components // SHARE), 1)
    n_tasks = n_groups * n_shares
    pair = lambda group, share: (group * n_shares + share).alias("pair")
    group = F.pmod(F.xxhash64("block"), F.lit(n_groups)) if n_groups < n_blocks else F.col("number")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    numbered = file if n_groups < n_blocks else file.join(F.broadcast(file.select("block").withColumn("number", F.row_number().over(Window.orderBy("block")).cast("long") - 1)), "block")
    left = numbered.withColumn("share", each(n_shares)).select(pair(group, F.col("share")), *FIELDS)
    kept = anchors.columns
    right = anchors.withColumns({"share": F.pmod(F.xxhash64("anchor_id"), F.lit(n_shares)), "group": each(n_groups)}).select(pair(F.col("group"), F.col("share")), *kept)

    def run(blocks: pa.Table, wanted: pa.Table) -> pa.Table:
        out = []
        sides: dict[int, tuple] = {}
        dims_of = wanted.column("dims").to_numpy()
        for dims in np.unique(dims_of).tolist():
            part = wanted.filter(pa.array(dims_of == dims))
            vectors = np.frombuffer(b"".join(part.column("vector").to_pylist()), np.int32).reshape(part.num_rows, dims).astype(np.int64)
            side = Anchors(part.column("anchor_id").to_numpy(), part.column("label").to_numpy(), vectors, slots, k)
            windows = ()
            if ratios:
                score = np.array([[*x, *[None] * (slots - len(x))] for x in part.column("positives").to_pylist()], object)
                known = np.not_equal(score, None)
                p = np.where(known, score, 0).astype(np.int64)
                least, most, of = ratios
                windows = (np.where(known, -(-least * p // of), 1), np.where(known, most * p // of, 0))
            sides[dims] = (side, windows)
        for dims, block in blocks_of(blocks):
            if dims in sides:
                side, windows = sides[dims]
                negatives_in(block, side, *windows) if ratios else positives_in(block, side)
        for side, _ in sides.values():
            query, score, ids = side.found
            out.append(pa.table([side.ids[query // slots], (query % slots).astype(np.int32), ids, score], names=["anchor_id", "slot", "row_id", "score"]))
        none = pa.table({"anchor_id": pa.array([], pa.int64()), "slot": pa.array([], pa.int32()), "row_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        return pa.concat_tables([none, *out])

    deal = lambda df: df.repartition(n_tasks, "pair").groupBy("pair")
    return deal(left).cogroup(deal(right)).applyInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """found with rank: the k best rows of each anchor and slot, from the few that each group of blocks gave."""
    w = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 10, ratios: tuple[int, int, int] = (30, 90, 100)
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which anchor holds.

    Scores are inner products of the components as whole numbers (floor of scale times the component). An anchor's positives
    are its best rows of the same label, and for each the best rows of other labels follow with a score between ratios[0] and ratios[1]
    of ratios[2] parts of the positive's; higher scores first, ties by smaller key. Results are exact: the approximations only
    save exact scores. Rows with a null key, label, vector or component, or one that is not finite or of 2^27 or more after
    scaling, take no part; rows of one key count once, as the one with the least label and vector; vectors of different length are not
    compared. An anchor without positives, or a positive without such negatives, gives no row; an empty table gives none.
    Other columns play no part.
    """
    own = [F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole(F.col(vector), scale).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor")]
    clean = rows.select(*own).where("id is not null and label is not null and vector is not null")
    # equal keys meet after each task has taken its least row
    single = clean.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("row")).select("id", "row.label", "row.vector", "row.anchor")
    kept = staged(single, "vectors")
    file = staged(packed(kept), "approximations")
    anchors = staged(encoded(kept.where("anchor")), "anchors")
    first = staged(ranked(scanned(file, anchors, 1, positives), positives), "positives")
    scores = first.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p")).select("anchor_id", F.transform("p", lambda x: x["score"]).alias("positives"))
    opened = staged(anchors.join(scores, "anchor_id"), "windows")
    second = ranked(scanned(file, opened, positives, negatives, ratios), negatives)
    of = first.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = second.join(of, ["anchor_id", "slot"])
    return out.select("anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def encoded(rows: DataFrame) -> DataFrame:
    """Anchors with their vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(x, np.int32) for x in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array([len(x) for x in vectors], pa.int32()), pa.array([x.tobytes() for x in vectors], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["anchor_id", "label", "dims", "vector"])

    return rows.select("id", "label", "vector").mapInArrow(run, ANCHORS)
