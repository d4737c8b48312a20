"""Set-similarity self-join on word shingles by count vectors, bounds on summed minima, and verification.

Shingles hash into groups, and a document is the point of its group counts. Two sets of n and m shingles link
only if their overlap reaches percent / (100 + percent) * (n + m), and the overlap is at most the sum of the
coordinate minima of their points.

1. Directory. The fine groups are put in one order for the whole corpus, rarest total first. Minima that sum to
   the overlap leave no room for two points that differ in all of their first coordinates: of n shingles in
   this order, the first n * (100 - percent) / 100 + 1 must hold one of any linked set. Each is a cell of the
   directory; shingles that many documents share come last and so open no cells.
2. Nodes. Exact copies fold into one point. The set with the most shared cells leads a cell, and all that share a
   cell with a leading set are a node of the tree. Each set is bounded against a leading set, verified, and linked sets
   fold into components. In a node that still holds several components the points are packed into leaves with upper
   corners, a leaf whose corner cannot reach the overlap is passed over, and so is a pair. Large nodes are split
   in chunks, each pair of chunks a piece of work.
3. Verification on the exact shingle sets of what passes the bound.

In the nodes points hold 64 coarse counts of one byte. Candidate pairs are then bounded once more on fine
points with a count for every four shingles, so what reaches the texts is nearly all linked. Of two points the finer folds into
the groups of the other. A count of one byte may stand for more (MOST); the bound then stays one, as it is
written as n - sum of the excess of one point over the other, and cut counts only lower an excess.
Sets are told apart by 64-bit codes. Rows with one id but different texts are different rows throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import cells as C
from cairn.llm import kernels as K
from cairn.operators.graph import connected_components
from cairn.operators.shared import Staged

U64 = np.uint64
# Coordinates of a point, and what a count is cut to.
DIMS = 64
MOST = 255
# Fine groups, whose totals over all documents order the directory: 8 MB, whatever the corpus.
GROUP_BITS = 20
GROUPS = 1 << GROUP_BITS
TOTAL_PARTS = 64
CHUNK = 2048
LEAF = 32
# Identifier lists of at most this many bytes, by a count of rows and the length of their texts, are broadcast; longer ones are joined by a shuffle.
BROADCAST_BYTES = 4 << 20
SLICE_BYTES = 8 << 20


def sorted_sets(data: np.ndarray, offsets: np.ndarray, width: int, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the distinct shingles, sorted by document and hash; with the ranks of the fine groups, in their order."""
    n_docs = len(offsets) - 1
    code, doc, _, _ = K.words(data, offsets)
    h, at = K.shingles(code, doc, n_docs, width)
    if rank is not None:
        shift = U64(64 - GROUP_BITS)
        h = (rank[(h >> shift).astype(np.int64)].astype(U64) << shift) | (h & U64((1 << (64 - GROUP_BITS)) - 1))
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    return h[fresh], at[fresh]


def signatures(h: np.ndarray, at: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(set size, 64-bit code of the set) of each document."""
    size = np.bincount(at, minlength=n_docs)
    total = np.zeros(n_docs, U64)
    np.add.at(total, at, K.mix(h, 3))
    other = np.zeros(n_docs, U64)
    np.add.at(other, at, K.mix(h, 4))
    return size, K.mix(K.mix(total) ^ other + size.astype(U64)).view(np.int64)


def count_vectors(h: np.ndarray, at: np.ndarray, n_docs: int) -> np.ndarray:
    """Counts of shingles in DIMS groups, one row for each document; a count above MOST stands as MOST."""
    group = (h & U64(DIMS - 1)).astype(np.int64)
    return np.minimum(np.bincount(at * DIMS + group, minlength=n_docs * DIMS), MOST).reshape(n_docs, DIMS).astype(np.uint8)


def fine_points(h: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[bytes]:
    """The counts of each document in fine_dims() groups."""
    dims = fine_dims(size)
    begin = np.cumsum(dims) - dims
    group = (h & (dims[at] - 1).astype(U64)).astype(np.int64)
    counts = np.minimum(np.bincount(begin[at] + group, minlength=int(dims.sum())), MOST).astype(np.uint8)
    return [counts[a : a + n].tobytes() for a, n in zip(begin.tolist(), dims.tolist(), strict=True)]


def fine_dims(size: np.ndarray) -> np.ndarray:
    """A power of two of at least a quarter of the set size, DIMS at least."""
    return np.maximum(DIMS, 2 ** np.ceil(np.log2(np.maximum(size, 1) / 4))).astype(np.int64)


def facts(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, sig, counts, fine) of each row, and with part set, totals of a part of the fine groups in a task.

    sig is null for a row without shingles or without an id.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "sig", "counts", "fine", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ids = np.zeros(GROUPS, np.int64), None
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            for i, j in K.slices(offsets):
                h, at = sorted_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                size, sig = signatures(h, at, j - i)
                total += np.bincount((h >> U64(64 - GROUP_BITS)).astype(np.int64), minlength=GROUPS)
                ids = batch.column(0).slice(i, j - i)
                absent = (size == 0) | ids.is_null().to_numpy(zero_copy_only=False)
                vector = pa.array([v.tobytes() for v in count_vectors(h, at, j - i)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(sig, pa.int64(), mask=absent), vector, pa.array(fine_points(h, at, size), pa.binary()), pa.nulls(j - i, pa.int32())], names)
        if ids is not None:
            cut = [x.astype(np.min_scalar_type(x.max())).tobytes() for x in np.split(total, TOTAL_PARTS)]
            none = lambda t: pa.nulls(TOTAL_PARTS, t)
            yield pa.RecordBatch.from_arrays([none(ids.type), none(pa.int64()), none(pa.int64()), pa.array(cut, pa.binary()), none(pa.binary()), pa.array(range(TOTAL_PARTS), pa.int32())], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, sig long, counts binary, fine binary, part int")


def ranks(known: DataFrame) -> np.ndarray:
    """The rank of each fine group by its total over all documents, the rarest first. TOTAL_PARTS rows reach the driver, 8 MB together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                width = 8 * len(counts) * TOTAL_PARTS // GROUPS
                total[part] = total.get(part, 0) + np.frombuffer(counts, f"uint{width}").astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "counts"])

    parts = known.where("part is not null").select("part", "counts").repartition(TOTAL_PARTS, "part")
    total = np.zeros(GROUPS, np.int64)
    for row in parts.mapInArrow(run, "part int, counts binary").collect():
        total[row["part"] * (GROUPS // TOTAL_PARTS) :][: GROUPS // TOTAL_PARTS] = np.frombuffer(row["counts"], np.int64)
    out = np.empty(GROUPS, np.uint32)
    out[np.argsort(total, kind="stable")] = np.arange(GROUPS, dtype=np.uint32)
    return out


def members(docs: DataFrame, width: int, percent: int, rank: np.ndarray, n_slices: int) -> DataFrame:
    """(cell, sig) for every cell that more than one distinct set falls into; an entry may come twice."""
    n_slices = max(1, min(n_slices, 1 << 20))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        texts, salt = 0, 0
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(0))
            for i, j in K.slices(offsets):
                h, at = sorted_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width, rank)
                # the codes of facts() are of the hashes before the order
                size = np.bincount(at, minlength=j - i)
                sig = signatures(unranked(h, rank), at, j - i)[1]
                if len(seen) > 200_000:
                    seen.clear()
                first = np.where(size > 0, size * (100 - percent) // 100 + 1, 0)
                for d, s in enumerate(sig.tolist()):
                    if s in seen:
                        first[d] = 0  # an exact copy met before in this task
                    seen.add(s)
                begin = np.cumsum(size) - size
                take = np.arange(len(h)) - begin[at] < first[at]
                held.append(C.entries(K.mix(h[take], 5), sig[at[take]]))
                texts += int(offsets[j] - offsets[i])
                if texts >= SLICE_BYTES:
                    yield C.blocks(np.concatenate(held), n_slices, salt)
                    held, texts, salt = [], 0, salt + 7919
        if held:
            yield C.blocks(np.concatenate(held), n_slices, salt)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in C.shared(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x["cell"]).view(np.int64)), pa.array(np.ascontiguousarray(x["row"]))], ["cell", "sig"])

    blocks = docs.select("text").mapInArrow(scatter, C.SCHEMA)
    # a task takes several slices, one after the other, in the order of a sort that may spill
    return blocks.repartition(max(1, n_slices // 4), "slice").sortWithinPartitions("slice", "local").mapInArrow(gather, "cell long, sig long")


def unranked(h: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The hashes whose fine groups were put in the order of rank."""
    shift = U64(64 - GROUP_BITS)
    group = np.empty(GROUPS, np.uint32)
    group[rank] = np.arange(GROUPS, dtype=np.uint32)
    return (group[(h >> shift).astype(np.int64)].astype(U64) << shift) | (h & U64((1 << (64 - GROUP_BITS)) - 1))


def listed(df: DataFrame, column: str) -> DataFrame:
    """The identifiers of df, marked for broadcast if they take at most BROADCAST_BYTES; else as they are."""
    found = df.select(column)
    rows, size = found.agg(F.count("*"), F.sum(F.octet_length(F.col(column).cast("string")))).first()
    return F.broadcast(found) if 16 * rows + (size or 0) <= BROADCAST_BYTES else found


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How much points p exceed q, coordinate by coordinate, summed."""
    return (np.maximum(p, q) - q).sum(-1, dtype=np.int64)


def bound(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The largest overlap of sets of n and m shingles with points p and q: the sum of coordinate minima, as n less the excess of p, or m less that of q."""
    return np.minimum(n - excess(p, q), m - excess(q, p))


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return -((-percent * (n + m)) // (100 + percent))


def points_of(column: pa.Array) -> np.ndarray:
    return K.text_bytes(column)[0].reshape(-1, DIMS)


def within_bound(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose fine points leave the least overlap in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(c).to_numpy() for c in range(4))
            good = np.zeros(len(a), bool)
            for x, (p, q) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                p, q = (np.frombuffer(y, np.uint8) for y in (p, q))
                dims = min(len(p), len(q))
                p, q = (y if len(y) == dims else np.minimum(y.reshape(-1, dims).sum(0, dtype=np.int64), MOST).astype(np.uint8) for y in (p, q))
                good[x] = bound(n[x], p, m[x], q) >= least_overlap(n[x], m[x], percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    left = sets.select(F.col("sig").alias("a"), F.col("n"), F.col("fine").alias("p"))
    right = sets.select(F.col("sig").alias("b"), F.col("n").alias("m"), F.col("fine").alias("q"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "p", "q").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, width: int, percent: int) -> Staged:
    """The pairs (a, b) of set codes whose points leave the overlap in reach and whose shingle sets have it."""
    near = Staged(within_bound(pairs, sets, percent), "near")
    needed = near.df.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    holders = Staged(sets.join(needed, "sig").select("sig", F.col("first").alias("doc_id")), "holders")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(0))
            for i, j in K.slices(offsets):
                h, at = sorted_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(signatures(h, at, j - i)[1])], ["text", "sig"])

    texts = docs.select("doc_id", "text").join(listed(holders.df, "doc_id"), "doc_id", "left_semi").select("text").mapInArrow(coded, "text string, sig long")
    # rows that share an id but not a text have other codes and fall out here
    texts = Staged(texts.join(holders.df.select("sig"), "sig").dropDuplicates(["sig"]).select("sig", "text"), "texts")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            good = np.zeros(len(a), bool)
            for x in range(len(a)):
                left, right = (_set_of(kept, int(s[x]), batch.column(c), x, width) for s, c in ((a, 2), (b, 3)))
                both = len(np.intersect1d(left, right, assume_unique=True))
                good[x] = 100 * both >= percent * (len(left) + len(right) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    left = texts.df.select(F.col("sig").alias("a"), F.col("text").alias("left_text"))
    right = texts.df.select(F.col("sig").alias("b"), F.col("text").alias("right_text"))
    out = Staged(near.df.join(left, "a").join(right, "b").select("a", "b", "left_text", "right_text").mapInArrow(judge, "a long, b long"), "links")
    for used in (near, holders, texts):
        used.drop()
    return out


def _set_of(kept: dict[int, np.ndarray], sig: int, texts: pa.Array, row: int, width: int) -> np.ndarray:
    """The shingle set of a text, kept while the held sets stay few."""
    if sig not in kept:
        if len(kept) >= 256:
            kept.clear()
        kept[sig] = sorted_sets(*K.text_bytes(texts.slice(row, 1)), width)[0]
    return kept[sig]


def tree_pairs(counts: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of different components whose summed minima reach the least overlap, by way of packed leaves.

    side splits the rows of a chunk pair: with two sides only pairs across them are formed. Points are
    packed along their size and leading counts; a leaf whose upper corner and least size cannot reach the
    overlap with a point is passed over.
    """
    order = np.lexsort((counts[:, 1], counts[:, 0], n))
    leaves = np.arange(0, len(order), LEAF)
    corner = np.maximum.reduceat(counts[order], leaves, axis=0)
    least = np.minimum.reduceat(n[order], leaves)
    across = side.min() != side.max()
    left, right = [], []
    for q in range(len(order)):
        if across and side[q]:
            continue
        near = np.flatnonzero(n[q] - excess(counts[q], corner) >= least_overlap(n[q], least, percent))
        if not len(near):
            continue
        rows = np.concatenate([order[leaves[x] : leaves[x] + LEAF] for x in near])
        rows = rows[(comp[rows] != comp[q]) & (side[rows] == 1 if across else rows > q)]
        rows = rows[bound(n[q], counts[q], n[rows], counts[rows]) >= least_overlap(n[q], n[rows], percent)]
        left.append(np.full(len(rows), q))
        right.append(rows)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def leaf_pairs(counts: np.ndarray, n: np.ndarray, comp: np.ndarray, leaf: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of different components in one leaf (-1: none) of at most LEAF rows whose summed minima reach the least overlap."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for apart in range(1, LEAF):
        x = np.flatnonzero((leaf[:-apart] == leaf[apart:]) & (leaf[apart:] >= 0))
        if not len(x):
            break
        x = x[comp[x] != comp[x + apart]]
        x = x[np.minimum(n[x], n[x + apart]) >= least_overlap(n[x], n[x + apart], percent)]
        x = x[bound(n[x], counts[x], n[x + apart], counts[x + apart]) >= least_overlap(n[x], n[x + apart], percent)]
        left.append(x)
        right.append(x + apart)
    return np.concatenate(left), np.concatenate(right)


def cell_pairs(points: DataFrame, percent: int, parts: int) -> DataFrame:
    """(a, b) for each node (cell) and pair of its points, of different components, that passes the bound.

    points has cell, sig, comp, n, counts. Nodes of more than CHUNK points are split into chunks
    and every pair of chunks is a piece of work of its own.
    """
    sizes = points.groupBy("cell").agg(F.count("*").alias("held"))
    cut = points.join(sizes, "cell").withColumn("c", F.ceil(F.col("held") / CHUNK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("sig"), F.col("c")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("c") - 1))
    dealt = cut.withColumn("other", other).select(
        "cell", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "sig", "comp", "n", "counts"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in K.whole_runs(batches, 3):
            sig, comp, n = (rows.column(c).to_numpy() for c in (4, 5, 6))
            counts = points_of(rows.column(7))
            i, j, chunk = (rows.column(c).to_numpy() for c in (1, 2, 3))
            edges = K.run_edges(rows, 3)
            size = np.diff(edges)
            found = [leaf_pairs(counts, n, comp, np.repeat(np.where((size <= LEAF) & (i[edges[:-1]] == j[edges[:-1]]), np.arange(len(size)), -1), size), percent)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                side = (chunk[a:b] != i[a]).astype(int)
                if (b - a <= LEAF and i[a] == j[a]) or (i[a] != j[a] and side.min() == side.max()):
                    continue
                x, y = tree_pairs(counts[a:b], n[a:b], comp[a:b], side, percent)
                found.append((x + a, y + a))
            x, y = (np.concatenate(c) for c in zip(*found, strict=True))
            # a pair may pass in many cells
            pairs = np.unique(np.stack([np.minimum(sig[x], sig[y]), np.maximum(sig[x], sig[y])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    ordered = dealt.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return ordered.mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sig) of each row, and (sig, first, component_id, leads) of each distinct set.

    first is a set's smallest doc_id, component_id the smallest doc_id that links reach, and leads marks one set of each component, whose first is component_id.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = Staged(facts(docs, width), "facts")
    rank = ranks(known.df)
    rows = known.df.where("part is null")
    sets = Staged(rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("fine").alias("fine")), "sets")
    found = Staged(members(docs.where("doc_id is not null and text is not null"), width, percent, rank, 8 * parts), "members")
    # first: each set against the leading set of the cells that it shares with it most often; sets with the most
    # shared cells lead, as the common origin of near copies has. A set's own cells are far fewer than a partition holds
    kept = found.df.withColumn("c", F.count("*").over(Window.partitionBy("sig")))
    lead = kept.groupBy("cell").agg(F.max_by("sig", F.struct("c", "sig")).alias("a"))
    # a node is all that shares a cell with its leading set: whatever shares a cell is in a node together, once and not in each of its cells
    nodes = Staged(found.df.join(lead, "cell").groupBy("sig", "a").agg(F.count("*").alias("c")), "nodes")
    found.drop()
    stars = nodes.df.where("a <> sig").groupBy("sig").agg(F.max_by("a", F.struct("c", "a")).alias("a"))
    stars = Staged(stars.select("a", F.col("sig").alias("b")), "stars")
    links = verified(stars.df, docs, sets.df, width, percent)
    near = Staged(connected_components(links.df, "a", "b"), "near")
    # then: all pairs of a node that are still in different components
    named = nodes.df.select(F.col("a").alias("cell"), "sig").join(near.df.withColumnRenamed("node", "sig").withColumnRenamed("component", "comp"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    named = Staged(named, "named")
    mixed = named.df.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("cell")
    points = named.df.join(mixed, "cell").join(sets.df.select("sig", "n", "counts"), "sig")
    pairs = Staged(cell_pairs(points, percent, parts).distinct(), "pairs")
    tested = pairs.df.join(stars.df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = verified(tested, docs, sets.df, width, percent)
    joined = Staged(connected_components(links.df.unionByName(more.df), "a", "b"), "joined")
    # a component's smallest document
    least = sets.df.select("sig", "first").join(joined.df.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    least = Staged(least, "least")
    roots = least.df.groupBy("component").agg(F.min(F.struct("first", "sig")).alias("root"))
    ends = Staged(least.df.join(roots, "component").select("sig", "first", F.col("root.first").alias("component_id"), (F.col("sig") == F.col("root.sig")).alias("leads")), "ends")
    out = Staged(rows.select("doc_id", "n", "sig"), "rows")
    for used in (known, sets, nodes, stars, links, near, named, pairs, more, joined, least):
        used.drop()
    return out.df, ends.df


def classes(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: documents whose shingle sets have a Jaccard similarity of
    percent / 100 or more are linked, and component_id is the smallest doc_id that links reach.

    A row without words has an empty set, links with nothing and is its own component; so is a row
    without an id, whose component is null. Repeated rows are given each, and so are rows that share an id but
    not a text; an empty table gives no rows; other columns are not read. A text is held whole by its task,
    with about 60 bytes for each of its words.
    """
    rows, ends = grouped(docs, width, percent)
    return rows.join(ends, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of linked texts: one with the smallest doc_id, and of its texts, if the id is
    repeated, one. Rows without an id stay, as do rows without words; other columns may have any names.
    """
    rows, ends = grouped(docs, width, percent)
    stays = F.col("sig").isNull() | (F.col("leads") & (F.col("doc_id") == F.col("first")))
    judged = rows.where("doc_id is not null").join(ends.select("sig", "first", "leads"), "sig", "left").select("doc_id", "sig", stays.alias("stays"))
    by_id = Staged(judged.groupBy("doc_id").agg(F.count("*").alias("held"), F.bool_or("stays").alias("stays")).where("stays"), "chosen").df
    single = listed(by_id.where("held = 1"), "doc_id")
    kept = docs.join(single, "doc_id", "left_semi").select(docs.columns)
    repeated = by_id.where("held > 1").select("doc_id")
    if not repeated.isEmpty():
        mark = "sig"
        while mark.lower() in map(str.lower, docs.columns):
            mark += "_"
        some = docs.join(listed(repeated, "doc_id"), "doc_id", "left_semi").select(docs.columns)
        some = with_codes(some, width, mark)
        right = judged.where("stays and sig is not null").join(repeated, "doc_id", "left_semi").select("doc_id", F.col("sig").alias(mark)).distinct()
        texts = some.join(right, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
        kept = kept.unionByName(texts.select(docs.columns)).unionByName(some.where(F.col(mark).isNull()).select(docs.columns))
    return kept.unionByName(docs.where("doc_id is null"))


def with_codes(docs: DataFrame, width: int, name: str) -> DataFrame:
    """docs with the code of each row's set in column name, null without words."""
    names = [*docs.columns, name]
    at_text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(at_text))
            for i, j in K.slices(offsets):
                h, at = sorted_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                size, sig = signatures(h, at, j - i)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sig, pa.int64(), mask=size == 0)], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
