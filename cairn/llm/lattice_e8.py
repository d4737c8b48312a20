"""Near-duplicate vectors by E8 lattice hashing.

Each table projects unit vectors to some blocks of eight dimensions and decodes every block to a point of
the E8 lattice; the points together are the vector's cell. A vector is filed under its own cell and looks
into the nearest cells around it. What meets in a cell is verified by the cosine in double precision.
The number of blocks grows with the logarithm of the number of vectors, so that the unrelated vectors
that a vector meets stay about as many, and the number of tables with the blocks, so that recall stays.

Vectors within half the threshold's angle of a common one form a ball: by the triangle inequality of
angles all of them are linked, so a group of near copies of any size costs as much as its rows. Cells then
hold balls, pairs of balls are decided by their centres and radii where these suffice, and member by
member, in blocks, where they do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import cells as C
from cairn.llm import kernels as K
from cairn.operators.graph import connected_components
from cairn.operators.shared import Staged

U64 = np.uint64
# Blocks of a table, cells looked into, scale of the projection and tables, by falling share of unrelated vectors that meet in a
# table (of the last row carried on from the others). Measured on vectors of 64 and 384 dimensions: each row finds 0.97 or more
# of the pairs with a cosine of 0.9, more of closer ones.
SETTINGS = [(2, 8, 1.8, 10, 4e-5), (3, 16, 2.0, 16, 1.5e-6), (4, 32, 2.2, 20, 5e-8), (5, 64, 2.4, 26, 1.7e-9)]
# Unrelated vectors that a vector meets, at most.
MET = 100
ROWS_IN_CHUNK = 8192
BLOCK_ROWS = 32
SLACK = 1e-9


def nearby(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doubled lattice points, squared distances) of eight E8 points near each row, the nearest first.

    E8 is the union of D8 and D8 shifted by one half. The nearest point of D8 is the rounded one, or,
    if its sum is odd, the one with its worst coordinate rounded the other way; next ones turn others.
    """
    points, distances = [], []
    rows = np.arange(len(x))
    for shift in (0.0, 0.5):
        y = x - shift
        r = np.rint(y)
        error = y - r
        order = np.argsort(-np.abs(error), axis=1, kind="stable")
        step = np.where(error >= 0, 1.0, -1.0)
        odd = (r.sum(1) % 2 != 0)[:, None]

        def turned(*which: int, r: np.ndarray = r, order: np.ndarray = order, step: np.ndarray = step) -> np.ndarray:
            out = r.copy()
            for k in which:
                out[rows, order[:, k]] += step[rows, order[:, k]]
            return out

        for even_way, odd_way in (((), (0,)), ((0, 1), (1,)), ((0, 2), (2,)), ((1, 2), (3,))):
            point = np.where(odd, turned(*odd_way), turned(*even_way)) + shift
            points.append((2 * point).astype(np.int64))
            distances.append(((x - point) ** 2).sum(1))
    near, apart = np.stack(points, 1), np.stack(distances, 1)
    order = np.argsort(apart, axis=1, kind="stable")
    return np.take_along_axis(near, order[:, :, None], 1), np.take_along_axis(apart, order, 1)


def setting(n: int) -> tuple[int, int, float, int]:
    """(blocks, probes, scale, tables) for n vectors: the first with which unrelated ones meet MET others at most.

    Beyond the rows of SETTINGS each further block goes on as they do: twice the probes, a larger scale, three tenths more
    tables, and a thirtieth of the unrelated vectors in a table, so there is one for every n.
    """
    rows = list(SETTINGS)
    while rows[-1][3] * rows[-1][4] * n > MET:
        blocks, probes, scale, tables, share = rows[-1]
        rows.append((blocks + 1, 2 * probes, scale + 0.2, -(-13 * tables // 10), share / 30))
    return next(x for x in rows if x[3] * x[4] * n <= MET)[:4]


def cell_codes(unit: np.ndarray, table: int, blocks: int, probes: int, scale: float) -> np.ndarray:
    """Codes of the own cell and the nearest others of each row, in one table."""
    rng = np.random.Generator(np.random.PCG64([17, table, unit.shape[1]]))
    code, apart = None, None
    for _ in range(blocks):
        point, far = nearby(unit @ rng.standard_normal((unit.shape[1], 8)) / scale)
        one = np.zeros(point.shape[:2], U64)
        for c in range(8):
            one = K.mix(one ^ point[:, :, c].astype(np.int64).view(U64))
        if code is None:
            code, apart = one, far
        else:
            code = K.mix(code[:, :, None] * U64(3) + one[:, None, :]).reshape(len(unit), -1)
            apart = (apart[:, :, None] + far[:, None, :]).reshape(len(unit), -1)
            order = np.argsort(apart, axis=1, kind="stable")[:, : probes + 1]
            code, apart = np.take_along_axis(code, order, 1), np.take_along_axis(apart, order, 1)
    return K.mix(code[:, : probes + 1] + U64(table * 1000 + unit.shape[1]))


def unit_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(row, vec_id, unit) of the vectors that can link; unit holds the doubles of the vector at length one."""
    kind = vectors.schema[vec_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            values, ends = column.values, column.offsets.to_numpy()
            flat = values.to_numpy(zero_copy_only=False).astype(float)
            if values.null_count:
                flat = np.where(values.is_null().to_numpy(zero_copy_only=False), np.nan, flat)
            units: list[bytes | None] = [None] * batch.num_rows
            size = np.diff(ends)
            for length in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == length)
                x = flat[ends[at][:, None] + np.arange(length)]
                top = np.abs(x).max(1)
                good = np.isfinite(top) & (top > 0)
                x = x[good] / top[good][:, None]
                x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                for k, row in zip(at[good].tolist(), x, strict=True):
                    units[k] = row.tobytes()
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.binary())], ["row", "vec_id", "unit"])
            yield out.filter(out.column(2).is_valid())

    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")).where("embedding is not null and vec_id is not null")
    return numbered.mapInArrow(run, f"row long, vec_id {kind}, unit binary")


def filed(units: DataFrame, blocks: int, probes: int, scale: float, tables: int, n_slices: int) -> DataFrame:
    """(cell, row, own): a row's own cell of each table and the cells that it looks into, where more than one row is in the cell."""
    n_slices = max(1, min(n_slices, 1 << 20))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_IN_CHUNK):
                chunk = batch.slice(lo, ROWS_IN_CHUNK)
                row, data = chunk.column(0).to_numpy(), chunk.column(1).to_pylist()
                size = np.array([len(x) for x in data])
                found = []
                for length in np.unique(size):
                    which = np.flatnonzero(size == length)
                    for at in range(0, len(which), 1024):
                        part = which[at : at + 1024]
                        unit = np.frombuffer(b"".join(data[i] for i in part)).reshape(len(part), -1)
                        for table in range(tables):
                            code = cell_codes(unit, table, blocks, probes, scale)
                            own = np.zeros(code.shape, np.uint8)
                            own[:, 0] = 1
                            found.append(C.entries(code.ravel(), np.repeat(row[part], code.shape[1]), own.ravel()))
                yield C.blocks(np.concatenate(found), n_slices, salt)
                salt += 7919

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in C.shared(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x["cell"]).view(np.int64)), pa.array(np.ascontiguousarray(x["row"])), pa.array(x["mark"] > 0)], ["cell", "row", "own"])

    dealt = units.select("row", "unit").mapInArrow(scatter, C.SCHEMA)
    return dealt.repartition(max(1, n_slices // 4), "slice").sortWithinPartitions("slice", "local").mapInArrow(gather, "cell long, row long, own boolean")


def cosines(pairs: DataFrame, schema: str) -> DataFrame:
    """pairs with cosine in place of their columns u and v; vectors of other lengths have the cosine -1."""
    names = [c for c in pairs.columns if c not in ("u", "v")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("u", "v"))
            out = np.full(batch.num_rows, -1.0)
            size = np.array([len(x) if len(x) == len(y) else 0 for x, y in zip(u, v, strict=True)])
            for length in np.unique(size[size > 0]):
                at = np.flatnonzero(size == length)
                left, right = (np.frombuffer(b"".join(x[i] for i in at)).reshape(len(at), -1) for x in (u, v))
                out[at] = np.einsum("ij,ij->i", left, right)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(out)], [*names, "cosine"])

    return pairs.mapInArrow(run, schema + ", cosine double")


def block_links(blocks: DataFrame, threshold: float) -> DataFrame:
    """(a, b, row, n): links of each member of two balls to the other ball, from rows (a, b, left, right) of member blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, left, right in zip(*(batch.column(c) for c in range(4)), strict=True):
                sides = []
                for side in (left, right):
                    rows, units = (x for x in side.values.flatten())
                    sides.append((rows.to_numpy(), np.frombuffer(b"".join(units.to_pylist())).reshape(len(rows), -1)))
                linked = sides[0][1] @ sides[1][1].T >= threshold
                n = np.concatenate([linked.sum(1), linked.sum(0)])
                some = n > 0
                rows = np.concatenate([sides[0][0], sides[1][0]])[some]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), a.as_py())), pa.array(np.full(len(rows), b.as_py())), pa.array(rows), pa.array(n[some])], ["a", "b", "row", "n"])

    return blocks.mapInArrow(run, "a long, b long, row long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row: how many other vectors were found with a cosine of
    threshold or more, the smallest vec_id that such links reach, and whether it is the row's own.

    Vectors that are null, zero, or hold nulls or non-finite components link with nothing, as do those
    without an id and vectors of other lengths. Repeated rows are vectors of their own and link with each
    other. An empty table gives no rows; other columns are not read.
    """
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = Staged(unit_vectors(vectors, vec_id, embedding), "units")
    cells = Staged(filed(units.df, *setting(units.df.count()), 8 * parts), "cells")
    unit = units.df.select("row", "unit")
    # balls: a row joins the smallest first row of its own cells that is near enough to it, or stays alone
    half = float(np.cos(np.arccos(threshold) / 2)) + SLACK
    first = cells.df.where("own").groupBy("cell").agg(F.min("row").alias("first"))
    tried = cells.df.where("own").join(first, "cell").where("first < row").select("row", "first").distinct()
    tried = tried.join(unit.withColumnRenamed("unit", "u"), "row").join(unit.select(F.col("row").alias("first"), F.col("unit").alias("v")), "first")
    joined = cosines(tried.select("row", "first", "u", "v"), "row long, first long").where(F.col("cosine") >= half)
    joined = joined.groupBy("row").agg(F.min(F.struct("first", "cosine")).alias("best")).select("row", "best.first", "best.cosine")
    member = units.df.select("row", "vec_id").join(joined, "row", "left")
    member = Staged(member.select("row", "vec_id", F.coalesce("first", "row").alias("ball"), F.coalesce("cosine", F.lit(1.0)).alias("cosine")), "balls")
    balls = member.df.groupBy("ball").agg(F.count("*").alias("size"), F.min("cosine").alias("reach"), F.min("vec_id").alias("least_id"))
    balls = Staged(balls.join(unit.withColumnRenamed("row", "ball"), "ball"), "centres")
    # pairs of balls that meet in a cell
    held = cells.df.join(member.df.select("row", "ball"), "row").groupBy("cell", "ball").agg(F.max("own").alias("own"))
    held = Staged(held, "held")
    seen = held.df.withColumnRenamed("ball", "other").join(held.df.where("own").select("cell", "ball"), "cell").where("ball <> other")
    pairs = seen.select(F.least("ball", "other").alias("a"), F.greatest("ball", "other").alias("b")).distinct()
    side = lambda x, y: balls.df.select(F.col("ball").alias(x), F.col("unit").alias(y), F.col("size").alias(f"size_{x}"), F.acos(F.least("reach", F.lit(1.0))).alias(f"reach_{x}"))
    paired = pairs.join(side("a", "u"), "a").join(side("b", "v"), "b")
    judged = cosines(paired.select("a", "b", "size_a", "size_b", "reach_a", "reach_b", "u", "v"), "a long, b long, size_a long, size_b long, reach_a double, reach_b double")
    alone = (F.col("size_a") == 1) & (F.col("size_b") == 1) & (F.col("reach_a") == 0) & (F.col("reach_b") == 0)
    angle, spread, limit = F.acos(F.least(F.greatest("cosine", F.lit(-1.0)), F.lit(1.0))), F.col("reach_a") + F.col("reach_b"), float(np.arccos(threshold))
    verdict = F.when(alone, F.when(F.col("cosine") >= threshold, "all")).when(angle + spread <= limit - SLACK, "all").when(angle - spread <= limit + SLACK, "some")
    judged = Staged(judged.withColumn("verdict", verdict).where("verdict is not null").select("a", "b", "size_a", "size_b", "verdict"), "judged")
    whole = judged.df.where("verdict = 'all'")
    per_ball = whole.select(F.col("a").alias("ball"), F.col("size_b").alias("n")).unionByName(whole.select(F.col("b").alias("ball"), F.col("size_a").alias("n")))
    per_ball = per_ball.groupBy("ball").agg(F.sum("n").alias("others"))
    chunk = F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / BLOCK_ROWS))
    needed = judged.df.where("verdict = 'some'").select(F.explode(F.array("a", "b")).alias("ball")).distinct()
    blocks = member.df.select("row", "ball").join(needed, "ball").join(balls.df.select("ball", "size"), "ball").join(unit, "row").groupBy("ball", chunk.alias("chunk"))
    blocks = Staged(blocks.agg(F.collect_list(F.struct("row", "unit")).alias("members")), "blocks")
    mixed = judged.df.where("verdict = 'some'").select("a", "b")
    mixed = mixed.join(blocks.df.select(F.col("ball").alias("a"), F.col("members").alias("left")), "a").join(blocks.df.select(F.col("ball").alias("b"), F.col("members").alias("right")), "b")
    partly = Staged(block_links(mixed.select("a", "b", "left", "right"), threshold).groupBy("a", "b", "row").agg(F.sum("n").alias("n")), "partly")
    edges = whole.select("a", "b").unionByName(partly.df.select("a", "b")).distinct()
    roots = Staged(connected_components(edges, "a", "b"), "roots")
    named = balls.df.select("ball", "size", "least_id").join(roots.df.withColumnRenamed("node", "ball"), "ball", "left").join(per_ball, "ball", "left")
    named = named.select("ball", "size", "least_id", F.coalesce("component", "ball").alias("component"), F.coalesce("others", F.lit(0)).alias("others"))
    named = Staged(named, "named")
    ends = named.df.groupBy("component").agg(F.min("least_id").alias("component_id"))
    ends = named.df.join(ends, "component").select("ball", "component_id", (F.col("size") - 1 + F.col("others")).alias("links"))
    rows = member.df.join(ends, "ball").join(partly.df.groupBy("row").agg(F.sum("n").alias("part")), "row", "left")
    linked = rows.select("vec_id", (F.col("links") + F.coalesce("part", F.lit(0))).cast("long").alias("n_links"), "component_id")
    # the rows that can link are told from the others by the same rule as above
    v = F.col(embedding)
    bad = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.forall(v, lambda x: x == 0) | F.col(vec_id).isNull()
    rest = vectors.where(F.coalesce(bad, F.lit(True))).select(F.col(vec_id).alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(vec_id).alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
