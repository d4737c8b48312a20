"""Joins on intervals by range partitions of their positions, so that one key with most of the rows is many tasks.

Points and the starts of spans are sorted together by key and position into many parts. A span is at home in the part of its
start; one that ends beyond it is copied to the parts that it reaches. Within a part the points are in order, so those
that a span holds are a run of them, found by two binary searches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.shared import staged
from cairn.operators.windows import range_sorted

# Spans that one task takes, and pairs in a batch of its results.
MOST, PAIRS = 1_000_000, 1 << 15
# Rows of both sides of a key that are joined as they are; a key with more goes through the parts.
EACH = 256


def _events(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """(points and spans as k, at, until, point, span with the part they are sorted into, borders of the parts)."""
    k = F.xxhash64(*keys)
    whole = lambda df: F.struct(*df.columns)
    here = [F.col(c).isNotNull() for c in keys]
    every = lambda df, *more: df.where(_all([*here, *more]))
    p = every(points, F.col(at).isNotNull()).select(k.alias("k"), F.col(at).cast("double").alias("at"), F.lit(None).cast("double").alias("until"), whole(points).alias("point"))
    s = every(spans, F.col(start) <= F.col(end)).select(k.alias("k"), F.col(start).cast("double").alias("at"), F.col(end).cast("double").alias("until"), whole(spans).alias("span"))
    # a span stands before the points at its start, so they are in its part or in a later one
    both = p.unionByName(s, allowMissingColumns=True).withColumns({"kind": F.col("until").isNull(), "tie": F.monotonically_increasing_id()})
    rows, _ = range_sorted(both, ["k", "at", "kind", "tie"])
    place = F.struct("k", "at")
    borders = rows.groupBy("__part").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # one row for each part of the sort
    return rows.drop("__place", "kind", "tie"), staged(borders.withColumn("next", F.lead("first").over(Window.orderBy("__part"))), "borders")


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _reaching(rows: DataFrame, borders: DataFrame) -> DataFrame:
    """A row for each later part that a span reaches, with whole: whether it holds all of that part's positions."""
    until = F.struct("k", F.col("until").alias("at"))
    home = rows.where("until is not null").join(F.broadcast(borders.select("__part", "next")), "__part").where(until >= F.col("next")).drop("next")
    later = borders.select(F.col("__part").alias("__to"), "first", "last")
    # only spans that leave their part meet the borders, one row for each part of the sort
    reached = home.join(F.broadcast(later), (F.col("__to") > F.col("__part")) & (F.col("first") <= until))
    return reached.select(F.col("__to").alias("__part"), "k", "at", "until", "point", "span", (F.col("last") <= until).alias("whole"))


def _dealt(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """Rows and copies with cell, a part or, where more than MOST spans reach it, a share of its spans beside all of its points."""
    counts = copies.groupBy("__part").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("__part", F.ceil(F.col("n") / MOST).alias("shares"))
    with_shares = lambda df: df.join(F.broadcast(counts), "__part", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    point = F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)
    own = with_shares(rows).withColumn("share", F.explode(F.when(F.col("until").isNull(), point).otherwise(F.array(F.lit(0).cast("long")))))
    other = with_shares(copies.select(*rows.columns)).withColumn("share", F.pmod(F.xxhash64("k", "at", "until"), F.col("shares")))
    return own.unionByName(other).select((F.col("__part") * (1 << 20) + F.col("share")).alias("cell"), "k", "at", "until", "point", "span")


def _by_size(a: DataFrame, b: DataFrame, keys: list[str], plain, parts) -> DataFrame:
    """plain(a, b) of the keys with EACH rows or fewer, whose pairs are few, and parts(a, b) of the others."""
    counts = a.select(*keys).unionByName(b.select(*keys)).groupBy(*keys).agg(F.count("*").alias("n"))
    hot = staged(counts.where((F.col("n") > EACH) & _all([F.col(c).isNotNull() for c in keys])).select(*keys), "hot")
    if hot.isEmpty():
        return plain(a, b)
    of = lambda df, how: df.join(hot, keys, how).select(df.columns)
    return plain(of(a, "left_anti"), of(b, "left_anti")).unionByName(parts(of(a, "left_semi"), of(b, "left_semi")))


def _runs(table: pa.Table, after_start: bool) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray]:
    """(points in order, spans, first and end of the run of points that each span holds)."""
    is_span = table.column("until").is_valid()
    points, spans = table.filter(pc.invert(is_span)), table.filter(is_span)
    k, position = points.column("k").to_numpy(), points.column("at").to_numpy()
    order = np.lexsort((position, k))
    points, k, position = points.take(order), k[order], position[order]
    keys, places = np.unique(k), np.unique(position)
    code = np.searchsorted(keys, k) * (len(places) + 1) + np.searchsorted(places, position)
    sk = spans.column("k").to_numpy()
    known = np.isin(sk, keys)
    base = np.searchsorted(keys, sk) * (len(places) + 1)
    first = np.searchsorted(code, base + np.searchsorted(places, spans.column("at").to_numpy(), "right" if after_start else "left"))
    end = np.searchsorted(code, base + np.searchsorted(places, spans.column("until").to_numpy(), "right"))
    return points, spans, first, np.where(known, np.maximum(first, end), first)


def stabbed(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, after_start: bool = False) -> DataFrame:
    """(point, span): structs of each point and span of equal keys with start <= at <= end, or start < at where after_start.

    Positions are compared as doubles. Rows with a null key or position, and spans that end before they start, are in no
    pair; repeated rows are paired each. A task gives its pairs in batches of PAIRS.
    """
    rows, borders = _events(points, spans, keys, at, start, end)
    dealt = _dealt(rows, _reaching(rows, borders))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        held, outer, first, end_ = _runs(table, after_start)
        n = end_ - first
        before = np.cumsum(n) - n
        for lo in range(0, int(n.sum()), PAIRS):
            pair = np.arange(lo, min(lo + PAIRS, int(n.sum())))
            span = np.searchsorted(before + n, pair, "right")
            point = first[span] + pair - before[span]
            out = pa.table([held.column("point").take(point), outer.column("span").take(span)], names=["point", "span"])
            yield from out.combine_chunks().to_batches()

    schema = f"point {rows.schema['point'].dataType.simpleString()}, span {rows.schema['span'].dataType.simpleString()}"
    found = dealt.groupBy("cell").applyInArrow(run, schema)
    return found.where(_all([F.col(f"point.{c}") == F.col(f"span.{c}") for c in keys]))  # keys whose codes agree


def range_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of closed intervals (a_start, a_end) of left and (b_start, b_end) of right that share a point, within equal keys.

    Keys of up to EACH rows are joined as they are. For others, of two intervals that overlap the later one starts in the other:
    pairs are those in which a starts in b, and those in which b starts in a and after it.
    """
    sound = (F.col("a_start") <= F.col("a_end")) & (F.col("b_start") <= F.col("b_end"))
    met = sound & (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end"))
    plain = lambda a, b: a.join(b, keys).where(met).select(*left.columns, *[c for c in right.columns if c not in keys])
    return _by_size(left, right, keys, plain, lambda a, b: _overlap_in_parts(a, b, keys))


def _overlap_in_parts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    a_in_b = stabbed(left, right, keys, "a_start", "b_start", "b_end").select(F.col("point").alias("l"), F.col("span").alias("r"))
    b_in_a = stabbed(right, left, keys, "b_start", "a_start", "a_end", after_start=True).select(F.col("span").alias("l"), F.col("point").alias("r"))
    empty = (F.col("l.a_start") > F.col("l.a_end")) | (F.col("r.b_start") > F.col("r.b_end"))
    return a_in_b.unionByName(b_in_a).where(~F.coalesce(empty, F.lit(False))).select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in keys])


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], point: str, point_id: list[str]) -> DataFrame:
    """points with the name of the narrowest span (start, end, name) that holds each, null without one; ties go to the smaller name.

    Keys of up to EACH rows are joined as they are. Of others no pair is formed: in a part, spans in order of width and name mark the points of their run that have none yet, each once. Of
    the spans that hold a whole part of the sort, only the narrowest is sent there.
    """

    def plain(p: DataFrame, x: DataFrame) -> DataFrame:
        inside = p.join(x.select(*keys, F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("name").alias("__name")), keys).where((F.col("__s") <= F.col(point)) & (F.col(point) <= F.col("__e")))
        ids = [*dict.fromkeys([*keys, *point_id])]
        best = inside.groupBy(*ids).agg(F.min_by("__name", F.struct(F.col("__e") - F.col("__s"), "__name")).alias("name"))
        return p.join(best, ids, "left").select(*p.columns, "name")

    return _by_size(points, spans, keys, plain, lambda p, x: _innermost_in_parts(p, x, keys, point, point_id).select(*p.columns, "name"))


def _innermost_in_parts(points: DataFrame, spans: DataFrame, keys: list[str], point: str, point_id: list[str]) -> DataFrame:
    rows, borders = _events(points.select(*keys, point, *[c for c in point_id if c not in (*keys, point)]), spans, keys, point, "start", "end")
    copies = _reaching(rows, borders)
    rank = F.struct((F.col("span.end") - F.col("span.start")).alias("width"), F.col("span.name").alias("name"))
    # all rows of a part that is held whole have one key
    least = copies.where("whole").groupBy("__part").agg(F.min_by(F.struct("k", "at", "until", "point", "span"), rank).alias("x")).select("__part", "x.*")
    dealt = _dealt(rows, copies.where("not whole").drop("whole").unionByName(least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        held, outer, first, end = _runs(table, False)
        span = outer.column("span").combine_chunks()
        start, stop, name = (span.field(c) for c in ("start", "end", "name"))
        width = pc.subtract(stop, start)
        order = pc.sort_indices(pa.table([width, name], names=["width", "name"]), sort_keys=[("width", "ascending"), ("name", "ascending")]).to_numpy()
        free = np.arange(held.num_rows + 1)  # the next point without a span, as far as it is known
        best = np.full(held.num_rows, -1)
        for s in order[end[order] > first[order]].tolist():
            i, stop_at = int(first[s]), int(end[s])
            while True:
                root = i
                while free[root] != root:
                    root = int(free[root])
                while free[i] != root:
                    free[i], i = root, int(free[i])
                if root >= stop_at:
                    break
                best[root], free[root], i = s, root + 1, root + 1
        found = best >= 0
        out = pa.table([held.column("point").filter(found), span.take(best[found])], names=["point", "span"])
        yield from out.combine_chunks().to_batches()

    schema = f"point {rows.schema['point'].dataType.simpleString()}, span {rows.schema['span'].dataType.simpleString()}"
    found = dealt.groupBy("cell").applyInArrow(run, schema).where(_all([F.col(f"point.{c}") == F.col(f"span.{c}") for c in keys]))
    # a part's shares, and repeated rows of one id, meet here
    own = [F.col(f"point.{c}").alias(c) for c in dict.fromkeys([*keys, *point_id])]
    best = found.select(*own, F.col("span.name").alias("name"), rank.alias("r")).groupBy(*dict.fromkeys([*keys, *point_id])).agg(F.min_by("name", "r").alias("name"))
    return points.join(best, [*dict.fromkeys([*keys, *point_id])], "left")


def nonoverlapping(df: DataFrame, keys: list[str], start: str, end: str, name: str = "kept") -> DataFrame:
    """df with name: whether a row's span is kept when a key's spans are taken in order of start, the longer of equal starts first,
    and each is kept that begins at or after the end of the last kept one.

    A task reads its keys' spans in that order and remembers one number, so work is linear in the spans and memory does not
    follow a key. Which span is kept depends on all before, so one key is one task's stream. Rows without a key, start or end are not kept.
    """
    code = "__k"
    sound = _all([F.col(c).isNotNull() for c in (*keys, start, end)])
    # rows that cannot be kept are dealt by their own values, not to one task
    placed = df.withColumn(code, F.when(sound, F.xxhash64(*keys)).otherwise(F.xxhash64(*[F.col(c) for c in (*keys, start, end)], F.monotonically_increasing_id())))
    placed = placed.withColumns({"__a": F.when(sound, F.col(start).cast("double")), "__b": F.when(sound, F.col(end).cast("double"))})
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartition(n, code).sortWithinPartitions(code, *keys, "__a", F.desc("__b"))
    columns = [c for c in df.columns if c != name]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns) + f", `{name}` boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reach = None, -np.inf
        for batch in batches:
            code_, a, b = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (code, "__a", "__b"))
            kept = np.zeros(batch.num_rows, bool)
            edges = [0, *(np.flatnonzero(code_[1:] != code_[:-1]) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if code_[lo] != last:
                    last, reach = code_[lo], -np.inf
                at = lo + int(np.searchsorted(a[lo:hi], reach))
                while at < hi and not np.isnan(a[at]):
                    kept[at], reach = True, b[at]
                    at = max(at + 1, lo + int(np.searchsorted(a[lo:hi], reach)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(kept)], [*columns, name])

    return ordered.select(*columns, code, "__a", "__b").mapInArrow(run, schema)
