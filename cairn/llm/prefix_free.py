"""Repeated-substring removal by prefix-free parsing.

A rolling hash picks triggers: the trigger of a window of LEN bytes is the leftmost smallest hash among
its first REACH positions, so equal windows have equal triggers at equal places. A trigger's phrase is
the union of the windows that it stands for. Phrases form the dictionary, their order of occurrence the
parse. A window's place in the order of all suffixes, cut at LEN bytes, is decided in three steps: by the
phrase (all its windows are repeated if the phrase is), by the core that all windows of the phrase hold
(none is repeated if the core is not), and only for phrases in between by the dictionary's own suffixes,
first in pieces of PIECE window starts and then one by one. Highly repetitive text is settled by its
dictionary, so only the neighbourhood of differences is looked at byte by byte.

Suffixes are ordered by 104-bit codes rather than by letters, as only equal ones need to meet. The codes
travel in blocks, one for each task chunk and slice of the code space; what is equal within a chunk is
combined before, so neither a phrase with very many copies nor a core with very many contexts goes to
one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import kernels as K
from cairn.llm.spans import free_names
from cairn.operators.shared import Staged

U64 = np.uint64
REACH, GRAM, PIECE = 128, 16, 8
CONTEXTS = 4
CHUNK_BYTES = 8 << 20
# Reference lists of at most this many rows are broadcast; longer ones are joined by a shuffle.
BROADCAST_BYTES = 6 << 20
SEGMENT = "ref long, lo int, n int, back int, full boolean, open boolean"
ENTRY = np.dtype([("core", "<u8"), ("whole", "<u8"), ("ref", "<i8"), ("lo", "<i4"), ("n", "u1"), ("back", "u1"), ("many", "?"), ("open", "?")])
# As written between tasks: the upper bits of core follow from the slice.
BRIEF = np.dtype([("low", "<u4"), ("mid", "u1"), ("whole", "<u8"), ("ref", "<i8"), ("lo", "<i4"), ("n", "u1"), ("back", "u1"), ("many", "?")])


def coded(h: np.ndarray, inverse: np.ndarray, lo: np.ndarray, n: np.ndarray, back: np.ndarray, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(core, whole) codes of n window starts from lo, whose trigger lies back bytes after lo.

    The core is what any window that starts in the same stretch of size distances to the trigger holds.
    """
    span = lambda a, b: K.mix((h[b] - h[a]) * inverse[a] + (b - a).astype(U64))
    near = back // size * size
    start = lo + back - near
    return K.mix(span(start, start - size + 1 + length) + near.astype(U64)), K.mix(span(lo, lo + n - 1 + length), 5) + back.astype(U64)


def phrases(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first window start, number of window starts, trigger minus first start) of every phrase, and the prefix hash."""
    h = K.prefix_hash(data)
    inverse = K.powers(K.BASE_INVERSE, len(data) + 1)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, h, inverse
    m = len(data) - GRAM + 1
    key = (K.mix((h[GRAM:] - h[:-GRAM]) * inverse[:m]) & ~U64(0xFFFFFFFF)) | np.arange(m, dtype=U64)
    width = 1
    while width < REACH:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    starts = len(data) - length + 1
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:starts]
    p = np.flatnonzero(np.arange(starts) + length <= offsets[1:][doc])
    if not len(p):
        return none, none, none, none, h, inverse
    trigger, doc = (key[p] & U64(0xFFFFFFFF)).astype(np.int64), doc[p]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (trigger[1:] != trigger[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(fresh)
    lo = p[first]
    return doc[first], lo, np.diff(np.append(first, len(p))), trigger[first] - lo, h, inverse


def pieces(lo: np.ndarray, n: np.ndarray, back: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, lo, n, back) of the segments cut where the distance to the trigger is a multiple of size."""
    if size == 1:
        of = np.repeat(np.arange(len(lo)), n)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return of, lo[of] + step, np.ones(len(of), np.int64), back[of] - step
    low, high = (back - n + 1) // size, back // size
    count = high - low + 1
    of = np.repeat(np.arange(len(lo)), count)
    bucket = high[of] - (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
    top = np.minimum(bucket * size + size - 1, back[of])
    bottom = np.maximum(bucket * size, (back - n + 1)[of])
    return of, lo[of] + back[of] - top, top - bottom + 1, top


def combine(found: np.ndarray, n_slices: int, salt: int) -> pa.RecordBatch:
    """Blocks of a chunk's entries: one for each slice of the codes, and local ones for what is settled here."""
    part = ((found["core"] >> U64(32)) * U64(n_slices)) >> U64(32)
    found["core"] = (part << U64(44)) | (found["core"] & U64((1 << 40) - 1))
    found = found[np.lexsort((found["whole"], found["core"]))]
    core_first = np.ones(len(found), bool)
    core_first[1:] = found["core"][1:] != found["core"][:-1]
    first = core_first.copy()
    first[1:] |= found["whole"][1:] != found["whole"][:-1]
    copies = np.diff(np.append(np.flatnonzero(first), len(found)))
    found["many"] = np.repeat(copies > 1, copies)
    nth = np.cumsum(first) - np.repeat(np.cumsum(first)[core_first], np.diff(np.append(np.flatnonzero(core_first), len(found))))
    sent = first & (nth < CONTEXTS)
    found["open"] = first  # what is not sent is one of several contexts of its core, or a copy
    local, lead = found[~sent], found[sent]
    brief = np.zeros(len(lead), BRIEF)
    brief["low"], brief["mid"] = lead["core"] & U64(0xFFFFFFFF), (lead["core"] >> U64(32)) & U64(0xFF)
    for c in BRIEF.names[2:]:
        brief[c] = lead[c]
    edges = np.searchsorted(lead["core"] >> U64(44), np.arange(n_slices + 1, dtype=U64))
    rows = [(s, 0, brief[a:b].tobytes()) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
    rows += [((salt + lo) % n_slices, 1, local[lo : lo + 32768].tobytes()) for lo in range(0, len(local), 32768)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["slice", "local", "block"])


def settled(entry: np.ndarray, full: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.ascontiguousarray(entry["ref"])), pa.array(np.ascontiguousarray(entry["lo"]))]
    columns += [pa.array(entry[c].astype(np.int32)) for c in ("n", "back")] + [pa.array(np.ascontiguousarray(c)) for c in (full, more)]
    return pa.RecordBatch.from_arrays(columns, ["ref", "lo", "n", "back", "full", "open"])


def met(blocks: DataFrame, n_slices: int) -> DataFrame:
    """Segments that are repeated in full, and open ones, whose parts are to be compared: all contexts of a core that has
    several, one copy of each."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for s, local, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if local:
                    entry = np.frombuffer(block, ENTRY)
                    yield settled(entry, entry["many"], entry["open"])
                else:
                    parts.setdefault(s, []).append(np.frombuffer(block, BRIEF))
        for some in parts.values():
            brief = np.concatenate(some)
            core = (brief["mid"].astype(U64) << U64(32)) | brief["low"].astype(U64)
            order = np.lexsort((brief["whole"], core))
            core, brief = core[order], brief[order]
            core_first = np.ones(len(core), bool)
            core_first[1:] = core[1:] != core[:-1]
            first = core_first.copy()
            first[1:] |= brief["whole"][1:] != brief["whole"][:-1]
            begin = np.flatnonzero(first)
            copies = np.diff(np.append(begin, len(core)))
            full = np.repeat((copies > 1) | np.logical_or.reduceat(brief["many"], begin), copies)
            rows = np.diff(np.append(np.flatnonzero(core_first), len(core)))
            contexts = np.add.reduceat(first.astype(np.int64), np.flatnonzero(core_first))
            more = np.repeat(contexts > 1, rows) & first
            out = full | more
            if out.any():
                yield settled(brief[out], full[out], more[out])

    return blocks.repartition(n_slices, "slice").mapInArrow(gather, SEGMENT)


def chunked(entries: Iterator[tuple[np.ndarray, int]], n_slices: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size, salt = 0, 0
    for entry, n in entries:
        held.append(entry)
        size += n
        if size >= CHUNK_BYTES:
            yield combine(np.concatenate(held), n_slices, salt)
            held, size, salt = [], 0, salt + 7919
    if held:
        yield combine(np.concatenate(held), n_slices, salt)


def entries_of(ref: np.ndarray, lo: np.ndarray, n: np.ndarray, back: np.ndarray, at: np.ndarray, h: np.ndarray, inverse: np.ndarray, size: int, length: int) -> np.ndarray:
    """Entries of segments that start at byte lo of the slice, at being the document's first byte there."""
    out = np.zeros(len(lo), ENTRY)
    out["core"], out["whole"] = coded(h, inverse, lo, n, back, size, length)
    out["ref"], out["lo"], out["n"], out["back"] = ref, lo - at, n, back
    return out


def referred(docs: DataFrame, name: str = "ref") -> DataFrame:
    """docs with ref, or another name, a 64-bit code of id and text: rows that share it have the same bytes and the same answer."""
    return docs.withColumn(name, F.xxhash64("doc_id", "text"))


def listed(df: DataFrame) -> DataFrame:
    """A table of one 64-bit code in each row, marked for broadcast if it takes at most BROADCAST_BYTES."""
    most = BROADCAST_BYTES // 16
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def parsed(docs: DataFrame, length: int, n_slices: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, int]]:
            for batch in batches:
                data, offsets = K.text_bytes(batch.column(1))
                ref = batch.column(0).to_numpy()
                for i, j in K.slices(offsets):
                    at = offsets[i : j + 1] - offsets[i]
                    doc, lo, n, back, h, inverse = phrases(data[offsets[i] : offsets[j]], at, length)
                    if len(doc):
                        yield entries_of(ref[i:j][doc], lo, n, back, at[doc], h, inverse, REACH, length), int(at[-1])

        yield from chunked(found(), n_slices)

    return met(referred(docs).where(F.octet_length("text") >= length).select("ref", "text").mapInArrow(scan, "slice int, local int, block binary"), n_slices)


def resolved(docs: DataFrame, open_segments: DataFrame, size: int, length: int, n_slices: int) -> DataFrame:
    """The segments cut into pieces of size window starts and met again."""
    by_ref = Staged(open_segments.groupBy("ref").agg(F.collect_list(F.struct("lo", "n", "back")).alias("segments")), "open")
    some = referred(docs).join(listed(by_ref.df.select("ref")), "ref", "left_semi").select("ref", "text").dropDuplicates(["ref"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, int]]:
            for batch in batches:
                data, offsets = K.text_bytes(batch.column(1))
                ref, lists = batch.column(0).to_numpy(), batch.column(2)
                bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
                lo, n, back = (x.to_numpy().astype(np.int64) for x in lists.flatten().flatten())
                for i, j in K.slices(offsets):
                    at = offsets[i : j + 1] - offsets[i]
                    h = K.prefix_hash(data[offsets[i] : offsets[j]])
                    inverse = K.powers(K.BASE_INVERSE, len(h))
                    doc = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]))
                    a, b = bounds[i], bounds[j]
                    of, first, count, apart = pieces(lo[a:b] + at[doc], n[a:b], back[a:b], size)
                    yield entries_of(ref[i:j][doc[of]], first, count, apart, at[doc[of]], h, inverse, size, length), int(at[-1])

        yield from chunked(found(), n_slices)

    return met(some.join(by_ref.df, "ref").select("ref", "text", "segments").mapInArrow(scan, "slice int, local int, block binary"), n_slices)


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """(ref, spans): for each row code the byte ranges, as (lo, n), of window starts whose window occurs elsewhere too."""
    n_slices = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = [Staged(parsed(docs, length, n_slices), "phrases")]
    for size in (PIECE, 1):
        steps.append(Staged(resolved(docs, steps[-1].df.where("open"), size, length, n_slices), "pieces"))
    full = steps[0].df.where("full")
    for step in steps[1:]:
        full = full.unionByName(step.df.where("full"))
    return full.groupBy("ref").agg(F.collect_set(F.struct("lo", "n")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs with kept (the bytes left), n_bytes, n_removed and n_spans (maximal removed runs).

    Every byte covered by a string of length bytes that also starts elsewhere in the column, the same
    text included, is removed. A null or empty text, and one shorter than length, keeps its bytes.
    Repeated rows count as occurrences of each other, so whole copies lose all they hold; rows are given
    each; an empty table gives no rows; columns of docs named like a new one, in any case, are replaced, others stay.
    A text is held whole by its task, several times over.
    """
    new = ["kept", "n_bytes", "n_removed", "n_spans"]
    base = docs.select([c for c in docs.columns if c.lower() not in new])
    ref, held, body = free_names(docs, "ref", "spans", "body")
    found = Staged(repeated_spans(base.select("doc_id", "text"), length), "spans").df
    spans = found.select(F.col("ref").alias(ref), F.col("spans").alias(held))
    refs, names = listed(spans.select(ref)), [*base.columns, *new]
    rows = referred(base, ref)
    text = F.coalesce("text", F.lit("")).cast("binary")
    untouched = rows.join(refs, ref, "left_anti").select(
        *base.columns, text.alias("kept"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.num_columns - 2
            data, offsets = K.text_bytes(batch.column(width))
            lists = batch.column(width + 1)
            bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            lo, n = (x.to_numpy().astype(np.int64) for x in lists.flatten().flatten())
            kept, removed, runs = [], [], []
            for d in range(batch.num_rows):
                text = data[offsets[d] : offsets[d + 1]]
                edge = np.zeros(len(text) + 1, np.int32)
                a = lo[bounds[d] : bounds[d + 1]]
                np.add.at(edge, a, 1)
                np.add.at(edge, a + n[bounds[d] : bounds[d + 1]] - 1 + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept.append(text[~gone].tobytes())
                removed.append(int(gone.sum()))
                runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            columns = [*batch.columns[:width], pa.array(kept, pa.binary()), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    hit = rows.join(refs, ref, "left_semi").join(spans, ref).select(*base.columns, F.col("text").alias(body), held)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return untouched.unionByName(hit.mapInArrow(cut, f"{fields}, kept binary, n_bytes long, n_removed long, n_spans long"))
