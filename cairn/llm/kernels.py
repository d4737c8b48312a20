"""Numpy helpers over Arrow text columns, used inside Spark tasks.

All work on slices of about SLICE bytes of whole documents, so that memory follows the slice and
not the Arrow batch; one longer document forms a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U64 = np.uint64
# Odd multiplier of the polynomial prefix hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

_byte_rng = np.random.Generator(np.random.PCG64(20240601))
BYTE_CODE = _byte_rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept per worker and grown when needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 2 * SLICE), base, U64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """(first, end) ranges of documents with about size bytes together."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[i] = sum of code(data[j]) * BASE**j for j < i."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit codes of stretches of bytes that follow each other: sums of a mixed value of each byte and its place in the stretch.

    A polynomial modulo 2^64 gives the same value to some regular texts, whatever its base; here the bytes of
    two places are unrelated, so nothing cancels by its form.
    """
    size = end - start
    inside = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    value = mix(BYTE_CODE[data[inside]] + (inside - np.repeat(start, size)).astype(U64) * U64(BASE))
    total = np.zeros(len(value) + 1, U64)
    np.cumsum(value, out=total[1:])
    edge = np.concatenate([[0], np.cumsum(size)])
    return mix(total[edge[1:]] - total[edge[:-1]] + size.astype(U64))


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, start, end) of each word: bytes outside the class gap, ASCII white space by default, A-Z lower-cased."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = LOWER[data]
    space = gap[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    start = np.flatnonzero(~space & (before | first[:-1]))
    end = np.flatnonzero(~space & (after | first[1:])) + 1
    return word_codes(low, start, end), np.searchsorted(offsets, start, "right") - 1, start, end


def shingles(code: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each run of width words; a document with 1 to width - 1 words has one, of all its words."""
    if not len(code):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    count = np.bincount(doc, minlength=n_docs)
    m = len(code) - width + 1
    out, at = np.zeros(0, U64), np.zeros(0, np.int64)
    if m > 0:
        whole = doc[:m] == doc[width - 1 :]
        acc = np.zeros(m, U64)
        for i in range(width):
            acc = mix(acc * U64(0xD6E8FEB86659FD93) + code[i : i + m])
        out, at = acc[whole], doc[:m][whole]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(doc, short)
        more = np.array([_run(code[a : a + count[d]]) for d, a in zip(short, first, strict=True)], U64)
        out, at = np.concatenate([out, more]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at


def _run(code: np.ndarray) -> int:
    acc = np.full(1, len(code), U64)
    for c in code:
        acc = mix(acc * U64(0xD6E8FEB86659FD93) + c)
    return int(acc[0])


def per_document(at: np.ndarray, n_docs: int) -> np.ndarray:
    """Bounds of each document in a sorted document column: rows bounds[d] to bounds[d + 1]."""
    return np.searchsorted(at, np.arange(n_docs + 1))


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows that agree in the first keys columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for c in range(keys):
            v = batch.column(c).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(batch.column(c)[a].as_py() for c in range(keys))
            if held and key != last:
                yield joined(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield joined(held)


def run_edges(rows: pa.RecordBatch, keys: int) -> np.ndarray:
    """Bounds of the groups of neighbouring rows that agree in the first keys columns."""
    change = np.zeros(max(rows.num_rows - 1, 0), bool)
    for c in range(keys):
        v = rows.column(c).to_numpy(zero_copy_only=False)
        change |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [rows.num_rows]])


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups of rows that agree in the first keys columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(batch.column(c)[0] != held[0].column(c)[0] for c in range(keys)):
            yield joined(held)
            held = []
        last = int(run_edges(batch, keys)[-2])
        if last:
            yield joined([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
