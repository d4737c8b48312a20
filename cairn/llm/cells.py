"""Cells that more than one row falls into, found without a row of the table for each cell of each row.

Tasks send their cells in compact blocks of one slice of the code space, one entry for each cell and task chunk,
so a slice gets at most as many entries of a cell as there are chunks, whatever the group of near copies;
the other rows of a cell met within a chunk travel beside, in blocks dealt at random. A slice's task sorts its
entries and keeps the cells that are there twice; single cells are never written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cairn.llm import kernels as K

U64 = np.uint64
ENTRY = np.dtype([("cell", "<u8"), ("row", "<i8"), ("mark", "u1")])
# As written between tasks: the upper cell bits follow from the slice.
BRIEF = np.dtype([("low", "<u4"), ("mid", "u1"), ("row", "<i8"), ("mark", "u1")])
SCHEMA = "slice int, local int, block binary"
LOCAL = 65536


def entries(cell: np.ndarray, row: np.ndarray, mark: np.ndarray | int = 0) -> np.ndarray:
    out = np.zeros(len(cell), ENTRY)
    out["cell"], out["row"], out["mark"] = cell, row, mark
    return out


def blocks(found: np.ndarray, n_slices: int, salt: int) -> pa.RecordBatch:
    """The blocks of a chunk's entries. A code is cut to its slice and 40 bits; the few different ones that meet are told apart by verification."""
    part = ((found["cell"] >> U64(32)) * U64(n_slices)) >> U64(32)
    found["cell"] = (part << U64(44)) | (found["cell"] & U64((1 << 40) - 1))
    # the largest mark first: it stands for the cell
    found = found[np.lexsort((found["row"], 255 - found["mark"].astype(np.int64), found["cell"]))]
    first = np.ones(len(found), bool)
    first[1:] = found["cell"][1:] != found["cell"][:-1]
    local = found[~(first & np.append(first[1:], True))]
    lead = found[first]
    edges = np.searchsorted(lead["cell"] >> U64(44), np.arange(n_slices + 1, dtype=U64))
    brief = np.zeros(len(lead), BRIEF)
    brief["low"], brief["mid"] = lead["cell"] & U64(0xFFFFFFFF), (lead["cell"] >> U64(32)) & U64(0xFF)
    brief["row"], brief["mark"] = lead["row"], lead["mark"]
    rows = [(s, 0, brief[a:b].tobytes()) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
    rows += [((salt + lo) % n_slices, 1, local[lo : lo + LOCAL].tobytes()) for lo in range(0, len(local), LOCAL)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["slice", "local", "block"])


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Entries of the cells that two rows or more fall into, from blocks sorted by slice and local. An entry may come twice."""
    for rows in K.runs(batches, 2):
        held = rows.column(2).to_pylist()
        if rows.column(1)[0].as_py():
            yield from (np.frombuffer(x, ENTRY) for x in held)
            continue
        brief = np.concatenate([np.frombuffer(x, BRIEF) for x in held])
        cell = (U64(rows.column(0)[0].as_py()) << U64(44)) | (brief["mid"].astype(U64) << U64(32)) | brief["low"].astype(U64)
        order = np.lexsort((brief["row"], cell))
        cell, brief = cell[order], brief[order]
        fresh = np.ones(len(cell), bool)
        fresh[1:] = (cell[1:] != cell[:-1]) | (brief["row"][1:] != brief["row"][:-1])
        cell, brief = cell[fresh], brief[fresh]
        same = np.zeros(len(cell) + 1, bool)
        same[1:-1] = cell[1:] == cell[:-1]
        both = same[1:] | same[:-1]
        yield entries(cell[both], brief["row"][both], brief["mark"][both])
