"""JSON lines of large files in byte ranges, with prefixes that are checked against their digests.

A Python data source cuts every file's prefix into ranges, and a range has the lines that begin in it, so a file of any
size is many tasks and no task holds more than a line and a read. Another task for each prefix reads it in pieces and compares
its sha256; a prefix that was changed or is short fails the job.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE, READ, ROWS = 64 << 20, 1 << 20, 4096
SCHEMA = "file string, begin long, number long, offset long, raw string"


@dataclass
class Range(InputPartition):
    """The lines of a file that begin in begin to end, up to its prefix; or the check of the whole prefix."""

    path: str
    begin: int
    end: int
    prefix: int
    sha256: str | None = None


def opened(path: str):
    """(stream, bytes) of a file of any file system that Arrow knows by its URI; a bare path is local."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system.open_input_file(inner), system.get_file_info(inner).size


def prefix_digest(path: str, prefix: int) -> str | None:
    """sha256 of the first bytes of a file; None if it is shorter."""
    stream, size = opened(path)
    with stream:
        if size < prefix:
            return None
        digest, left = hashlib.sha256(), prefix
        while left:
            piece = stream.read(min(READ, left))
            digest.update(piece)
            left -= len(piece)
    return digest.hexdigest()


def lines_from(path: str, begin: int, end: int, prefix: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its line feed) of the lines that begin in begin to end; the last ends with the prefix, if not before."""
    stream, _ = opened(path)
    with stream:
        at, held = begin, b""
        if begin:
            # the line that holds the byte before begins earlier, unless that byte ends it
            stream.seek(begin - 1)
            at = begin - 1
            while True:
                piece = stream.read(min(READ, prefix - at))
                cut = piece.find(b"\n")
                if cut >= 0:
                    at, held = at + cut + 1, piece[cut + 1 :]
                    break
                at += len(piece)
                if not piece or at >= prefix:
                    return
        position = at + len(held)
        while at < end:
            cut = held.find(b"\n")
            parts = [held]
            while cut < 0 and position < prefix:
                piece = stream.read(min(READ, prefix - position))
                if not piece:
                    break
                position += len(piece)
                found = piece.find(b"\n")
                parts.append(piece)
                if found >= 0:
                    cut = sum(map(len, parts[:-1])) + found
            held = b"".join(parts)
            if cut < 0:
                if held:
                    yield at, held
                return
            yield at, held[:cut]
            at, held = at + cut + 1, held[cut + 1 :]


class LineRanges(DataSource):
    """files: a JSON list of {path, prefix_bytes, prefix_sha256}, the last two of which may be missing; range_bytes: bytes of a range."""

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LineReader(json.loads(self.options["files"]), int(self.options.get("range_bytes", RANGE)))


class LineReader(DataSourceReader):
    def __init__(self, files: list[dict], size: int):
        self.files, self.size = files, size

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for row in self.files:
            prefix = row.get("prefix_bytes")
            if prefix is None:
                stream, prefix = opened(row["path"])
                stream.close()
            if row.get("prefix_sha256"):
                out.append(Range(row["path"], 0, 0, prefix, row["prefix_sha256"]))
            out += [Range(row["path"], begin, min(begin + self.size, prefix), prefix) for begin in range(0, prefix, self.size)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.sha256 is not None:
            if prefix_digest(part.path, part.prefix) != part.sha256:
                raise ValueError(f"the prefix of {part.path} has changed")
            return
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        rows: list[tuple] = []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        held = 0
        for number, (offset, line) in enumerate(lines_from(part.path, part.begin, part.end, part.prefix)):
            rows.append((part.path, part.begin, number, offset, line.decode("utf-8", "replace")))
            held += len(line)
            if len(rows) >= ROWS or held >= READ:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


def read_jsonl(spark: SparkSession, files: list[dict], range_bytes: int = RANGE) -> DataFrame:
    """(file, line, offset, event) of the lines, from 0, of JSON lines files or of their prefixes; empty lines count and are left out.

    files has a dict for each file: path, and prefix_bytes with prefix_sha256 where only an authenticated prefix is read. A prefix
    may end within a line, whose beginning is then the last line. What is no JSON is a null event. The job fails if a prefix has another
    digest or the file is shorter.
    """
    spark.dataSource.register(LineRanges)
    rows = spark.read.format("line_ranges").option("files", json.dumps(files)).option("range_bytes", range_bytes).load()
    w = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range of a file
    ranges = rows.groupBy("file", "begin").agg(F.count("*").alias("n")).select("file", "begin", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    numbered = rows.where("raw <> ''").join(ranges, ["file", "begin"])
    return numbered.select("file", (F.col("before") + F.col("number")).alias("line"), "offset", F.try_parse_json("raw").alias("event"))
