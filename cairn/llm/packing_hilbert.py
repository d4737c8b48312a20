"""Packing: documents in the order of a space-filling curve, cut into sequences without gaps.

Every document's tokens are hashed into a count vector, the unit vector is projected to a few
dimensions, and its cell's Hilbert key orders the corpus. Laid end to end in that order the documents
form one stream; a sequence is a stretch of max_tokens ids of it, so only the last one is padded.
Each text is encoded once and the ids are written; the range sort moves only keys and lengths, and one join brings the
places back to the ids.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.shared import Staged

BUCKETS, DIMS, BITS = 1024, 4, 8
# Characters on which Python's and the tokenizer's classes, lower case and composition agree.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xa7\xa9\xab\xac\xae\xb0\xb1\xb6\xb7\xbb\xbf-įı-ľŁ-ň–—‘-„…€]*")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
CACHE_WORDS = 400_000
PROJECTION = np.random.Generator(np.random.PCG64(7)).standard_normal((BUCKETS, DIMS))


class Encoder:
    """Ids of texts as the tokenizer file gives them, with the ids of words kept between calls.

    Words of a text are independent in this vocabulary (an end mark closes each), so plain texts are
    split here and only unseen words are encoded; other texts are encoded whole.
    """

    def __init__(self, name: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(name))
        self.end = np.array([end_id], np.uint32).tobytes()
        size = self.whole.get_vocab_size()
        self.split = sum(str(self.whole.id_to_token(i)).endswith("</w>") for i in range(size)) > 1
        self.known: dict[str, bytes] = {}
        self.merge = self._merger() if self.split else None

    def _merger(self):
        """Byte-pair merges of one word. The end mark becomes a byte that no UTF-8 text holds, so that a
        plain byte-level encoder with the file's ids as ranks gives the file's ids for a word."""
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = set(self.whole.get_added_tokens_decoder())
        ranks = {}
        for token, i in self.whole.get_vocab().items():
            if i not in special:
                closed = token.endswith("</w>") and token != "</w>"
                ranks[bytes(byte[c] for c in (token[:-4] if closed else token)) + b"\xff" * closed] = i
        return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _learn(self, words: list[str]) -> None:
        merge = self.merge
        for word in words:
            self.known[word] = np.array(merge(word.encode() + b"\xff"), np.uint32).tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text and the end id."""
        if not self.split or "<|" in text or not PLAIN.fullmatch(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32).tobytes() + self.end
        words = PIECE.findall(text.lower())
        try:
            return b"".join(map(self.known.__getitem__, words)) + self.end
        except KeyError:
            distinct = set(words)
            if len(self.known) + len(distinct) > CACHE_WORDS:
                self.known.clear()
            self._learn([w for w in distinct if w not in self.known])
            return b"".join(map(self.known.__getitem__, words)) + self.end


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(name: str, end_id: int) -> Encoder:
    if (name, end_id) not in _encoders:
        _encoders[name, end_id] = Encoder(name, end_id)
    return _encoders[name, end_id]


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of unsigned cell coordinates, by Skilling's transpose of Gray codes."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            turn = (x[i] & q) != 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turn, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def document_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of the projected, hashed unit vectors of documents."""
    out = np.zeros(len(ids), np.int64)
    for at in range(0, len(ids), 512):
        part = ids[at : at + 512]
        v = np.array([np.bincount((x * np.uint32(2654435761)) >> np.uint32(22), minlength=BUCKETS) for x in part], float)
        point = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ PROJECTION
        cells = np.clip(((np.tanh(point) + 1) * (1 << (BITS - 1))).astype(np.int64), 0, (1 << BITS) - 1)
        out[at : at + 512] = hilbert_keys(cells, BITS)
    return out


def pack(
    docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, max_tokens: int = 4096, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of the packed sequences.

    ids are little-endian unsigned 32-bit ids. Each row is a document of its own, so repeated rows and
    rows with a null id are packed each; a null or empty text has the end id alone. Equal keys are
    ordered by the row's place in the table. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = encoder(tokenizer, end_id)
        wide = encode_text.whole.get_vocab_size() > 65536
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [np.frombuffer(encode_text(x or ""), np.uint32) for x in part.column(2).to_pylist()]
                stored = [x.tobytes() if wide else x.astype(np.uint16).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array(document_keys(ids), pa.int64()),
                        pa.array(stored, pa.binary()),
                        pa.array([wide] * len(ids), pa.bool_()),
                    ],
                    ["row", "doc_id", "n", "key", "stored", "wide"],
                )

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    encoded = Staged(numbered.mapInArrow(encode, f"row long, doc_id {kind}, n long, key long, stored binary, wide boolean"), "encoded")

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            place = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(n), pa.int32()), pa.array(place, pa.int64()), batch.column(1)], ["row", "part", "place", "n"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = encoded.df.select("row", "n", "key").repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row")
    placed = Staged(order.select("row", "n").mapInArrow(running, "row long, part int, place long, n long"), "placed")
    # one row for each partition of the range sort
    totals = sorted(tuple(x) for x in placed.df.groupBy("part").agg(F.max(F.col("place") + F.col("n"))).collect())
    before, bases = 0, []
    for part, size in totals:
        bases.append((part, before))
        before += size
    base = spark.createDataFrame(bases, "part int, base long")
    at = placed.df.join(F.broadcast(base), "part").select("row", (F.col("base") + F.col("place")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows: list[tuple] = []
                for i, (n, stored, is_wide, where) in enumerate(zip(*(part.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True)):
                    ids = np.frombuffer(stored, np.uint32 if is_wide else np.uint16).astype(np.uint32)
                    start = 0
                    while start < n:
                        length = min(n - start, max_tokens - (where + start) % max_tokens)
                        rows.append((i, start, length, ids[start : start + length].tobytes(), n, (where + start) // max_tokens, (where + start) % max_tokens))
                        start += length
                took = list(zip(*rows, strict=True))
                columns = [part.column(0).take(pa.array(took[0]))] + [pa.array(c, pa.binary() if k == 2 else pa.int64()) for k, c in enumerate(took[1:])]
                yield pa.RecordBatch.from_arrays(columns, names)

    return (
        encoded.df.join(at, "row")
        .select("doc_id", "n", "stored", "wide", "at")
        .mapInArrow(cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    )


def piece_digests(docs: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of the ids."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
