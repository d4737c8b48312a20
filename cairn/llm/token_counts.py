"""Token counts: batch encoding inside Arrow functions that return lengths only.

A map over the documents, without a shuffle. Texts are cut into parts of at most MAX_PART characters
at safe boundaries, parts are packed into batches of about BATCH_BYTES bytes, and each batch is
encoded at once, so neither one long text nor many short ones make a batch large.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 1 << 20
MAX_PART = 1 << 16
# A blank between two characters that are neither blanks nor part of a "<|...|>" string: no token of a
# byte-level vocabulary crosses it, as a blank can only begin a piece.
SAFE_CUT = re.compile(r"(?<=[^\s|<>])(?= [^\s|<>])")
# Letters, digits and signs on which the two encoders' character classes agree; other texts go to the slower one.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xa7\xa9\xab\xac\xae\xaf\xb6\xb7\xbb\xbf-ſ–—‘-„…€]*")

_loaded: dict[str, Callable[[list[str]], list[int]]] = {}


def parts(text: str, limit: int = MAX_PART) -> list[str]:
    """text in parts of about limit characters cut at safe boundaries; a stretch without one stays whole."""
    out, at = [], 0
    while len(text) - at > limit:
        cut = SAFE_CUT.search(text, at + limit)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


def counter(name: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts for a file of public_tokenizers; loaded once per worker."""
    if name not in _loaded:
        _loaded[name] = _load(name)
    return _loaded[name]


def _load(name: str) -> Callable[[list[str]], list[int]]:
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in piece.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    twin = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(twin):
        return lambda texts: [len(x.ids) for x in exact.encode_batch(texts, add_special_tokens=False)]

    import tiktoken

    with open(twin, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {x.content: i for i, x in exact.get_added_tokens_decoder().items()}
    quick = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def count(texts: list[str]) -> list[int]:
        # the same vocabulary and merges: the quick encoder gives the library's counts on plain characters
        out = [len(quick.encode(x, allowed_special="all")) if PLAIN.fullmatch(x) else -1 for x in texts]
        rest = [i for i, n in enumerate(out) if n < 0]
        for i, x in zip(rest, exact.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = len(x.ids)
        return out

    return count


def count_texts(texts: list[str], tokenizer: str) -> list[int]:
    """Token counts of whole texts, encoded in batches of about BATCH_BYTES bytes."""
    count = counter(tokenizer)
    cut = tokenizer.startswith("byte_bpe")
    out = [0] * len(texts)
    batch: list[str] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal batch, owner, held
        for i, n in zip(owner, count(batch), strict=True):
            out[i] += n
        batch, owner, held = [], [], 0

    for i, text in enumerate(texts):
        for part in parts(text) if cut and len(text) > MAX_PART else [text]:
            batch.append(part)
            owner.append(i)
            held += len(part) if part.isascii() else len(part.encode())
            if held >= BATCH_BYTES:
                flush()
    if batch:
        flush()
    return out


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, text: str = "text") -> DataFrame:
    """All columns of docs but the text, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    Nulls and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; an empty table gives
    no rows. Columns of docs that are named like a new one, in any case, are replaced. A special string inside a text
    counts as the library's default has it: one token. A text is held whole by its task and encoded in parts of about
    MAX_PART characters.
    """
    new = ["n_bytes", "n_tokens", "over_limit"]
    keep = [c for c in docs.columns if c != text and c.lower() not in new]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            filled = column.fill_null("") if column.null_count else column
            size = pc.binary_length(filled).cast(pa.int64())
            n = pa.array(count_texts(filled.to_pylist(), tokenizer), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], size, n], [*keep, "n_bytes", "n_tokens"])

    out = docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
