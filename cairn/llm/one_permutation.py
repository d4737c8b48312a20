"""Document fingerprints: one-permutation MinHash of word shingles in DataFrame functions alone.

Each shingle of a text is hashed once; the upper bits of the hash name a bin, and the least hash of each bin is kept. An
empty bin takes the value of the first bin, in an order of its own, that is not empty (optimal densification), so two texts fill it
from the same bin as often as they should. Only the BITS low bits of each value are stored, as hexadecimal digits, and the
likeness of two fingerprints is corrected for the bits that agree by chance.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.spans import free_names, let
from cairn.operators.shared import staged

WIDTH = 5
BIN_BITS, BITS = 7, 8
BINS, DIGITS, LOW = 1 << BIN_BITS, BITS // 4, (1 << BITS) - 1


def shingle_codes(text: Column, width: int = WIDTH) -> Column:
    """64-bit hashes of the runs of width words (lower-cased, between ASCII white space); of all words if there are fewer; none without words."""

    def of(words: Column) -> Column:
        ends = F.slice(words, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(0)))
        many = F.transform(ends, lambda word, i: F.xxhash64(word, *[F.get(words, i + k) for k in range(1, width)]))
        return F.when(F.size(words) >= width, many).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return let(F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), ""), of)


def bin_of(code: Column) -> Column:
    return F.shiftrightunsigned(code, 64 - BIN_BITS)


def least_of_bins(codes: Column) -> Column:
    """The least code of each bin that has any, in order of the codes: bins are stretches of that order."""
    first = lambda order: F.filter(order, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(order, i - 1))))
    return let(F.sort_array(codes), first)


@functools.cache
def orders() -> list[str]:
    """For each bin, the numbers of all bins in an order of its own, from a hash of both numbers."""
    key = lambda i: lambda j: hashlib.sha256(f"{i}:{j}".encode()).digest()
    return [",".join(map(str, sorted(range(BINS), key=key(i)))) for i in range(BINS)]


def densified(least: Column) -> Column:
    """BINS values of BITS bits: those of the least codes, and for each empty bin that of the first bin of its own order that is not empty."""
    # constant, so that Catalyst folds it once
    order = F.array(*[F.split(F.lit(x), ",").cast("array<int>") for x in orders()])
    every = F.sequence(F.lit(0), F.lit(BINS - 1))
    number = lambda x: bin_of(x).cast("int")
    full = lambda slot: slot.bitwiseAND(1 << BITS) == 0

    def filled(held: Column) -> Column:
        # bin number, a bit that marks an empty bin, value: one slot for each bin, in order of their numbers
        slot = F.transform(held, lambda x: F.shiftleft(number(x), BITS + 1).bitwiseOR(x.bitwiseAND(LOW).cast("int")))
        empty = F.transform(F.array_except(every, F.transform(held, number)), lambda i: F.shiftleft(i, BITS + 1).bitwiseOR(1 << BITS))

        def of(slots: Column) -> Column:
            def first(own: Column) -> Column:
                # most empty bins end within a few steps
                hit = lambda a, b: F.get(F.filter(F.slice(own, a + 1, b - a), lambda j: full(F.get(slots, j))), F.lit(0))
                return F.get(slots, F.coalesce(hit(0, 8), hit(8, 32), hit(32, BINS)))

            value = lambda x: F.when(full(x), x).otherwise(first(F.get(order, F.shiftright(x, BITS + 1))))
            return F.transform(slots, lambda x: value(x).bitwiseAND(LOW))

        return F.when(F.size(held) > 0, let(F.sort_array(F.concat(slot, empty)), of)).otherwise(F.expr("cast(array() as array<int>)"))

    return let(least, filled)


def fingerprint(text: Column, width: int = WIDTH) -> Column:
    """DIGITS hexadecimal digits for each of BINS bins; an empty string for a text without words. text must not be null."""
    shown = F.array(*[F.lit(f"{x:0{DIGITS}x}") for x in range(LOW + 1)])
    digits = lambda x: F.get(shown, x)
    return F.array_join(F.transform(densified(least_of_bins(shingle_codes(text, width))), digits), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimate of the Jaccard similarity of two texts' shingles from their fingerprints, 0 to 1.

    Bins of unlike texts agree by chance at a rate of 2^-BITS, which is taken out. Two fingerprints of texts without words are
    alike (1), one of them is unlike any other (0).
    """
    at = lambda x, i: F.substr(x, i, F.lit(DIGITS))
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS * DIGITS), F.lit(DIGITS)), lambda i: at(a, i) == at(b, i))) / F.lit(float(BINS))
    chance = 2.0**-BITS
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", width: int = WIDTH) -> DataFrame:
    """docs with the fingerprint of each text, by a map. A null text counts as empty; repeated rows have one each; a column of docs
    called name, in any case, is replaced; an empty table gives no rows. Arrays of a text's words and hashes are held by its task."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    return docs.select(*kept, fingerprint(F.coalesce(F.col(text), F.lit("")), width).alias(name))


def next_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, fingerprint, next_text, next_fingerprint): each document beside the next one in descending order of key, the first after the last.

    Nulls count as empty texts and come last as keys. Rows of one key are ordered by a hash of their texts, and equal rows
    follow each other, so that all but the last of them have their own text as the next one. A single row is its own next
    one. Texts are sorted by range into many tasks and written once; then each part of that order looks
    one row ahead, and the first row of a part is also sent to the part before it.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), body.alias("body")).withColumns({"code": F.xxhash64("body"), "tie": F.monotonically_increasing_id()})
    order = [F.desc_nulls_last("key"), F.asc("code"), F.asc("tie")]
    # a number of its own, as the work of a part is in its hashing and not in its bytes
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    part, at = F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("at")
    done = staged(placed.select("key", "body", fingerprint(F.col("body")).alias("print"), part, at), "in_order")
    heads = done.where("at = 0")
    before = F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy()))
    # one row for each part: as many as the sort has partitions
    parts = F.broadcast(heads.select("part", before.alias("to")))
    ahead = heads.join(parts, "part").select("key", "body", "print", F.col("to").alias("part"), F.lit(1 << 40).alias("at"))
    w = Window.partitionBy("part").orderBy("at")
    both = done.unionByName(ahead).withColumns({"next_text": F.lead("body").over(w), "next_fingerprint": F.lead("print").over(w)})
    return both.where(F.col("at") < 1 << 40).select(F.col("key").alias(key), F.col("body").alias(text), F.col("print").alias("fingerprint"), "next_text", "next_fingerprint")


def edited(text: Column, other: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of other."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(other, F.lit(1), half))


def near_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """next_texts() with n_chars, the edited text, its fingerprint, and the likeness of the fingerprint to that and to the next one."""
    pairs = next_texts(docs, key, text)
    changed, = free_names(pairs, "edited_text")
    pairs = pairs.withColumn(changed, edited(F.col(text), F.col("next_text")))
    prints = pairs.select("*", F.length(text).cast("long").alias("n_chars"), fingerprint(F.col(changed)).alias("edited_fingerprint"))
    return prints.withColumns({
        "near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("next_fingerprint")),
    })
