"""Content identities: digests that other tools can recompute."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import let


def text_digest(*parts: Column) -> Column:
    """sha256 of the parts with NUL between them."""
    return F.sha2(F.concat_ws("\x00", *[p.cast("string") for p in parts]), 256)


def git_blob(content: Column) -> Column:
    """The sha1 that git gives a file of these bytes."""
    raw = content.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.length(raw).cast("string")).cast("binary"), F.unhex(F.lit("00")), raw))


def list_digest(values: Column) -> Column:
    """sha256 of the sorted values as JSON."""
    return F.sha2(F.to_json(F.array_sort(values)), 256)


# First digits of a digest by which it is gathered, level by level: 65,536 buckets, then 256, then one.
LEVELS = (4, 2, 0)


def digest_tree(each: DataFrame, by: list[str], name: str, count: str | None = None) -> DataFrame:
    """(by, name): one digest of all digests (column __d) of a group, repeated ones included, whatever their order and partitioning.

    Digests are gathered in buckets by their first digits and each bucket's sorted digests hashed; the buckets' digests are
    gathered in the same way, by fewer digits, so a group of 10^9 is spread over buckets of some ten thousand. It is not the digest of
    one list of all digests, which would need one task for each group. count names the number of digests.
    """
    level = each.select(*by, F.col("__d").alias("__at"), "__d", F.lit(1).cast("long").alias("__n"))
    for digits in LEVELS:
        prefix = F.substring("__at", 1, digits) if digits else F.lit("")
        gathered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__d"))), lambda x: x["__d"]), "")
        level = level.groupBy(*by, prefix.alias("__b")).agg(F.sha2(gathered, 256).alias("__d"), F.sum("__n").alias("__n")).withColumnRenamed("__b", "__at")
    return level.select(*by, *([F.col("__n").alias(count)] if count else []), F.col("__d").alias(name))


def set_digest(df: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """(by, name): one digest of all values of a group, repeated ones included, as digest_tree() gathers them."""
    return digest_tree(df.select(*by, F.sha2(value, 256).alias("__d")), by, name)


def canonical_digest(ascii_only: bool = False):
    """A pandas UDF: sha256 of a JSON text written with sorted keys and without blanks, whatever its numbers. canonical_json() needs no Python."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if x is None:
                return None
            return hashlib.sha256(json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only).encode()).hexdigest()

        return texts.map(one)

    return digest


# A JSON string, and what only a number that is no integer has outside of strings.
STRING = r'"(?:[^"\\]|\\.)*+"'
FRACTION = r"[0-9][.eE]"
# Control characters that are written by number with a letter in it.
LETTERED = ["000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F"]


# What lies outside of strings up to and with the next colon or comma, from the end of the one before on.
SEPARATED = r'\G((?:[^":,]|' + STRING + r")*+[:,])"
# A character that is not printable ASCII.
BEYOND = r"[^ -~]"


def _escaped(text: Column) -> Column:
    """A text with every character that is not printable ASCII as \\u and four digits, two of them beyond the first plane."""
    four = lambda x: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(x)), 4, "0"))

    def of(c: Column) -> Column:
        code = F.ascii(c)
        pair = F.concat(four(F.shiftright(code - 65536, 10) + 0xD800), four((code - 65536).bitwiseAND(0x3FF) + 0xDC00))
        return F.when(code < 65536, four(code)).otherwise(pair)

    odd = F.transform(F.regexp_extract_all(text, F.lit(BEYOND), F.lit(0)), of)
    parts = F.zip_with(F.split(text, BEYOND, -1), odd, lambda plain, code: F.concat(plain, F.coalesce(code, F.lit(""))))
    return F.when(text.rlike(BEYOND), F.array_join(parts, "")).otherwise(text)


def json_form(canonical: Column, ascii_only: bool = False, spaced: bool = False) -> Column:
    """Another form of what canonical_json() gives, for queries that need several of one text."""
    out = F.regexp_replace(canonical, SEPARATED, "$1 ") if spaced else canonical
    return let(out, _escaped) if ascii_only else out


def canonical_json(text: Column, ascii_only: bool = False, spaced: bool = False) -> Column:
    """A JSON text with the keys of all objects in order, in one of the usual forms: without blanks or with one behind each
    comma and colon, and with characters as they are or in ASCII.

    The text becomes a VARIANT, whose objects hold their keys in order, and is written from it. Null for what is no JSON, for an
    object that repeats a key, and for a number that is no integer, as writers differ in these; canonical_digest() takes them.
    Keys are ordered by UTF-16 units, which is the order of code points in the first plane.
    """
    whole = lambda x: ~x.rlike(FRACTION) | ~F.regexp_replace(x, STRING, "").rlike(FRACTION)

    def lettered(out: Column) -> Column:
        low = out
        for code in LETTERED:
            low = F.regexp_replace(low, r"(?<!\\)((?:\\\\)*)\\u" + code, "$1\\\\u" + code.lower())
        return F.when(F.contains(out, F.lit("\\u00")), low).otherwise(out)

    written = let(text, lambda x: F.when(whole(x), F.to_json(F.try_parse_json(x))))
    return json_form(let(written, lettered), ascii_only, spaced)


def span_digest(text: Column, start: Column, end: Column) -> Column:
    """sha256 of lines start to end, from 1, both included, joined by line feeds."""
    return F.sha2(F.array_join(F.slice(F.split(text, "\r\n|\n|\r"), start.cast("int"), (end - start + 1).cast("int")), "\n"), 256)
