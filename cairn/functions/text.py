"""Text expressions: masks, marks, context and word runs."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Masks of secrets in their order. A named value stands behind a name that ends in one of these words and a colon or
# equals sign, up to white space, a quotation mark, bracket, comma or semicolon; a bearer token is that of RFC 6750,
# section 2.1; a long run has 32 or more signs of the alphabets of RFC 4648 with their padding. None looks around
# itself, so every engine finds the same.
SECRET_WORDS = ["token", "secret", "password", "passwd", "passphrase", "credential", "credentials", "api_key", "api-key", "apikey", "access_key", "access-key", "private_key", "private-key"]
NAMED = r"(?i)([a-z0-9_.-]*(?:" + "|".join(SECRET_WORDS) + r"))(\s*[:=]\s*[\"']?)([^\s\"'()\[\]{},;]+)"
BEARER = r"(?i)(bearer +)([a-z0-9._~+/-]+=*)"
LONG = r"[A-Za-z0-9+/_-]{32,}={0,2}"


# NAMED without the signs before the word: they are never part of what is masked, the word must end where they end, and to
# seek them at each sign of a text takes the square of a run's length.
NAMED_WORD = NAMED.replace("([a-z0-9_.-]*(?:", "((?:", 1)


def holds_any(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of words, letters in either case: what a pattern with a word in it costs is spent on these texts only."""
    shortest = [w for w in words if not any(v != w and v in w for v in words)]
    if not all(re.fullmatch(r"[a-z0-9_ -]+", w) for w in shortest):
        return text.rlike("(?i)" + "|".join(words))
    return let(F.lower(text), lambda low: reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in shortest]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _replaced(text: Column, words: list[str], pattern: str, by: str) -> Column:
    return F.when(holds_any(text, words), F.regexp_replace(text, pattern, by)).otherwise(text)


def _named(text: Column) -> Column:
    return _replaced(text, SECRET_WORDS, NAMED_WORD, "$1$2[MASKED]")


def _bearer(text: Column) -> Column:
    return _replaced(text, ["bearer "], BEARER, "$1[MASKED]")


def mask_secrets(text: Column) -> Column:
    return F.regexp_replace(_bearer(_named(text)), LONG, "[MASKED]")


def mask_counts(text: Column) -> Column:
    """struct of the number of masks of each sort, as the masks are put one after the other."""

    def n(x: Column, p: str, words: list[str] | None = None) -> Column:
        found = F.regexp_count(x, F.lit(p)).cast("long")
        return found if words is None else F.when(holds_any(x, words), found).when(x.isNotNull(), F.lit(0).cast("long"))

    counts = lambda t, named: F.struct(n(t, NAMED_WORD, SECRET_WORDS).alias("named"), n(named, BEARER, ["bearer "]).alias("bearer"), n(_bearer(named), LONG).alias("long"))
    return let(text, lambda t: let(_named(t), lambda named: counts(t, named)))


def redact_structured(text: Column, words: list[str] = SECRET_WORDS) -> Column:
    """A JSON, YAML, properties or plain text in which the scalar value of every key that holds one of words, PEM blocks and secrets are masked.

    A key is a quoted or bare name before a colon or equals sign. A quoted value is masked between its
    quotation marks, with escapes, a bare one to the end of its line, a comma or a closing bracket; true, false, null
    and nested values stay. A masked PEM block takes its lines with it. The encoding is that of the column, UTF-8.
    """
    # a bare key is matched from its first such word on, as its signs before that stay (see NAMED_WORD)
    key = r"(?i)(\"[^\"\n]*(?:" + "|".join(words) + r")[^\"\n]*\"|(?:" + "|".join(words) + r")[a-z0-9_.-]*)"

    def keyed(x: Column) -> Column:
        quoted = F.regexp_replace(x, key + r'(\s*[:=]\s*)"(?:[^"\\\n]|\\.)*"', '$1$2"[MASKED]"')
        single = F.regexp_replace(quoted, key + r"(\s*[:=]\s*)'[^'\n]*'", "$1$2'[MASKED]'")
        return F.regexp_replace(single, key + r"([ \t]*[:=][ \t]*)(?!true\b|false\b|null\b)([^\s\"'\[{,}\]][^\n,}\]]*)", "$1$2[MASKED]")

    pem = F.regexp_replace(text, r"-----BEGIN [A-Z0-9 ]+-----[^-]*(?:-[^-]+)*-----END [A-Z0-9 ]+-----", "[MASKED]")
    blocks = F.when(F.contains(text, F.lit("-----BEGIN ")), pem).otherwise(text)
    return let(blocks, lambda x: let(F.when(holds_any(x, words), keyed(x)).otherwise(x), _bearer))


def strip(text: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    return F.split(text, "\r\n|\n|\r")


def context(all_lines: Column, at: Column, width: int) -> Column:
    """The non-empty stripped lines from width before to width after line number at, from 1."""
    first = F.greatest(F.lit(1), at - width)
    return F.filter(F.transform(F.slice(all_lines, first, at + width - first + 1), strip), lambda x: x != "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def word_runs(words: Column, width: int) -> Column:
    """Distinct runs of width words, joined by blanks; none for fewer words."""
    n = F.size(words) - width + 1
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(words, i, F.lit(width)), " "))
    return F.when(n >= 1, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def coordinate(value: Column) -> Column:
    """"path:line" as struct(path, line), or null."""
    good = value.rlike(r"^.+:[0-9]+$")
    return F.when(good, F.struct(F.regexp_extract(value, r"^(.+):(\d+)$", 1).alias("path"), F.regexp_extract(value, r"^(.+):(\d+)$", 2).try_cast("long").alias("line")))


def in_module(module: Column, root: str) -> Column:
    return (module == root) | module.startswith(root + ".")
