"""Lexical fingerprints of source code: tokens by regular expressions, without comments, and with folded identifiers.

A source is cut in one pass of one pattern for its language: comments, literals, words, numbers, and any other sign by
itself. Two sources that differ in white space and comments have the same literal digest; two that differ in the names of
identifiers too have the same normalised digest. Neither says that they do the same.
"""

from __future__ import annotations

import keyword
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.text import let

WORD = r"[\p{L}_$][\p{L}\p{N}_$]*"
NUMBER = r"[0-9][\p{L}\p{N}_.]*"
OTHER = r"[^\s]"
# A quoted literal in one line, with escapes; the possessive repeat keeps no state for each character.
DOUBLE, SINGLE = r'"(?:[^"\\\n]|\\.)*+"', r"'(?:[^'\\\n]|\\.)*+'"
SLASHES = r"//[^\n]*|/\*[\s\S]*?\*/"
FOLDED = "<IDENTIFIER>"


@dataclass(frozen=True)
class Grammar:
    comment: str
    literal: str
    keywords: tuple[str, ...]

    @property
    def token(self) -> str:
        """Comments, and all else as the first group."""
        return self.comment + "|(" + "|".join([self.literal, WORD, NUMBER, OTHER]) + ")"


# The reserved words of the languages' specifications, those with a meaning only in places left out.
JAVA = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package "
    "private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
)
TYPESCRIPT = (
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with "
    "implements interface let package private protected public static yield async await"
)
CSHARP = (
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface "
    "internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint "
    "ulong unchecked unsafe ushort using virtual void volatile while"
)
KOTLIN = "as break class continue do else false for fun if in interface is null object package return super this throw true try typealias typeof val var when while"

TRIPLE = r'"""[\s\S]*?"""'
PYTHON = Grammar(r"#[^\n]*", "(?:[rRbBuUfF]{1,2}(?=[\"']))?(?:" + TRIPLE + r"|'''[\s\S]*?'''|" + DOUBLE + "|" + SINGLE + ")", tuple(keyword.kwlist))
_TS = Grammar(SLASHES, DOUBLE + "|" + SINGLE + r"|`(?:[^`\\]|\\[\s\S])*+`", tuple(TYPESCRIPT.split()))
GRAMMARS = {
    "py": PYTHON,
    "ts": _TS,
    "tsx": _TS,
    "mts": _TS,
    "java": Grammar(SLASHES, TRIPLE + "|" + DOUBLE + "|" + SINGLE, tuple(JAVA.split())),
    "cs": Grammar(SLASHES, r'[$]?@[$]?"(?:[^"]|"")*+"|[$]?' + DOUBLE + "|" + SINGLE, tuple(CSHARP.split())),
    "kt": Grammar(SLASHES, TRIPLE + "|" + DOUBLE + "|" + SINGLE, tuple(KOTLIN.split())),
}


def lexemes(source: Column, grammar: Grammar) -> Column:
    """The tokens of a source in order, without comments and white space."""
    return F.filter(F.regexp_extract_all(source, F.lit(grammar.token), F.lit(1)), lambda x: x != "")


def folded(tokens: Column, grammar: Grammar) -> Column:
    """Tokens with FOLDED in the place of every word that is no keyword."""
    return F.transform(tokens, lambda x: F.when(x.rlike(f"^{WORD}$") & ~x.isin(*grammar.keywords), FOLDED).otherwise(x))


def token_digest(tokens: Column) -> Column:
    return F.sha2(F.to_json(tokens), 256)


def quoted(tokens: Column) -> Column:
    """Every token as a JSON string."""
    inner = lambda x: let(F.to_json(F.array(x)), lambda j: j.substr(F.lit(2), F.length(j) - 2))
    return F.transform(tokens, lambda x: F.when(x == FOLDED, f'"{FOLDED}"').otherwise(inner(x)))


def runs_of_five(each: Column) -> Column:
    """The distinct runs of five strings, joined by commas: twos, fours of them and fives. Five strings at least."""
    n = F.size(each)
    joined = lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, F.lit(","), y))
    five = lambda two: joined(joined(F.slice(two, 1, n - 4), F.slice(two, 3, n - 4)), F.slice(each, 5, n - 4))
    return F.array_distinct(let(joined(F.slice(each, 1, n - 1), F.slice(each, 2, n - 1)), five))


def fingerprint(source: Column, language: Column, most: int = 100_000) -> Column:
    """struct(status, tokens, literal_token_sha256, identifier_normalized_sha256, shingles) of a source.

    language is a file suffix of GRAMMARS; another one has the status unknown_language, and a source of more than most tokens
    token_budget_exceeded, with nulls in the rest. shingles are the distinct runs of five folded tokens, each by 16
    digits of a digest; fewer tokens have none. A null source counts as empty.
    """

    def one(grammar: Grammar) -> Column:
        def of(tokens: Column) -> Column:
            return let(folded(tokens, grammar), lambda shape: let(quoted(shape), lambda each: told(tokens, shape, each)))

        return let(lexemes(F.coalesce(source, F.lit("")), grammar), of)

    def told(tokens: Column, shape: Column, each: Column) -> Column:
        # runs as JSON are told apart before they are digested: most sources repeat few runs
        digest = lambda inner: F.sha2(F.concat(F.lit("["), inner, F.lit("]")), 256)
        fits = F.size(tokens) <= most
        shingles = F.when(F.size(shape) >= 5, F.sort_array(F.array_distinct(F.transform(runs_of_five(each), lambda x: F.substring(digest(x), 1, 16))))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.struct(
            F.when(fits, "ok").otherwise("token_budget_exceeded").alias("status"), F.when(fits, F.size(tokens)).alias("tokens"), F.when(fits, token_digest(tokens)).alias("literal_token_sha256"),
            F.when(fits, digest(F.array_join(each, ","))).alias("identifier_normalized_sha256"), F.when(fits, shingles).alias("shingles"),
        )

    kind = "struct<status:string,tokens:int,literal_token_sha256:string,identifier_normalized_sha256:string,shingles:array<string>>"
    out = F.struct(F.lit("unknown_language").alias("status"), F.lit(None).cast("int").alias("tokens"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("array<string>").alias("c")).cast(kind)
    for name, grammar in GRAMMARS.items():
        out = F.when(language == name, one(grammar).cast(kind)).otherwise(out)
    return out
