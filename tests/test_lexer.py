"""Lexical fingerprints: comments and layout, renamed identifiers, literals, budgets and long sources."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cairn.functions import lexer

SOURCES = {
    "py": ("def add(a, b):\n    # sum\n    return a + b  # end\n", "def plus( first,second ):\n  return first+second", "def add(a, b):\n    return a - b\n", ["def", "add", "(", "a", ",", "b", ")", ":", "return", "a", "+", "b"]),
    "ts": ("const x = `a ${b} // no`; // yes\nlet y = f('#');", "const q=`a ${b} // no`;/* gone\n*/let z=g('#');", "const x = `a ${c} // no`; let y = f('#');", ["const", "x", "=", "`a ${b} // no`", ";", "let", "y", "=", "f", "(", "'#'", ")", ";"]),
    "java": ('class A { /* x */ String s = "/* \\" no */"; }', 'class Bé{String t="/* \\" no */";}', 'class A { String s = ""; }', ["class", "A", "{", "String", "s", "=", '"/* \\" no */"', ";", "}"]),
    "cs": ('var p = @"c:\\x""y"; // z', 'var path=@"c:\\x""y";', 'var p = @"c:\\x"; ', ["var", "p", "=", '@"c:\\x""y"', ";"]),
    "kt": ('val s = """a\n// b""" // c', 'val text="""a\n// b"""', 'var s = """a\n// b"""', ["val", "s", "=", '"""a\n// b"""']),
}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_renamed_copies_share_the_second_digest(spark, language):
    one, renamed, other, tokens = SOURCES[language]
    rows = spark.createDataFrame(list(enumerate([one, renamed, other, None])), "i int, source string").select("i", lexer.fingerprint(F.col("source"), F.lit(language)).alias("x"), lexer.lexemes(F.col("source"), lexer.GRAMMARS[language]).alias("t"))
    a, b, c, none = (r for r in rows.orderBy("i").collect())
    assert a.t == tokens
    assert a.x.literal_token_sha256 == hashlib.sha256(json.dumps(tokens, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() != b.x.literal_token_sha256
    assert a.x.identifier_normalized_sha256 == b.x.identifier_normalized_sha256 and a.x.shingles == b.x.shingles
    assert c.x.identifier_normalized_sha256 != a.x.identifier_normalized_sha256
    shape = [lexer.FOLDED if t.isidentifier() and t not in lexer.GRAMMARS[language].keywords else t for t in tokens]
    runs = {hashlib.sha256(json.dumps(shape[i : i + 5], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:16] for i in range(len(shape) - 4)}
    assert set(a.x.shingles) == runs and none.x.status == "ok" and none.x.tokens == 0 and none.x.shingles == []


def test_budgets_and_long_literals(spark):
    long = 'x = "' + "a\\n" * 200_000 + '" + ' + "'" + "b" * 300_000 + "'  # end"
    rows = [("py", long), ("py", "a " * 50), ("go", "package main"), (None, "x"), ("py", "'''" + "q\n" * 100_000 + "'''"), ("ts", "/*" + "*" * 300_000 + "*/ x")]
    x = lexer.fingerprint(F.col("s"), F.col("l"), most=40)
    got = [r.x for r in spark.createDataFrame(rows, "l string, s string").select(x.alias("x")).collect()]
    assert [(r.status, r.tokens) for r in got] == [("ok", 5), ("token_budget_exceeded", None), ("unknown_language", None), ("unknown_language", None), ("ok", 1), ("ok", 1)]
    assert got[1].literal_token_sha256 is None and got[1].shingles is None


def test_runs_are_told_apart_before_they_are_digested(spark):
    """Runs over tokens with the signs of JSON in them, and no more digests than distinct runs."""
    source = r"""a = '\"]' + "],[" , '\\' # x""" + "\n"
    source = source * 40 + "b " * 100
    x = lexer.fingerprint(F.col("s"), F.lit("py"))
    row = spark.createDataFrame([(source,)], "s string").select(x.alias("x"), lexer.lexemes(F.col("s"), lexer.PYTHON).alias("t"))
    r = row.first()
    shape = [lexer.FOLDED if t in ("a", "b") else t for t in r.t]
    as_json = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    runs = {as_json(shape[i : i + 5]) for i in range(len(shape) - 4)}
    assert r.x.tokens == len(r.t) == 40 * 7 + 100 and r.x.shingles == sorted({hashlib.sha256(run.encode()).hexdigest()[:16] for run in runs})
    each = spark.createDataFrame([(shape,)], "t array<string>").select(lexer.runs_of_five(lexer.quoted(F.col("t"))).alias("runs")).first()
    assert sorted(f"[{run}]" for run in each.runs) == sorted(runs)
