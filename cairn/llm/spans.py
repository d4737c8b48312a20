"""Column expressions for the places of regular-expression matches, in code points, end exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,end:bigint,rank:int,kind:string>"
# Matches that are gathered in one array before it is added to the others.
STEP = 128
# Code points of the pieces in which a text is masked.
PIECE = 4096


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each with as many signs after it as it takes to differ from those of docs in any case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, state: Column, out_type: str, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """What step gives for each item in turn, from (state, item) to (next state, whether something is given, what).

    Items are taken STEP at a time: an array of n is copied n / STEP times, and not n times. items has one element or more.
    """
    none = lambda kind: F.expr(f"cast(array() as {kind})")
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / STEP).cast("int")), lambda k: F.slice(items, k * STEP + 1, STEP))

    def inner(acc: Column, x: Column) -> Column:
        after, given, what = step(acc["state"], x)
        return F.struct(after.alias("state"), F.when(given, F.concat(acc["out"], F.array(what.cast(out_type)))).otherwise(acc["out"]).alias("out"))

    def outer(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["state"].alias("state"), none(f"array<{out_type}>").alias("out")), inner)
        return let(done, lambda v: F.struct(v["state"].alias("state"), F.concat(acc["out"], F.array(v["out"])).alias("out")))

    start = F.struct(state.alias("state"), none(f"array<array<{out_type}>>").alias("out"))
    return F.flatten(F.aggregate(slices, start, outer)["out"])


def _steps(text: Column, pattern: str, keep_group: int) -> Column:
    """The text before each match, the match, and the group that is judged; last, the text behind all, with nulls."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(keep_group)) if keep_group else found
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), judged.alias("part"))


def match_spans(text: Column, pattern: str, kind: str, rank: int, keep_group: int = 0, at_least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches whose group keep_group has at_least code points or more.

    The text between matches and the matches alternate, so that a running sum of both lengths gives the
    places. Matches that fail the length are dropped after matching, without a retry.
    """
    one = lambda begin, end, x: F.struct(begin.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))
    return _matches(text, pattern, SPAN, one, keep_group, at_least)


def match_texts(text: Column, pattern: str) -> Column:
    """start, end and the text itself (hit) of each match."""
    one = lambda begin, end, x: F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit"))
    return _matches(text, pattern, "struct<start:bigint,end:bigint,hit:string>", one)


def _matches(text: Column, pattern: str, kind: str, one: Callable, keep_group: int = 0, at_least: int = 0) -> Column:
    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        begin = at + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        return end, x["hit"].isNotNull() & (F.length(x["part"]) >= at_least), one(begin, end, x)

    found = let(_steps(text, pattern, keep_group), lambda steps: running(steps, F.lit(0).cast("long"), kind, step))
    return F.when(text.rlike(pattern), found).otherwise(F.expr(f"cast(array() as array<{kind}>)"))


def blanked(text: Column, pattern: str, keep_group: int = 0, at_least: int = 0) -> Column:
    """text with every code point of such a match replaced by \\x01, so that what lies beside keeps its place."""

    def one(x: Column) -> Column:
        hit = F.coalesce(x["hit"], F.lit(""))
        return F.concat(x["gap"], F.when(F.length(x["part"]) >= at_least, F.repeat(F.lit("\x01"), F.length(hit))).otherwise(hit))

    return F.when(text.rlike(pattern), F.array_join(F.transform(_steps(text, pattern, keep_group), one), "")).otherwise(text)


def joined(spans: Column) -> Column:
    """kind:start:end of each span by start, then kind as listed, joined by commas."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(order, one), ",")


def masked(text: Column, spans: Column, mark: str) -> Column:
    """text with each maximal run of overlapping or touching spans replaced by mark.

    The text is cut once into pieces of PIECE code points and what stands between spans is taken from its piece, so
    work grows with the length and the number of spans, and not with their product.
    """
    one = lambda start, end, run: F.struct(start.alias("start"), run.alias("run"), end.alias("end"))
    border = lambda at: one(at, at, F.lit(False))
    starts = F.transform(spans, lambda x: one(x["start"], x["end"], F.lit(True)))
    size = F.length(text).cast("long")
    # the borders of the pieces and the end of the text, before a span that begins there
    borders = F.concat(F.transform(F.sequence(F.lit(0).cast("long"), F.floor(size / PIECE)), lambda k: border(k * PIECE)), F.array(border(size)))

    def over(pieces: Column) -> Column:
        def step(state: Column, x: Column) -> tuple[Column, Column, Column]:
            done = state["done"]
            opens = x["run"] & ((x["start"] > done) | ~state["run"])
            gap = F.substr(F.get(pieces, F.floor(done / PIECE).cast("int")), (done % PIECE + 1).cast("int"), (x["start"] - done).cast("int"))
            kept = F.when(x["start"] > done, gap).otherwise("")
            after = F.struct(F.greatest(done, x["end"]).alias("done"), (x["run"] | (state["run"] & (x["start"] <= done))).alias("run"))
            return after, opens | (x["start"] > done), F.concat(kept, F.when(opens, F.lit(mark)).otherwise(""))

        state = F.struct(F.lit(0).cast("long").alias("done"), F.lit(False).alias("run"))
        return F.array_join(running(F.array_sort(F.concat(starts, borders)), state, "string", step), "")

    return F.when(F.size(spans) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), over)).otherwise(text)
