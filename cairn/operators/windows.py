"""Ranking, sampling and interval operators on windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.shared import staged

NUL = "\x00"


def hash_rank(seed: str, *parts: str) -> Column:
    """sha256 of the seed and the parts, NUL between them: an order that every engine reproduces."""
    return F.sha2(F.concat_ws(NUL, F.lit(seed), *[F.col(p).cast("string") for p in parts]), 256)


# First rows of a key that Spark keeps in each task before the shuffle (its default threshold of window group limits).
LIMITED = 1000
# Strata, one row each, that are broadcast; more are joined.
STRATA = 100_000


def first_rows(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """df with name, from 1, for the first k rows of each key in an explicit order.

    Every task keeps the k first of its own rows of a key, and only those are shuffled, so a key with most of the rows is
    as spread as they are. For a larger k the rows are numbered in one order of keys and rows.
    """
    if k <= LIMITED:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
    return numbered_within(df, by, order, name).where(F.col(name) <= k).withColumn(name, F.col(name).cast("int")).drop("__size")


def numbered_within(df: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    """df with the number (long) of each row within its key, from 1, and __size, the key's rows: no task holds a key.

    Rows are sorted by key and order over all tasks and numbered once; a key's first number, known for all of its rows, is taken off.
    """
    rows = globally_numbered(df, [*by, *order], "__at")
    first = staged(rows.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.min("__at").alias("__first"), F.count("*").alias("__size")), "sizes")
    first = F.broadcast(first) if first.count() <= STRATA else first
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return rows.join(first, same).withColumn(name, F.col("__at") - F.col("__first") + 1).drop("__at", "__first", *[f"__{c}" for c in by])


def hash_sample(df: DataFrame, stratum: str, key: str, k: int, seed: str) -> DataFrame:
    """k rows of each stratum in hash order, with their inclusion probability min(k, n) / n; n is counted apart."""
    sizes = df.groupBy(F.col(stratum).alias("__s")).agg(F.count("*").alias("__n"))
    taken = first_rows(df, [stratum], [hash_rank(seed, stratum, key), key], k, "__r").drop("__r")
    return taken.join(sizes, F.col(stratum).eqNullSafe(F.col("__s"))).withColumn("probability", F.least(F.lit(k), "__n") / F.col("__n")).drop("__n", "__s")


def fraction_split(df: DataFrame, stratum: str, key: str, fraction: float, least: int, seed: str) -> DataFrame:
    """df with side: the first max(least, floor(n * fraction)) rows of a stratum in hash order, n - 1 at most, are development."""
    ranked = numbered_within(df.withColumn("__h", hash_rank(seed, stratum, key)), [stratum], ["__h", key], "__r")
    cut = F.least(F.greatest(F.lit(least), F.floor(F.col("__size") * fraction)), F.col("__size") - 1)
    return ranked.withColumn("side", F.when(F.col("__r") <= cut, "development").otherwise("confirmation")).drop("__h", "__r", "__size")


def cumulative_split(df: DataFrame, family: str, fraction: float, seed: str) -> DataFrame:
    """df with side: whole families, in hash order, are development until a fraction of all rows is reached.

    The running sum is over one row for each family, in a range sort.
    """
    sizes = df.groupBy(family).agg(F.count("*").alias("size"))
    placed = running_before(sizes, [hash_rank(seed, family), family], "size", "__sum_before")
    sides = placed.select(family, F.when(F.col("__sum_before") < F.col("__total") * fraction, "development").otherwise("confirmation").alias("side"))
    return df.join(sides, family)


def range_sorted(df: DataFrame, order: list) -> tuple[DataFrame, DataFrame]:
    """(df with __place, one row (__part, rows) for each partition): rows in a global order over many tasks.

    A range partitioning is sorted within its partitions and written once; __place holds the partition and
    the row's place in it, so that what was written is what later passes see.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    done = staged(placed, "ordered")
    return done.withColumn("__part", F.shiftright("__place", 33)), done.groupBy(F.shiftright("__place", 33).alias("__part")).agg(F.count("*").alias("__rows"))


def globally_numbered(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """df with the number of each row in a full order, from 1. Only one row for each partition meets in a task."""
    rows, parts = range_sorted(df, order)
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("__part", before.alias("__before"))
    number = F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(F.broadcast(offsets), "__part").withColumn(name, number).drop("__part", "__place", "__before")


def running_before(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows before each in a full order, and __total over all. Sums run within partitions, on top of those of the partitions before."""
    rows, _ = range_sorted(df, order)
    parts = rows.groupBy("__part").agg(F.sum(value).alias("__sum"))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__part", F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__before"), F.sum("__sum").over(Window.partitionBy()).alias("__total"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(name, own).join(F.broadcast(offsets), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__place", "__before")


def numbered(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order."""
    return numbered(df, keys, order, "__r").where("__r = 1").drop("__r")


def merge_ranges(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or adjacent integer ranges (start <= previous end + 1) merged, with the number of parts."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", (reach.isNull() | (F.col(start) > reach + 1)).cast("int"))
    grouped = marked.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "__g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("__g")


def runs_of_numbers(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Consecutive distinct numbers as ranges (start, end)."""
    island = F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    return df.select(*keys, number).distinct().withColumn("__g", island).groupBy(*keys, "__g").agg(F.min(number).alias("start"), F.max(number).alias("end")).drop("__g")


def outer_spans(spans: Column) -> Column:
    """Of struct(start, end) spans, those that begin at or after the last kept end; the longer of equal starts is kept."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]).cast("int"))
    none = F.slice(order, 1, 0)
    return F.aggregate(order, none, lambda kept, x: F.when((F.size(kept) == 0) | (x["start"] >= F.element_at(kept, -1)["end"]), F.concat(kept, F.array(x))).otherwise(kept))


def round_robin(df: DataFrame, stratum: str, key: str) -> DataFrame:
    """df with turn (number of the row in its stratum) and place (number in the interleaved order: turn by turn, the strata in theirs).

    Rows are numbered within their strata by a sort over all tasks, and turn by turn by another, so neither a stratum
    with most of the rows nor a large number of strata meets in a task. Rows with a null stratum come first in a turn.
    """
    turned = numbered_within(df, [stratum], [key], "turn").drop("__size")
    return globally_numbered(turned, ["turn", stratum], "place")


# Names of families that a choice which depends on all before it may hold on the driver.
MOST_NAMES = 1_000_000


def family_round_robin(df: DataFrame, stratum: str, family: str, order: list[str], target: int) -> DataFrame:
    """Rows taken in turns, one of each stratum in their order, until there are target rows: a row is passed over if its family was taken.

    A turn takes at most one row of each stratum, and what may be taken in it depends on all before, so the work is a
    loop over turns; it reads one row for each family and stratum, of each stratum no more than target families.
    Meant for targets that are small against the table, as the result is: ValueError if strata times target exceed MOST_NAMES,
    the names that the driver holds.
    """
    if df.select(stratum).distinct().count() * target > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} strata times rows")
    row = F.struct(*order, *[c for c in df.columns if c not in order])
    best = df.groupBy(stratum, family).agg(F.min(row).alias("row")).select(*[F.col(f"row.{c}").alias(c) for c in df.columns])
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    pool = best.withColumn("__r", rank).where(F.col("__r") <= target).orderBy(stratum, "__r")
    queues: dict = {}
    for r in pool.select(stratum, family, "__r").toLocalIterator():  # strata * target names at most
        queues.setdefault(r[0], []).append((r[1], r[2]))
    taken, chosen, progressed = set(), [], True
    while progressed and len(chosen) < target:
        progressed = False
        for s in sorted(queues):
            queue = queues[s]
            while queue and queue[0][0] in taken:
                queue.pop(0)
            if queue and len(chosen) < target:
                name, r = queue.pop(0)
                taken.add(name)
                chosen.append((s, r, len(chosen) + 1))
                progressed = True
    kinds = f"{stratum} {df.schema[stratum].dataType.simpleString()}, __r int, place int"
    return pool.join(F.broadcast(df.sparkSession.createDataFrame(chosen, kinds)), [stratum, "__r"]).select(*df.columns, "place")


def top_with_ties(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    return df.withColumn("__r", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(score)))).where("__r = 1").drop("__r")


def budgeted(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key, with truncated: whether the key had more, as its row k + 1 tells."""
    ranked = first_rows(df, keys, order, k + 1, "__r")
    more = F.max("__r").over(Window.partitionBy(*keys)) > k
    return ranked.withColumn("truncated", more).where(F.col("__r") <= k).drop("__r")
