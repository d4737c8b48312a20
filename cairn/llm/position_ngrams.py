"""Target-distribution importance resampling on a table of word positions.

Words of all texts are exploded with their positions; lead() over a document's window puts the following words beside each, so
that a row holds one n-gram of each order. The n-grams are hashed to buckets, counted by bucket over the corpus and over
the target texts, and each bucket's log ratio of the two is joined back and averaged by document. Documents are then
drawn without replacement by the highest sums of that mean and a Gumbel variate made from a hash of the document's key.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.shared import Staged, staged
from cairn.operators.windows import globally_numbered

ORDERS, BUCKETS = 2, 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Between words; A-Z belong to words, as they are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(word: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def positions(texts: DataFrame, keep: list[str], text: str, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(keep, row, at, b1, b2, ...): for each word of each text its place and the buckets of the n-grams that begin with it; null where the text ends before.

    row is a number of its own for each row; a text without words has one row without place and buckets. Texts are shuffled
    once by row, so the words that a task explodes are in the partition that the window asks for.
    """
    session = texts.sparkSession
    rows = texts.select(*keep, F.col(text).alias("body"), F.monotonically_increasing_id().alias("row"))
    spread = rows.repartition(int(session.conf.get("spark.sql.shuffle.partitions")), "row")
    words = F.array_remove(F.split(F.coalesce(F.col("body"), F.lit("")), GAP), "")
    exploded = spread.select(*keep, "row", F.posexplode_outer(words).alias("at", "raw"))
    w = Window.partitionBy("row").orderBy("at")
    table = exploded.withColumn("w0", lowered(F.col("raw"))).drop("raw")
    table = table.withColumns({f"w{k}": F.lead("w0", k).over(w) for k in range(1, orders)})

    def bucket(n: int) -> Column:
        run = F.concat(*[x for k in range(n) for x in ([F.lit(" ")] * bool(k) + [F.col(f"w{k}")])])
        return (F.crc32(F.encode(run, "UTF-8")) % buckets).cast("int").alias(f"b{n}")

    return table.select(*keep, "row", "at", *[bucket(n) for n in range(1, orders + 1)])


def bucket_counts(table: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(bucket, n) over all rows and orders of positions(); no more rows than there are buckets. Tasks count first."""
    each = table.select(F.explode(F.array(*[f"b{n}" for n in range(1, orders + 1)])).alias("bucket")).where("bucket is not null")
    return each.groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for the corpus's buckets: floor(1000 ln(share in target / share in corpus)), both counted with one more in each bucket.

    corpus and target are bucket_counts(); their totals are two numbers read by the driver.
    """
    both = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    total = lambda df: F.lit(df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).cast("double") + buckets
    share = ((F.coalesce("t", F.lit(0)) + 1.0) * total(corpus)) / ((F.col("s") + 1.0) * total(target))
    return both.select("bucket", F.floor(F.log(share) * 1000).alias("gain"))


def gumbel(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the first 8 digits of sha256(seed:key)."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 25, least_words: int = 20, seed: int = 7, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_features, weight, score, rank) for each row of docs: rank 1, 2, ... for the drawn rows, floor(percent * N / 100) of the N rows with least_words words or more.

    weight is the floored mean of the gains of a row's n-grams (0 without any) towards the texts of target, and score adds the
    hash's Gumbel variate; higher scores come first, ties go to the smaller key, null keys come last. Null texts count as empty;
    repeated rows are counted, scored and ranked each; an empty docs table gives no rows, and an empty target gives gains all
    the same. Other columns of docs, whatever their names, play no part. Every text is a window of its own, so a hot source or key makes
    no large group, and a very long text is sorted by one task, on disk if it must be. The table of positions is
    written once, and what is broadcast is a row for each of the buckets.
    """
    table = Staged(positions(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), ["key"], "text", orders, buckets), "positions").df
    wanted = positions(target.select(F.col(text).alias("text")), [], "text", orders, buckets)
    gain = staged(gains(staged(bucket_counts(table, orders), "corpus"), staged(bucket_counts(wanted, orders), "target"), buckets), "gains")
    found = table
    for n in range(1, orders + 1):
        found = found.join(F.broadcast(gain.select(F.col("bucket").alias(f"b{n}"), F.col("gain").alias(f"g{n}"))), f"b{n}", "left")
    each = range(1, orders + 1)
    gained = functools.reduce(Column.__add__, [F.coalesce(f"g{n}", F.lit(0)) for n in each])
    counted = functools.reduce(Column.__add__, [F.col(f"b{n}").isNotNull().cast("long") for n in each])
    sums = found.groupBy("row", "key").agg(F.sum(gained).alias("gain"), F.sum(counted).alias("n_features"), F.count("at").alias("words"))
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    scored = staged(sums.select("key", "row", "n_features", "words", weight.alias("weight")).withColumn("score", F.col("weight") + gumbel(F.col("key"), seed)), "scored")
    return drawn(scored, F.col("words") >= least_words, percent).select(F.col("key").alias(key), "n_features", "weight", "score", "rank")


def drawn(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """scored with rank: of the eligible rows, floor(percent * N / 100) are numbered in descending order of score, then by key."""
    rows = scored.where(eligible)
    k = percent * rows.count() // 100
    numbered = globally_numbered(rows, [F.desc("score"), F.asc_nulls_last("key"), F.asc("row")])
    number = F.when(F.col("rank") <= k, F.col("rank")).cast("long")
    return numbered.withColumn("rank", number).unionByName(scored.where(~eligible).withColumn("rank", F.lit(None).cast("long")))
