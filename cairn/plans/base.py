"""The driver tables in the roles of evidence tables, as frames and as the same SQL.

doc_id is a record, lang its stratum, source its repository; labels.quality is the gold label, and three
deterministic rules on the text are the prediction arms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARMS = ["length", "language", "marks"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def records(spark: SparkSession, d: str) -> DataFrame:
    """documents with gold (present, absent or null) and toxic."""
    gold = F.when(F.col("quality") == 1, "present").when(F.col("quality") == 0, "absent")
    labels = table(spark, d, "labels").select("doc_id", gold.alias("gold"), "toxic")
    return table(spark, d, "documents").join(labels, "doc_id", "left")


def arms(df: DataFrame) -> DataFrame:
    n, lang = F.col("n_chars"), F.col("lang")
    return df.withColumns({
        "length": F.when(n > 1500, "present").when(n < 300, "unknown").otherwise("absent"),
        "language": F.when(lang.isin("en", "de"), "present").when(lang == "fr", "absent").otherwise("unknown"),
        "marks": F.when(F.contains("text", F.lit("***")), "absent").when(n % 5 == 0, "unknown").otherwise("present"),
    })


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, gold, arm, prediction): one row for each record and arm."""
    wide = arms(records(spark, d)).select("doc_id", "lang", "source", "n_chars", "gold", *ARMS)
    return wide.unpivot(["doc_id", "lang", "source", "n_chars", "gold"], ARMS, "arm", "prediction")


REC = """rec AS (SELECT d.*, CASE l.quality WHEN 1 THEN 'present' WHEN 0 THEN 'absent' END AS gold, l.toxic
FROM documents d LEFT JOIN labels l USING (doc_id))"""
WIDE = REC + """, wide AS (SELECT *, CASE WHEN n_chars > 1500 THEN 'present' WHEN n_chars < 300 THEN 'unknown' ELSE 'absent' END AS length,
CASE WHEN lang IN ('en', 'de') THEN 'present' WHEN lang = 'fr' THEN 'absent' ELSE 'unknown' END AS language,
CASE WHEN contains(text, '***') THEN 'absent' WHEN n_chars % 5 = 0 THEN 'unknown' ELSE 'present' END AS marks FROM rec)"""
PRED = WIDE + """, pred AS (SELECT doc_id, lang, source, n_chars, gold, 'length' AS arm, length AS prediction FROM wide
UNION ALL SELECT doc_id, lang, source, n_chars, gold, 'language', language FROM wide
UNION ALL SELECT doc_id, lang, source, n_chars, gold, 'marks', marks FROM wide)"""


def gathered_sql(each: str, by: str, count: str | None = None) -> str:
    """SQL of (by, count, digest) for the digests (by, dg) of each: hashed by four first digits, by two, and all."""
    one = lambda rows, at, order, n: f"SELECT {by}, {at} AS b, {n} AS n, sha256(string_agg(dg, '' ORDER BY {order})) AS dg FROM ({rows}) GROUP BY ALL"
    all_ = one(one(one(each, "dg[1:4]", "dg", "count(*)"), "b[1:2]", "b", "sum(n)"), "''", "b", "sum(n)")
    return f"SELECT {by}, " + (f"n::BIGINT AS {count}, " if count else "") + f"dg AS digest FROM ({all_})"


def rounded(df: DataFrame, *names: str, places: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in names})
