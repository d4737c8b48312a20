"""op3_pii: spans of personal data in every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.pii_boosting import BASE_KINDS, with_spans
from cairn.llm.queries import spans_sql
from cairn.llm.spans import joined


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return with_spans(docs).select("doc_id", *map(of, BASE_KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))


def fixed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of the fixed formats alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_spans(docs).select("doc_id", joined(F.col("base")).alias("spans"))


_DIGITS = "regexp_replace(h, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(list_reverse(string_split({_DIGITS}, '')), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INTEGER ELSE 2*c::INTEGER - CASE WHEN c::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
FIXED_SQL = spans_sql([
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(h, '.'), lambda x: x::HUGEINT)) <= 255"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN length({_DIGITS}) BETWEEN 12 AND 19 THEN {_LUHN} ELSE false END"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
])
