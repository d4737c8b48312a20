"""op6_secrets: spans of secrets in every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.queries import spans_sql
from cairn.llm.secrets_markov import with_spans
from cairn.llm.spans import joined


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return with_spans(docs).select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans")
    )


def fixed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of the fixed formats alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_spans(docs).select("doc_id", joined(F.col("base")).alias("spans"))


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
FIXED_SQL = spans_sql([
    ("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(h, '^{_ASSIGN.replace(chr(39), chr(39) * 2)}', '')) >= 8"),
    ("access", "AKIA[A-Z0-9]+", "length(h) >= 16"),
    ("hex", "[0-9a-f]+", "length(h) >= 32"),
])
