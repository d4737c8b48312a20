"""op10_token_counts: tokens of every document."""

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.token_counts import token_counts


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
