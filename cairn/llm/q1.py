"""op1_packing: every document packed into sequences of at most 4096 tokens."""

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.packing_hilbert import piece_digests


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
