"""op8_quality: a quality score of every document."""

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.quality_fm import classify


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
