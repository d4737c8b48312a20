"""op9_licenses: licence paragraphs of every document."""

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.license_regression import scan


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
