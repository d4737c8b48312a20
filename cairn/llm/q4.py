"""op4_decontamination: benchmark items found in the documents."""

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.decontamination import leaks


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
