"""op7_repeats: bytes of every document that 200-byte repeats cover."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.prefix_free import remove_repeats


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
