"""op12_fingerprints: every document's fingerprint, that of its edited text, and their likeness."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.one_permutation import near_edits


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
