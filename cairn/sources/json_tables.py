"""JSON documents with explicit schemas, verified reads, and sinks that never overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators.checks import require


def read_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document for each file of path; a file that breaks the schema fails the job."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_completed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The completed units of a folder of result files, with the file's name."""
    rows = read_document(spark, path, schema).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return rows.where("state = 'completed'")


def read_named(spark: SparkSession, paths: dict[str, str], schemas: dict[str, str]) -> dict[str, DataFrame]:
    """A frame for each named input; all missing ones are reported together."""
    hadoop, fs = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs
    missing = [name for name, path in paths.items() if not fs.Path(path).getFileSystem(hadoop).exists(fs.Path(path))]
    if missing:
        raise FileNotFoundError(", ".join(sorted(missing)))
    return {name: read_document(spark, path, schemas[name]) for name, path in paths.items()}


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of every file under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def digest_mismatches(actual: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, reason) where the manifest (path, sha256) and the files differ."""
    both = manifest.select("path", F.col("sha256").alias("planned")).join(actual.select("path", "sha256"), "path", "full_outer")
    reason = F.when(F.col("sha256").isNull(), "missing").when(F.col("planned").isNull(), "unplanned").when(F.col("sha256") != F.col("planned"), "changed")
    return both.select("path", reason.alias("reason")).where("reason is not null")


def read_verified(spark: SparkSession, path: str, manifest: DataFrame, schema: T.StructType | str) -> DataFrame:
    """The JSON documents under path with their file names, parsed from the very bytes whose sha256 the manifest (path, sha256) gives.

    paths in the manifest are relative to path. A file that is missing, not planned or changed fails the job before a row is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = "^.*?" + path.rstrip("/").replace("file:", "") + "/"
    held = files.select(F.regexp_replace("path", root, "").alias("path"), F.sha2("content", 256).alias("sha256"), "content")
    require(digest_mismatches(held, manifest), "file and manifest differ")
    # the digest is of the bytes that are parsed, so a change between the two reads loses the row and is found by the count
    return held.join(manifest.select("path", "sha256"), ["path", "sha256"]).select("path", F.from_json(F.col("content").cast("string"), schema, {"mode": "FAILFAST"}).alias("row")).select("path", "row.*")


def notebook_cells(notebooks: DataFrame, content: str = "content") -> DataFrame:
    """Columns of notebooks with (cell, source) for each code cell; a source may be a list or a text."""
    kind = "struct<cells: array<struct<cell_type: string, source: string>>>"
    cells = notebooks.withColumn("__nb", F.from_json(F.col(content).cast("string"), kind)).select(*[c for c in notebooks.columns if c != content], F.posexplode("__nb.cells").alias("cell", "__c"))
    parts = F.from_json(F.col("__c.source"), "array<string>")
    return cells.where("__c.cell_type = 'code'").withColumn("source", F.coalesce(F.when(F.col("__c.source").startswith("["), F.array_join(parts, "")), F.col("__c.source"))).drop("__c")


def write_once(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
