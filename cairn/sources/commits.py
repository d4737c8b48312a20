"""Sinks with a commit: what a reader sees is complete, and a crash at any point leaves what was there before.

A table is written to a folder of its own beside the others, and only then a small pointer file is put in place by one
rename, which the file system does at once or not at all.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


class Folder:
    """A folder of a Hadoop file system, through the session's JVM."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self.fs = self.at().getFileSystem(self.conf)

    def at(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.at())) if self.exists() else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """A new small file; FileExistsError if there is one of this name."""
        if self.exists(name):
            raise FileExistsError(f"{self.path}/{name} exists")
        stream = self.fs.create(self.at(name), False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()

    def replace(self, name: str, text: str) -> None:
        """A small file under a new name, then renamed over the old one."""
        fresh = f".{name}-{uuid.uuid4().hex}"
        self.put(fresh, text)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at().toUri(), self.conf)
        how = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = how.OVERWRITE
        context.rename(self.at(fresh), self.at(name), options)

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def write_checkpoint(df: DataFrame, path: str) -> int:
    """Write df as the next version of the checkpoint at path and make it the current one; returns its number.

    The version is complete before the pointer is renamed to it, so a reader finds the last version or this one. df may read
    the current version. The version before is kept for readers that have begun; older ones and unfinished ones are deleted.
    """
    spark = df.sparkSession
    folder = Folder(spark, path)
    before = current_version(spark, path)
    number = (before or 0) + 1
    name = f"version-{number:08d}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{folder.path}/{name}")
    kept = json.loads(folder.read(POINTER))["folder"] if before else None
    folder.replace(POINTER, json.dumps({"version": number, "folder": name}))
    for other in folder.names():
        if (other.startswith("version-") and other not in (name, kept)) or other.startswith(f".{POINTER}-"):
            folder.delete(other)
    return number


def current_version(spark: SparkSession, path: str) -> int | None:
    folder = Folder(spark, path)
    return json.loads(folder.read(POINTER))["version"] if folder.exists(POINTER) else None


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The current version; FileNotFoundError before the first is complete."""
    folder = Folder(spark, path)
    if not folder.exists(POINTER):
        raise FileNotFoundError(f"{folder.path}/{POINTER}")
    return spark.read.parquet(f"{folder.path}/{json.loads(folder.read(POINTER))['folder']}")


def digest_of_parts(spark: SparkSession, path: str) -> str:
    """One sha256 of the part files under path, whatever their names and order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    digests = files.select(F.sha2("content", 256).alias("d")).groupBy().agg(F.array_sort(F.collect_list("d")).alias("d"))
    return digests.select(F.sha2(F.array_join("d", "\n"), 256)).first()[0]


def text_digest(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def _shown(value: dict) -> str:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def start_run(spark: SparkSession, plan: dict, path: str) -> str:
    """Write PLAN.json to the new folder path and return its digest. FileExistsError if path has a plan."""
    folder = Folder(spark, path)
    text = _shown(plan)
    folder.put("PLAN.json", text)
    return text_digest(text)


def write_run(df: DataFrame, plan: dict, path: str) -> dict:
    """PLAN.json, the rows in RESULT, RESULT.json and MANIFEST.json under the new folder path, in this order; returns the manifest.

    The plan is on disk before the rows are computed. RESULT.json has the digest of the plan and of the rows, and
    MANIFEST.json that of both documents, so each is bound to all before. A run without a manifest has not ended; none is ever
    written over.
    """
    start_run(df.sparkSession, plan, path)
    return finish_run(df, path)


def finish_run(df: DataFrame, path: str) -> dict:
    """The rows and what follows them, for a folder in which the plan stands already."""
    spark = df.sparkSession
    folder = Folder(spark, path)
    plan = text_digest(folder.read("PLAN.json"))
    df.write.mode("errorifexists").json(f"{folder.path}/RESULT")
    return seal_run(spark, path, plan)


def seal_run(spark: SparkSession, path: str, plan_sha256: str) -> dict:
    folder = Folder(spark, path)
    result = _shown({"plan_sha256": plan_sha256, "rows_sha256": digest_of_parts(spark, f"{folder.path}/RESULT")})
    folder.put("RESULT.json", result)
    manifest = {"plan_sha256": plan_sha256, "result_sha256": text_digest(result)}
    folder.put("MANIFEST.json", _shown(manifest))
    return manifest


def add_sidecar(spark: SparkSession, plan: dict, path: str) -> dict:
    """The documents for a RESULT folder that was written without them; the plan says that it came after. None may exist yet."""
    return seal_run(spark, path, start_run(spark, plan | {"written_after_result": True}, path))


def broken_links(spark: SparkSession, path: str) -> list[str]:
    """Which of plan, rows and result differ from what binds them; "unfinished" without a manifest. Empty for a sound run."""
    folder = Folder(spark, path)
    if not folder.exists("MANIFEST.json"):
        return ["unfinished"]
    manifest, result = json.loads(folder.read("MANIFEST.json")), folder.read("RESULT.json")
    plan, rows = text_digest(folder.read("PLAN.json")), digest_of_parts(spark, f"{folder.path}/RESULT")
    told = json.loads(result)
    checks = {"plan": plan == manifest["plan_sha256"] == told["plan_sha256"], "rows": rows == told["rows_sha256"], "result": text_digest(result) == manifest["result_sha256"]}
    return [name for name, sound in checks.items() if not sound]
