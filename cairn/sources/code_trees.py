"""Source trees as tables: one row for each file, filtered on its path before its bytes are read."""

from __future__ import annotations

import json
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.json_tables import notebook_cells

# Folder names that are not a project's own code; a caller may give its own.
EXCLUDED = ["vendor", "node_modules", "site-packages", "dist", "build", "tests", "test", "__pycache__", ".git", ".venv", "venv"]
# A qualified name, with the star that Java and Kotlin end one with.
_NAME = r"([\p{L}_$][\p{L}\p{N}_$]*(?:\.[\p{L}_$][\p{L}\p{N}_$]*)*(?:\.\*)?)"


def _statement(keyword: str, words: str = "", end: str = "") -> str:
    """A line that begins with a keyword, any of some words, and a qualified name."""
    return rf"(?m)^[ \t]*{keyword}[ \t]+{words}{_NAME}{end}"


# The pattern of a module's name in an import of each language, and the group that holds it. In TypeScript and
# JavaScript a module is the literal behind from, import, import( or require(; in Java (JLS 7.5) the name behind
# import or import static; in Kotlin that behind import, with an alias behind it; in C# that of a using directive, which
# may be global, static or an alias, and is no using statement or declaration.
IMPORTS = {
    "typescript": (r"""\b(?:from|import|require)\s*\(?\s*(["'])([^"'\n]+)\1""", 2),
    "java": (_statement("import", r"(?:static[ \t]+)?", r"[ \t]*;"), 1),
    "kotlin": (_statement("import"), 1),
    "csharp": (_statement(r"(?:global[ \t]+)?using", r"(?:static[ \t]+|[\p{L}_][\p{L}\p{N}_]*[ \t]*=[ \t]*)?", r"[ \t]*;"), 1),
}
COMMENTS = r"(?s)/\*.*?\*/"


def excluded(path: Column, folders: list[str] = EXCLUDED) -> Column:
    """Whether a path lies in one of the folders or names a test file."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    return F.arrays_overlap(parts, F.array(*map(F.lit, folders))) | name.startswith("test_") | name.rlike(r"[_.](?:test|spec)\.[a-z]+$")


def read_tree(spark: SparkSession, root: str, pattern: str = "*.py", max_files: int | None = None) -> DataFrame:
    """(path, content) of the files under root that are the project's own; with max_files the first by path, and truncated."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    relative = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").replace("file:", "") + "/", "")
    own = files.select(relative.alias("path"), "content").where(~excluded(F.col("path")))
    if max_files is None:
        return own
    # a top-k over all tasks; one more path tells whether there are more
    first = own.select("path").orderBy("path").limit(max_files + 1)
    more = F.lit(first.count() > max_files)
    kept = own.select("path").orderBy("path").limit(max_files).withColumn("truncated", more)
    return own.join(kept, "path")


def imported_modules(files: DataFrame, language: str) -> DataFrame:
    """(path, module) for each module that a file imports, outside block comments."""
    text = F.regexp_replace(F.col("content").cast("string"), COMMENTS, "")
    pattern, group = IMPORTS[language]
    return files.select("path", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))).alias("module"))


def read_code(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """(path, cell, source) of the Python files and the code cells of notebooks under root; cell is 0 for a file."""
    python = read_tree(spark, root, "*.py", max_files).select("path", F.lit(0).alias("cell"), F.col("content").cast("string").alias("source"))
    notebooks = read_tree(spark, root, "*.ipynb", max_files).select("path", F.col("content").cast("string").alias("content"))
    return python.unionByName(notebook_cells(notebooks).select("path", F.col("cell").cast("int").alias("cell"), "source"))


def package_roots(files: DataFrame) -> DataFrame:
    """(path, field, root, gap) of the pyproject.toml contents in files (path, content): the package folders that a project
    names, one row for each, and a row with a gap where the text is no TOML or a field is not a list or mapping of names.

    Read are tool.setuptools.packages.find.where, tool.setuptools.package-dir, tool.poetry.packages.from and
    tool.hatch.build.targets.wheel.packages.
    """

    def names(value, field: str) -> list[tuple]:
        if value is None:
            return []
        found = list(value.values()) if isinstance(value, dict) else value
        if not isinstance(found, list) or not all(isinstance(x, str) for x in found):
            return [(field, None, "not_names")]
        return [(field, x, None) for x in dict.fromkeys(found)]

    def at(tree, *keys):
        for key in keys:
            tree = tree.get(key) if isinstance(tree, dict) else None
        return tree

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    tree = tomllib.loads(bytes(content).decode())
                except (tomllib.TOMLDecodeError, UnicodeDecodeError):
                    rows.append((path, "file", None, "not_toml"))
                    continue
                packages = at(tree, "tool", "poetry", "packages")
                from_ = [x.get("from", ".") if isinstance(x, dict) else None for x in packages] if isinstance(packages, list) else packages
                found = names(at(tree, "tool", "setuptools", "packages", "find", "where"), "setuptools.find") + names(at(tree, "tool", "setuptools", "package-dir"), "setuptools.package-dir")
                found += names(from_, "poetry.packages") + names(at(tree, "tool", "hatch", "build", "targets", "wheel", "packages"), "hatch.wheel")
                rows += [(path, *x) for x in found]
            yield pd.DataFrame(rows, columns=["path", "field", "root", "gap"])

    return files.select("path", "content").mapInPandas(run, "path string, field string, root string, gap string")


def config_values(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """(path, key, value, gap): the scalar values of JSON, TOML and YAML files (path, content), keys joined by dots, list places as numbers.

    YAML needs PyYAML on the workers; without it, in files that do not parse, and in files over max_bytes if it is given, one row has a gap in place of values.
    """

    def leaves(value, at: str):
        if isinstance(value, dict):
            for k, v in value.items():
                yield from leaves(v, f"{at}.{k}" if at else str(k))
        elif isinstance(value, list):
            for k, v in enumerate(value):
                yield from leaves(v, f"{at}.{k}" if at else str(k))
        else:
            yield at, None if value is None else json.dumps(value, default=str) if not isinstance(value, str) else value

    def parsed(path: str, text: str) -> list:
        if path.endswith(".json"):
            return [json.loads(text)]
        if path.endswith(".toml"):
            return [tomllib.loads(text)]
        import yaml

        return list(yaml.safe_load_all(text))

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                if max_bytes is not None and len(content) > max_bytes:
                    rows.append((path, None, None, "too_large"))
                    continue
                try:
                    rows += [(path, k, v, None) for tree in parsed(path.lower(), bytes(content).decode()) for k, v in leaves(tree, "")]
                except ImportError:
                    rows.append((path, None, None, "no_yaml"))
                except Exception as e:  # a parser of another's library: its errors have no common class
                    rows.append((path, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "key", "value", "gap"])

    return files.select("path", "content").mapInPandas(run, "path string, key string, value string, gap string")
