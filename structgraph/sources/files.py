"""Source trees as a DataFrame of ``path, lang, source, module_qname``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from structgraph.functions.paths import extension, module_qname

# Languages by extension, and folders that are skipped.
LANGUAGES = {
    "py": "python", "go": "go", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "vue": "vue", "rs": "rust",
    "java": "java", "kt": "java", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "c": "c_cpp", "cpp": "c_cpp", "cc": "c_cpp",
    "cxx": "c_cpp", "h": "c_cpp", "hpp": "c_cpp", "scala": "scala", "clj": "clojure", "cljs": "clojure", "cljc": "clojure", "dart": "dart",
    "ex": "elixir", "exs": "elixir", "sol": "solidity", "tf": "terraform", "hcl": "terraform", "proto": "proto",
}
SKIPPED = ("node_modules", "vendor", "__pycache__", "target", "dist", "build")


def language(path: Column) -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), extension(path))
    return F.when(extension(path).isin("ts", "tsx") & path.contains(".component.ts"), F.lit("angular")).otherwise(found)


def kept(path: Column) -> Column:
    """Whether no part of a relative path is hidden or skipped."""
    parts = F.split(path, "/")
    return ~F.exists(parts, lambda s: s.startswith(".") | s.isin(*SKIPPED))


def describe(files: DataFrame) -> DataFrame:
    """Files (``path``, ``source``) of known languages with language and module name."""
    own = files.where(kept(F.col("path"))).withColumn("lang", language(F.col("path"))).where("lang is not null")
    return own.select("path", "lang", "source", module_qname(F.col("path")).alias("module_qname"))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """All readable source files under ``root``; paths are relative to it, files that aren't UTF-8 are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)
    base = root.split("://")[-1].rstrip("/")
    path = F.substr(F.substring_index("path", base, -1), F.lit(2))
    text = raw.select(path.alias("path"), "content").where(kept(F.col("path")) & language(F.col("path")).isNotNull())
    text = text.where(F.is_valid_utf8(F.col("content").cast("string")))
    return describe(text.select("path", F.col("content").cast("string").alias("source")))
