"""Requirement documents and source files as (path, content) tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.sources.exclusions import excluded_path, is_generated, is_source

DOCUMENT = "path string, content string"


def _texts(spark: SparkSession, folder: str, pattern: str, recursive: bool) -> DataFrame:
    found = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=recursive)
    rows = found.select(F.col("value").alias("content"), F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))").alias("uri"))
    # the part of the address below the folder; an address may have one or three slashes after its scheme
    below = F.substring_index("uri", re.sub(r"^\w+:/*", "/", folder).rstrip("/") + "/", -1)
    return rows.select(below.alias("path"), "content")


def _exists(spark: SparkSession, folder: str) -> bool:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_documents(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """All Markdown files of a folder: path (below the folder) and content."""
    return _texts(spark, folder, "*.md", recursive)


def read_vault(spark: SparkSession, root: str, spec_paths: list[str], overrides: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """The documents of several folders below ``root`` and the folders that are missing.

    ``overrides`` (path, content) stands for texts that are not saved yet and wins over the file of that path.
    """
    missing = [p for p in spec_paths if not _exists(spark, f"{root}/{p}")]
    found = [read_documents(spark, f"{root}/{p}").withColumn("path", F.concat(F.lit(p.strip("/") + "/"), "path")) for p in spec_paths if p not in missing]
    rows = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], DOCUMENT)
    rows = rows.dropDuplicates(["path"])
    if overrides is not None:
        new = overrides.select("path", F.col("content").alias("new")).dropDuplicates(["path"])
        rows = rows.join(new, "path", "left").select("path", F.coalesce("new", "content").alias("content"))
    return rows, missing


def read_sources(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """The source files of a tree that are to be indexed: path and content."""
    rows = _texts(spark, root, "*", True).withColumn("path", F.translate("path", "\\", "/"))
    return rows.filter(is_source(F.col("path")) & ~excluded_path(F.col("path"), patterns) & ~is_generated(F.col("content")))
