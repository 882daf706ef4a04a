"""Incremental extraction: files that arrive in a folder become feature rows.

The reference semantics have no streams of their own; this is the batch
extraction applied to a file stream, one file at a time, without state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extraction import is_feature, parse
from ..sources.scan import SUFFIX, excluded, keeps


def arriving_features(spark: SparkSession, folder: str, language: str, exclude: list[str] | None = None) -> DataFrame:
    """Raw feature rows of files as they arrive under the folder; not for TypeScript,
    whose parameters need the types of the whole tree."""
    if language == "typescript":
        raise ValueError("TypeScript needs the whole tree")
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{SUFFIX[language]}").load(folder)
    files = files.withColumn("path", F.regexp_replace("path", "^file:/*", "/")).where(keeps(F.col("path"), language) & ~excluded(F.col("path"), exclude or []))
    return parse(files.select("path", "content"), language).where(is_feature(language, folder))
