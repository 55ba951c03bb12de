"""Which files of which sources make up the index.

Paths come as a table; sources as a table or a list.  A path belongs to the
first registered source that holds it; another language that claims it too is a
conflict, kept as a row of ``conflicts``.

Cases: sources marked as dependencies are dropped (F6); paths that no source
holds are dropped; null paths too; a path that comes twice counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as p


def claims(files: DataFrame, sources: DataFrame, repo: str, path: str) -> DataFrame:
    """Every pair of a file and a source of its repository that holds it: ``repo, path, source_ord, language``."""
    rules = sources.where(~F.coalesce(F.col("dep"), F.lit(False)) & F.col("root").isNotNull()).select(
        F.col(repo).alias("__repo"), "source_ord", F.lower("source_language").alias("language"),
        F.when(p.normal_path(F.col("root")).isin(".", "/"), "").otherwise(p.normal_path(F.col("root"))).alias("__root"), p.effective_extensions(F.lower("source_language"), F.col("extensions")).alias("__extensions"),
    ).distinct()
    seen = files.where(F.col(path).isNotNull()).select(F.col(repo).alias("repo"), p.normal_path(F.col(path)).alias("path")).distinct()
    met = seen.join(rules, F.col("repo") == F.col("__repo"))
    return met.where(p.under_root(F.col("path"), F.col("__root")) & F.array_contains("__extensions", p.extension(F.col("path")))).select("repo", "path", "source_ord", "language")


def discovered(claimed: DataFrame) -> DataFrame:
    """The first source of each path: ``repo, path, source_ord, language``."""
    first = claimed.groupBy("repo", "path").agg(F.min(F.struct("source_ord", "language")).alias("s"))
    return first.select("repo", "path", "s.source_ord", "s.language")


def conflicts(claimed: DataFrame) -> DataFrame:
    """Paths that sources of different languages claim: ``repo, path, languages``."""
    return claimed.groupBy("repo", "path").agg(F.array_sort(F.collect_set("language")).alias("languages")).where(F.size("languages") > 1)


def read_texts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The files below a folder as ``path, text``; content that isn't UTF-8 gives a null text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return raw.select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), F.when(F.expr("is_valid_utf8(cast(content as string))"), F.col("content").cast("string")).alias("text"))
