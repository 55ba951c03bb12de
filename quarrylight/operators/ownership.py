"""Which registered source a file belongs to.

A file belongs to the first source of its repository (lowest order) whose root
contains it and whose language and extensions fit.  The sources of a repository
are few; they are gathered into one row a repository and joined by repository,
so no file is compared with the sources of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def repository_rules(sources: DataFrame, repo: str = "repo") -> DataFrame:
    """One row a repository: ``repo, rules`` (array of order, root, dep, extensions, ascending).

    Repeated sources count once; null ``dep`` means false, null ``root`` never matches.
    """
    s = sources.where(F.col("root").isNotNull()).select(
        F.col(repo).alias("repo"),
        F.col("source_ord").alias("ord"),
        F.when(paths.normal_path(F.col("root")).isin(".", "/"), "").otherwise(paths.normal_path(F.col("root"))).alias("root"),
        F.coalesce(F.col("dep"), F.lit(False)).alias("dep"),
        paths.effective_extensions(F.lower(F.col("source_language")), F.col("extensions")).alias("extensions"),
        paths.default_extensions(F.lower(F.col("source_language"))).alias("allowed"),
    )
    s = s.withColumn("extensions", F.array_intersect("extensions", "allowed"))
    return s.groupBy("repo").agg(F.array_sort(F.collect_set(F.struct("ord", "root", "dep", "extensions"))).alias("rules"))


def owner(path, rules):
    """The first fitting rule as a struct; null if none fits."""
    p, e = paths.normal_path(path), paths.extension(paths.normal_path(path))
    return F.get(F.filter(rules, lambda r: paths.under_root(p, r["root"]) & F.array_contains(r["extensions"], e)), F.lit(0))


def with_owner(files: DataFrame, sources: DataFrame, repo: str = "repo", path: str = "file_path") -> DataFrame:
    """``files`` with ``owner_ord``, ``owner_dep`` (null where no source owns the file)."""
    rules = repository_rules(sources).withColumnRenamed("repo", "__repo").withColumnRenamed("rules", "__rules")
    j = files.join(rules, F.col(repo) == F.col("__repo"), "left").withColumn("__owner", owner(F.col(path), F.col("__rules")))
    return j.withColumns({"owner_ord": F.col("__owner.ord"), "owner_dep": F.col("__owner.dep")}).drop("__repo", "__rules", "__owner")
