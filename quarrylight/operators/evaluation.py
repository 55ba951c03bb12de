"""Retrieval quality from ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_at(ranked: DataFrame, relevant: str, k: int, query: str, category: str | None = None) -> DataFrame:
    """Mean precision at k over the queries, by category if given; a null relevance is not relevant.

    ``ranked`` has a row a result with ``rank`` from 1; results missing below k count as not relevant.
    """
    groups = [category] if category else []
    hits = ranked.where(F.col("rank") <= k).groupBy(*groups, query).agg(F.sum(F.coalesce(F.col(relevant).cast("double"), F.lit(0.0))).alias("hits"))
    return hits.groupBy(*groups).agg(F.count("*").alias("queries"), F.round(F.avg(F.col("hits") / k), 6).alias("precision"), F.round(F.avg((F.col("hits") > 0).cast("double")), 6).alias("answered"))
