"""File overviews (F8-F9, R10-R11) and counts (A1-A2).

Cases: a file without overview chunks has no overview (the API raises for it);
null display texts are skipped; a chunk that comes twice counts once; ties of visibility keep the chunk order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.code_text import visibility_rank


def overviews(chunks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a file: its overview chunks' texts by visibility, then by ``order``, joined by blank lines; ``parts``, ``overview``."""
    only = chunks.where((F.col("chunk_type") == "Overview") & F.col("display_text").isNotNull())
    parts = F.array_sort(F.collect_set(F.struct(visibility_rank(F.col("visibility")).alias("rank"), *order, "display_text")))
    return only.groupBy(*keys).agg(parts.alias("parts")).select(*keys, F.size("parts").cast("bigint").alias("parts"), F.array_join(F.transform("parts", lambda x: x["display_text"]), "\n\n").alias("overview"))


def index_result(files: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """A1: one row: ``files_indexed`` (also files without chunks) and ``chunks_created``."""
    return files.agg(F.count_distinct(F.struct(*keys)).alias("files_indexed")).crossJoin(chunks.agg(F.count("*").alias("chunks_created")))  # one row each
