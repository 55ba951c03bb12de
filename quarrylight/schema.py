"""The tables of the index: explicit schemas and value domains (section 1 of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The domains of the chunk columns.
KINDS = ("Function", "Struct", "Enum", "Trait", "Impl", "Module")
CHUNK_TYPES = ("Overview", "Function")
VISIBILITIES = ("Pub", "PubCrate", "PubSuper", "Private")
LANGUAGES = ("rust", "cpp")
FORMAT_VERSION = 1

CHUNKS = (
    "file_key string, chunk_ord int, language string, source_ord int, symbol_name string, kind string, chunk_type string, parent string, visibility string, line_start int, line_end int, "
    "signature string, doc_comment string, display_text string, embedding_text string, embedding array<float>, origin string, crate_name string, crate_version string, root_deps array<string>"
)
FILES = "file_key string, git_root string, source_ord int, language string"
GIT_STATES = "git_root string, last_indexed_commit string"
DIRTY = "git_root string, path string, sha256 string"
META = "version int, embedder string, model string"
SOURCES = "source_ord int, language string, root string, dep boolean, extensions array<string>"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """U13."""
    return spark.createDataFrame([], schema)


def invalid_chunks(chunks: DataFrame) -> DataFrame:
    """The rows whose kind, chunk type or visibility is outside its domain."""
    return chunks.where(~F.col("kind").isin(*KINDS) | ~F.col("chunk_type").isin(*CHUNK_TYPES) | ~F.col("visibility").isin(*VISIBILITIES))
