"""The queries of the training-data operators over the given tables: ``(spark, directory) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import spread
from . import docpairs, handwritten, leakage, neardup, packing, parsing, similar, stuffing


def table(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def files(spark: SparkSession, at: str) -> DataFrame:
    return spread(table(spark, at, "source_files").select("file_id", "repo", "file_path", "file_text"))


def documents(spark: SparkSession, at: str) -> DataFrame:
    return spread(table(spark, at, "documents").select("doc_id", "text"))


def chunk_texts(spark: SparkSession, at: str) -> DataFrame:
    return spread(table(spark, at, "chunks").select("chunk_id", "display_text"))


def p1_found(spark: SparkSession, at: str) -> DataFrame:
    near = similar.most_similar(table(spark, at, "chunks"), "chunk_id", "embedding", size=96, k=5, least=0.8)
    return near.select(F.least("chunk_id", "neighbour").alias("chunk_a"), F.greatest("chunk_id", "neighbour").alias("chunk_b")).distinct()


def p1_neighbours(spark: SparkSession, at: str) -> DataFrame:
    return similar.most_similar(table(spark, at, "chunks"), "chunk_id", "embedding", size=96, k=5)


def p2_found(spark: SparkSession, at: str) -> DataFrame:
    labelled = handwritten.label_files(files(spark, at), table(spark, at, "sources"))
    return labelled.where(~F.col("by_hand")).select("file_id").distinct()


def p2_reasons(spark: SparkSession, at: str) -> DataFrame:
    labelled = handwritten.label_files(files(spark, at), table(spark, at, "sources"))
    return labelled.dropDuplicates(["file_id"]).groupBy("repo", F.coalesce("reason", F.lit("by hand")).alias("reason")).agg(F.count("*").alias("files"))


def p3_found(spark: SparkSession, at: str) -> DataFrame:
    return parsing.check_files(files(spark, at)).where(~F.col("valid")).select("file_id").distinct()


def p3_errors(spark: SparkSession, at: str) -> DataFrame:
    return parsing.check_files(files(spark, at)).where(~F.col("valid")).dropDuplicates(["file_id"])


def p3_rates(spark: SparkSession, at: str) -> DataFrame:
    return parsing.rates(parsing.check_files(files(spark, at)))


def p4_found(spark: SparkSession, at: str) -> DataFrame:
    return docpairs.pair_functions(files(spark, at), code=False).select("file_id", "line_no").distinct()


def p4_pairs(spark: SparkSession, at: str) -> DataFrame:
    return docpairs.pair_functions(files(spark, at)).dropDuplicates(["file_id", "line_no", "name"])


def p5_found(spark: SparkSession, at: str) -> DataFrame:
    pairs = neardup.NearDuplicates(chunk_texts(spark, at), "chunk_id", "display_text", 3, 0.7).pairs()
    return pairs.select(F.col("key_a").alias("chunk_a"), F.col("key_b").alias("chunk_b"))


def p5_groups(spark: SparkSession, at: str) -> DataFrame:
    groups = neardup.NearDuplicates(chunk_texts(spark, at), "chunk_id", "display_text", 3, 0.7).groups()
    return groups.select(F.col("key").alias("chunk_id"), F.col("group").alias("group_id"), "copies", "links")


def p6_packed(spark: SparkSession, at: str) -> DataFrame:
    return packing.pack(packing.token_counts(documents(spark, at)), table(spark, at, "token_budgets"))


def p6_fill(spark: SparkSession, at: str) -> DataFrame:
    """How full the bins of each capacity are."""
    budgets = table(spark, at, "token_budgets").select("budget_id", "budget_name", "capacity_tokens").distinct()
    used = p6_packed(spark, at).groupBy("budget_id").agg(F.count_distinct("packer", "bin").alias("bins"), F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    return used.join(budgets, "budget_id").select("budget_id", "budget_name", "bins", "pieces", "tokens", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 6).alias("fill"))


def p7_found(spark: SparkSession, at: str) -> DataFrame:
    return leakage.leaks(documents(spark, at), table(spark, at, "eval_items")).where(F.col("longest_run") >= 12).select("doc_id", "item_id")


def p7_scores(spark: SparkSession, at: str) -> DataFrame:
    found = leakage.leaks(documents(spark, at), table(spark, at, "eval_items"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), "longest_run")


def p8_found(spark: SparkSession, at: str) -> DataFrame:
    return stuffing.score_pages(documents(spark, at)).where("stuffed").select("doc_id").distinct()


def p8_by_source(spark: SparkSession, at: str) -> DataFrame:
    scored = stuffing.score_pages(documents(spark, at)).withColumnRenamed("doc_id", "id").join(table(spark, at, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return scored.groupBy("source").agg(F.count("*").alias("pages"), F.sum(F.col("stuffed").cast("bigint")).alias("stuffed_pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_neighbours, p2_found, p2_reasons, p3_found, p3_errors, p3_rates, p4_found, p4_pairs,
        p5_found, p5_groups, p6_packed, p6_fill, p7_found, p7_scores, p8_found, p8_by_source,
    )
}
_GRAMS = """g AS (SELECT id, list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(list_slice(w, i, i + {n} - 1), ' '))) AS g FROM w WHERE len(w) >= {n})"""
SQL: dict[str, str] = {
    "p1_found": """WITH u AS (SELECT chunk_id, any_value(embedding)::DOUBLE[] AS e FROM chunks WHERE embedding IS NOT NULL AND len(embedding) = 96
        AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x) OR x IS NULL)) = 0 AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0 GROUP BY chunk_id),
      s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM u a JOIN u b ON a.chunk_id <> b.chunk_id),
      n AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS place FROM s)
      SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM n WHERE place <= 5 AND c >= 0.8""",
    "p5_found": f"""WITH w AS (SELECT chunk_id AS id, regexp_extract_all(lower(any_value(display_text)), '[a-z0-9_]+') AS w FROM chunks GROUP BY chunk_id), {_GRAMS.format(n=3)},
      x AS (SELECT id, len(g) AS n, unnest(g) AS gram FROM g), o AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM x a JOIN x b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL)
      SELECT a AS chunk_a, b AS chunk_b FROM o WHERE common >= 0.7 * (na + nb - common) - 1e-9""",
    "p7_found": f"""WITH w AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items), {_GRAMS.format(n=12)}, i AS (SELECT id AS item_id, unnest(g) AS gram FROM g),
      d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), e AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(list_slice(w, k, k + 11), ' '))) AS gram FROM d WHERE len(w) >= 12)
      SELECT DISTINCT e.doc_id, i.item_id FROM e JOIN i ON e.gram = i.gram""",
}
