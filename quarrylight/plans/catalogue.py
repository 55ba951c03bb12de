"""The queries of the core over the given tables: ``(spark, directory) -> DataFrame``, with the SQL that gives the same rows.

Each query runs an operator over whole tables.  ``SQL`` has DuckDB's form of
those that SQL can say; chunking, hashing embeddings and the stream's batch are
tested against fixtures instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code_text as ct
from ..functions import paths as p
from ..functions import vectors
from ..operators import discovery, embedding, evaluation, maintenance, ranking
from ..operators import overview as ov
from ..operators.chunking import build
from ..operators.ownership import with_owner
from ..streaming.changes import latest_events
from .lineage import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SIZE = 96  # numbers of a usable vector


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def _big(c: str | Column, name: str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(name)


# -- the pieces of SQL that several queries share

_PATH = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[\\/]+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '(^|/)\.$', '\1', 'g'), '(.)/$', '\1', 'g')"
_ROOT = "CASE WHEN {0} IN ('.', '/') THEN '' ELSE {0} END"
_EXTENSION = r"nullif(lower(regexp_extract({0}, '[^/.][^/]*\.([^./]*)$', 1)), '')"
_DEFAULT = "CASE {0} WHEN 'rust' THEN ['rs'] WHEN 'cpp' THEN ['cpp','cc','cxx','c','h','hpp','hxx','hh'] END"
_USABLE = f"""(SELECT chunk_id, any_value(embedding) AS embedding, any_value(symbol_name) AS symbol_name, any_value(origin) AS origin, any_value(repo) AS repo, any_value(kind) AS kind
  FROM chunks WHERE embedding IS NOT NULL AND len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: isnan(x))) = 0 GROUP BY chunk_id)"""
_SIM = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN list_sum(list_transform({0}::DOUBLE[], lambda x: x*x)) = 0 OR list_sum(list_transform({1}::DOUBLE[], lambda x: x*x)) = 0 THEN 0.0::DOUBLE ELSE list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[]) END))"
_SCORE = """{raw} + CASE WHEN {t} IS NULL OR {s} IS NULL THEN 0.0::DOUBLE WHEN lower({s}) = lower({t}) THEN 0.3::DOUBLE
  WHEN contains(lower({s}), lower({t})) OR contains(lower({t}), lower({s})) THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
  - CASE WHEN lower({o}) = 'dependency' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END"""


def deliveries(spark: SparkSession, at: str) -> DataFrame:
    """chunk rows with a vector that can be searched; a chunk may come twice."""
    return table(spark, at, "chunks").where(F.col("embedding").isNotNull() & (F.size("embedding") == SIZE) & ~F.array_contains("embedding", F.lit(float("nan")).cast("float")))


def usable(spark: SparkSession, at: str) -> DataFrame:
    """The same, each chunk once."""
    return deliveries(spark, at).dropDuplicates(["chunk_id"])


def _asked(spark: SparkSession, at: str) -> tuple[list[float], str]:
    row = deliveries(spark, at).orderBy("chunk_id").select("embedding", "symbol_name").first()
    return ([], "") if row is None else (list(row[0]), row[1])


_Q = f"WITH u AS {_USABLE}, q AS (SELECT embedding AS qe, symbol_name AS qs FROM u ORDER BY chunk_id LIMIT 1)"


@query(f"{_Q} SELECT chunk_id, round(raw, 6) AS similarity FROM (SELECT u.chunk_id, {_SIM.format('u.embedding', 'q.qe')} AS raw FROM u, q) ORDER BY raw DESC, chunk_id LIMIT 10")
def q_vector_topk(spark, at):
    vector, _ = _asked(spark, at)
    return ranking.nearest(deliveries(spark, at), vector, 10, "embedding", ["chunk_id"], "chunk_id").select("chunk_id", F.round("raw", 6).alias("similarity"))


def _two_stage(text: str, k: int) -> str:
    return f"""{_Q}, near AS (SELECT u.chunk_id, u.symbol_name, u.origin, {_SIM.format('u.embedding', 'q.qe')} AS raw FROM u, q ORDER BY raw DESC, chunk_id LIMIT {ranking.width(k)}),
  scored AS (SELECT near.*, {_SCORE.format(raw='raw', s='symbol_name', t=text, o='origin')} AS score FROM near, q)
  SELECT chunk_id, round(raw, 6) AS similarity, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, raw DESC, chunk_id) AS rank FROM scored ORDER BY score DESC, raw DESC, chunk_id LIMIT {k}"""


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("chunk_id", F.round("raw", 6).alias("similarity"), F.round("score", 6).alias("score"), _big("rank", "rank"))


@query(_two_stage("qs", 10))
def q_search_boosted(spark, at):
    vector, name = _asked(spark, at)
    return _ranked(ranking.search(deliveries(spark, at), vector, name, 10, ["chunk_id"], distinct="chunk_id"))


@query(_two_stage("NULL::VARCHAR", 10))
def q_search_no_text(spark, at):
    vector, _ = _asked(spark, at)
    return _ranked(ranking.search(deliveries(spark, at), vector, None, 10, ["chunk_id"], distinct="chunk_id"))


@query(
    f"""{_Q}, all_rows AS (SELECT u.chunk_id, u.symbol_name, u.origin, {_SIM.format('u.embedding', 'q.qe')} AS raw FROM u, q), near AS (SELECT * FROM all_rows ORDER BY raw DESC, chunk_id LIMIT {ranking.width(5)}),
  two AS (SELECT chunk_id, {_SCORE.format(raw='raw', s='symbol_name', t="'e'", o='origin')} AS score, raw FROM near ORDER BY score DESC, raw DESC, chunk_id LIMIT 5),
  one AS (SELECT chunk_id, {_SCORE.format(raw='raw', s='symbol_name', t="'e'", o='origin')} AS score, raw FROM all_rows ORDER BY score DESC, raw DESC, chunk_id LIMIT 5)
  SELECT coalesce(two.chunk_id, one.chunk_id) AS chunk_id, two.chunk_id IS NOT NULL AS two_stage, one.chunk_id IS NOT NULL AS one_stage FROM two FULL JOIN one ON two.chunk_id = one.chunk_id"""
)
def q_search_window(spark, at):
    """Which rows the first stage's window keeps out of the best 5."""
    vector, _ = _asked(spark, at)
    rows = deliveries(spark, at)
    two = ranking.search(rows, vector, "e", 5, ["chunk_id"], distinct="chunk_id").select("chunk_id", F.lit(True).alias("two"))
    scored = rows.withColumn("raw", vectors.similarity(F.col("embedding"), vectors.literal(vector))).drop("embedding").dropDuplicates(["chunk_id"])
    scored = scored.withColumn("score", ranking.score(F.col("raw"), F.col("symbol_name"), F.lit("e"), F.lower("origin") == "dependency"))
    one = scored.orderBy(F.desc("score"), F.desc("raw"), "chunk_id").limit(5).select("chunk_id", F.lit(True).alias("one"))
    return two.join(one, "chunk_id", "full").select("chunk_id", F.coalesce("two", F.lit(False)).alias("two_stage"), F.coalesce("one", F.lit(False)).alias("one_stage"))


def _multi(spark, at) -> DataFrame:
    rows = usable(spark, at).withColumn("dependency", F.coalesce(F.lower("origin") == "dependency", F.lit(False)))
    asked = rows.where(F.col("chunk_id") % 100 == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("symbol_name").alias("query_text"))
    return ranking.search_many(rows, asked, 5, "chunk_id", "query_id", "query_vector", "query_text", dependency="dependency")


_MULTI = f"""u AS {_USABLE}, q AS (SELECT chunk_id AS query_id, embedding AS qe, symbol_name AS qs FROM u WHERE chunk_id % 100 = 0),
  pairs AS (SELECT query_id, qs, u.*, {_SIM.format('u.embedding', 'q.qe')} AS raw FROM u, q),
  near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS place FROM pairs) WHERE place <= {ranking.width(5)}),
  scored AS (SELECT *, {_SCORE.format(raw='raw', s='symbol_name', t='qs', o='origin')} AS score FROM near),
  ranked AS (SELECT query_id, chunk_id, raw, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, raw DESC, chunk_id) AS rank FROM scored)"""


@query(f"WITH {_MULTI} SELECT query_id, chunk_id, round(raw, 6) AS similarity, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5")
def q_search_multi(spark, at):
    return _multi(spark, at).select("query_id", "chunk_id", F.round("raw", 6).alias("similarity"), F.round("score", 6).alias("score"), _big("rank", "rank"))


@query(
    f"""WITH {_MULTI}, judged AS (SELECT r.query_id, q.kind, r.rank, (a.repo = q.repo)::DOUBLE AS same FROM ranked r JOIN u a ON a.chunk_id = r.chunk_id JOIN u q ON q.chunk_id = r.query_id WHERE rank <= 3),
  hits AS (SELECT kind, query_id, sum(coalesce(same, 0)) AS hits FROM judged GROUP BY ALL)
  SELECT kind, count(*) AS queries, round(avg(hits / 3), 6) AS precision, round(avg((hits > 0)::INT::DOUBLE), 6) AS answered FROM hits GROUP BY kind"""
)
def q_precision_at_3(spark, at):
    facts = usable(spark, at).select("chunk_id", "repo", "kind")
    judged = _multi(spark, at).join(facts.select("chunk_id", F.col("repo").alias("found_repo")), "chunk_id").join(facts.select(F.col("chunk_id").alias("query_id"), "repo", "kind"), "query_id")
    return evaluation.precision_at(judged.withColumn("same", (F.col("repo") == F.col("found_repo")).cast("double")), "same", 3, "query_id", "kind")


@query(f"SELECT repo, count(*) AS usable_chunks FROM {_USABLE} GROUP BY repo")
def q_embedded_only(spark, at):
    return usable(spark, at).groupBy("repo").agg(F.count("*").alias("usable_chunks"))


@query(f"SELECT chunk_id, round(embedding[1]::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x*x))), 1e-12::DOUBLE), 6) AS first, round(embedding[{SIZE}]::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x*x))), 1e-12::DOUBLE), 6) AS last FROM {_USABLE}")
def q_l2_normalize(spark, at):
    return usable(spark, at).withColumn("n", vectors.normalised(F.col("embedding"))).select("chunk_id", F.round(F.get("n", F.lit(0)), 6).alias("first"), F.round(F.get("n", F.lit(SIZE - 1)), 6).alias("last"))


@query(f"SELECT repo, kind, pos, round(avg(x), 6) AS mean FROM (SELECT repo, kind, unnest(embedding)::DOUBLE AS x, unnest(range({SIZE})) AS pos FROM {_USABLE}) GROUP BY ALL")
def q_mean_pool(spark, at):
    return usable(spark, at).select("repo", "kind", F.posexplode(vectors.doubles(F.col("embedding"))).alias("pos", "x")).groupBy("repo", "kind", _big("pos", "pos")).agg(F.round(F.avg("x"), 6).alias("mean"))


@query(
    f"""WITH t AS (SELECT chunk_id, unnest(range(12)) AS token, embedding FROM {_USABLE}), m AS (SELECT chunk_id, list_slice(embedding, token * 8 + 1, token * 8 + 8)::DOUBLE[] AS v, (embedding[token * 8 + 1] > 0)::INT AS keep FROM t),
  x AS (SELECT chunk_id, unnest(range(8)) AS pos, unnest(v) AS x, keep FROM m)
  SELECT chunk_id, pos::BIGINT AS pos, round(sum(x * keep) / greatest(sum(keep), 1e-9::DOUBLE), 6) AS mean FROM x GROUP BY ALL"""
)
def q_masked_pool(spark, at):
    """Each vector as twelve tokens of eight numbers, of which those that begin above zero count."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda t: F.slice("embedding", t * 8 + 1, F.lit(8)))
    mask = F.transform(tokens, lambda v: (F.get(v, F.lit(0)) > 0).cast("int"))
    pooled = usable(spark, at).select("chunk_id", vectors.masked_mean(tokens, mask, 8).alias("mean"))
    return pooled.select("chunk_id", F.posexplode("mean").alias("pos", "mean")).select("chunk_id", _big("pos", "pos"), F.round("mean", 6).alias("mean"))


# -- paths, discovery, ownership

@query(f"""SELECT file_id, {_PATH.format('file_path')} AS path, {_EXTENSION.format(_PATH.format('file_path'))} AS extension, CASE WHEN {_EXTENSION.format(_PATH.format('file_path'))} = 'rs' THEN 'rust'
  WHEN list_contains({_DEFAULT.format("'cpp'")}, {_EXTENSION.format(_PATH.format('file_path'))}) THEN 'cpp' END AS language FROM source_files""")  # fmt: skip
def q_ext_filter(spark, at):
    path = p.normal_path(F.col("file_path"))
    return table(spark, at, "source_files").select("file_id", path.alias("path"), p.extension(path).alias("extension"), p.path_language(path).alias("language"))


@query(rf"""WITH f AS (SELECT file_id, {_PATH.format('file_path')} AS path FROM source_files) SELECT file_id, CASE WHEN regexp_replace(path, '^src/', '') IN ('lib.rs', 'main.rs') THEN 'crate'
  ELSE concat('crate::', replace(regexp_replace(regexp_replace(regexp_replace(path, '^src/', ''), '\.rs$', ''), '/mod$', ''), '/', '::')) END AS module_path,
  coalesce(nullif(regexp_extract(path, '([^/]*?)(\.[^./]*)?$', 1), ''), '_') AS module_name FROM f""")  # fmt: skip
def q_module_path(spark, at):
    path = p.normal_path(F.col("file_path"))
    return table(spark, at, "source_files").select("file_id", p.module_path(path).alias("module_path"), p.module_name(path).alias("module_name"))


@query(r"""WITH l AS (SELECT chunk_id, indexed_at, string_split(embedding_text, chr(10))[1] AS line FROM chunks) SELECT chunk_id, indexed_at, CASE WHEN line NOT LIKE '// %' THEN '' WHEN contains(substr(line, 4), ' (') THEN regexp_extract(line, '^// (.*) \(', 1) ELSE substr(line, 4) END AS module FROM l""")
def q_extract_module(spark, at):
    return table(spark, at, "chunks").select("chunk_id", "indexed_at", p.extract_module(F.col("embedding_text")).alias("module"))


_CLAIMS = f"""r AS (SELECT DISTINCT repo, source_ord, lower(source_language) AS language, {_ROOT.format(_PATH.format('root'))} AS root, coalesce(list_transform(extensions, lambda x: lower(x)), {_DEFAULT.format('lower(source_language)')}) AS extensions FROM sources WHERE NOT coalesce(dep, false) AND root IS NOT NULL),
  f AS (SELECT DISTINCT repo, {_PATH.format('file_path')} AS path FROM source_files),
  c AS (SELECT f.repo, f.path, r.source_ord, r.language FROM f JOIN r ON f.repo = r.repo WHERE (r.root = '' OR f.path = r.root OR starts_with(f.path, r.root || '/')) AND list_contains(r.extensions, {_EXTENSION.format('f.path')}))"""


@query(f"WITH {_CLAIMS} SELECT repo, path, min(source_ord)::BIGINT AS source_ord, arg_min(language, source_ord) AS language FROM c GROUP BY repo, path")
def q_discover_first_wins(spark, at):
    claimed = discovery.claims(table(spark, at, "source_files"), table(spark, at, "sources"), "repo", "file_path")
    return discovery.discovered(claimed).select("repo", "path", _big("source_ord", "source_ord"), "language")


@query(f"WITH {_CLAIMS} SELECT repo, count(*) AS claims, count(DISTINCT path) AS files, count(DISTINCT source_ord) AS claiming_sources FROM c GROUP BY repo")
def q_discover_claims(spark, at):
    claimed = discovery.claims(table(spark, at, "source_files"), table(spark, at, "sources"), "repo", "file_path")
    return claimed.groupBy("repo").agg(F.count("*").alias("claims"), F.count_distinct("path").alias("files"), F.count_distinct("source_ord").alias("claiming_sources"))


@query(f"""WITH r AS (SELECT repo, source_ord, coalesce(dep, false) AS dep, {_ROOT.format(_PATH.format('root'))} AS root, list_intersect(coalesce(list_transform(extensions, lambda x: lower(x)), {_DEFAULT.format('lower(source_language)')}), {_DEFAULT.format('lower(source_language)')}) AS extensions FROM sources),
  f AS (SELECT DISTINCT file_id, repo, {_PATH.format('file_path')} AS path FROM source_files),
  c AS (SELECT f.file_id, r.source_ord, r.dep FROM f JOIN r ON f.repo = r.repo WHERE (r.root = '' OR f.path = r.root OR starts_with(f.path, r.root || '/')) AND list_contains(r.extensions, {_EXTENSION.format('f.path')})),
  b AS (SELECT file_id, min(source_ord) AS o, arg_min(dep, (source_ord, dep)) AS dep FROM c GROUP BY file_id)
  SELECT f.file_id, b.o::BIGINT AS owner_ord, b.dep AS owner_dep FROM f LEFT JOIN b ON f.file_id = b.file_id""")  # fmt: skip
def q_ownership(spark, at):
    owned = with_owner(table(spark, at, "source_files").select("file_id", "repo", "file_path").distinct(), table(spark, at, "sources"))
    return owned.select("file_id", _big("owner_ord", "owner_ord"), "owner_dep")


# -- code text

@query(r"""SELECT chunk_id, indexed_at, CASE WHEN m = 'pub' THEN 'Pub' WHEN m LIKE 'pub%' AND contains(m, 'crate') THEN 'PubCrate' WHEN m LIKE 'pub%' AND contains(m, 'super') THEN 'PubSuper' ELSE 'Private' END AS parsed,
  coalesce(CASE visibility WHEN 'Pub' THEN 0 WHEN 'PubCrate' THEN 1 WHEN 'PubSuper' THEN 2 WHEN 'Private' THEN 3 END, 4)::BIGINT AS rank, coalesce(CASE visibility WHEN 'Pub' THEN 'pub ' WHEN 'PubCrate' THEN 'pub(crate) ' WHEN 'PubSuper' THEN 'pub(super) ' ELSE '' END, '') AS prefix
  FROM (SELECT *, trim(regexp_extract(coalesce(signature, ''), '^(pub(\([^)]*\))?)?', 0)) AS m FROM chunks)""")  # fmt: skip
def q_visibility(spark, at):
    modifier = F.regexp_extract(F.coalesce("signature", F.lit("")), r"^(pub(\([^)]*\))?)?", 0)
    v = F.col("visibility")
    return table(spark, at, "chunks").select("chunk_id", "indexed_at", ct.visibility(modifier).alias("parsed"), _big(ct.visibility_rank(v), "rank"), ct.visibility_prefix(v).alias("prefix"))


@query(r"""SELECT chunk_id, indexed_at, regexp_replace(CASE WHEN contains(display_text, '{') THEN string_split(display_text, '{')[1] ELSE string_split(display_text, chr(10))[1] END, '^\s+|\s+$', '', 'g') AS signature, trim(string_split(display_text, chr(10))[1], ' ') AS first_line,
  trim(string_split(symbol_name, '<')[1], ' ') AS base_type, nullif(regexp_extract(symbol_name, '^(?:::)*(.*)::[^:]*$', 1), '') AS owner, string_split(symbol_name, '::')[-1] AS name, concat_ws('::', nullif(repo, ''), symbol_name) AS qualified FROM chunks""")  # fmt: skip
def q_code_text(spark, at):
    text, name = F.col("display_text"), F.col("symbol_name")
    return table(spark, at, "chunks").select(
        "chunk_id", "indexed_at", ct.signature(text).alias("signature"), ct.first_line(text).alias("first_line"), ct.base_type(name).alias("base_type"), ct.owner_of(name).alias("owner"), ct.name_of(name).alias("name"), ct.qualified(F.col("repo"), name).alias("qualified")
    )


@query("SELECT repo, kind, count(*) AS chunks, sum(CASE WHEN line_end - line_start + 1 > 5 THEN 1 ELSE 0 END)::BIGINT AS large_chunks, max(line_end - line_start + 1)::BIGINT AS most_lines FROM chunks GROUP BY repo, kind")
def q_line_chunks(spark, at):
    n = ct.line_count(F.col("line_start"), F.col("line_end"))
    return table(spark, at, "chunks").groupBy("repo", "kind").agg(F.count("*").alias("chunks"), _big(F.sum(F.when(n > 5, 1).otherwise(0)), "large_chunks"), _big(F.max(n), "most_lines"))


@query(
    """WITH m AS (SELECT DISTINCT repo, file_path, parent, chunk_id, symbol_name, line_start, line_end FROM chunks WHERE parent IS NOT NULL)
  SELECT repo, file_path, parent, min(line_start)::BIGINT AS line_start, max(line_end)::BIGINT AS line_end, count(*) AS methods, string_agg(symbol_name, ',' ORDER BY line_start, chunk_id) AS names FROM m GROUP BY ALL"""
)
def q_type_groups(spark, at):
    m = table(spark, at, "chunks").where(F.col("parent").isNotNull()).select("repo", "file_path", "parent", "chunk_id", "symbol_name", "line_start", "line_end").distinct()
    start, end = build.hull(F.lit(True), F.col("line_start"), F.col("line_end"))
    members = build.ordered(F.lit(True), [F.col("line_start"), F.col("chunk_id")], F.col("symbol_name"))
    return m.groupBy("repo", "file_path", "parent").agg(_big(start, "line_start"), _big(end, "line_end"), F.count("*").alias("methods"), F.array_join(F.transform(members, lambda x: x["symbol_name"]), ",").alias("names"))


@query(
    """WITH c AS (SELECT chunk_id, any_value(repo) AS repo, any_value(file_path) AS file_path, any_value(chunk_ord) AS chunk_ord, any_value(display_text) AS display_text,
    coalesce(CASE any_value(visibility) WHEN 'Pub' THEN 0 WHEN 'PubCrate' THEN 1 WHEN 'PubSuper' THEN 2 WHEN 'Private' THEN 3 END, 4) AS rank FROM chunks WHERE chunk_type = 'Overview' GROUP BY chunk_id)
  SELECT repo, file_path, count(*) AS parts, string_agg(display_text, chr(10) || chr(10) ORDER BY rank, chunk_ord, display_text) AS overview FROM c WHERE display_text IS NOT NULL GROUP BY repo, file_path"""
)
def q_overview(spark, at):
    return ov.overviews(table(spark, at, "chunks"), ["repo", "file_path"], ["chunk_ord"])


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT repo, file_path FROM source_files)) AS files_indexed, (SELECT count(DISTINCT chunk_id) FROM chunks) AS chunks_created")
def q_index_result(spark, at):
    return ov.index_result(table(spark, at, "source_files"), table(spark, at, "chunks").select("chunk_id").distinct(), ["repo", "file_path"])


@query(
    """WITH c AS (SELECT DISTINCT repo, file_path, chunk_id FROM chunks), s AS (SELECT repo, count(DISTINCT file_id) AS files, sum(DISTINCT 0)::BIGINT AS zero FROM source_files GROUP BY repo)
  SELECT s.repo, s.files, coalesce(n.chunks, 0) AS chunks, coalesce(n.chunked_files, 0) AS chunked_files, round(coalesce(n.chunks, 0) / s.files::DOUBLE, 6) AS chunks_per_file
  FROM s LEFT JOIN (SELECT repo, count(*) AS chunks, count(DISTINCT file_path) AS chunked_files FROM c GROUP BY repo) n ON s.repo = n.repo"""
)
def q_scale_stats(spark, at):
    files = table(spark, at, "source_files").groupBy("repo").agg(F.count_distinct("file_id").alias("files"))
    chunks = table(spark, at, "chunks").select("repo", "file_path", "chunk_id").distinct().groupBy("repo").agg(F.count("*").alias("chunks"), F.count_distinct("file_path").alias("chunked_files"))
    j = files.join(chunks, "repo", "left").fillna(0, ["chunks", "chunked_files"])
    return j.withColumn("chunks_per_file", F.round(F.col("chunks") / F.col("files").cast("double"), 6))


# -- changes and maintenance

_LINES = """s AS (SELECT repo, CASE WHEN sha256 = repeat('0', 64) THEN 'D' || chr(9) || file_path WHEN substr(sha256, 1, 1) < '4' THEN 'M' || chr(9) || file_path WHEN substr(sha256, 1, 1) < '8' THEN 'A' || chr(9) || file_path
  WHEN substr(sha256, 1, 1) < 'c' THEN 'R90' || chr(9) || file_path || chr(9) || file_path || '.new' WHEN substr(sha256, 1, 1) < 'e' THEN 'C75' || chr(9) || file_path || chr(9) || file_path || '.copy' ELSE 'T' || chr(9) || file_path END AS line FROM dirty_snapshot)"""


def _status_lines(spark, at) -> DataFrame:
    d = table(spark, at, "dirty_snapshot")
    first, path = F.substring("sha256", 1, 1), F.col("file_path")
    joined = lambda *x: F.concat_ws("\t", *[F.lit(y) if isinstance(y, str) else y for y in x])
    line = (
        F.when(F.col("sha256") == maintenance.DELETED, joined("D", path)).when(first < "4", joined("M", path)).when(first < "8", joined("A", path)).when(first < "c", joined("R90", path, F.concat(path, F.lit(".new"))))
        .when(first < "e", joined("C75", path, F.concat(path, F.lit(".copy")))).otherwise(joined("T", path))
    )
    return d.select("repo", line.alias("line"))


@query(
    f"""WITH {_LINES}, f AS (SELECT repo, string_split(line, chr(9)) AS f FROM s)
  SELECT repo, f[2] AS path, CASE substr(f[1], 1, 1) WHEN 'A' THEN 'added' WHEN 'M' THEN 'modified' ELSE 'deleted' END AS change FROM f WHERE substr(f[1], 1, 1) IN ('A', 'M', 'D', 'R')
  UNION ALL SELECT repo, f[3], 'added' FROM f WHERE substr(f[1], 1, 1) IN ('R', 'C')"""
)
def q_name_status(spark, at):
    return _status_lines(spark, at).select("repo", F.inline(ct.status_changes(F.col("line"))))


@query("SELECT repo, file_path AS path, CASE WHEN contains(rest, ' -> ') THEN string_split(rest, ' -> ')[-1] ELSE rest END AS changed FROM (SELECT repo, file_path, substr(' M ' || file_path, 4) AS rest FROM dirty_snapshot)")
def q_porcelain(spark, at):
    return table(spark, at, "dirty_snapshot").select("repo", F.col("file_path").alias("path"), ct.porcelain_path(F.concat(F.lit(" M "), "file_path")).alias("changed"))


@query("SELECT DISTINCT file_id, repo, sha256(file_text) AS sha256 FROM source_files")
def q_content_hash(spark, at):
    return table(spark, at, "source_files").select("file_id", "repo", F.sha2("file_text", 256).alias("sha256")).distinct()


def _indexed_hashes(spark, at) -> DataFrame:
    return table(spark, at, "source_files").select("repo", "file_path", F.sha2("file_text", 256).alias("sha256")).distinct()


@query(
    """WITH h AS (SELECT DISTINCT repo, file_path, sha256(file_text) AS h FROM source_files)
  SELECT d.repo, d.file_path, d.sha256 FROM dirty_snapshot d LEFT JOIN h ON d.repo = h.repo AND d.file_path = h.file_path WHERE h.repo IS NULL OR d.sha256 IS DISTINCT FROM h.h"""
)
def q_dirty_changed(spark, at):
    return maintenance.dirty_changed(table(spark, at, "dirty_snapshot"), _indexed_hashes(spark, at), ["repo", "file_path"])


def _late_files(spark, at) -> DataFrame:
    """Files scanned after their repository was last indexed."""
    last = table(spark, at, "git_states").groupBy("repo").agg(F.max("indexed_at").alias("last"))
    return table(spark, at, "source_files").join(last, "repo").where(F.col("scanned_at") > F.col("last")).select("repo", "file_path").distinct()


_LATE = "late AS (SELECT DISTINCT f.repo, f.file_path FROM source_files f JOIN (SELECT repo, max(indexed_at) AS last FROM git_states GROUP BY repo) g ON f.repo = g.repo WHERE f.scanned_at > g.last)"


@query(
    f"""WITH {_LATE}, now AS (SELECT repo, file_path FROM dirty_snapshot WHERE substr(sha256, 1, 1) < '8')
  SELECT DISTINCT repo, file_path FROM dirty_snapshot d WHERE NOT EXISTS (SELECT 1 FROM now n WHERE n.repo = d.repo AND n.file_path = d.file_path) AND NOT EXISTS (SELECT 1 FROM late l WHERE l.repo = d.repo AND l.file_path = d.file_path)"""
)
def q_reverted(spark, at):
    before = table(spark, at, "dirty_snapshot")
    return maintenance.reverted(before, before.where(F.substring("sha256", 1, 1) < "8"), _late_files(spark, at), ["repo", "file_path"])


@query(f"WITH {_LATE} SELECT repo, file_path FROM late UNION SELECT repo, file_path FROM dirty_snapshot WHERE sha256 <> repeat('0', 64)")
def q_reindex_set(spark, at):
    alive = table(spark, at, "dirty_snapshot").where(F.col("sha256") != maintenance.DELETED)
    return maintenance.reindex_set(["repo", "file_path"], _late_files(spark, at), alive)


@query("SELECT DISTINCT repo, file_path FROM dirty_snapshot WHERE sha256 = repeat('0', 64)")
def q_remove_set(spark, at):
    return maintenance.reindex_set(["repo", "file_path"], table(spark, at, "dirty_snapshot").where(F.col("sha256") == maintenance.DELETED))


@query(
    f"""WITH {_LATE}, c AS (SELECT DISTINCT chunk_id, repo, file_path, kind FROM chunks), fresh AS (SELECT DISTINCT -f.file_id AS chunk_id, f.repo, f.file_path, 'Module' AS kind FROM source_files f JOIN late l ON f.repo = l.repo AND f.file_path = l.file_path)
  SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM late l WHERE l.repo = c.repo AND l.file_path = c.file_path) UNION ALL SELECT * FROM fresh"""
)
def q_patch_index(spark, at):
    """The chunk table after the changed files' chunks went and one row of each such file came."""
    late = _late_files(spark, at)
    chunks = table(spark, at, "chunks").select("chunk_id", "repo", "file_path", "kind").distinct()
    fresh = table(spark, at, "source_files").join(late, ["repo", "file_path"], "left_semi").select((-F.col("file_id")).alias("chunk_id"), "repo", "file_path", F.lit("Module").alias("kind")).distinct()
    return maintenance.patched(chunks, late, fresh, ["repo", "file_path"])


@query("SELECT g.repo, g.git_root, g.last_indexed_commit, g.indexed_at FROM git_states g WHERE EXISTS (SELECT 1 FROM sources s WHERE s.repo = g.repo AND NOT coalesce(s.dep, false))")
def q_prune_states(spark, at):
    active = table(spark, at, "sources").where(~F.coalesce("dep", F.lit(False)))
    return maintenance.kept_states(table(spark, at, "git_states"), active, ["repo"]).select("repo", "git_root", "last_indexed_commit", "indexed_at")


@query("SELECT repo, arg_max(last_indexed_commit, indexed_at) AS last_indexed_commit, max(indexed_at) AS indexed_at FROM git_states GROUP BY repo")
def q_latest_state(spark, at):
    return maintenance.latest(table(spark, at, "git_states"), ["repo"], "indexed_at").select("repo", "last_indexed_commit", "indexed_at")


@query("SELECT repo, coalesce(arg_max(embedding_model, indexed_at), 'default') AS embedding_model, count(*) AS layers FROM git_states GROUP BY repo")
def q_config_merge(spark, at):
    """U5 as columns: the latest layer that names a model wins."""
    return maintenance.merged_layers(table(spark, at, "git_states"), ["repo"], "indexed_at", embedding_model="default")


@query("WITH m AS (SELECT repo, coalesce(arg_max(embedding_model, indexed_at), 'default') AS model FROM git_states GROUP BY repo), c AS (SELECT repo, count(DISTINCT chunk_id) AS chunks FROM chunks GROUP BY repo) SELECT c.repo, c.chunks, m.model IS DISTINCT FROM 'mica-embed-v2' AS stale FROM c LEFT JOIN m ON c.repo = m.repo")
def q_stale_repos(spark, at):
    """Which repositories need a full rebuild because their model is another."""
    chunks = table(spark, at, "chunks").groupBy("repo").agg(F.count_distinct("chunk_id").alias("chunks"))
    j = chunks.join(q_config_merge(spark, at).select("repo", "embedding_model"), "repo", "left")
    return j.select("repo", "chunks", maintenance.stale(j, "mica-embed-v2").alias("stale"))


@query("WITH c AS (SELECT DISTINCT repo, chunk_id FROM chunks), n AS (SELECT repo, (row_number() OVER (PARTITION BY repo ORDER BY chunk_id) - 1) // 64 AS batch FROM c) SELECT repo, batch::BIGINT AS batch, count(*) AS texts FROM n GROUP BY ALL")
def q_batches(spark, at):
    """B1, M8: the batches of 64 in which a repository's chunks are embedded."""
    c = embedding.batches(table(spark, at, "chunks").select("repo", "chunk_id").distinct(), ["repo"], ["chunk_id"])
    return c.groupBy("repo", _big("batch", "batch")).agg(F.count("*").alias("texts"))


@query("SELECT CASE WHEN starts_with(a, here || '/') THEN substr(a, length(here) + 2) ELSE a END AS file_key, repo, file_path FROM (SELECT DISTINCT '/srv/mirror/' || s.repo || '/' || s.file_path AS a, '/srv/mirror/' || s.repo AS here, repo, file_path FROM source_files s)")
def q_file_key(spark, at):
    root = F.concat(F.lit("/srv/mirror/"), "repo")
    return table(spark, at, "source_files").select("repo", "file_path").distinct().select(p.file_key(root, F.col("file_path"), root).alias("file_key"), "repo", "file_path")


@query(
    """WITH e AS (SELECT DISTINCT file_id, file_text, scanned_at FROM source_files) SELECT file_id, max(scanned_at) AS at, length(arg_max(file_text, scanned_at))::BIGINT AS characters FROM e GROUP BY file_id"""
)
def q_latest_events(spark, at):
    """The stream's batch step over the deliveries of source files: the last one of each file."""
    events = table(spark, at, "source_files").select(F.col("file_id").cast("string").alias("file_key"), F.lit("modified").alias("change"), F.col("file_text").alias("text"), p.path_language(F.col("file_path")).alias("language"), F.col("scanned_at").alias("at"))
    return latest_events(events).select(F.col("file_key").cast("bigint").alias("file_id"), "at", _big(F.length("text"), "characters"))


def _chunked_files(spark, at) -> tuple[DataFrame, DataFrame]:
    """The source files, each once, and their chunks."""
    files = table(spark, at, "source_files").select("repo", "file_id", p.normal_path(F.col("file_path")).alias("path"), "file_text").withColumn("language", p.path_language(F.col("path")))
    first = table(spark, at, "source_files").groupBy("file_id").agg(F.min("scanned_at").alias("scanned_at"))  # texts of later deliveries are the same
    once = spread(table(spark, at, "source_files").select("repo", "file_id", "file_path", "file_text", "scanned_at")).join(first, ["file_id", "scanned_at"], "left_semi").select("repo", "file_id", p.normal_path(F.col("file_path")).alias("path"), "file_text")
    once = once.withColumn("language", p.path_language(F.col("path")))
    return files, build.chunk_files(once, ["repo", "file_id"], "path", "file_text", "language")


@query()
def q_chunk_files(spark, at):
    _, chunks = _chunked_files(spark, at)
    return chunks.select("repo", "file_id", "chunk_ord", "symbol_name", "kind", "chunk_type", "parent", "visibility", "line_start", "line_end", "signature", "doc_comment", F.length("display_text").alias("display_length"), F.length("embedding_text").alias("embedding_length"))


@query(
    rf"""WITH f AS (SELECT DISTINCT file_id, {_PATH.format('file_path')} AS path FROM source_files)
  SELECT file_id, coalesce(nullif(regexp_extract(path, '([^/]*?)(\.[^./]*)?$', 1), ''), '_') AS symbol_name, '// ' || path AS first_line, 0::BIGINT AS chunk_ord, 0::BIGINT AS line_start, 0::BIGINT AS line_end FROM f WHERE {_EXTENSION.format('path')} <> 'rs'"""
)
def q_skeletons(spark, at):
    """One skeleton a C++ file, the first of its chunks."""
    _, chunks = _chunked_files(spark, at)
    mine = chunks.where((F.col("language") == "cpp") & (F.col("kind") == "Module"))
    return mine.select("file_id", "symbol_name", ct.first_line(F.col("display_text")).alias("first_line"), _big("chunk_ord", "chunk_ord"), _big("line_start", "line_start"), _big("line_end", "line_end"))


@query("SELECT DISTINCT file_id, 0::BIGINT AS misplaced, 0::BIGINT AS short, 0::BIGINT AS outside, 0::BIGINT AS unnumbered FROM source_files")
def q_chunk_places(spark, at):
    """What must hold of each file's chunks: a function's text stands at its rows and has more than five, methods lie within their type's hull, numbers run from 0."""
    files, chunks = _chunked_files(spark, at)
    lines = F.split(F.regexp_replace("file_text", "\r\n", "\n"), "\n")
    texts = files.select(F.col("file_id").alias("id"), lines.alias("lines")).dropDuplicates(["id"])
    function = F.col("chunk_type") == "Function"
    shown = F.split(F.regexp_replace("display_text", "\r\n", "\n"), "\n")
    rows = ct.line_count(F.col("line_start"), F.col("line_end"))
    framed = F.col("parent").isNotNull() & (F.col("language") == "rust")  # behind the header of its impl, before a closing brace
    skip = F.when(framed, F.size(shown) - rows - 1).otherwise(F.size(shown) - rows)
    same = F.forall(F.zip_with(F.slice(shown, skip + 1, rows), F.slice("lines", F.col("line_start") + 1, rows), lambda a, b: F.coalesce(F.endswith(F.rtrim(b), F.trim(a)) | F.startswith(F.ltrim(b), F.trim(a)) | F.contains(b, F.trim(a)), F.lit(False))), lambda x: x)
    hulls = chunks.where((F.col("chunk_type") == "Overview") & (F.col("kind") != "Module")).select("file_id", F.col("symbol_name").alias("parent"), F.col("line_start").alias("first"), F.col("line_end").alias("last"))
    j = chunks.join(texts, F.col("file_id") == F.col("id")).join(hulls, ["file_id", "parent"], "left")
    counted = j.groupBy("file_id").agg(
        F.sum((function & ~same).cast("bigint")).alias("misplaced"), F.sum((function & (rows <= build.LARGE)).cast("bigint")).alias("short"),
        F.sum(F.coalesce((F.col("line_start") < F.col("first")) | (F.col("line_end") > F.col("last")), F.lit(False)).cast("bigint")).alias("outside"),
        (F.max("chunk_ord") + 1 - F.count_distinct("chunk_ord")).cast("bigint").alias("unnumbered"),
    )
    return files.select("file_id").distinct().join(counted, "file_id", "left").fillna(0)


@query()
def q_hash_embed(spark, at):
    first = table(spark, at, "chunks").groupBy("chunk_id").agg(F.min("indexed_at").alias("indexed_at"))  # later deliveries are equal
    texts = spread(table(spark, at, "chunks").select("chunk_id", "indexed_at", "embedding_text")).join(first, ["chunk_id", "indexed_at"], "left_semi")
    made = embedding.with_embeddings(texts.select("chunk_id", "embedding_text"), into="vector")
    return made.select("chunk_id", F.size("vector").alias("numbers"), F.round(vectors.norm(vectors.doubles(F.col("vector"))), 4).alias("length"))
