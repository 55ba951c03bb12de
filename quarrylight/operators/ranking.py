"""Two-stage vector search.

First the ``max(2k, k + 20)`` nearest rows by raw similarity, then boosts for
the symbol name and a penalty for dependencies, then the best k of those.

A single query goes through ``mapInArrow``: a task multiplies its batches with the
query and keeps its own best rows, each key once; only these few meet, in top-k
plans.  Many queries go in blocks: one block, up to ``block`` queries, is sent to
the tasks that read the table; more of them stay distributed, as a grid of blocks of
queries and parts of the table, each cell a bounded group, and neither passes
through the driver.

Cases: rows with a null vector are left out (F7); k = 0 and empty tables give no
rows (F14); a vector of another length than the query's raises an error; a zero
vector has similarity 0; ties are ordered by similarity and then by the tie
columns; columns of the table that are called like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions import vectors

# Boosts and penalty of the score.
EXACT_BOOST, PARTIAL_BOOST, DEPENDENCY_PENALTY = 0.3, 0.1, 0.1


def width(k: int) -> int:
    """M5: how many candidates the first stage takes."""
    return max(2 * k, k + 20)


def symbol_boost(symbol: Column, text: Column) -> Column:
    """R2: equal names 0.3, one within the other 0.1, case aside; a null text boosts nothing, an empty one is in every name."""
    s, t = F.lower(symbol), F.lower(text)
    return F.coalesce(F.when(s == t, EXACT_BOOST).when(s.contains(t) | t.contains(s), PARTIAL_BOOST), F.lit(0.0))


def penalty(dependency: Column) -> Column:
    """R3."""
    return F.when(F.coalesce(dependency, F.lit(False)), -DEPENDENCY_PENALTY).otherwise(0.0)


def score(raw: Column, symbol: Column, text: Column, dependency: Column) -> Column:
    return raw + symbol_boost(symbol, text) + penalty(dependency)


def similarities(queries: np.ndarray, column: pa.Array) -> np.ndarray:
    """M1 for matrices: the clamped cosines of unit queries (or zeros) and the vectors of an Arrow list column."""
    size = queries.shape[1]
    v = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != size).any():
        raise ValueError(f"a vector has not {size} numbers but {lengths[lengths != size][0]}")
    v = v.reshape(-1, size).astype(np.float64)
    n = np.sqrt((v * v).sum(1))
    return np.clip(queries @ (v / np.where(n > 0, n, 1.0)[:, None]).T, 0.0, 1.0)


def unit(values: np.ndarray) -> np.ndarray:
    q = np.asarray(values, dtype=np.float64)
    return q / np.maximum(np.sqrt((q * q).sum(-1, keepdims=True)), 1e-300)


def _first(rows: pa.Table, ties: list[str], distinct: str | None, take: int) -> pa.Table:
    """The best ``take`` rows by ``raw`` and ties, each value of ``distinct`` once."""
    order = rows.select(["raw", *dict.fromkeys([*ties, *([distinct] if distinct else [])])]).to_pandas()
    if distinct and len(order) > take:  # what is below the raw value of the last key needed can't be taken
        falling = order["raw"].sort_values(ascending=False, kind="stable")
        seen = pd.factorize(order[distinct].to_numpy()[falling.index], use_na_sentinel=False)[0]
        enough = np.flatnonzero(seen >= take - 1)
        if len(enough):
            order = order[order["raw"] >= falling.iloc[enough[0]]]
    elif len(order) > take:
        order = order[order["raw"] >= np.partition(order["raw"].to_numpy(), len(order) - take)[len(order) - take]]
    order = order.sort_values(["raw", *ties], ascending=[False] + [True] * len(ties), kind="stable", na_position="first")
    if distinct:
        order = order.drop_duplicates([distinct])
    return rows.take(pa.array(order.index[:take].to_numpy()))


def nearest(table: DataFrame, query: Sequence[float], take: int, vector: str, ties: list[str], distinct: str | None = None) -> DataFrame:
    """The rows nearest to a query vector, with ``raw`` and without the vector, which is never shuffled.

    ``distinct`` names a key of which only one row counts, the nearest.
    """
    asked = unit(np.array([query]))
    rest = [c for c in table.columns if c not in (vector, "raw")]
    schema = ", ".join(f"`{c}` {t}" for c, t in table.select(*rest).dtypes) + ", raw double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            raw = similarities(asked, b.column(0))[0]
            rows = pa.table([*b.columns[1:], pa.array(raw)], names=[*rest, "raw"])
            held = _first(rows if held is None else pa.concat_tables([held, rows]), ties, distinct, take)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    best = table.where(F.col(vector).isNotNull()).select(vector, *rest).mapInArrow(run, schema)  # `take` rows a task
    order = [F.desc("raw"), *ties]
    if distinct:
        best = best.withColumn("__place", F.row_number().over(Window.partitionBy(distinct).orderBy(*order))).where("__place = 1").drop("__place")
    return best.orderBy(*order).limit(take)


def search(table: DataFrame, query: Sequence[float], text: str | None, k: int, ties: list[str], vector: str = "embedding", symbol: str = "symbol_name", dependency: Column | None = None, distinct: str | None = None) -> DataFrame:
    """The best k rows with ``raw``, ``score`` and ``rank`` (from 1)."""
    if k <= 0:
        return table.drop(vector).limit(0).withColumns({"raw": F.lit(0.0), "score": F.lit(0.0), "rank": F.lit(1)})
    dependency = F.lower(F.col("origin")) == "dependency" if dependency is None else dependency
    window = nearest(table, query, width(k), vector, ties, distinct)
    scored = window.withColumn("score", score(F.col("raw"), F.col(symbol), F.lit(text).cast("string"), dependency))
    best = scored.orderBy(F.desc("score"), F.desc("raw"), *ties).limit(k)
    order = Window.orderBy(F.desc("score"), F.desc("raw"), *ties)  # k rows
    return best.withColumn("rank", F.row_number().over(order))


class _Best:
    """The ``take`` best keys of each query so far; ties go to the lesser keys."""

    def __init__(self, queries: int, take: int) -> None:
        self.take, self.raw, self.keys = take, np.zeros((queries, 0)), np.zeros((queries, 0), object)

    def add(self, raw: np.ndarray, keys: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        raw = np.hstack([self.raw, raw[:, order]])
        keys = np.hstack([self.keys, np.broadcast_to(keys[order], (len(raw), len(order)))])
        n = raw.shape[1]
        if n <= self.take:
            self.raw, self.keys = raw, keys
            return
        top = np.argpartition(-raw, self.take - 1, axis=1)[:, : self.take]
        edge = np.take_along_axis(raw, top, 1).min(1)
        for i in np.flatnonzero((raw >= edge[:, None]).sum(1) > self.take).tolist():  # ties at the edge
            near = np.flatnonzero(raw[i] >= edge[i])
            top[i] = near[np.lexsort((keys[i, near], -raw[i, near]))][: self.take]
        self.raw, self.keys = np.take_along_axis(raw, top, 1), np.take_along_axis(keys, top, 1)


def _candidates(table: DataFrame, queries: DataFrame, take: int, block: int, part: int) -> DataFrame:
    """``q, key, raw``: of each part of the table at least the ``take`` nearest ``key, v`` for each of the queries ``q, v``."""
    kinds = dict(table.dtypes)["key"], dict(queries.dtypes)["q"]
    arrow = to_arrow_type(queries.schema["q"].dataType), to_arrow_type(table.schema["key"].dataType)
    schema = f"q {kinds[1]}, key {kinds[0]}, raw double"

    def rows(ids: list, best: _Best) -> pa.Table:
        asked = pa.array([i for i in ids for _ in range(best.raw.shape[1])], arrow[0])
        return pa.table([asked, pa.array(best.keys.ravel().tolist(), arrow[1]), pa.array(best.raw.ravel())], ["q", "key", "raw"])

    held = queries.limit(block + 1).toPandas()
    if len(held) <= block:
        ids, asked = held["q"].tolist(), unit(np.array(held["v"].tolist())) if len(held) else np.zeros((0, 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(len(ids), take)
            for b in batches:
                best.add(similarities(asked, b.column(1)), np.array(b.column(0).to_pylist(), dtype=object))
            yield from rows(ids, best).to_batches()

        return (table if ids else table.limit(0)).mapInArrow(run, schema)
    blocks, parts = -(-queries.count() // block), max(1, -(-table.count() // part))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, best = left.column("q").to_pylist(), _Best(left.num_rows, take)
        if ids:
            asked = unit(np.array(left.column("v").to_pylist()))
            for b in right.to_batches(max_chunksize=8192):
                best.add(similarities(asked, b.column(right.schema.get_field_index("v"))), np.array(b.column(right.schema.get_field_index("key")).to_pylist(), dtype=object))
        return rows(ids, best)

    spread = lambda df, key, mine, n, other, m: df.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    asked = spread(queries, "q", "block", blocks, "part", parts)
    near = spread(table, "key", "part", parts, "block", blocks)
    return asked.groupBy("block", "part").cogroup(near.groupBy("block", "part")).applyInArrow(cell, schema)


def search_many(
    table: DataFrame, queries: DataFrame, k: int, key: str, query_key: str, query_vector: str, query_text: str | None, vector: str = "embedding", symbol: str = "symbol_name", dependency: str | None = None, block: int = 2_000, part: int = 50_000
) -> DataFrame:
    """R4 for every row of ``queries``: ``query_key, key, raw, score, rank``; the queries are a stated set, taken in blocks of ``block``."""
    take = width(k)
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_key).alias("q"), vectors.doubles(F.col(query_vector)).alias("v"))
    found = _candidates(table.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v")), asked, take, block, part)
    window = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("raw"), "key"))).where(F.col("place") <= take)
    facts = table.select(F.col(key).alias("key"), F.col(symbol).alias("s") if symbol else F.lit(None).cast("string").alias("s"), (F.col(dependency) if dependency else F.lit(False)).alias("d"))
    texts = queries.select(F.col(query_key).alias("q"), (F.col(query_text) if query_text else F.lit(None)).cast("string").alias("t"))
    scored = window.join(facts, "key").join(texts, "q").withColumn("score", score(F.col("raw"), F.col("s"), F.col("t"), F.col("d")))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("raw"), "key"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_key), F.col("key").alias(key), "raw", "score", "rank")
