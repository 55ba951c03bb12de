"""Set logic of index maintenance (J1-J2, J6, J9, D2-D5, I8, I10) as joins of narrow tables.

Every function takes the columns it needs by name; other columns pass through
or are ignored.  Null keys match nothing and are dropped from change sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELETED = "0" * 64  # the content hash of a file that is gone


def _old(df: DataFrame, keys: list[str], value: str | None = None) -> DataFrame:
    return df.select(*[F.col(k).alias(f"__{k}") for k in keys], *([F.col(value).alias("__old")] if value else []))


def _same(keys: list[str]):
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return on


def dirty_changed(current: DataFrame, previous: DataFrame, keys: list[str], hash_: str = "sha256") -> DataFrame:
    """Current dirty files that are new or whose hash differs from before (null hashes equal each other)."""
    old = _old(previous, keys, hash_).dropDuplicates([f"__{k}" for k in keys]).withColumn("__seen", F.lit(True))
    j = current.join(old, _same(keys), "left")
    return j.where(F.col("__seen").isNull() | ~F.col(hash_).eqNullSafe(F.col("__old"))).select(*current.columns)


def reverted(previous: DataFrame, current: DataFrame, committed: DataFrame, keys: list[str]) -> DataFrame:
    """Files that were dirty, are not now, and no commit has touched."""
    gone = previous.select(*keys).distinct().join(_old(current, keys), _same(keys), "left_anti")
    return gone.join(_old(committed, keys), _same(keys), "left_anti")


def reindex_set(keys: list[str], *sources: DataFrame) -> DataFrame:
    """The union of change sets, each key once."""
    out = sources[0].select(*keys)
    for s in sources[1:]:
        out = out.union(s.select(*keys))
    return out.dropna(subset=keys).distinct()


def without(table: DataFrame, affected: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is not affected."""
    return table.join(_old(affected, keys), _same(keys), "left_anti")


def patched(table: DataFrame, affected: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Affected keys lose their rows, then the fresh rows come in; a key without fresh rows is gone."""
    return without(table, affected, keys).unionByName(fresh.select(*table.columns))


def kept_states(states: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    """States of roots that are still active."""
    return states.join(_old(active, keys), _same(keys), "left_semi")


def latest(states: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The state of each key with the greatest order; among equals the greatest row."""
    rest = [c for c in states.columns if c not in keys]
    best = states.groupBy(*keys).agg(F.max(F.struct(F.col(order), *[F.col(c) for c in rest if c != order])).alias("__s"))
    return best.select(*keys, *[F.col(f"__s.{c}").alias(c) for c in rest]).select(*states.columns)


def merged_layers(layers: DataFrame, keys: list[str], order: str, **defaults) -> DataFrame:
    """U5 over rows: per key each named column from the latest layer that sets it, else its default, and ``layers``."""
    last = [F.coalesce(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))), F.lit(value)).alias(c) for c, value in defaults.items()]
    return layers.groupBy(*keys).agg(*last, F.count("*").alias("layers"))


def stale(states: DataFrame, model: str, column: str = "embedding_model") -> Column:
    """Whether rows built with another model, or with none known, have to be built again."""
    return ~states[column].eqNullSafe(F.lit(model))
