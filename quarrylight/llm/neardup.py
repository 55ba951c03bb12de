"""Near-duplicate records with small edits: a blocked sparse product of records by word n-grams.

A record is the set of its hashed word n-grams.  Records with equal sets are
one (copies are only expanded where a result asks for pairs of keys).  The
product of the incidence matrix with its transpose holds the overlaps of all
pairs; what is computed of it:

* only columns that can matter.  With the n-grams of a record in one global
  order, rare ones first, two records of Jaccard t or more share one of the
  first ``n - ceil(t n) + 1`` of each.  The order comes from counts over all
  records in ``2**17`` hashed counters, the only thing that is broadcast;
* in blocks.  The records of a column are cut into blocks of ``block``, and
  blocks are paired, so a column that a third of all records share becomes many
  small tasks;
* with bounds.  Pairs whose sizes exclude t are not formed; overlaps are added
  up by pair, and pairs whose overlap so far plus what the rest can add stays
  below the bound are dropped.  What is left gets its exact overlap.

Cases: texts with fewer words than n have no n-gram and pair with nothing; null
keys or texts give no row; a key that comes twice counts once for each
different text; ties and repeated rows change nothing; an empty table gives
empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..plans.lineage import cut

_WORD = re.compile(r"[a-z0-9_]+")
COUNTERS = 17
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < 500_000:
            self[word] = h
        return h


_HASHES = _Hashes()


def ngrams(text: str, n: int) -> np.ndarray:
    """The sorted distinct hashes of the text's word n-grams."""
    words = _WORD.findall(text.lower())
    if len(words) < n:
        return np.zeros(0, np.int64)
    h = np.array([_HASHES[w] for w in words], dtype=np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * _A + h[k : len(h) - n + 1 + k]
        out ^= out >> np.uint64(29)
    return np.unique((out * _B).view(np.int64))


def records(table: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``key, doc, size, grams``: ``doc`` names the set of n-grams; rows without one are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [ngrams(t, n) for t in b["t"]]
            keep = [k for k, g in enumerate(sets) if len(g)]
            yield pd.DataFrame(
                {"key": b["k"].iloc[keep].to_numpy(), "doc": [xxhash.xxh128_digest(sets[k].tobytes()) for k in keep], "size": [len(sets[k]) for k in keep], "grams": [sets[k] for k in keep]}
            )

    rows = table.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & F.col("t").isNotNull())
    return rows.mapInPandas(run, f"key {dict(table.dtypes)[key]}, doc binary, size int, grams array<bigint>")


def _counters(docs: DataFrame) -> np.ndarray:
    """How many records have an n-gram of each counter; ``2**COUNTERS`` numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(1 << COUNTERS, np.int64)
        for b in batches:
            if len(b):
                sums += np.bincount(np.concatenate(b["grams"].to_list()) & ((1 << COUNTERS) - 1), minlength=1 << COUNTERS)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"counter": at, "n": sums[at]})

    counted = docs.select("grams").mapInPandas(run, "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << COUNTERS, np.int64)
    out[counted["counter"]] = counted["n"]
    return out


def _prefixes(docs: DataFrame, counters: np.ndarray, t: float) -> DataFrame:
    """``gram, doc, size``: the rarest n-grams of each record, as many as t needs."""
    shared = docs.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = shared.value
        for b in batches:
            first, doc, size = [], [], []
            for d, g in zip(b["doc"], b["grams"]):
                keep = len(g) - int(np.ceil(t * len(g) - 1e-9)) + 1
                count = often[g & ((1 << COUNTERS) - 1)]
                chosen = np.lexsort((g, count))[:keep]
                chosen = chosen[count[chosen] > 1]  # a counter of one is an n-gram of one record
                first.append(g[chosen])
                doc += [d] * len(chosen)
                size += [len(g)] * len(chosen)
            yield pd.DataFrame({"gram": np.concatenate(first) if first else np.zeros(0, np.int64), "doc": doc, "size": np.array(size, np.int32)})

    return docs.select("doc", "grams").mapInPandas(run, "gram bigint, doc binary, size int")


def _needed(a: Column, b: Column, t: float) -> Column:
    """The least overlap of two sets of these sizes for Jaccard t."""
    return F.ceil(F.lit(t) / (1 + t) * (a + b) - 1e-6)


def similar_sets(docs: DataFrame, t: float, block: int = 256) -> DataFrame:
    """``doc_a, doc_b, similarity`` for the pairs of different sets of ``docs`` (``doc, size, grams``, each set once) with Jaccard t or more."""
    first = _prefixes(docs, _counters(docs), t)
    sizes = first.groupBy("gram").agg(F.count("*").alias("records")).where(F.col("records") > 1)
    blocks = F.ceil(F.col("records") / block).cast("int")
    placed = first.join(sizes.withColumnRenamed("gram", "__gram"), F.col("gram") == F.col("__gram")).withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("doc", "gram"), F.col("blocks")).cast("int"))
    # block i meets block j >= i once: as the left one of (i, j) and as the right one
    left = placed.select("gram", F.col("mine").alias("i"), F.explode(F.sequence(F.col("mine"), F.col("blocks") - 1)).alias("j"), F.col("doc").alias("da"), F.col("size").alias("sa"))
    right = placed.select("gram", F.explode(F.sequence(F.lit(0), F.col("mine"))).alias("i"), F.col("mine").alias("j"), F.col("doc").alias("db"), F.col("size").alias("sb"))
    fits = (F.least("sa", "sb") >= F.ceil(F.lit(t) * F.greatest("sa", "sb") - 1e-6)) & F.when(F.col("i") == F.col("j"), F.col("da") < F.col("db")).otherwise(F.col("da") != F.col("db"))
    met = left.join(right, ["gram", "i", "j"]).where(fits)
    met = met.select(F.least("da", "db").alias("doc_a"), F.greatest("da", "db").alias("doc_b"), F.when(F.col("da") < F.col("db"), F.col("sa")).otherwise(F.col("sb")).alias("size_a"), F.when(F.col("da") < F.col("db"), F.col("sb")).otherwise(F.col("sa")).alias("size_b"))
    overlap = met.groupBy("doc_a", "doc_b", "size_a", "size_b").agg(F.count("*").alias("overlap"))
    rest = lambda n: F.ceil(F.lit(t) * n - 1e-6) - 1  # noqa: E731 - n-grams of a record behind its prefix
    open_ = overlap.where(F.col("overlap") + F.greatest(rest(F.col("size_a")), rest(F.col("size_b"))) >= _needed(F.col("size_a"), F.col("size_b"), t)).select("doc_a", "doc_b")
    sets = docs.select("doc", "grams")
    a = open_.join(sets.select(F.col("doc").alias("doc_a"), F.col("grams").alias("ga")), "doc_a")
    both = a.join(sets.select(F.col("doc").alias("doc_b"), F.col("grams").alias("gb")), "doc_b")
    both = both.withColumn("common", F.size(F.array_intersect("ga", "gb")))
    similarity = F.col("common") / (F.size("ga") + F.size("gb") - F.col("common"))
    return both.select("doc_a", "doc_b", similarity.alias("similarity")).where(F.col("similarity") >= t - 1e-12)


class NearDuplicates:
    """The near-duplicates of a table: sets, links between them, and which keys have which set."""

    def __init__(self, table: DataFrame, key: str, text: str, n: int = 3, threshold: float = 0.7) -> None:
        rows = cut(records(table, key, text, n))
        self.members = rows.select("key", "doc").distinct()
        self.links = cut(similar_sets(rows.groupBy("doc").agg(F.first("size").alias("size"), F.first("grams").alias("grams")), threshold))

    def pairs(self) -> DataFrame:
        """``key_a < key_b, similarity``: every pair of keys, copies included."""
        m = self.members
        across = self.links.join(m.select(F.col("key").alias("x"), F.col("doc").alias("doc_a")), "doc_a").join(m.select(F.col("key").alias("y"), F.col("doc").alias("doc_b")), "doc_b").select("x", "y", "similarity")
        several = m.groupBy("doc").agg(F.count("*").alias("copies")).where("copies > 1").select("doc")
        own = m.join(several, "doc", "left_semi")
        same = own.select("doc", F.col("key").alias("x")).join(own.select("doc", F.col("key").alias("y")), "doc").where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
        return across.union(same).where("x != y").groupBy(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).agg(F.max("similarity").alias("similarity"))

    def groups(self) -> DataFrame:
        """``key, group, copies, links``: its group's least key, how many keys share its set, how many other sets it is linked to."""
        m = self.members
        sets = m.groupBy("doc").agg(F.min("key").alias("least"), F.count("*").alias("copies"))
        ends = self.links.select(F.col("doc_a").alias("doc"), F.col("doc_b").alias("other")).union(self.links.select("doc_b", "doc_a"))
        degree = ends.groupBy("doc").agg(F.count("*").alias("links"))
        joined = components(self.links, "doc_a", "doc_b").withColumnRenamed("vertex", "doc")
        named = sets.join(joined, "doc", "left").join(degree, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        least = named.groupBy("component").agg(F.min("least").alias("group"))
        named = named.join(least, "component").select("doc", "group", "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
        least = F.min(F.struct("group", F.struct("copies", "links").alias("rest"))).alias("x")  # a key with several texts is in the least of its groups
        return m.join(named, "doc").groupBy("key").agg(least, F.sum("links").alias("links")).select("key", "x.group", "x.rest.copies", "links")
