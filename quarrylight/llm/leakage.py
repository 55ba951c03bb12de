"""Evaluation texts leaking into training text.

The items are a table like the documents; neither passes through the driver.

1. A scan of the corpus counts, over all documents, the n-grams that the items
   have; of every window of ``run`` item words the rarest n-gram becomes a seed,
   so whatever shares ``run`` words in a row with an item holds one of its seeds.
2. A second scan finds the seeds; its narrow rows (document, place, seed) are
   joined to the items' seeds.  Seeds that the corpus holds more often than
   ``HOT`` times are spread over ``PARTS`` parts.
3. A third scan takes the words of the documents that were met.  A local
   alignment of a positive score that goes through a seed spans at most three
   words a word of the item on either side of it, so the words that far around
   an item's seeds are aligned whole with the item, by Smith-Waterman over
   words, many pairs at a time.

The number of scans does not hang on the number of items.  What a scan may pass
on is told by a filter of bits, at most ``2**MOST_BITS`` of them: a superset,
which the joins make exact.

Cases: null and empty texts match nothing; items shorter than an n-gram too;
rows with a null key are left out; repeated documents count once a key, and a
key with several texts has the best result of them, items likewise; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

_WORD = re.compile(r"[a-z0-9]+")
_A = np.uint64(0x9E3779B97F4A7C15)
MATCH, MISMATCH, GAP = 2, -1, 1
# Bits of a filter (32 MB), bytes of its segments, bits a value, occurrences that make a seed hot, and the parts of a hot one.
MOST_BITS, SEGMENT, SPARSE, HOT, PARTS = 28, 1 << 16, 16, 10_000, 64
# Cells that are aligned at once.
CELLS = 1 << 18


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word) or 1
        if len(self) < 500_000:
            self[word] = h
        return h


_HASHES = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams, by place."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(31))) * _A + h[k : len(h) - n + 1 + k]
    return out


class BitFilter:
    """A set of hashes as bits: tells for sure what is not in it."""

    def __init__(self, bits: int, held: np.ndarray) -> None:
        self.bits, self.held = bits, held

    @staticmethod
    def places(values: np.ndarray, bits: int) -> np.ndarray:
        v = values.astype(np.uint64)
        return ((v ^ (v >> np.uint64(29))) * _A >> np.uint64(64 - bits)).astype(np.int64)

    def has(self, values: np.ndarray) -> np.ndarray:
        at = self.places(values, self.bits)
        return (self.held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bit_filter(values: DataFrame) -> BitFilter:
    """The filter of a column of hashes; its size follows their number up to a bound, its parts are joined by Spark."""
    bits = min(MOST_BITS, max(SEGMENT.bit_length() + 2, (SPARSE * values.count()).bit_length()))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(1 << (bits - 3), np.uint8)
        for b in batches:
            at = np.unique(BitFilter.places(b.iloc[:, 0].to_numpy(np.int64).view(np.uint64), bits))
            np.bitwise_or.at(held, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        parts = held.reshape(-1, SEGMENT)
        some = np.flatnonzero(parts.any(1))
        yield pd.DataFrame({"segment": some, "held": [parts[i].tobytes() for i in some]})

    def join(group: pd.DataFrame) -> pd.DataFrame:
        whole = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group["held"]])
        return pd.DataFrame({"segment": group["segment"].iloc[:1], "held": [whole.tobytes()]})

    kind = "segment bigint, held binary"
    held = np.zeros((1 << (bits - 3)) // SEGMENT * SEGMENT, np.uint8)
    for r in values.mapInPandas(mark, kind).groupBy("segment").applyInPandas(join, kind).collect():  # at most 32 MB
        held[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = np.frombuffer(r["held"], np.uint8)
    return BitFilter(bits, held)


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores and the longest runs of equal words, of passages against items, pair by pair."""
    b, m, n = len(passages), max(map(len, passages)), max(map(len, items))
    p, q = np.zeros((b, m), np.uint64), np.full((b, n), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(b):
        p[k, : len(passages[k])] = passages[k]
        q[k, : len(items[k])] = items[k]
    h, run = np.zeros((b, n + 1), np.int32), np.zeros((b, n + 1), np.int32)
    slope = GAP * np.arange(n + 1, dtype=np.int32)
    best, longest = np.zeros(b, np.int32), np.zeros(b, np.int32)
    for row in range(m):
        same = p[:, row, None] == q
        t = np.zeros_like(h)
        t[:, 1:] = np.maximum(np.maximum(h[:, :-1] + np.where(same, MATCH, MISMATCH).astype(np.int32), h[:, 1:] - GAP), 0)
        h = np.maximum.accumulate(t + slope, axis=1) - slope  # gaps along the item
        after = np.zeros_like(run)
        after[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        run = after
        best, longest = np.maximum(best, h.max(1)), np.maximum(longest, run.max(1))
    return best, longest


def _texts(table: DataFrame, key: str, text: str) -> DataFrame:
    """``k, t`` and ``h``, which tells the texts of a key apart."""
    return table.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & F.col("t").isNotNull()).withColumn("h", F.xxhash64("t"))


def _grams_of_items(items: DataFrame, n: int) -> DataFrame:
    """``item, version, words`` and ``grams``, by place; one row an item and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [word_hashes(t) for t in b["t"]]
            yield pd.DataFrame({"item": b["k"], "version": b["h"], "words": [w.tobytes() for w in words], "grams": [grams(w, n).view(np.int64) for w in words]})

    kind = dict(items.dtypes)["k"]
    return items.dropDuplicates(["k", "h"]).mapInPandas(run, f"item {kind}, version bigint, words binary, grams array<bigint>").where(F.size("grams") > 0)


def _seeds(texts: DataFrame, items: DataFrame, n: int, run: int) -> DataFrame:
    """``item, version, place, seed, often``: of every window of ``run`` words the n-gram that the corpus holds least often."""
    kind = dict(items.dtypes)["item"]
    of_items = items.select("item", "version", F.posexplode("grams").alias("place", "gram"))
    known = texts.sparkSession.sparkContext.broadcast(bit_filter(of_items.select("gram").distinct()))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [g[known.value.has(g)] for g in (grams(word_hashes(t), n) for t in b["t"])]
            values, often = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pd.DataFrame({"gram": values.view(np.int64), "n": often})

    counted = texts.select("t").mapInPandas(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("often"))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        rank = np.lexsort((group["gram"], group["often"])).argsort()
        width = min(len(group), run - n + 1)
        at = np.unique(np.lib.stride_tricks.sliding_window_view(rank, width).argmin(1) + np.arange(len(group) - width + 1))
        return group.iloc[at][["item", "version", "place", "gram", "often"]].rename(columns={"gram": "seed"})

    held = of_items.join(counted, "gram", "left").fillna(0, ["often"])
    return held.groupBy("item", "version").applyInPandas(choose, f"item {kind}, version bigint, place int, seed bigint, often bigint")  # one item a group


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = 5, run: int = 12) -> DataFrame:
    """One row a document and item that share a seed: ``key, item_key, score`` (share of the best possible), ``longest_run``."""
    context = documents.sparkSession.sparkContext
    texts, wanted = _texts(documents, key, text), _grams_of_items(_texts(items, item_key, item_text), n)
    kind, item_kind = dict(texts.dtypes)["k"], dict(wanted.dtypes)["item"]
    seeds = cut(_seeds(texts, wanted, n, run))
    chosen = context.broadcast(bit_filter(seeds.select("seed").distinct()))
    hot = context.broadcast(bit_filter(seeds.where(F.col("often") > HOT).select("seed").distinct()))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in enumerate(b["t"]):
                g = grams(word_hashes(t), n)
                at = np.flatnonzero(chosen.value.has(g))
                rows.append((np.full(len(at), i), at, g[at]))
            which, at, seed = (np.concatenate(x) for x in zip(*rows)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
            part = np.where(hot.value.has(seed), b["h"].to_numpy(np.int64)[which] % PARTS, 0)
            yield pd.DataFrame({"k": b["k"].to_numpy()[which], "h": b["h"].to_numpy()[which], "at": at, "seed": seed.view(np.int64), "part": part})

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            many = np.where(hot.value.has(b["seed"].to_numpy(np.int64).view(np.uint64)), PARTS, 1)
            out = b.loc[b.index.repeat(many), ["item", "version", "place", "seed"]]
            yield out.assign(part=np.arange(len(out)) - np.repeat(np.cumsum(many) - many, many))

    spread = seeds.mapInPandas(parts, f"item {item_kind}, version bigint, place int, seed bigint, part bigint")
    hits = texts.mapInPandas(find, f"k {kind}, h bigint, at int, seed bigint, part bigint")
    met = hits.join(spread, ["seed", "part"]).select("k", "h", "item", "version", F.struct("at", "place").alias("hit"))
    pairs = cut(met.groupBy("k", "h", "item", "version").agg(F.sort_array(F.collect_set("hit")).alias("hits")))
    here = context.broadcast(bit_filter(pairs.select("h").distinct()))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[here.value.has(b["h"].to_numpy(np.int64).view(np.uint64))]
            yield pd.DataFrame({"k": b["k"], "h": b["h"], "doc_words": [word_hashes(t).tobytes() for t in b["t"]]})

    words = texts.mapInPandas(take, f"k {kind}, h bigint, doc_words binary").dropDuplicates(["k", "h"])
    joined = pairs.join(wanted.select("item", "version", "words"), ["item", "version"]).join(words, ["k", "h"]).select("k", "item", "hits", "words", "doc_words")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            asked, passages, items_of = [], [], []
            for i, (hits, w, d) in enumerate(zip(b["hits"], b["words"], b["doc_words"])):
                item, doc = np.frombuffer(w, np.uint64), np.frombuffer(d, np.uint64)
                for low, high in spans([(h["at"], h["place"]) for h in hits], len(item)):
                    asked.append(i)
                    passages.append(doc[max(0, low) : high])
                    items_of.append(item)
            best, longest = aligned(passages, items_of)
            found = pd.DataFrame({"i": np.array(asked, np.int64), "score": best, "longest_run": longest}).groupby("i").max()
            size = np.array([len(w) // 8 for w in b["words"]])
            yield pd.DataFrame({key: b["k"].to_numpy(), item_key: b["item"].to_numpy(), "score": found["score"].to_numpy() / (MATCH * size), "longest_run": found["longest_run"].to_numpy()})

    scored = joined.mapInPandas(score, f"`{key}` {kind}, `{item_key}` {item_kind}, score double, longest_run int")
    return scored.groupBy(key, item_key).agg(F.max("score").alias("score"), F.max("longest_run").alias("longest_run"))


def spans(hits: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The places of a document that alignments through these seeds (place in the document, in the item) can reach, as few passages."""
    reach = MATCH // GAP + 1  # words of the document a matching word can pay for, itself included
    out: list[tuple[int, int]] = []
    for low, high in sorted((at - reach * place, at + reach * (size - place)) for at, place in hits):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def aligned(passages: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``align`` for any number of pairs, those of like sizes together."""
    best, longest = np.zeros(len(passages), np.int32), np.zeros(len(passages), np.int32)
    order = sorted(range(len(passages)), key=lambda i: (len(items[i]), len(passages[i])))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(items[order[end]]) <= CELLS // 8 and len(items[order[end]]) <= 1.25 * len(items[order[at]]) + 4:
            end += 1
        part = order[at:end]
        part.sort(key=lambda i: len(passages[i]))
        for k in range(0, len(part), 128):
            some = part[k : k + 128]
            best[some], longest[some] = align([passages[i] for i in some], [items[i] for i in some])
        at = end
    return best, longest
