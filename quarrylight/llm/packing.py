"""Filling fixed-capacity containers with items: token sequences of documents.

Texts become token counts with a public tokenizer; a text longer than the
capacity is cut into full pieces and a rest, all others stay whole.  Pieces are
spread evenly by key over as many packers as the table needs; each packs online
by best fit into a bounded number of open bins.  The free spaces of the open
bins are the bits of one integer, so the tightest bin that fits is its lowest
bit from the piece's size up; when a bin too many is open the fullest closes.

Cases: null and empty texts have no tokens and get no bin; a key that comes
twice is packed twice; capacities that are null or below one are left out.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

TOKENIZERS = "/opt/tokenizers"
PACKER_PIECES, OPEN_BINS = 20_000, 256


def encoder(folder: str, name: str = "byte_bpe_50k.tiktoken"):
    """The tokenizer of a rank file in ``folder``, made once a worker."""
    if (folder, name) not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in (Path(folder) / name).read_bytes().splitlines() if line)}
        # Fixed value: the split pattern of byte-level BPE vocabularies of this size.
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _ENCODERS[folder, name] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[folder, name]


_ENCODERS: dict = {}


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """``key, tokens`` for every text that has any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(folder).encode_ordinary
        for b in batches:
            yield pd.DataFrame({key: b["k"], "tokens": [len(encode(t)) for t in b["t"]]})

    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & (F.col("t") != ""))
    return rows.mapInPandas(run, f"`{key}` {dict(documents.dtypes)[key]}, tokens int")


class OpenBins:
    """Best fit with a bounded number of open bins."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.free = 0  # bit f: an open bin has f left
        self.at: dict[int, list[int]] = {}
        self.open = self.made = 0

    def put(self, size: int) -> int:
        """The bin that takes a piece."""
        fits = self.free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            bins = self.at[left]
            chosen = bins.pop()
            if not bins:
                self.free ^= 1 << left
            left -= size
        else:
            if self.open >= self.limit:
                fullest = (self.free & -self.free).bit_length() - 1
                self.at[fullest].pop()
                if not self.at[fullest]:
                    self.free ^= 1 << fullest
                self.open -= 1
            chosen, left = self.made, self.capacity - size
            self.made += 1
            self.open += 1
        if left:
            self.at.setdefault(left, []).append(chosen)
            self.free |= 1 << left
        else:
            self.open -= 1  # full
        return chosen


def pack(sized: DataFrame, budgets: DataFrame, key: str = "doc_id", size: str = "tokens", budget: str = "budget_id", capacity: str = "capacity_tokens", open_bins: int = OPEN_BINS, packer_pieces: int = PACKER_PIECES) -> DataFrame:
    """``budget, key, piece, start, size, packer, bin``: where every piece of every item lies, for each capacity."""
    kind, kind_b = dict(sized.dtypes)[key], dict(budgets.dtypes)[budget]
    caps = [(r[0], r[1]) for r in budgets.select(budget, capacity).distinct().where(F.col(capacity) >= 1).orderBy(budget).collect()]  # the stated capacities
    sized = cut(sized.select(key, size))  # read twice: counted and packed; texts are tokenised once
    packers = max(1, -(-sized.count() // packer_pieces))
    listed = F.array(*[F.struct(F.lit(b).cast(kind_b).alias("b"), F.lit(c).alias("c")) for b, c in caps]) if caps else F.expr(f"cast(array() as array<struct<b:{kind_b},c:int>>)")
    pieces = (
        sized.where(F.col(size) > 0)
        .select(F.col(key).alias("k"), F.col(size).alias("n"), F.explode(listed).alias("x"))
        .select("k", "x.b", "x.c", "n", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.col("x.c"))).alias("piece", "start"))
        .select("b", "c", "k", "piece", "start", F.least(F.col("c"), F.col("n") - F.col("start")).alias("n"), F.pmod(F.xxhash64("k", "piece"), F.lit(packers)).cast("int").alias("packer"))
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["k", "piece"])
        bins = OpenBins(int(group["c"].iloc[0]), open_bins)
        return group.assign(bin=[bins.put(n) for n in group["n"].tolist()])[["b", "k", "piece", "start", "n", "packer", "bin"]]

    packed = pieces.groupBy("b", "c", "packer").applyInPandas(run, f"b {kind_b}, k {kind}, piece int, start int, n int, packer int, bin int")  # about packer_pieces rows a group
    return packed.select(F.col("b").alias(budget), F.col("k").alias(key), "piece", "start", F.col("n").alias(size), "packer", "bin")
