"""Embedding texts in batches (E6-E9, B1-B2, M2-M3, M11) by a pluggable embedder.

The default embedder hashes words, parts of names and character trigrams into
signed buckets and normalises: a pure function of the text, the same on every
partition and machine.  It is lexical, not semantic.  A model comes in through
``register_embedder``: a factory, called once a worker, that returns a function
from a list of texts to a matrix.

Cases: null texts get a null vector; an empty text a zero vector.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BATCH = 64  # fixed value: texts a batch
DIMENSION = 256
_WORD = re.compile(r"[A-Za-z_]\w*|\d+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def hashing_embedder() -> Callable[[list[str]], np.ndarray]:
    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), DIMENSION), dtype=np.float64)
        for row, text in enumerate(texts):
            features: list[str] = []
            for word in _WORD.findall(text):
                low = word.lower()
                features.append(low)
                features += [p.lower() for p in _PART.findall(word)]
                features += [low[i : i + 3] for i in range(max(0, len(low) - 2))]
            if features:
                h = np.array([zlib.crc32(x.encode()) for x in features], dtype=np.int64)
                np.add.at(out[row], h % DIMENSION, np.where((h >> 16) & 1, 1.0, -1.0))
        return out / np.maximum(np.sqrt((out**2).sum(1)), 1e-12)[:, None]

    return embed


EMBEDDERS: dict[str, Callable[[], Callable[[list[str]], np.ndarray]]] = {"hash-256": hashing_embedder}
_LOADED: dict[str, Callable] = {}


def register_embedder(name: str, factory: Callable[[], Callable[[list[str]], np.ndarray]]) -> None:
    """U11, E9."""
    EMBEDDERS[name] = factory


def embedder(name: str) -> Callable[[list[str]], np.ndarray]:
    """The embedder of this process; an unknown name raises KeyError."""
    if name not in _LOADED:
        _LOADED[name] = EMBEDDERS[name]()
    return _LOADED[name]


def embed_one(text: str, name: str = "hash-256") -> list[float]:
    """E8."""
    return [float(x) for x in embedder(name)([text])[0].astype(np.float32)]


def batches(texts: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """B1, M8: the number of the batch of ``BATCH`` that each text falls in, counted from 0 within its group, as ``batch``."""
    place = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
    return texts.withColumn("batch", F.floor((place - 1) / BATCH))


def with_embeddings(table: DataFrame, text: str = "embedding_text", into: str = "embedding", name: str = "hash-256") -> DataFrame:
    """The table with a vector column; texts go to the embedder in batches of ``BATCH``, across files."""
    factory = EMBEDDERS[name]  # goes out with the task: a worker may not have it registered
    rest = [c for c in table.columns if c != into]
    schema = ", ".join(f"`{c}` {t}" for c, t in table.select(*rest).dtypes) + f", `{into}` array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _LOADED:
            _LOADED[name] = factory()
        embed = _LOADED[name]
        for b in batches:
            texts, vectors = b[text].tolist(), []
            for at in range(0, len(texts), BATCH):
                part = texts[at : at + BATCH]
                made = embed([t or "" for t in part]).astype(np.float32)
                vectors += [None if t is None else v for t, v in zip(part, made)]
            yield b.assign(**{into: pd.Series(vectors, index=b.index, dtype=object)})

    return table.select(*rest).mapInPandas(run, schema)
