"""Most similar vectors for every vector, by a hash-prefix forest.

A tree gives every vector a long string of bits.  The first bits are the sides
of planes between two centres each; which plane a prefix asks next was learnt
from ``sample`` rows, down to ``cell`` of them.  The other bits, up to
``CODE_BITS``, are sides of orthogonal planes through the middle of that cell.
A tree's strings lie in a sorted array.  A search

1. descends: in every tree the neighbours of a string in the array are those
   with which it shares its longest prefixes;
2. ascends in all trees at once, from the longest shared prefix on, one bit a
   step, until the nodes of that depth hold ``candidates`` vectors together;
3. scores the vectors of those nodes and keeps the best k of all trees.

How it runs: the arrays are cut into slices of about ``rows`` strings, whose
bounds are quantiles of the sample's strings (equal strings are told apart by a
hash of the key, so copies are shared out too), and a slice is a sorted
partition that its task reads as a stream.  The first pass carries strings only
and finds how many others share 1, 2, ... bits with each one, ``window`` places
either way; summed over the trees this is the depth at which the ascent ends.
The second carries the vectors, as 24-bit fractions, and scores blocks of the
array against their surroundings by matrix products, of which only pairs count
that share the prefix of that depth.  What a search does hangs on ``candidates``
and ``window`` alone, not on the size of the table; every row is indexed and
every row is a query.  What goes out to the tasks is bounded by ``sample``.

Scores: float products choose ``SLACK`` more than needed, double differences rank
them; nothing is rounded before the final rank.

Cases: null, short or long vectors, zero vectors and those with a null, NaN or
infinite value are not usable and give no row; a null key gives none; a key that
comes with several vectors counts with the least of them; equal vectors are each
other's neighbours, those next in the arrays first; empty tables give no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CODE_BITS = 60
SCALE = 8388607.0
# Candidates beside those needed, rows scored at a time, and of how many hashes a sample is drawn.
SLACK, BLOCK, SHARES = 8, 256, 1 << 30
# Rounds of moving two centres, the sampled rows that move them, and the least share of a cell on one side.
ROUNDS, MOVERS, LEAST_SIDE, DEEPEST = 4, 256, 0.15, 48


def usable(column: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of an Arrow list column hold a usable vector, and these, normalised."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64), nan=-1)
    rows = np.flatnonzero(lengths == size)
    if not len(rows):
        return rows, np.zeros((0, size), np.float32)
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    with np.errstate(all="ignore"):
        norm = np.sqrt((values**2).sum(1))
        good = np.isfinite(norm) & (norm > 0)
    return rows[good], (values[good] / norm[good, None]).astype(np.float32)


def packed_bytes(vectors: np.ndarray) -> list[bytes]:
    """Three bytes a value."""
    fractions = np.ascontiguousarray(np.round(vectors * SCALE).astype("<i4"))
    return [x.tobytes() for x in fractions.view(np.uint8).reshape(*vectors.shape, 4)[:, :, :3]]


def unpacked(values: list[bytes], size: int) -> np.ndarray:
    """The vectors of ``packed_bytes``, normalised, in double."""
    wide = np.zeros((len(values), size, 4), np.uint8)
    wide[:, :, 1:] = np.frombuffer(b"".join(values), np.uint8).reshape(-1, size, 3)
    v = (wide.view("<i4")[:, :, 0] >> 8).astype(np.float64)
    return v / np.sqrt((v**2).sum(1))[:, None]


class Tree:
    """The hash of one tree: which plane each prefix asks, and the planes that every cell asks afterwards."""

    def __init__(self, sample: np.ndarray, cell: int, rng: np.random.Generator) -> None:
        size = sample.shape[1]
        self.planes, self.bounds, self.children, self.middles = [], [], [], []
        x = sample.astype(np.float32)
        open_cells = [(np.arange(len(x)), 0, None, 0)]  # rows, depth, parent, side
        while open_cells:
            rows, depth, parent, side = open_cells.pop()
            cut = self._cut(x[rows], rng) if len(rows) >= 2 * cell and depth < DEEPEST else None
            if cut is None:
                self.middles.append(x[rows].mean(0) if len(rows) else np.zeros(size, np.float32))
                here = -len(self.middles)
            else:
                here = len(self.planes)
                self.planes.append(cut[0])
                self.bounds.append(cut[1])
                self.children.append([0, 0])
                right = x[rows] @ cut[0] > cut[1]
                open_cells += [(rows[right], depth + 1, here, 1), (rows[~right], depth + 1, here, 0)]
            if parent is not None:
                self.children[parent][side] = here
        self.planes = np.array(self.planes, np.float32).reshape(-1, size)
        self.bounds = np.array(self.bounds, np.float32)
        self.children = np.array(self.children, np.int64).reshape(-1, 2)
        self.middles = np.array(self.middles, np.float32)
        blocks = [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(-(-CODE_BITS // size))]
        self.rest = np.hstack(blocks)[:, :CODE_BITS].astype(np.float32)

    @staticmethod
    def _cut(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float] | None:
        """The plane between two centres of these rows, or none if the rows are equal."""
        movers = x if len(x) <= MOVERS else x[rng.choice(len(x), MOVERS, replace=False)]
        a = movers[rng.integers(len(movers))]
        others = np.flatnonzero(((movers - a) ** 2).sum(1) > 1e-12)
        if not len(others):
            return None
        b = movers[rng.choice(others)]
        for _ in range(ROUNDS):
            near = movers @ (a - b) > (a @ a - b @ b) / 2
            if near.all() or not near.any():
                break
            a, b = movers[near].mean(0), movers[~near].mean(0)
        plane = a - b
        side = x @ plane
        bound = (a @ a - b @ b) / 2
        if not LEAST_SIDE <= (side > bound).mean() <= 1 - LEAST_SIDE:
            bound = np.median(side)
        return (plane, float(bound)) if (side > bound).any() and (side <= bound).any() else None

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """The strings of bits as integers, the first bit highest."""
        n = len(vectors)
        node, code, depth = np.full(n, 0 if len(self.planes) else -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.arange(n) if len(self.planes) else np.zeros(0, np.int64)
        while len(live):
            at = node[live]
            bit = np.einsum("ij,ij->i", vectors[live], self.planes[at]) > self.bounds[at]
            code[live] = code[live] << 1 | bit
            depth[live] += 1
            node[live] = self.children[at, bit.astype(np.int64)]
            live = live[node[live] >= 0]
        rest = (vectors - self.middles[-node - 1]) @ self.rest > 0
        tail = rest @ (np.int64(1) << np.arange(CODE_BITS - 1, -1, -1, dtype=np.int64))
        return code << (CODE_BITS - depth) | tail >> depth


def tie(share: np.ndarray, tree: int) -> np.ndarray:
    """The order of equal strings, another one in each tree."""
    return (share * np.int64(2 * tree + 0x9E3779B1) >> 11) & (SHARES - 1)


def fitted(table: DataFrame, key: str, vector: str, size: int, trees: int, sample: int, cell: int, slices: int, rows: int, seed: int) -> list[tuple[Tree, np.ndarray, np.ndarray]]:
    """The trees, each with the first strings and ties of its slices; learnt in one task a tree."""
    spark = table.sparkSession
    share = F.pmod(F.xxhash64(key), F.lit(SHARES))
    chosen = table.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (share < int(min(1.0, sample / max(1, rows)) * SHARES))).select(share.alias("share"), F.col(vector).alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, v = usable(b.column(1), size)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(packed_bytes(v), pa.binary())], ["share", "v"])

    held = chosen.mapInArrow(pack, "share bigint, v binary").distinct().toPandas().sort_values(["share", "v"])  # about `sample` rows
    vectors = unpacked(held["v"].tolist(), size).astype(np.float32) if len(held) else np.zeros((0, size), np.float32)
    known = spark.sparkContext.broadcast((vectors, held["share"].to_numpy(np.int64)))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, shares = known.value
        for b in batches:
            made = []
            for t in b["id"].tolist():
                tree = Tree(x, cell, np.random.default_rng([seed, t]))
                code, late = tree.codes(x), tie(shares, t)
                order = np.lexsort((late, code))
                first = order[[len(x) * s // slices for s in range(1, slices)]] if len(x) else order
                made.append(pickle.dumps((tree, code[first], late[first])))
            yield pd.DataFrame({"tree": b["id"], "made": made})

    got = spark.range(0, trees, 1, trees).mapInPandas(fit, "tree bigint, made binary").toPandas().sort_values("tree")
    return [pickle.loads(bytes(x)) for x in got["made"]]


def slice_of(code: np.ndarray, late: np.ndarray, first_code: np.ndarray, first_late: np.ndarray) -> np.ndarray:
    """The slice of each string: how many slices' firsts are not after it."""
    low, high = np.searchsorted(first_code, code, "left"), np.searchsorted(first_code, code, "right")
    out = low.astype(np.int64)
    for i in np.flatnonzero(high > low).tolist():  # strings that several slices may share
        out[i] = low[i] + np.searchsorted(first_late[low[i] : high[i]], late[i], "right")
    return out


def shared_counts(codes: np.ndarray, window: int) -> np.ndarray:
    """How many of the ``window`` strings either way share 1, 2, ... bits with each string of a sorted array."""
    n = len(codes)
    apart = codes[1:] ^ codes[:-1]
    bits = CODE_BITS - np.frexp((apart & ~(apart >> 1)).astype(np.float64))[1]  # thinned out, so that none is rounded up
    place = np.arange(n)
    out = np.empty((n, CODE_BITS), np.uint16)
    for d in range(1, CODE_BITS + 1):
        breaks = np.flatnonzero(bits < d)  # between a row and the next one
        k = np.searchsorted(breaks, place)  # breaks before each row
        before = np.r_[-1, breaks][k]
        after = np.r_[breaks, n - 1][k]
        out[:, d - 1] = np.minimum(place - before - 1, window) + np.minimum(after - place, window)
    return out


def stop_depth(counts: list[bytes], candidates: int) -> int:
    """The depth at which the ascent in all trees at once has met ``candidates`` vectors; 0 is the roots."""
    total = np.frombuffer(b"".join(counts), np.uint16).reshape(-1, CODE_BITS).sum(0, dtype=np.int64)
    return int((total >= candidates).sum())


def best_of(block: slice, v: np.ndarray, code: np.ndarray, stop: np.ndarray, key_id: np.ndarray, window: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, other, cosine``: the best k of the strings around each row of the block that share its prefix."""
    low, high = max(0, block.start - window), min(len(v), block.stop + window)
    asked, around = np.arange(block.start, block.stop), np.arange(low, high)
    near = v[around]
    centred = (near - near.mean(0)).astype(np.float32)
    half = (centred.astype(np.float64) ** 2).sum(1).astype(np.float32) / 2
    mine = asked - low
    s = centred[mine] @ centred.T
    s -= half
    s -= half[mine, None]  # the cosine less one
    s[(code[asked][:, None] ^ code[around]) >> (CODE_BITS - stop[asked])[:, None] != 0] = -np.inf
    s[np.arange(len(asked)), mine] = -np.inf
    if least > -1:
        held = (s >= least - 1 - 1e-5).any(1)
        mine, asked, s = mine[held], asked[held], s[held]
    take = min(s.shape[1], k + SLACK)
    if not len(mine) or not take:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    top = np.argpartition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take :]
    cosine = 1 - ((near[mine][:, None] - near[top]) ** 2).sum(2) / 2
    cosine[np.take_along_axis(s, top, 1) == -np.inf] = -np.inf
    order = np.lexsort((key_id[low + top], -cosine), axis=1)[:, :k]
    other, cosine = low + np.take_along_axis(top, order, 1), np.take_along_axis(cosine, order, 1)
    r, c = np.nonzero(cosine >= least)
    return asked[r], other[r, c], cosine[r, c]


def _streamed(batches: Iterator[pa.RecordBatch], margin: int) -> Iterator[tuple[pa.Table, int, int]]:
    """The rows of a partition in pieces: a table with up to ``margin`` rows on either side of the piece, and where the piece begins and ends in it."""
    held, done, piece = None, 0, 16 * BLOCK + margin
    for b in batches:
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if held.num_rows - done >= piece + margin:
            end = held.num_rows - margin
            yield held.combine_chunks(), done, end
            keep = max(0, end - margin)
            held, done = held.slice(keep), end - keep
    if held is not None and held.num_rows > done:
        yield held.combine_chunks(), done, held.num_rows


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition without the rows that repeat the one before."""
    before = None
    for b in batches:
        if not b.num_rows:
            continue
        code, late, keys = b.column("code").to_numpy(), b.column("late").to_numpy(), np.array(b.column("key").to_pylist(), dtype=object)
        again = np.r_[before == (code[0], late[0], keys[0]), (code[1:] == code[:-1]) & (late[1:] == late[:-1]) & (keys[1:] == keys[:-1])]
        before = code[-1], late[-1], keys[-1]
        yield b.filter(pa.array(~again.astype(bool)))


def most_similar(
    table: DataFrame, key: str, vector: str, size: int, k: int = 5, least: float = -1.0, trees: int = 12, candidates: int = 5000, window: int = 384, sample: int = 16_384, cell: int = 8, rows: int = 100_000, seed: int = 11
) -> DataFrame:
    """``key, neighbour, similarity, rank``: for every usable vector the k most similar others of at least ``least`` cosine."""
    count = table.count()
    slices = max(1, -(-count // rows))
    forest = table.sparkSession.sparkContext.broadcast(fitted(table, key, vector, size, trees, sample, cell, slices, count, seed))
    kind = dict(table.dtypes)[key]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, v = usable(b.column(1), size)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(packed_bytes(v), pa.binary())], ["key", "v"])

    def placed(v: np.ndarray, share: np.ndarray, carried: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        """Each row once a tree, with its slice, its string and its tie."""
        for t, (tree, first_code, first_late) in enumerate(forest.value):
            code, late = tree.codes(v), tie(share, t)
            place = t * slices + slice_of(code, late, first_code, first_late)
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(code), pa.array(late.astype(np.int32)), *carried.values()], ["slice", "code", "late", *carried])

    def spread_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, v = usable(b.column("v"), size)
            v = unpacked(packed_bytes(v), size).astype(np.float32)
            yield from placed(v, b.column("share").to_numpy()[at], {"key": b.column("key").take(pa.array(at))})

    def spread_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = unpacked(b.column("v").to_pylist(), size).astype(np.float32)
            yield from placed(v, b.column("share").to_numpy(), {n: b.column(n) for n in ("key", "stop", "v")})

    def count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, begin, end in _streamed(_once(batches), window):
            counts = shared_counts(held.column("code").to_numpy(), window)[begin:end]
            yield pa.RecordBatch.from_arrays([held.column("key").combine_chunks().slice(begin, end - begin), pa.array([x.tobytes() for x in counts], pa.binary())], ["key", "counts"])

    def ascend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([stop_depth(x, candidates) for x in b.column(1).to_pylist()], pa.int32())], ["stop_key", "stop"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, begin, end in _streamed(batches, window):
            keys = held.column("key").combine_chunks()
            v, code, stop = unpacked(held.column("v").to_pylist(), size), held.column("code").to_numpy(), held.column("stop").to_numpy().astype(np.int64)
            key_id = keys.dictionary_encode().indices.to_numpy() if not pa.types.is_integer(keys.type) else keys.to_numpy()
            for at in range(begin, end, BLOCK):
                i, j, c = best_of(slice(at, min(end, at + BLOCK)), v, code, stop, key_id, window, k, least)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(i)), keys.take(pa.array(j)), pa.array(c, pa.float64())], ["key", "neighbour", "similarity"])

    share = F.pmod(F.xxhash64("key"), F.lit(SHARES)).alias("share")
    asked = table.select(F.col(key).alias("key"), F.col(vector).alias("v")).where(F.col("key").isNotNull() & F.col("v").isNotNull())
    array = "slice int, code bigint, late int"

    def sorted_slices(strings: DataFrame) -> DataFrame:
        return strings.repartitionById(trees * slices, "slice").sortWithinPartitions("slice", "code", "late", "key")

    strings = sorted_slices(asked.select(share, "key", "v").mapInArrow(spread_strings, f"{array}, key {kind}"))
    counts = strings.mapInArrow(count_shared, f"key {kind}, counts binary").groupBy("key").agg(F.collect_list("counts").alias("counts"))  # one a tree
    stops = counts.mapInArrow(ascend, f"stop_key {kind}, stop int")
    once = asked.mapInArrow(pack, f"key {kind}, v binary").groupBy("key").agg(F.min("v").alias("v"))
    going = once.join(stops, F.col("key") == F.col("stop_key")).select(share, "key", "stop", "v")
    found = sorted_slices(going.mapInArrow(spread_vectors, f"{array}, key {kind}, stop int, v binary")).mapInArrow(score, f"key {kind}, neighbour {kind}, similarity double")
    merged = found.repartition("key").groupBy("key", "neighbour").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("similarity"), "neighbour"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("key").alias(key), "neighbour", F.round("similarity", 5).alias("similarity"), "rank")
