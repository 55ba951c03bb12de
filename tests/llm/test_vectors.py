import os

import numpy as np
import pyarrow as pa
import pytest

from quarrylight.llm import similar

CHUNKS = "/root/testdata/sf0.1/chunks.parquet"


def brute(vectors, k, least):
    n = np.array([np.asarray(v, float) / np.linalg.norm(v) for _, v in vectors])
    s = n @ n.T
    np.fill_diagonal(s, -2)
    out = {}
    for i, (key, _) in enumerate(vectors):
        order = sorted(range(len(vectors)), key=lambda j: (-round(s[i, j], 5), vectors[j][0]))[:k]
        out[key] = [vectors[j][0] for j in order if i != j and s[i, j] >= least]
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 16))
    rows = [(i, [float(x) for x in centres[i % 20] + 0.3 * rng.standard_normal(16)]) for i in range(300)]
    odd = [(900, None), (901, []), (902, [1.0] * 15), (903, [0.0] * 16), (904, [float("nan")] * 16), (905, [float("inf")] + [0.0] * 15), (None, rows[0][1]), (rows[3][0], rows[3][1])]
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows + odd], "id long, e array<float>, neighbour string, rank int")
    got = similar.most_similar(df, "id", "e", 16, k=4).collect()
    want = brute([(k, np.float32(v)) for k, v in rows], 4, -1)
    mine = {}
    for r in sorted(got, key=lambda r: (r["id"], r["rank"])):
        mine.setdefault(r["id"], []).append(r["neighbour"])
    assert set(mine) == set(want)
    assert sum(mine[k] == want[k] for k in want) >= 298  # equal to five places
    least = similar.most_similar(df, "id", "e", 16, k=4, least=0.9).collect()
    assert all(r["similarity"] >= 0.9 for r in least) and least


def test_recall_of_a_deep_forest(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((300, 32))
    rows = [(i, [float(x) for x in centres[i % 300] + 0.35 * rng.standard_normal(32)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, e array<float>")
    got = {(r["id"], r["neighbour"]) for r in similar.most_similar(df, "id", "e", 32, k=5, candidates=200, window=24, sample=1000, cell=4, rows=700).collect()}
    want = {(k, n) for k, ns in brute(rows, 5, -1).items() for n in ns}
    assert len(got & want) / len(want) >= 0.9


def test_recall_of_the_plain_top_five_at_a_twentieth_of_the_pairs(spark):
    if not os.path.exists(CHUNKS):
        pytest.skip("no test data")
    table = spark.read.parquet(CHUNKS)
    asked = {"trees": 12, "candidates": 600, "window": 64, "sample": 16_384, "cell": 6}
    found = similar.most_similar(table, "chunk_id", "embedding", 96, k=5, **asked).toPandas()
    held = table.select("chunk_id", "embedding").dropDuplicates(["chunk_id"]).toPandas().sort_values("chunk_id")
    rows, v = similar.usable(pa.array(held["embedding"].tolist(), pa.list_(pa.float32())), 96)
    ids = held["chunk_id"].to_numpy()[rows]
    cosine = v.astype(float) @ v.astype(float).T
    np.fill_diagonal(cosine, -2)
    best = np.argpartition(-cosine, 5, axis=1)[:, :5]
    want = set(zip(np.repeat(ids, 5).tolist(), ids[best.ravel()].tolist()))
    assert len(want & set(zip(found["chunk_id"].tolist(), found["neighbour"].tolist()))) >= 0.9 * len(want)
    trees = [similar.Tree(v, asked["cell"], np.random.default_rng([11, t])) for t in range(asked["trees"])]
    assert min(len(t.middles) for t in trees) >= 1000
    codes = [t.codes(v) for t in trees]
    counts = []
    for code in codes:
        order = np.argsort(code, kind="stable")
        back = np.empty(len(v), np.int64)
        back[order] = np.arange(len(v))
        counts.append(similar.shared_counts(code[order], asked["window"])[back])
    total = np.sum(counts, axis=0, dtype=np.int64)
    stops = [similar.stop_depth([c[i].tobytes() for c in counts], asked["candidates"]) for i in range(len(v))]
    assert np.mean([total[i, d - 1] if d else 2 * 64 * 12 for i, d in enumerate(stops)]) < 0.1 * len(v)


def test_hot_copies_and_empty_table(spark):
    rng = np.random.default_rng(7)
    same = [float(x) for x in rng.standard_normal(8)]
    rows = [(i, same if i < 200 else [float(x) for x in rng.standard_normal(8)]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, e array<float>").repartition(3)
    got = similar.most_similar(df, "id", "e", 8, k=3, candidates=60, window=16, sample=300, cell=2, rows=50).collect()
    copies = [r for r in got if r["id"] < 200]
    assert len(copies) == 600 and all(r["similarity"] == 1.0 and r["neighbour"] < 200 and r["neighbour"] != r["id"] for r in copies)
    assert len({r["id"] for r in got}) == 600
    assert similar.most_similar(df.limit(0), "id", "e", 8).count() == 0 and similar.most_similar(df.limit(1), "id", "e", 8).count() == 0


def test_slices_share_out_hot_strings():
    rng = np.random.default_rng(8)
    code, late = np.sort(np.r_[np.full(4000, 7), rng.integers(0, 1 << 40, 6000)]), rng.integers(0, similar.SHARES, 10000)
    order = np.lexsort((late, code))
    first = order[[1000 * s for s in range(1, 10)]]
    sizes = np.bincount(similar.slice_of(code, late, code[first], late[first]), minlength=10)
    assert sizes.max() == sizes.min() == 1000


def test_counts_of_shared_prefixes():
    rng = np.random.default_rng(4)
    code = np.sort(rng.integers(0, 1 << 60, 200) & rng.integers(0, 1 << 60, 200))
    got = similar.shared_counts(code, 5)
    for i in range(200):
        others = [j for j in range(max(0, i - 5), min(200, i + 6)) if j != i]
        assert got[i].tolist() == [sum(code[i] >> (60 - d) == code[j] >> (60 - d) for j in others) for d in range(1, 61)]
    assert similar.stop_depth([got[0].tobytes(), got[0].tobytes()], 10**6) == 0


def test_recall_of_a_third_that_is_nearly_equal(spark):
    rng = np.random.default_rng(9)
    n, size = 3000, 32
    v = rng.standard_normal((n, size))
    v[::3] = v[0] / np.linalg.norm(v[0]) + rng.standard_normal((n // 3, size)) * np.sqrt(1e-4 / size)  # pairs of cosine 0.9999
    v = v.astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, e array<float>")
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    assert 0.9998 < np.median(s[::3, ::3]) < 0.99995
    want = {(i, int(j)) for i in range(0, n, 3) for j in np.argsort(-s[i])[:5]}
    got = {(r["id"], r["neighbour"]) for r in similar.most_similar(df, "id", "e", size, k=5, candidates=800, window=48, sample=1500, cell=4, rows=1000).collect() if not r["id"] % 3}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9


def test_ranks_by_unrounded_scores_and_least_keys():
    rng = np.random.default_rng(10)
    base = rng.standard_normal(16)
    v = base + rng.standard_normal((400, 16)) * 1e-4
    v[100:107] = base  # copies, fewer than the slack
    v = similar.unpacked(similar.packed_bytes((v / np.linalg.norm(v, axis=1)[:, None])), 16)
    none = np.zeros(400, np.int64)
    got = [similar.best_of(slice(at, min(400, at + 64)), v, none, none, np.arange(400), 400, 3, -1.0) for at in range(0, 400, 64)]
    i, j = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
    far = ((v[:, None] - v[None]) ** 2).sum(2)
    np.fill_diagonal(far, 9)
    assert (i == np.repeat(np.arange(400), 3)).all() and (j.reshape(-1, 3) == np.argsort(far, axis=1, kind="stable")[:, :3]).all()
