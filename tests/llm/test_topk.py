import numpy as np
import pytest

from kairograph.llm.topk import bucket_top, coordinate_survivors, exact_top


def brute(rows, every, k=5, scale=256.0):
    good = [
        (i, np.floor(np.array(v, np.float64) * scale))
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, tuple(np.pad(v, (0, width - len(v))))) for i, v in good]
    queries = {i: min(v for j, v in good if j == i) for i, _ in good if i % every == 0}
    found = set()
    for q, x in queries.items():
        scores = sorted((-int(np.dot(x, v)), i) for i, v in good if i != q)
        found |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return found


def check(spark, rows, every, chunk_rows=4096):
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, length int")
    found = exact_top(frame, lambda key: key % every == 0, chunk_rows=chunk_rows)
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert {tuple(r) for r in found.collect()} == brute(rows32, every)


def test_lengths_of_many_sizes(spark):
    """Few long vectors near each query, so that buckets are left out and both ways of pruning are used."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 16))
    rows = [(i, (base[i % 20] * rng.lognormal(0, 1) + rng.normal(0, 0.05, 16)).tolist()) for i in range(1500)]
    check(spark, rows, 50, chunk_rows=100)


def test_equal_vectors_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [0.5, 0.25, -1.0] if i % 3 else rng.choice([0.0, 0.5, -0.5], 3).tolist()) for i in rng.permutation(600)]
    check(spark, rows, 20, chunk_rows=50)


def test_hard_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 1.0]), (50, [0.0, 0.0]), (100, [-1.0, -2.0]), (None, [9.0, 9.0]), (3, None), (4, [1.0, None]),
        (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0]), (-50, [0.3, -0.001]),
    ]
    check(spark, rows, 50)


@pytest.mark.parametrize("rows", [[], [(1, [1.0])], [(50, [1.0])], [(50, None)]])
def test_few_rows(spark, rows):
    check(spark, rows, 50)


def test_long_vectors_beside_ordinary_ones(spark):
    """Integers of any size in the comparison: doubles hold none of the large products exactly."""
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(300)]
    rows += [(int(300 + i), [float(np.float32(x)) for x in rng.normal(size=4) * 10.0**e]) for e in (3, 6, 9, 12) for i in range(e * 10, e * 10 + 10)]
    rows += [(20, [1e6, 1.0, 2.0, 3.0]), (40, [1e6 + 1, 1.0, 2.0, 3.0])]
    found = exact_top(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda key: key % 20 == 0).collect()
    numbers = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    queries = {}
    for i, v in numbers:
        if i % 20 == 0:
            queries[i] = min(queries.get(i, v), v)
    clip = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    want = set()
    for q, x in queries.items():
        best = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for i, v in numbers if i != q)[:5]
        want |= {(q, rank, i, clip(-s)) for rank, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in found} == want
    assert any(r[3] == (1 << 63) - 1 for r in want) and any(1 << 53 < r[3] < (1 << 63) - 1 for r in want)


def test_coordinates_lose_nothing():
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(2000, 6))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    for threshold in (0.2, 0.8, 0.95):
        for query in unit[:50]:
            near = set(np.flatnonzero(unit @ query >= threshold).tolist())
            left = set(coordinate_survivors(unit, query, threshold).tolist())
            assert near <= left
            assert threshold < 0.9 or len(left) < 1000


def test_bucket_reaches_floor():
    rng = np.random.default_rng(4)
    numbers = rng.integers(-5, 6, (300, 4)).astype(float)
    lengths = np.linalg.norm(numbers, axis=1)
    order = np.argsort(-lengths, kind="stable")
    numbers, lengths, keys = numbers[order], lengths[order], rng.permutation(300)
    queries = (keys[:60], lengths[:60], numbers[:60])
    for at in (-np.inf, 0.0, 20.0, 60.0, 1e9):
        found = bucket_top(queries, (keys, lengths, numbers), np.full(60, at), 3)
        for i, (ids, scores) in enumerate(found):
            all_ = sorted((-s, int(j)) for j, s in zip(keys, numbers @ numbers[i], strict=True) if j != keys[i] and s >= at)[:3]
            assert list(zip(ids.tolist(), scores.tolist(), strict=True)) == [(j, -s) for s, j in all_]
