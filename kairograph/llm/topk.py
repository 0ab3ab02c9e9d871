"""Exact top-k by inner product with norm-bucketed retrieval.

Vectors are grouped by length into buckets, and queries into blocks. A first round finds for each
query k products in the bucket of the longest vectors; the least of them is a score that its
results must reach. A bucket whose longest vector cannot reach it is left out; within the others
the score becomes a cosine threshold of the bucket, which decides for each query how to prune:
by length, which leaves the longer vectors of the bucket, or, where the threshold is high, by the
coordinates in which the query is largest. Products of what is left are computed exactly.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.llm.common import ship, stored

CHUNK_ROWS = 4096
BLOCK_ROWS = 512
LEVELS = 64
BLOCKS_PER_GROUP = 16
FOCUS = 4
STEEP = 0.8
SLACK = 1e-9
# Sums of products stay exact in doubles while the lengths multiply to less than this.
EXACT = float(1 << 52)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
# Bytes of a product that is no LONG, as a number that sorts like it.
WIDE = 160


def prepared(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """key, numbers (floor(scale * x) as doubles) and length of the vectors that take part."""
    absolute = lambda v: F.abs(v.cast("double"))
    x = F.col(vector)
    # Null makes the whole condition null; NaN is above infinity in Spark's order.
    finite = F.forall(x, lambda v: absolute(v) * abs(scale) < float("inf"))
    # From 2^52 on every double is whole.
    scaled = lambda v: v.cast("double") * scale
    whole = F.transform(x, lambda v: F.when(F.abs(scaled(v)) < EXACT, F.floor(scaled(v)).cast("double")).otherwise(scaled(v)))
    rows = vectors.where(F.col(key).isNotNull() & x.isNotNull()).where(finite).select(F.col(key).alias("key"), whole.alias("numbers"))
    square = F.aggregate("numbers", F.lit(0.0), lambda total, v: total + v * v)
    return stored(rows.withColumn("length", F.sqrt(square)), "vectors")


def _matrix(numbers: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows as a matrix; shorter vectors are filled with zeros."""
    if isinstance(numbers, pa.ChunkedArray):
        numbers = numbers.combine_chunks()
    flat, sizes = numbers.flatten().to_numpy(), np.diff(numbers.offsets.to_numpy())
    found = np.zeros((len(sizes), width))
    found[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return found


PACK = "group long, part long, longest double, keys binary, lengths binary, numbers binary"


def packed(rows: DataFrame, group: Column, part: Column, width: int) -> DataFrame:
    """Rows of a (group, part) as one row: keys, lengths and numbers, longest vectors first."""

    def pack(table: pa.Table) -> pa.Table:
        lengths, keys = table["length"].to_numpy(), table["key"].to_numpy()
        order = np.lexsort((keys, -lengths))
        numbers = _matrix(table["numbers"], width)[order]
        data = [lengths[order[0]], keys[order].tobytes(), lengths[order].tobytes(), numbers.astype("<f8").tobytes()]
        types = (pa.float64(), pa.binary(), pa.binary(), pa.binary())
        columns = [table["group"][:1], table["part"][:1], *(pa.array([d], t) for d, t in zip(data, types, strict=True))]
        return pa.table(columns, names=["group", "part", "longest", "keys", "lengths", "numbers"])

    marked = rows.select(group.cast("long").alias("group"), part.cast("long").alias("part"), "key", "length", "numbers")
    return marked.groupBy("group", "part").applyInArrow(pack, PACK)


# --- one query block against one bucket ---------------------------------------------------


def coordinate_survivors(unit: np.ndarray, query: np.ndarray, threshold: float, focus: int = FOCUS) -> np.ndarray:
    """Rows of unit vectors that may have a cosine of the threshold or more with a unit query.

    A vector within an angle a of the query makes an angle within a of the query's own with every axis.
    """
    angle = np.arccos(np.clip(threshold, -1, 1))
    axes = np.argsort(-np.abs(query))[:focus]
    own = np.arccos(np.clip(query[axes], -1, 1))
    low = np.cos(np.minimum(np.pi, own + angle)) - SLACK
    high = np.cos(np.maximum(0, own - angle)) + SLACK
    return np.flatnonzero(((unit[:, axes] >= low) & (unit[:, axes] <= high)).all(axis=1))


def bucket_top(
    queries: tuple[np.ndarray, np.ndarray, np.ndarray],
    bucket: tuple[np.ndarray, np.ndarray, np.ndarray],
    floor: np.ndarray,
    k: int,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the keys and products of the bucket's best k that reach its floor; ties to smaller keys."""
    query_keys, query_lengths, query_numbers = queries
    keys, lengths, numbers = bucket
    none = (keys[:0], np.zeros(0))
    found = [none] * len(query_keys)
    with np.errstate(divide="ignore", invalid="ignore"):
        # Vectors at least this long can reach the floor; a query of length 0 or a floor below 0 excludes none.
        needed = np.where((query_lengths > 0) & (floor > 0), floor / query_lengths * (1 - SLACK), 0.0)
        local = np.where(needed > 0, needed / max(lengths[0], 1e-300), 0.0)
    prefix = np.searchsorted(-lengths, -needed, side="right")
    unit = None
    by_length = []
    for i in np.flatnonzero(prefix).tolist():
        if local[i] < STEEP:
            by_length.append(i)
            continue
        if unit is None:
            unit = numbers / np.maximum(lengths, 1e-300)[:, None]
        n = prefix[i]
        rows = coordinate_survivors(unit[:n], query_numbers[i] / query_lengths[i], local[i] * (1 - SLACK))
        found[i] = _best(keys[rows], _products(numbers[rows], query_numbers[i], lengths[0] * query_lengths[i]), query_keys[i], floor[i], k)
    by_length, long = [i for i in by_length if lengths[0] * query_lengths[i] < EXACT], [i for i in by_length if lengths[0] * query_lengths[i] >= EXACT]
    if by_length:
        n = int(prefix[by_length].max())
        products = query_numbers[by_length] @ numbers[:n].T
        for row, i in enumerate(by_length):
            found[i] = _best(keys[: prefix[i]], products[row, : prefix[i]], query_keys[i], floor[i], k)
    for i in long:
        n = int(prefix[i])
        found[i] = _best(keys[:n], _products(numbers[:n], query_numbers[i], np.inf), query_keys[i], floor[i], k)
    return found


def _products(numbers: np.ndarray, query: np.ndarray, bound: float) -> np.ndarray:
    """Products of the rows with a query, as doubles where these are exact, and as integers of any size where not."""
    if bound < EXACT:
        return numbers @ query
    whole = [int(x) for x in query]
    out = np.empty(len(numbers), dtype=object)
    for i, row in enumerate(numbers.tolist()):
        out[i] = sum(int(x) * y for x, y in zip(row, whole, strict=True))
    return out


def _best(keys: np.ndarray, products: np.ndarray, own: int, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    rows = np.flatnonzero((products >= floor) & (keys != own))
    if products.dtype == object:
        rows = np.array(sorted(rows.tolist(), key=lambda i: (-products[i], keys[i]))[:k], np.int64)
        return keys[rows], products[rows]
    if len(rows) > k:
        bar = np.partition(products[rows], len(rows) - k)[len(rows) - k]
        rows = rows[products[rows] >= bar]
    rows = rows[np.lexsort((keys[rows], -products[rows]))][:k]
    return keys[rows], products[rows]


# --- jobs ---------------------------------------------------------------------------------


def _unpacked(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.frombuffer(row["keys"], np.int64)
    return keys, np.frombuffer(row["lengths"]), np.frombuffer(row["numbers"], "<f8").reshape(len(keys), width)


def _search(k: int, width: int):
    def run(_, buckets: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        for bucket in buckets.to_pylist():
            vectors = _unpacked(bucket, width)
            for block in blocks.to_pylist():
                queries = _unpacked(block, width)
                for query, (keys, products) in zip(queries[0], bucket_top(queries, vectors, np.frombuffer(block["floors"]), k), strict=True):
                    out[0] += [int(query)] * len(keys)
                    out[1] += keys.tolist()
                    whole = [int(x) for x in products.tolist()]
                    out[2] += [min(max(x, LEAST), MOST) for x in whole]
                    out[3] += [None if LEAST < x < MOST else (x + (1 << (8 * WIDE - 1))).to_bytes(WIDE, "big") for x in whole]
        kinds = (("query", pa.int64()), ("key", pa.int64()), ("score", pa.int64()), ("wide", pa.binary()))
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds, out, strict=True)})

    return run


def _matched(pairs: DataFrame, buckets: DataFrame, blocks: DataFrame, k: int, width: int) -> DataFrame:
    """Products of the (bucket, block) pairs: (group, part, block), several blocks to one copy of a bucket."""
    wanted = pairs.withColumn("batch", F.floor(F.col("block") / BLOCKS_PER_GROUP))
    own = wanted.select("block", *[F.col(c).alias(f"to_{c}") for c in ("group", "part", "batch")])
    left = wanted.select("group", "part", "batch").distinct().join(buckets, ["group", "part"])
    right = own.join(blocks.withColumnRenamed("group", "block").drop("part", "longest"), "block")
    searched = left.groupBy("group", "part", "batch").cogroup(right.groupBy("to_group", "to_part", "to_batch"))
    return searched.applyInArrow(_search(k, width), "query long, key long, score long, wide binary")


def top(found: DataFrame, k: int) -> DataFrame:
    """query, rank, key, score of the best k; partial top-k lists are cut before the exchange."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("wide"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _with_floors(blocks: DataFrame, least: DataFrame) -> DataFrame:
    """Add the floors of the queries of each block, and the least length that a vector needs for any of them."""

    def add(_, block: pa.Table, known: pa.Table) -> pa.Table:
        keys = np.frombuffer(block["keys"][0].as_py(), np.int64)
        lengths = np.frombuffer(block["lengths"][0].as_py())
        floors = pd.Series(known["floor"].to_numpy(), known["query"].to_numpy()).reindex(keys).fillna(-np.inf).to_numpy()
        open_ = (floors <= 0) | (lengths == 0)
        needed = 0.0 if open_.any() else float((floors / lengths).min()) * (1 - SLACK)
        return block.append_column("floors", pa.array([floors.tobytes()], pa.binary())).append_column("needed", pa.array([needed]))

    return blocks.groupBy("group").cogroup(least.groupBy("block")).applyInArrow(add, f"{PACK}, floors binary, needed double")


def exact_top(
    vectors: DataFrame,
    is_query: Callable[[Column], Column],
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: float = 256.0,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """query, rank, key, score: for each query the k largest inner products with other vectors.

    Numbers are floor(scale * x); ties go to the smaller key. Vectors without a key, null ones and
    those with a null or non-finite number take no part. Shorter vectors are filled with zeros. Rows
    with the query's key are its own; other keys that repeat are candidates each for itself, and a
    query key that repeats is answered once, for its least vector. Products of long vectors, which doubles
    cannot hold, are taken in integers of any size; a score outside LONG is given as the nearest LONG, and
    ranked by what it is. Numbers are up to 1e150. Buckets of equal length are dealt out by a hash, so many equal vectors are
    only more buckets. An empty table, and one without queries, give an empty result.
    """
    ship(vectors.sparkSession)
    rows = prepared(vectors, key, vector, scale)
    size = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.size("numbers")).alias("width"),
        F.max("length").alias("longest"),
        F.percentile_approx("length", [i / LEVELS for i in range(1, LEVELS)], 1000).alias("limits"),
    ).first()
    queries = rows.where(is_query(F.col("key"))).groupBy("key")
    queries = queries.agg(F.min("numbers").alias("numbers"), F.min_by("length", "numbers").alias("length"))
    n_queries = queries.count()
    if not size["n"] or not n_queries:
        return vectors.sparkSession.createDataFrame([], "query long, rank int, key long, score long")
    width = max(size["width"], 1)
    limits = sorted(set(size["limits"]), reverse=True)
    level = F.size(F.filter(F.array(*[F.lit(x) for x in limits]), lambda x: x > F.col("length")))
    # Counts of at most LEVELS levels.
    per_level = {r["level"]: r["n"] for r in rows.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    chunks = F.element_at(F.create_map(*[F.lit(int(x)) for l, n in per_level.items() for x in (l, -(-n // chunk_rows))]), level)
    buckets = stored(packed(rows, level, F.pmod(F.xxhash64("key", F.lit(3)), chunks), width), "norm-buckets")
    n_blocks = -(-n_queries // BLOCK_ROWS)
    block = F.pmod(F.xxhash64("key", F.lit(4)), F.lit(n_blocks))
    blocks = stored(packed(queries, block, F.lit(0), width), "query-blocks")

    first = min(per_level)
    ids = buckets.select("group", "part", "longest")
    none = queries.select(F.col("key").alias("query"), block.alias("block"), F.lit(None).cast("double").alias("floor"))
    opened = _with_floors(blocks, none)
    start = [F.lit(x).cast("long").alias(n) for x, n in ((first, "group"), (0, "part"))]
    began = _matched(blocks.select(F.col("group").alias("block"), *start), buckets, opened, k, width)
    began = stored(began, "first-products")
    kth = top(began, k).where(F.col("rank") == k)
    # A query that has k products in the first bucket needs at least the k-th of them.
    of_block = F.pmod(F.xxhash64("query", F.lit(4)), F.lit(n_blocks)).alias("block")
    kth_score = F.col("score").cast("double")
    # A double beyond 2^52 may lie above its LONG, and the least LONG may stand for less.
    floor = F.when(F.abs(kth_score) < EXACT, kth_score).when(kth_score > -float(1 << 62), kth_score - F.abs(kth_score) * SLACK).otherwise(float("-inf"))
    least = kth.select("query", of_block, floor.alias("floor"))
    ready = stored(_with_floors(blocks, least), "query-floors")
    # A pair is one bucket and one block of queries that it may serve, not one of vectors.
    reach = ready.select(F.col("group").alias("block"), "needed")
    pairs = ids.join(reach, F.col("longest") >= F.col("needed")).select("group", "part", "block")
    pairs = pairs.where(~((F.col("group") == first) & (F.col("part") == 0)))
    return top(began.unionByName(_matched(pairs, buckets, ready.drop("needed"), k, width)), k).select(
        "query", F.col("rank").cast("int").alias("rank"), "key", "score"
    )
