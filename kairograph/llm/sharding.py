"""Histogram sort into shards of nearly equal bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.llm.common import ship, stored, text_or_empty

ROW_BYTES = 8
PARTS_PER_SHARD = 64
PART_BYTES = 256 << 20


@dataclass(frozen=True)
class Splitters:
    """Parts of the key order, in order.

    Cell i holds the keys below `bounds[i]` and not below the bound before. A cell of one key that is
    heavier than the tolerance is `cut[i]` parts by the second key, any other one part; `first[i]`
    is its first part. `shard` and `start` give the shard of a part and its first slot there.
    """

    bounds: np.ndarray
    cut: np.ndarray
    first: np.ndarray
    shard: np.ndarray
    start: np.ndarray

    def cell(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, keys, side="right")

    def part(self, keys: np.ndarray, seconds: np.ndarray) -> np.ndarray:
        cell = self.cell(keys)
        high = seconds.view(np.uint64) >> np.uint64(32)
        return self.first[cell] + ((high * self.cut[cell].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def _cells(keys: DataFrame, bounds: np.ndarray) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("long")
    def cell(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(np.searchsorted(shared.value, part.to_numpy(), side="right"))

    return keys.withColumn("cell", cell("key"))


def histogram(keys: DataFrame, most: int) -> tuple[np.ndarray, pd.DataFrame]:
    """Bounds such that each cell has at most `most` bytes or a single key, and exact bytes and rows by cell.

    Starts with an even grid over the hashed keys. Every round counts all cells in one pass and
    puts new probes into those that are too heavy: quantiles of their keys, and the key of the
    largest row alone. A key that holds much of the data is so cut out within a few rounds.
    """
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    cells = max(1, 2 * (total // most))
    bounds = np.array([((i * (1 << 64)) // cells) - (1 << 63) for i in range(1, cells)], dtype=np.int64)
    quantiles = [i / 9 for i in range(1, 9)]
    while True:
        placed = _cells(keys, bounds)
        counts = (
            placed.groupBy("cell")
            .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
            .toPandas()
            .sort_values("cell", ignore_index=True)
        )
        heavy = counts[(counts.bytes > most) & (counts.low < counts.high)]
        if heavy.empty:
            return bounds, counts
        # One row per heavy cell, and there are fewer cells than twice the parts.
        wanted = keys.sparkSession.createDataFrame([(int(c),) for c in heavy.cell], "cell long")
        probes = (
            placed.join(F.broadcast(wanted), "cell", "left_semi")
            .groupBy("cell")
            .agg(F.percentile_approx("key", quantiles, 200).alias("q"), F.max_by("key", "bytes").alias("largest"))
            .collect()
        )
        new = {int(k) + i for row in probes for k in (*row.q, row.largest) for i in (0, 1)}
        lowest = {int(row.low) for row in heavy.itertuples()}
        # The least key of a cell would cut off nothing; the one after it cuts off that key.
        new = (new - lowest) | {k + 1 for k in lowest if k + 1 in new}
        if not new - set(bounds.tolist()):
            new = {int(row.low) + 1 for row in heavy.itertuples()}
        bounds = np.unique(np.concatenate([bounds, np.array(sorted(k for k in new if k < 1 << 63), dtype=np.int64)]))


def tolerance(keys: DataFrame, shards: int) -> int:
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    return max(1, min(total // (shards * PARTS_PER_SHARD), PART_BYTES))


def find_splitters(keys: DataFrame, shards: int) -> Splitters:
    """Exact counts of bytes below candidate bounds, refined until each part is within the tolerance."""
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    most = tolerance(keys, shards)
    bounds, counts = histogram(keys, most)
    cells = len(bounds) + 1
    cut = np.ones(cells, dtype=np.int64)
    for row in counts.itertuples():
        if row.bytes > most and row.rows > 1:
            cut[row.cell] = -(-row.bytes // most)
    first = np.concatenate([[0], np.cumsum(cut)[:-1]])
    parts = int(cut.sum())
    splitters = Splitters(bounds, cut, first, np.zeros(parts, np.int64), np.zeros(parts, np.int64))
    exact = with_parts(keys, splitters).groupBy("place.part").agg(F.sum("bytes"), F.count(F.lit(1))).collect()
    size, rows = np.zeros(parts, np.int64), np.zeros(parts, np.int64)
    for part, b, n in exact:
        size[part], rows[part] = b, n
    below = np.concatenate([[0], np.cumsum(size)])
    aims = np.arange(1, shards) * (total / shards)
    after = np.searchsorted(below, aims)
    nearer = np.where(aims - below[after - 1] <= below[after] - aims, after - 1, after) if total else after
    edges = np.maximum.accumulate(nearer)
    shard = np.searchsorted(edges, np.arange(parts), side="right")
    before = np.concatenate([[0], np.cumsum(rows)])[:-1]
    opening = np.array([before[np.searchsorted(shard, s)] if (shard == s).any() else 0 for s in range(shards)])
    return Splitters(bounds, cut, first, shard, before - opening[shard])


def with_parts(df: DataFrame, splitters: Splitters, key: str = "key", second: str = "second") -> DataFrame:
    """Add `place`: part, shard and the first slot of the part."""
    shared = df.sparkSession.sparkContext.broadcast(splitters)

    @F.pandas_udf("part long, shard int, start long")
    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        s = shared.value
        for keys, seconds in parts:
            part = s.part(keys.to_numpy(), seconds.to_numpy())
            yield pd.DataFrame({"part": part, "shard": s.shard[part].astype(np.int32), "start": s.start[part]})

    return df.withColumn("place", place(key, second))


def _sort_key(text: str) -> Column:
    return F.xxhash64(text_or_empty(text))


def shard(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row as `row` with shard and slot; slots of a shard run from 0 without gaps.

    Rows are sorted by a hash of the text, then by a hash of id and text: equal texts are neighbours,
    and a group of them is cut by the second key only where it is larger than the tolerance of a
    64th of a shard. Shards differ by about that or by their largest document. The size of a row is
    its UTF-8 bytes and `ROW_BYTES`; null texts have none. Texts are exchanged once, in parts of at
    most `PART_BYTES` unless one document is longer. Rows of one id and text that are heavier than the
    tolerance get a stored number in their second key, by which they are cut as well. Null ids are sorted like any id, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    second = F.xxhash64(F.lit(2), F.col(key), text_or_empty(text))
    size = (F.octet_length(text_or_empty(text)) + F.lit(ROW_BYTES)).cast("long")
    keys = stored(docs.select(_sort_key(text).alias("key"), second.alias("second"), size.alias("bytes")), "shard-keys")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _sort_key(text).alias("key"), second.alias("second")
    )
    heavy = keys.groupBy("key", "second").agg(F.sum("bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n"))
    heavy = stored(heavy.where(F.col("n") > 1).where(F.col("n_bytes") > tolerance(keys, shards)).select("key", "second"), "repeated-rows")
    if not heavy.isEmpty():
        # Fewer than there are parts. The number is stored, so that counts and rows agree.
        marked = rows.join(F.broadcast(heavy.withColumn("repeated", F.lit(True))), ["key", "second"], "left")
        salted = F.xxhash64("second", F.monotonically_increasing_id())
        number = F.when(F.col("repeated"), salted).otherwise(F.col("second"))
        rows = stored(marked.select("row", "key", number.alias("second")), "numbered-rows")
        size = (F.octet_length(text_or_empty(f"row.`{text}`")) + F.lit(ROW_BYTES)).cast("long")
        keys = rows.select("key", "second", size.alias("bytes"))
    splitters = find_splitters(keys, shards)
    placed = with_parts(rows, splitters)
    within = Window.partitionBy("part").orderBy("key", "second")
    return placed.select("row", "key", "second", "place.*").select(
        "row", "shard", (F.col("start") + F.row_number().over(within) - 1).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, **options) -> None:
    """Write the sharded rows as one folder per shard, with their slots."""
    rows = shard(docs, shards, **options).select("row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows.write.partitionBy("_shard").parquet(path)
