"""Exact deduplication of a batch against an immutable snapshot that is screened by binary-fuse filters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import ship, stored, text_or_empty

# Fixed value: the characters that do not count when texts are compared.
WHITE_SPACE = " \t\n\x0b\x0c\r"
KEY = ("digest", "n_bytes")
KEYS_PER_FILTER = 1 << 14
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """One stored row per document: row number, key, length and the SHA-256 and size of its normalised bytes.

    Null texts count as empty. `carry` keeps the columns of `docs` as one struct `row`, so that names cannot clash.
    """
    raw = text_or_empty(text)
    # The normalised text is made once per row, as an element of an array.
    plain = F.explode(F.array(F.translate(raw, WHITE_SPACE, ""))).alias("_plain")
    rows = docs.select(
        F.col(key).alias("key"),
        F.char_length(raw).cast("long").alias("length"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
        plain,
    )
    found = rows.select(
        "key",
        "length",
        *(["row"] if carry else []),
        F.unhex(F.sha2(F.encode("_plain", "utf-8"), 256)).alias("digest"),
        F.octet_length("_plain").cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("number"),
    )
    return stored(found, "digests")


def best() -> Column:
    """The row that stays: longest original, then smallest key (null last), then first row."""
    return F.min(F.struct((-F.col("length")).alias("shorter"), F.col("key").isNull().alias("no_key"), "key", "number"))


def groups(rows: DataFrame) -> DataFrame:
    """Equal texts as one row; merged before the shuffle, so large groups of copies are no burden."""
    return rows.groupBy(*KEY).agg(best().alias("stays"), F.count(F.lit(1)).alias("size"))


# --- static binary-fuse filters -----------------------------------------------------------


@dataclass(frozen=True)
class Shape:
    """Geometry of a filter with three probes in consecutive segments."""

    segment: int
    segments: int

    @classmethod
    def of(cls, n: int) -> Shape:
        n = max(n, 2)
        segment = 1 << min(18, int(np.log(n) / np.log(3.33) + 2.25))
        slots = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))) + 1
        return cls(segment, max(1, -(-slots // segment) - 2))

    @property
    def slots(self) -> int:
        return (self.segments + 2) * self.segment


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    for factor in MIX:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _probes(h: np.ndarray, shape: Shape) -> np.ndarray:
    mask = np.uint64(shape.segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(shape.segments * shape.segment)) >> np.uint64(32)
    second = (first + np.uint64(shape.segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * shape.segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint8)


def fuse_filter(keys: np.ndarray) -> tuple[int, bytes]:
    """Seed and slots of a filter that holds every key; others pass with a chance of 1 in 256.

    Slots used by one key only are peeled off in layers; filling the layers in reverse makes
    the three slots of each key combine to its fingerprint.
    """
    keys = np.unique(keys)
    shape = Shape.of(len(keys))
    for seed in range(1, 200):
        h = _mixed(keys, seed)
        probes = _probes(h, shape)
        owners = np.zeros(shape.slots, dtype=np.int64)
        for row in probes:
            np.bitwise_xor.at(owners, row, np.arange(len(keys)))
        count = np.bincount(probes.ravel(), minlength=shape.slots)
        layers = []
        peeled = 0
        while True:
            single = np.flatnonzero(count == 1)
            if not len(single):
                break
            who, at = np.unique(owners[single], return_index=True)
            layers.append((who, single[at]))
            peeled += len(who)
            for row in probes[:, who]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owners, row, who)
        if peeled == len(keys):
            slots = np.zeros(shape.slots, dtype=np.uint8)
            prints = _prints(h)
            for who, slot in reversed(layers):
                slots[slot] = 0
                slots[slot] = prints[who] ^ np.bitwise_xor.reduce(slots[probes[:, who]], axis=0)
            return seed, slots.tobytes()
    raise RuntimeError(f"no filter found for {len(keys)} keys")


def may_hold(filter_: tuple[int, bytes], n: int, keys: np.ndarray) -> np.ndarray:
    seed, data = filter_
    h = _mixed(keys, seed)
    return np.bitwise_xor.reduce(np.frombuffer(data, np.uint8)[_probes(h, Shape.of(n))], axis=0) == _prints(h)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)


# --- snapshot and batch -------------------------------------------------------------------


@dataclass(frozen=True)
class Snapshot:
    """Groups of equal texts in buckets and one filter per bucket, both stored and never changed."""

    groups: DataFrame
    filters: DataFrame
    buckets: int


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(n))


def _probe_key() -> Column:
    return F.xxhash64("digest", "n_bytes").alias("probe")


def take_snapshot(rows: DataFrame, keys_per_filter: int = KEYS_PER_FILTER) -> Snapshot:
    held = stored(groups(rows), "snapshot")
    buckets = max(64, -(-held.count() // keys_per_filter))

    def build(part: pa.Table) -> pa.Table:
        keys = np.unique(_numbers(part["probe"]))
        seed, slots = fuse_filter(keys)
        return pa.table(
            {
                "bucket": part["bucket"][:1],
                "seed": pa.array([seed], pa.int64()),
                "keys": pa.array([len(keys)], pa.int64()),
                "slots": pa.array([slots], pa.binary()),
            }
        )

    keyed = held.select(_bucket(buckets).alias("bucket"), _probe_key())
    filters = keyed.groupBy("bucket").applyInArrow(build, "bucket long, seed long, keys long, slots binary")
    return Snapshot(held, stored(filters, "filters"), buckets)


def screen(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Add `positive` to the groups of a batch: whether the filter of their bucket may hold them.

    A bucket has about `KEYS_PER_FILTER` distinct texts however many copies there are.
    """

    def probe(_, part: pa.Table, filters: pa.Table) -> pa.Table:
        if part.num_rows == 0:
            return part.drop_columns(["bucket", "probe"]).append_column("positive", pa.array([], pa.bool_()))
        hit = np.zeros(part.num_rows, dtype=bool)
        if filters.num_rows:
            found = (filters["seed"][0].as_py(), filters["slots"][0].as_py())
            hit = may_hold(found, filters["keys"][0].as_py(), _numbers(part["probe"]))
        return part.drop_columns(["bucket", "probe"]).append_column("positive", pa.array(hit))

    schema = batch.schema.add("positive", "boolean")
    keyed = batch.withColumns({"bucket": _bucket(snapshot.buckets), "probe": _probe_key()})
    return keyed.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInArrow(probe, schema)


def merge(snapshot: Snapshot, batch: DataFrame) -> DataFrame:
    """Groups of snapshot and batch together: digest, n_bytes, stays, size.

    Only positives are joined with the exact buckets, on the 256-bit digest and the byte count;
    negatives are new for certain. Copies inside the batch were grouped before.
    """
    screened = stored(screen(groups(batch), snapshot), "screened")
    fresh = screened.where(~F.col("positive")).drop("positive")
    positive = screened.where("positive").drop("positive")
    old = snapshot.groups.select(*KEY, F.col("stays").alias("old"), F.col("size").alias("old_size"))
    checked = positive.join(old, list(KEY), "left").select(
        *KEY,
        F.least("stays", F.coalesce("old", "stays")).alias("stays"),
        (F.col("size") + F.coalesce("old_size", F.lit(0))).alias("size"),
    )
    untouched = snapshot.groups.join(positive, list(KEY), "left_anti")
    return fresh.unionByName(checked).unionByName(untouched)


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """Every row with its group of equal texts: key, digest, n_bytes, keep_key, group_size, kept (and `row`).

    Texts are equal when they agree without white space; null counts as empty, so all empty texts
    are one group. The longest original stays, then the smallest key, null keys last; of repeated
    rows the first stays. The documents are taken as an immutable first half, by a hash of the
    digest and the row number, and a second half that is screened against it; the result does
    not depend on the split. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = digests(docs, key, text, carry)
    half = F.pmod(F.xxhash64("digest", "number"), F.lit(2))
    snapshot = take_snapshot(rows.where(half == 0))
    found = merge(snapshot, rows.where(half == 1)).withColumnRenamed("size", "group_size")
    return rows.join(found, list(KEY)).select(
        *(["row"] if carry else []),
        "key",
        *KEY,
        F.col("stays.key").alias("keep_key"),
        "group_size",
        (F.col("number") == F.col("stays.number")).alias("kept"),
    )
