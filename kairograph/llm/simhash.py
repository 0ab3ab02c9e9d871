"""SimHash near-duplicates: candidates from equal blocks, thinned by pivot distance tables, then verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm import jaccard
from kairograph.llm.common import Scratch, ship, stored
from kairograph.llm.components import components
from kairograph.llm.shingles import hashed_shingles

BITS = 64
SHINGLE = 3
DISTANCE = 3
PIVOTS = np.random.default_rng(64).integers(0, 1 << 64, 32, dtype=np.uint64)
BLOCKS = 5
BUCKET_ROWS = 512
CHUNK = 1 << 14
BROADCAST_ROWS = 500_000
# With so few open bits a bucket of distinct fingerprints is small and is not split further.
FEW_BITS = 12


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of the word shingles of a text; 0 without words."""
    counts, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in hashed_shingles(text, size, CHUNK):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint as a long with the same 64 bits; an existing column of that name is replaced."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(np.array([fingerprint(t) for t in part], dtype=np.uint64).view(np.int64))

    return docs.withColumn(name, of(F.col(text).cast("string")))


# --- candidates ---------------------------------------------------------------------------


def _cut(bits: list[int], n: int) -> list[list[int]]:
    edges = [len(bits) * i // n for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def block_masks(distance: int = DISTANCE) -> list[list[list[int]]]:
    """Bits that are fixed in each table, level by level.

    Two fingerprints within the distance agree in BLOCKS - distance whole blocks: one table for
    each choice. Inside a bucket they agree again in one of distance + 1 blocks of the open bits,
    so table t of a level becomes tables (distance + 1) * t and following of the next.
    """
    blocks = _cut(list(range(BITS)), BLOCKS)
    level = [sum(chosen, []) for chosen in combinations(blocks, BLOCKS - distance)]
    levels = [level]
    while max(BITS - len(fixed) for fixed in level) > FEW_BITS:
        level = [fixed + b for fixed in level for b in _cut([i for i in range(BITS) if i not in fixed], distance + 1)]
        levels.append(level)
    return levels


def _as_long(bits: list[int]) -> int:
    mask = sum(1 << i for i in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def pivot_distances(prints: np.ndarray) -> np.ndarray:
    """The pivot table: Hamming distances of each fingerprint to every reference fingerprint."""
    return np.bitwise_count(prints[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def connect(buckets: np.ndarray, prints: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For each fingerprint the place of the first one that pairs within the distance connect it with in its (sorted) bucket.

    Pairs are looked at by their shift, and those that are connected already are passed over, so no
    list of pairs arises. The triangle inequality discards a pair as soon as one pivot coordinate
    differs by more than the distance; only survivors are compared themselves.
    """
    coordinates = pivot_distances(prints)
    label = np.arange(len(prints))
    left = label[:-1]
    shift = 1
    while len(left):
        left = left[left + shift < len(prints)]
        left = left[buckets[left] == buckets[left + shift]]
        a = left[label[left] != label[left + shift]]
        for some in (slice(0, 4), slice(4, None)):
            differ = np.abs(coordinates[a, some] - coordinates[a + shift, some]).max(axis=1, initial=0)
            a = a[differ <= distance]
        a = a[np.bitwise_count(prints[a] ^ prints[a + shift]) <= distance]
        label = _merged(label, a, a + shift)
        shift += 1
    return label


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the groups of a and b; a label is always the first place of its group."""
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
        a, b = a[label[a] != label[b]], b[label[a] != label[b]]
    return label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by bucket; a bucket that a batch cuts waits for the next one."""
    held = np.zeros((2, 0), dtype=np.int64)

    def made(rows: np.ndarray) -> pa.RecordBatch:
        label = connect(rows[0], rows[1].view(np.uint64))
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(rows[1, moved]), pa.array(rows[1, label[moved]])], names=["u", "v"])

    for batch in batches:
        rows = np.concatenate([held, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])], axis=1)
        ready = int(np.searchsorted(-(rows[0] == rows[0, -1]).astype(np.int8)[::-1], 0)) if rows.shape[1] else 0
        cut = rows.shape[1] - ready
        held = rows[:, cut:]
        if cut:
            yield made(rows[:, :cut])
    if held.shape[1]:
        yield made(held)


def links(distinct: DataFrame, most: int = BUCKET_ROWS, run: Scratch | None = None) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) that connect all that are within the distance.

    The tables of the levels are among those of `run`, if given.

    Buckets of one fingerprint go; buckets of up to `most` are searched in one task; larger ones
    are cut by further blocks, which loses no pair, until they are small or have `FEW_BITS` open bits.
    """
    spark = distinct.sparkSession
    levels = block_masks()
    rows = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(levels[0]) - 1))).alias("table"))
    found: DataFrame | None = None
    for depth, level in enumerate(levels):
        masks = F.array(*[F.lit(_as_long(bits)) for bits in level])
        bucket = F.xxhash64("table", F.col("fp").bitwiseAND(masks[F.col("table")]))
        rows = rows.select("fp", "table", bucket.alias("bucket"))
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = (run.stored if run else stored)(rows.join(sizes, "bucket"), "simhash-buckets")
        last = depth == len(levels) - 1
        small = rows if last else rows.where(F.col("n") <= most)
        part = (
            small.select("bucket", "fp")
            .repartition("bucket")
            .sortWithinPartitions("bucket")
            .mapInArrow(_links, "u long, v long")
        )
        found = part if found is None else found.unionByName(part)
        rows = rows.where(F.col("n") > most)
        if last or rows.isEmpty():
            break
        children = F.sequence(F.col("table") * (DISTANCE + 1), F.col("table") * (DISTANCE + 1) + DISTANCE)
        rows = rows.select("fp", F.explode(children).alias("table"))
    ship(spark)
    return found


def node_pairs(nodes: DataFrame, run: Scratch) -> DataFrame:
    """u, v: pairs of nodes (columns node, fp) with equal fingerprints, each with the least, and of least ones that `links` connects."""
    least = run.stored(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    equal = nodes.join(least, "fp").where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    near = links(least.select("fp"), run=run)
    for end in "uv":
        near = near.join(least.select(F.col("fp").alias(end), F.col("least").alias(f"least_{end}")), end)
    near = near.select(F.least("least_u", "least_v").alias("u"), F.greatest("least_u", "least_v").alias("v"))
    return equal.unionByName(near).distinct()


def _rows_and_classes(docs: DataFrame, key: str, text: str, carry: bool) -> tuple[DataFrame, DataFrame]:
    """Stored rows (number, doc, fp and `row`), and root and component of each fingerprint."""
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    texts = docs.select(F.col(key).alias("doc"), F.col(text).alias("_text"), *whole)
    rows = fingerprints(texts, "_text", "fp").drop("_text").withColumn("number", F.monotonically_increasing_id())
    rows = stored(rows, "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc").alias("least"))
    tree = stored(components(links(nodes.select("fp"))), "components")
    placed = nodes.join(tree, nodes["fp"] == tree["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    placed = stored(placed, "simhash-nodes")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component"))
    return rows, placed.join(smallest, "root").select("fp", "root", "component")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """Every row with number, doc, fp (long), root and component: the smallest key that links of up to 3 bits reach (and `row`).

    Texts are compared by word shingles without case of A-Z; null and blank texts have fingerprint
    zero, which is linked like any other. Equal fingerprints are one node, so copies cost nothing.
    A component of null keys only is null; null keys are otherwise ignored. `root` tells components
    apart, `number` tells rows apart. Empty in, empty out.
    """
    rows, classes = _rows_and_classes(docs, key, text, carry)
    return rows.join(classes, "fp")


def one_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float | None = None
) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the row with the smallest key stays.

    Texts are linked by fingerprints within `DISTANCE`, of shingles of three words; or, with a similarity,
    where the Jaccard similarity of their sets of shingles is at least that: pairs of near fingerprints of these shingles are verified
    first, and the prefix filter of `jaccard` then finds the links that fingerprints do not show. Null keys come last; of rows
    with the same key the first stays.
    """
    if similarity is not None:
        rows, gone = jaccard.removed(docs, key, text, shingle, similarity, lambda t: fingerprint(t, shingle), node_pairs)
        # Up to so many addresses are sent to every executor, and no row is exchanged.
        gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
        return rows.join(gone, "address", "left_anti").select("row.*")
    if shingle != SHINGLE:
        raise ValueError(f"fingerprints are of shingles of {SHINGLE} words")
    rows, classes = _rows_and_classes(docs, key, text, carry=True)
    order = F.struct(F.col("doc").isNull().alias("no_key"), "doc", "number")
    first = rows.select("fp", "doc", "number").join(classes, "fp").groupBy("root").agg(F.min(order).alias("first"))
    return rows.join(first.select(F.col("first.number").alias("number")), "number", "left_semi").select("row.*")
