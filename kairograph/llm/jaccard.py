"""Groups of texts linked by the Jaccard similarity of their shingles: a complete prefix filter, thinned, then verified.

Two sets with a similarity of t or more share one of the first n - ceil(t * n) + 1 of their n shingles in
any order that is the same for all texts. The order here is that of the hashes, with common shingles last, the
most frequent at the end.
So texts that share one of those are all the candidates that there are, whatever the order.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import Scratch, addressed, freed_shuffles, ship
from kairograph.llm.components import components
from kairograph.llm.shingles import shingle_set

# Shingles that are found in COMMON texts of one in SAMPLE come last in the order; at most MOST_COMMON are broadcast.
SAMPLE = 32
COMMON = 8
MOST_COMMON = 1 << 17
CELLS = 64
# Places between two members of a bucket that are looked at in one round.
ROUNDS = ((1, 16), (16, 256), (256, None))
# Members of a bucket that are compared with each other in one step; further ones are in further blocks.
BLOCK = 2048
KINDS = "node long, other long, size long, cells binary, fine binary, fp long"
MOST_CELLS = 1 << 16
SEEN = 1 << 18


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def node_of(found: np.ndarray, seed: int) -> int:
    """A 64-bit hash of a set of shingles, as a long."""
    return _signed(xxhash.xxh3_64_intdigest(found.tobytes(), seed))


def described(text: str | None, size: int, seed: int) -> tuple[int, int, int, bytes, bytes]:
    """Node, a second hash and size of the set of shingles, and how many of them fall into each of CELLS cells, and into each of about n / 2."""
    found = shingle_set(text, size)
    fine = min(MOST_CELLS, max(CELLS, 1 << (max(len(found) // 2, 1) - 1).bit_length()))
    other = _signed(xxhash.xxh64_intdigest(found.tobytes(), seed))
    return node_of(found, seed), other, len(found), _cells(found, CELLS).tobytes(), _cells(found, fine).tobytes()


def _cells(found: np.ndarray, n: int) -> np.ndarray:
    """How many hashes fall into each of n equal ranges, n a power of two; 255 and more are 255."""
    return np.minimum(np.bincount(found >> np.uint64(65 - n.bit_length()), minlength=n), 255).astype(np.uint8)


def fine_enough(a: bytes, b: bytes, sizes: int, least: Fraction) -> bool:
    """`near_enough` for one pair whose cells may differ in number."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    x, y = (np.minimum(c.reshape(n, -1).sum(axis=1, dtype=np.int64), 255) for c in (x, y))
    return bool(near_enough(x[None], y[None], np.array([sizes]), least)[0])


class Common:
    """Frequent shingles in the order of their hashes, each with its place from the rarest to the most frequent."""

    def __init__(self, by_count: np.ndarray):
        order = np.argsort(by_count, kind="stable")
        self.tokens, self.rank = by_count[order], len(by_count) - order


def prefix(found: np.ndarray, common: Common, least: Fraction) -> np.ndarray:
    """The first shingles in the order of rare ones by hash, then frequent ones, the most frequent last."""
    at = np.searchsorted(common.tokens, found)
    late = np.zeros(len(found), bool)
    if len(common.tokens):
        at = np.minimum(at, len(common.tokens) - 1)
        late = common.tokens[at] == found
        at = at[late]
    n = len(found)
    last = found[late][np.argsort(common.rank[at], kind="stable")] if late.any() else found[:0]
    return np.concatenate([found[~late], last])[: n - _ceil(least * n) + 1]


def _ceil(x: Fraction) -> int:
    return -(-x.numerator // x.denominator)


def similar(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * least.denominator >= least.numerator * (len(a) + len(b) - both)


def near_enough(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, least: Fraction) -> np.ndarray:
    """Whether pairs can be similar: sets differ by at least as many shingles as their cells do."""
    differ = np.abs(a.astype(np.int64) - b).sum(axis=1)
    # A similarity of t or more leaves at most (1 - t) / (1 + t) of both sizes outside the overlap.
    p, q = least.numerator, least.denominator
    return differ * (q + p) <= (q - p) * sizes


def describe(docs: DataFrame, text: str, size: int, seed: int, fingerprint: Callable[[str | None], int]) -> DataFrame:
    """Add `kind`: node, second hash, size and cells of the shingles, and the fingerprint of the text."""
    ship(docs.sparkSession)

    @F.pandas_udf(KINDS)
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(*described(t, size, seed), _signed(fingerprint(t))) for t in part]
            yield pd.DataFrame(rows, columns=["node", "other", "size", "cells", "fine", "fp"])

    return docs.withColumn("kind", of(F.col(text).cast("string")))


def _tokens(texts: DataFrame, size: int, seed: int, common: Common | None, least: Fraction) -> DataFrame:
    """token, node, size: the prefix of each text, or without `common` all its shingles; most equal sets of a task go once."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out, held = [], 0
            for text in batch.column(0).to_pylist():
                found = shingle_set(text, size)
                node = node_of(found, seed)
                if node in seen or not len(found):
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                some = found if shared.value is None else prefix(found, shared.value, least)
                out.append((some, np.full(len(some), node), np.full(len(some), len(found))))
                held += len(some)
                if held > 1 << 16:
                    yield _batch(out)
                    out, held = [], 0
            if out:
                yield _batch(out)

    return texts.select("text").mapInArrow(run, "token long, node long, size long")


def _batch(out: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    token, node, size = (np.concatenate(c) for c in zip(*out, strict=True))
    columns = [pa.array(c) for c in (token.view(np.int64), node.astype(np.int64), size.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["token", "node", "size"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of tokens that are in two sets or more, each node once; rows are sorted by token and node.

    Only the last row waits for the next batch, however large a bucket is.
    """
    held = np.zeros((3, 0), np.int64)
    before = None
    for batch in batches:
        rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
        rows = rows[:, np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))[: rows.shape[1]]]
        if rows.shape[1] < 2:
            held = rows
            continue
        same = rows[0, 1:] == rows[0, :-1]
        kept = rows[:, :-1][:, np.append(rows[0, 0] == before, same[:-1]) | same]
        before, held = rows[0, -2], rows[:, -1:]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept], names=["token", "node", "size"])
    if held.shape[1] and held[0, 0] == before:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["token", "node", "size"])


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first column, a key at a time; a key that a batch cuts waits for the next one."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cut = int(np.argmax(rows[0] == rows[0][-1]))
        if held and (cut or rows[0][0] != held[0][0][0]):
            yield [np.concatenate(c) for c in zip(*held, [r[:cut] for r in rows], strict=True)]
            held = []
        elif cut:
            yield [r[:cut] for r in rows]
        held.append([r[cut:] for r in rows])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _pairs(low: int, high: int | None, least: Fraction):
    """Pairs of different labels, low to high places apart in their bucket, that have sizes and cells which fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, size, node, label, cells in _whole_blocks(batches):
            cells = np.frombuffer(b"".join(cells), np.uint8).reshape(-1, CELLS)
            left, shift = np.arange(len(token)), low
            while high is None or shift < high:
                left = left[left + shift < len(token)]
                left = left[token[left] == token[left + shift]]
                # Rows go by size, so what is too large here is too large further on.
                left = left[size[left] * least.denominator >= size[left + shift] * least.numerator]
                if not len(left):
                    break
                a = left[label[left] != label[left + shift]]
                a = a[near_enough(cells[a], cells[a + shift], size[a] + size[a + shift], least)]
                if len(a):
                    u, v = np.minimum(node[a], node[a + shift]), np.maximum(node[a], node[a + shift])
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                shift += 1

    return run


def _across(least: Fraction):
    """Pairs of different labels of two blocks, or within one, that have sizes and cells which fit; `left` and `right` mark the sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, side, size, node, label, cells in _whole_blocks(batches):
            cells = np.frombuffer(b"".join(cells), np.uint8).reshape(-1, CELLS)
            right = np.flatnonzero(side != 0)
            for i in np.flatnonzero(side != 1).tolist():
                b = right[(label[right] != label[i]) & (right != i)]
                b = b[(size[b] * least.denominator >= size[i] * least.numerator) & (size[i] * least.denominator >= size[b] * least.numerator)]
                b = b[near_enough(cells[b], cells[i][None], size[b] + size[i], least)]
                if len(b):
                    u, v = np.minimum(node[b], node[i]), np.maximum(node[b], node[i])
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def _some(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the wanted (address, node). A bit map keeps most other texts out of the exchange; it lets all wanted ones pass."""
    spark = source.sparkSession
    # Sixteen bits for each, up to 32 MB; a fuller map only lets more texts pass.
    bits = 1 << min(28, max(20, (16 * wanted.count()).bit_length()))
    bit = F.pmod(F.xxhash64("address"), F.lit(bits))
    maps = wanted.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    held = np.zeros((bits // 32768 + 2, 4096), np.uint8)
    for row in maps.toLocalIterator():
        held[row.part] = np.frombuffer(row.bits, np.uint8)
    shared = spark.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def may(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for part, at in parts:
            at = at.to_numpy()
            yield pd.Series((shared.value[part.to_numpy(), at >> 3] >> (at & 7) & 1).astype(bool))

    # The map is asked before the text is looked at.
    return source.where(may(F.bitmap_bucket_number(bit), F.bitmap_bit_position(bit))).join(wanted, "address").select("node", "text")


def verified(pairs: DataFrame, nodes: DataFrame, source: DataFrame, size: int, least: Fraction, run: Scratch) -> DataFrame:
    """The pairs (u, v) that are similar: thinned by the finer cells of their shingles, then compared shingle by shingle.

    Where no pair is left, the steps after that have nothing to do and are not planned.
    """

    @F.pandas_udf("boolean")
    def can(a: pd.Series, b: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([fine_enough(*x, least) for x in zip(a, b, sizes, strict=True)], dtype=bool)

    @F.pandas_udf("boolean")
    def are(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(shingle_set(x, size), shingle_set(y, size), least) for x, y in zip(a, b, strict=True)], dtype=bool)

    def ends(rows: DataFrame) -> list[DataFrame]:
        return [rows.select(*[F.col(c).alias(end if c == "node" else f"{c}_{end}") for c in rows.columns]) for end in "uv"]

    pairs = run.stored(pairs, "pairs")
    u, v = ends(nodes.select("node", "size", "fine"))
    thin = pairs.join(u, "u").join(v, "v").where(can("fine_u", "fine_v", F.col("size_u") + F.col("size_v"))).select("u", "v")
    if pairs.isEmpty():
        return pairs
    thin = run.stored(thin, "candidates")
    if thin.isEmpty():
        run.drop(pairs)
        return thin
    wanted = thin.select(F.col("u").alias("node")).unionByName(thin.select(F.col("v").alias("node"))).distinct()
    wanted = run.stored(nodes.select("address", "node").join(wanted, "node", "left_semi").select("address", "node"), "wanted")
    some = run.stored(_some(source, wanted), "texts")
    u, v = ends(some)
    links = run.stored(thin.join(u, "u").join(v, "v").where(are("text_u", "text_v")).select("u", "v"), "links")
    run.drop(pairs, thin, wanted, some)
    return links


def _candidates(labelled: DataFrame, low: int, high: int | None, least: Fraction, run: Scratch) -> DataFrame:
    """Pairs (u, v) of different labels in a bucket; buckets of more than a block are compared block by block in the last round."""
    columns = ["token", "size", "node", "label", "cells"]

    def near(rows: DataFrame, low: int, high: int | None) -> DataFrame:
        ordered = rows.select(*columns).repartition("token").sortWithinPartitions("token", "size", "node")
        return ordered.mapInArrow(_pairs(low, high, least), "u long, v long")

    if high is not None:
        return near(labelled, low, high).distinct()
    sizes = labelled.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    large = run.stored(sizes.where(F.col("n") > BLOCK), "large-buckets")
    found = near(labelled.join(large, "token", "left_anti"), low, None)
    if large.isEmpty():
        return found.distinct()
    # A block has members of like size: of each power of 5/4, cut by a hash. Similar sets lie in the same range or the next one.
    members = labelled.join(large, "token").withColumn("range", F.floor(F.log(F.col("size").cast("double")) / F.lit(float(np.log(1 / float(least))))))
    dealt = members.groupBy("token", "range").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    members = run.stored(members.join(dealt, ["token", "range"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))), "large-members")
    blocks = members.select("token", "range", "part").distinct()
    other = blocks.select("token", F.col("range").alias("range_b"), F.col("part").alias("part_b"))
    ahead = (F.col("range_b") == F.col("range") + 1) | ((F.col("range_b") == F.col("range")) & (F.col("part_b") >= F.col("part")))
    # One row for two blocks of a bucket, not for two of its members.
    meet = run.stored(blocks.join(other, "token").where(ahead).withColumn("pair", F.monotonically_increasing_id()), "block-pairs")
    alone = (F.col("range") == F.col("range_b")) & (F.col("part") == F.col("part_b"))
    left = meet.select("token", "range", "part", "pair", F.when(alone, F.lit(2)).otherwise(F.lit(0)).alias("side"))
    right = meet.where(~alone).select("token", F.col("range_b").alias("range"), F.col("part_b").alias("part"), "pair", F.lit(1).alias("side"))
    both = left.unionByName(right).join(members, ["token", "range", "part"]).select("pair", "side", "size", "node", "label", "cells")
    ordered = both.repartition("pair").sortWithinPartitions("pair", "side")
    return found.unionByName(ordered.mapInArrow(_across(least), "u long, v long")).distinct()


def classes(
    source: DataFrame, kinds: DataFrame, size: int, seed: int, similarity: float, run: Scratch, near: Callable[[DataFrame, Scratch], DataFrame]
) -> DataFrame:
    """node, root: groups that links of at least this similarity connect.

    `source` has address and text of each row, `kinds` its address and kind (see `describe`). Texts of equal sets are one
    node, so copies cost nothing; texts without shingles are one set. Sets are compared by 64-bit hashes of
    shingles. The first links are those of near fingerprints (`near` gives pairs u, v of the nodes' node and fp), verified like all
    others. The next round links every node to one candidate at most, so that large groups are connected
    early; the rounds after it look at all candidates of different groups. Texts are moved once for each candidate.
    """
    least = Fraction(str(similarity))
    ship(source.sparkSession)
    nodes = kinds.groupBy("kind.node").agg(F.first("kind.size").alias("size"), F.first("kind.cells").alias("cells"), F.first("kind.fine").alias("fine"), F.min("address").alias("address"), F.min("kind.fp").alias("fp"))
    nodes = run.stored(nodes, "nodes")
    sample = source.where(F.pmod(F.xxhash64("address"), F.lit(SAMPLE)) == 0)
    often = _tokens(sample, size, seed, None, least).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    with freed_shuffles(source.sparkSession):
        # As columns: a row object for each shingle takes many times the memory of its number.
        often = often.orderBy(F.desc("n"), "token").limit(MOST_COMMON).select("token").toArrow()
    common = Common(often["token"].to_numpy().view(np.uint64))
    tokens = _tokens(source, size, seed, common, least).repartition("token").sortWithinPartitions("token", "node")
    buckets = run.stored(tokens.mapInArrow(_shared, "token long, node long, size long"), "buckets")
    cells = nodes.select("node", "cells")

    links = verified(near(nodes.select("node", "fp"), run), nodes, source, size, least, run)
    tree = run.stored(components(links, run), "components")

    def grown(tree: DataFrame, new: DataFrame) -> DataFrame:
        """The groups of `tree` after further links; the same table if there are none."""
        if new.isEmpty():
            return tree
        known = tree.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u <> v")
        return run.stored(components(known.unionByName(new), run), "components")

    alone = buckets.join(tree, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root").join(cells, "node")
    first = _candidates(alone, 1, 2, least, run).groupBy("v").agg(F.max("u").alias("u")).select("u", "v")
    new = verified(first, nodes, source, size, least, run)
    for low, high in ROUNDS:
        tree = grown(tree, new)
        labelled = buckets.join(tree, "node", "left").select("token", "size", "node", F.coalesce("root", "node").alias("label"))
        open_ = labelled.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("n"))
        open_ = open_.where(F.col("a") < F.col("b")).where(F.col("n") > low).select("token")
        labelled = run.stored(labelled.join(open_, "token", "left_semi").join(cells, "node"), "open")
        if labelled.isEmpty():
            break
        new = verified(_candidates(labelled, low, high, least, run), nodes, source, size, least, run)
        run.drop(labelled)
    else:
        tree = grown(tree, new)
    return nodes.join(tree, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def removed(
    docs: DataFrame,
    key: str,
    text: str,
    size: int,
    similarity: float,
    fingerprint: Callable[[str | None], int],
    near: Callable[[DataFrame, Scratch], DataFrame],
) -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` with an address each, and the addresses of those that are not the first of their group.

    First is the smallest key, null keys last; of rows with the same key the least address. Rows of files are addressed
    in place and never copied; others are stored once.
    """
    spark = docs.sparkSession
    run = Scratch(spark, "near")
    rows = addressed(docs)
    source = rows.select("address", F.col(f"row.`{text}`").cast("string").alias("text"))
    for seed in itertools.count():
        kinds = describe(rows.select("address", F.col(f"row.`{key}`").alias("doc"), F.col(f"row.`{text}`").alias("text")), "text", size, seed, fingerprint).drop("text")
        kinds = run.stored(kinds, "kinds")
        # Sets are told apart by 128 bits: where half of these agree and not the rest, another seed is taken.
        if kinds.groupBy("kind.node").agg(F.min("kind.other").alias("a"), F.max("kind.other").alias("b")).where("a <> b").isEmpty():
            break
    found = classes(source, kinds, size, seed, similarity, run, near)
    order = F.struct(F.col("doc").isNull().alias("no_key"), "doc", "address")
    placed = kinds.select("kind.node", "doc", "address").join(found, "node")
    first = placed.groupBy("root").agg(F.min(order).alias("first"))
    gone = placed.join(first, "root").where(F.col("address") != F.col("first.address")).select("address")
    return rows, run.close(gone, "near-removed")
