"""A prefix trie of rebuilt conversations, from hash products of their heads and suffixes; rebuilt texts are never made."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm.common import Scratch, ship, text_or_empty

BLOCK = 20
HEADS = 4
PRIME = (1 << 127) - 1
PIECE = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"

# --- scans ------------------------------------------------------------------------------------
#
# Rows are sorted over the whole table, so that a group which holds much of it lies on many tasks. Each task multiplies
# what it has of a group from its own start; the products of whole tasks, of which there are few, give what comes before.


class Sums:
    """Running sums of two numbers."""

    unit, ddl = (0, 0), "sum_a long, sum_b long"
    times = staticmethod(lambda x, y: (x[0] + y[0], x[1] + y[1]))
    element = staticmethod(lambda a, b: (a, b))
    pack = staticmethod(lambda x: x)
    unpack = staticmethod(lambda a, b: (a, b))
    arrow = (pa.int64(), pa.int64())


class Products:
    """Fingerprints of sequences of turns: how many there are, and a polynomial of their hashes modulo a prime.

    They form a monoid: (n, x) times (m, y) is (n + m, x * base^m + y), and the fingerprint of a part
    follows from those of two beginnings.
    """

    unit, ddl = (0, 0), "place long, print binary"
    arrow = (pa.int64(), pa.binary())

    def __init__(self, base: int):
        self.base = base

    def times(self, x: tuple[int, int], y: tuple[int, int]) -> tuple[int, int]:
        return x[0] + y[0], (x[1] * pow(self.base, y[0], PRIME) + y[1]) % PRIME

    def element(self, digest: bytes) -> tuple[int, int]:
        return 1, int.from_bytes(digest, "little") % PRIME

    def pack(self, x: tuple[int, int]) -> tuple[int, bytes]:
        return x[0], x[1].to_bytes(16, "little")

    def unpack(self, n: int, x: bytes) -> tuple[int, int]:
        return n, int.from_bytes(x, "little")


def _fields(names: list[str], kinds: tuple, rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [[] for _ in names], kinds, strict=True)]


def scan(df: DataFrame, run: Scratch, group: str, order: list[Column], of: list[str], monoid, name: str) -> DataFrame:
    """Rows of `df` with the product of the elements of a group (a long) up to each row, in the given order, which has no ties."""
    names = [x.split()[0] for x in monoid.ddl.split(", ")]
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.repartitionByRange(tasks, F.col(group), *order).sortWithinPartitions(F.col(group), *order).withColumn("task", F.spark_partition_id())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    index = [ordered.columns.index(c) for c in (group, *of)]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, product, row = None, monoid.unit, 0
        for batch in batches:
            out = []
            for g, *values in zip(*(batch.column(i).to_pylist() for i in index), strict=True):
                if g != at:
                    at, product = g, monoid.unit
                product = monoid.times(product, monoid.element(*values))
                out.append(monoid.pack(product))
            rows = pa.array(range(row, row + len(out)), pa.int64())
            row += len(out)
            yield pa.RecordBatch.from_arrays([*batch.columns, rows, *_fields(names, monoid.arrow, out)], names=[*batch.schema.names, "row", *names])

    rows = run.stored(ordered.mapInArrow(local, f"{fields}, row long, {monoid.ddl}"), name)
    # A task shares its first and its last group with others at most, so these are two rows a task at most.
    ends = rows.groupBy(group, "task").agg(F.max_by(F.struct(*names), "row").alias("last"))
    many = ends.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(group)
    ends = run.stored(ends.join(many, group, "left_semi").select(group, "task", "last.*"), f"{name}-ends")

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, product = None, monoid.unit
        for batch in batches:
            out = []
            for g, _, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != at:
                    at, product = g, monoid.unit
                out.append(monoid.pack(product))
                product = monoid.times(product, monoid.unpack(*values))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *_fields(names, monoid.arrow, out)], names=[group, "task", *(f"before_{n}" for n in names)])

    before = ends.repartition(group).sortWithinPartitions(group, "task")
    before = before.mapInArrow(carried, f"`{group}` long, task int, " + ", ".join(f"before_{x}" for x in monoid.ddl.split(", ")))

    @F.arrow_udf(f"struct<{', '.join(x.replace(' ', ': ') for x in monoid.ddl.split(', '))}>")
    def whole(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        k = len(names)
        for columns in parts:
            out = []
            for v in zip(*(c.to_pylist() for c in columns), strict=True):
                out.append(v[k:] if v[0] is None else monoid.pack(monoid.times(monoid.unpack(*v[:k]), monoid.unpack(*v[k:]))))
            yield pa.StructArray.from_arrays(_fields(names, monoid.arrow, out), names=names)

    joined = rows.join(F.broadcast(before), [group, "task"], "left")
    joined = joined.withColumn("whole", whole(*[F.col(f"before_{n}") for n in names], *[F.col(n) for n in names]))
    return joined.select(*df.columns, *[F.col(f"whole.{n}").alias(n) for n in names])


# --- nodes ------------------------------------------------------------------------------------

ZERO = bytes(16)


def _number(x: bytes | None) -> int:
    return int.from_bytes(x, "little") if x is not None else 0


def _rebuilt(convs: DataFrame, base: int) -> DataFrame:
    """Each conversation with the `head` turns that it takes, its length, and `delta`: what the head makes of its own products.

    With H the products of the own turns, the rebuilt ones are H(j) + delta * base^(j - skip), delta = head - H(skip).
    """

    @F.arrow_udf("binary")
    def difference(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in parts:
            rows = zip(a.to_pylist(), b.to_pylist(), strict=True)
            yield pa.array([((_number(x) - _number(y)) % PRIME).to_bytes(16, "little") for x, y in rows], pa.binary())

    heads = convs.where(F.col("conv") % BLOCK == 0).select(F.col("conv").alias("base"), F.col("n").alias("base_n"), F.col("prints").alias("base_prints"))
    rows = convs.withColumn("base", F.col("conv") - F.col("conv") % BLOCK).withColumn("skip", F.crc32(F.col("conv").cast("string")) % HEADS)
    rows = rows.join(heads, "base", "left").withColumn("head", F.least("skip", F.coalesce("base_n", F.lit(0))))
    at = lambda prints, n: F.when(F.col(n) > 0, F.try_element_at(prints, F.col(n).cast("int")))
    rows = rows.withColumn("delta", difference(at(F.col("base_prints"), "head"), at(F.col("prints"), "skip")))
    return rows.select("conv", "base", "skip", "head", "delta", (F.col("head") + F.greatest(F.col("n") - F.col("skip"), F.lit(0))).alias("length"))


def _members(turns: DataFrame, convs: DataFrame, base: int) -> DataFrame:
    """depth, print, sha, words, conv, ends: every conversation at every node that its rebuilt turns pass, from the root on."""

    @F.arrow_udf("binary")
    def moved(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for prints, deltas, steps in parts:
            rows = zip(prints.to_pylist(), deltas.to_pylist(), steps.to_pylist(), strict=True)
            yield pa.array([x if d == ZERO else ((_number(x) + _number(d) * pow(base, n, PRIME)) % PRIME).to_bytes(16, "little") for x, d, n in rows], pa.binary())

    steps = F.col("place") - F.col("skip")
    own = turns.join(convs, "conv").where("place > skip")
    own = own.select((F.col("head") + steps).alias("depth"), moved("print", "delta", steps).alias("print"), "sha", "words", "conv", "length")
    heads = turns.where((F.col("conv") % BLOCK == 0) & (F.col("place") < HEADS)).withColumnRenamed("conv", "base")
    head = heads.join(convs, "base").where("place <= head").select(F.col("place").alias("depth"), "print", "sha", "words", "conv", "length")
    root = convs.select(F.lit(0).cast("long").alias("depth"), F.lit(ZERO).alias("print"), F.lit(ZERO).alias("sha"), F.lit(0).cast("long").alias("words"), "conv", "length")
    return own.unionByName(head).unionByName(root).withColumn("ends", F.col("depth") == F.col("length")).drop("length")


def _digests(ends: DataFrame) -> DataFrame:
    """depth, print, ends_sha256 of the conversations that end at a node, in ascending order and with commas between.

    They are sorted over the whole table and written out in pieces; the task that hashes a node reads pieces, not rows.
    """
    tasks = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["print", "depth"]
    ordered = ends.select(*keys, "conv").repartitionByRange(tasks, *keys, "conv").sortWithinPartitions(*keys, "conv").withColumn("task", F.spark_partition_id())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, task, number, held, size = None, 0, 0, [], 0

        def made() -> pa.RecordBatch:
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays(_fields([*keys], kinds, [(*at, task, number, ",".join(held))]), names=[*keys, "task", "number", "piece"])

        for batch in batches:
            for print_, depth, conv, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and ((print_, depth) != at or size > PIECE):
                    yield made()
                    number, held, size = number + 1, [], 0
                at, task = (print_, depth), own
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield made()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for print_, depth, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4)), strict=True):
                if (print_, depth) != at:
                    if at:
                        out.append((*at, state.hexdigest()))
                    at, state = (print_, depth), hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            yield _digest_rows(out)
        if at:
            yield _digest_rows([(*at, state.hexdigest())])

    made = ordered.mapInArrow(pieces, "print binary, depth long, task int, number long, piece string")
    made = made.repartition(tasks, *keys).sortWithinPartitions(*keys, "task", "number")
    return made.mapInArrow(digest, "print binary, depth long, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["print", "depth", "ends_sha256"]
    return pa.RecordBatch.from_arrays(_fields(names, (pa.binary(), pa.int64(), pa.string()), rows), names=names)


def _nodes(turns: DataFrame, run: Scratch, base: int) -> DataFrame | None:
    """Stored depth, print, conv, n_convs, words, sha and ends_sha256 of each node; None if two sequences share a fingerprint."""
    order = [F.col("turn"), F.col("sha"), F.col("number")]
    turns = run.stored(scan(turns, run, "conv", order, ["sha"], Products(base), "products").select("conv", "place", "print", "sha", "words"), "turns")
    first = [F.max(F.when(F.col("place") == i, F.col("print"))) for i in range(1, HEADS)]
    convs = turns.groupBy("conv").agg(F.max("place").alias("n"), F.array(*first).alias("prints"))
    convs = run.stored(_rebuilt(run.stored(convs, "lengths"), base), "conversations")
    members = run.stored(_members(turns, convs, base), "members")
    nodes = members.groupBy("depth", "print").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.min("sha").alias("sha"), F.max("sha").alias("other")
    )
    nodes = nodes.join(_digests(members.where("ends")), ["depth", "print"], "left")
    nodes = run.stored(nodes, "nodes")
    run.drop(members)
    # Nodes are right if the members of each have the same last turn and come from the same node above; the
    # fingerprint above follows from the last turn, so equal turns at every node are enough.
    return nodes.drop("other") if nodes.where("sha <> other").isEmpty() else None


def _totals(tops: DataFrame, own: DataFrame, run: Scratch) -> DataFrame:
    """conv, leaves, saved: summed over a chain and all chains that hang on it, directly or not. Each round doubles the reach."""
    state = run.stored(own.join(tops.select("conv", F.col("parent").alias("up")), "conv", "left"), "totals")
    while not state.where("up IS NOT NULL").isEmpty():
        gains = state.where("up IS NOT NULL").groupBy(F.col("up").alias("conv")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = state.where("up IS NOT NULL").select(F.col("conv").alias("up"), F.col("up").alias("next"))
        more = lambda c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0))
        state = state.join(gains, "conv", "left").join(above, "up", "left")
        state = run.stored(state.select("conv", more("leaves").alias("leaves"), more("saved").alias("saved"), F.col("next").alias("up")), "totals")
    return state.drop("up")


def prefix_trie(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bases: Iterator[int] | None = None
) -> DataFrame:
    """One row per distinct beginning of a rebuilt conversation, the empty one included.

    conv (its smallest member), depth, parent (the smallest member one turn shorter; root: null), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Conversation c is rebuilt from the first h turns of conversation
    c - c % 20 and its own turns after its first h, h = crc32(c) % 4. Turns go by `turn`, nulls first, and where that ties
    by SHA-256 of role and text. Null and missing roles and texts are empty; turns of no conversation (null) are left out;
    equal rows are turns of their own. No conversations, no rows.

    The smallest member of a node stays so along its own turns, so nodes form chains, one for each smallest member. A
    subtree is the rest of a chain and the chains that hang on it: totals go up the tree of chains, then along each chain.
    """
    spark: SparkSession = conversations.sparkSession
    ship(spark)
    run = Scratch(spark, "trie")
    named = F.concat(F.octet_length(text_or_empty(role)).cast("string"), F.lit(":"), text_or_empty(role), text_or_empty(text))
    turns = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.unhex(F.sha2(F.encode(named, "utf-8"), 256)).alias("sha"),
        F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("number"),
    )
    turns = run.stored(turns, "hashed")
    for base in bases or (0x9E3779B97F4A7C15F39CC0605CEDC835 + 2 * i for i in itertools.count()):
        nodes = _nodes(turns, run, base)
        if nodes is not None:
            break

    @F.arrow_udf("binary")
    def above(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        back = pow(base, -1, PRIME)
        for prints, shas in parts:
            rows = zip(prints.to_pylist(), shas.to_pylist(), strict=True)
            yield pa.array([((_number(x) - _number(t)) * back % PRIME).to_bytes(16, "little") for x, t in rows], pa.binary())

    chains = nodes.groupBy("conv").agg(F.min("depth").alias("top"), F.max("depth").alias("last"), F.min_by(F.struct("print", "sha"), "depth").alias("first"))
    chains = run.stored(chains.withColumn("at", F.col("top") - 1).withColumn("above", above("first.print", "first.sha")).drop("first"), "chains")
    # Most chains hang on the root, whose conversation is known without a join.
    smallest = chains.where("top = 0").select(F.col("conv").alias("parent"))
    on_root = chains.where("at = 0").select("conv", "at").crossJoin(F.broadcast(smallest))
    deeper = chains.where("at > 0").join(nodes.select(F.col("conv").alias("parent"), F.col("depth").alias("at"), F.col("print").alias("above")), ["at", "above"])
    tops = run.stored(on_root.unionByName(deeper.select("conv", "at", "parent")), "tops")
    hanging = tops.groupBy(F.col("parent").alias("conv"), F.col("at").alias("depth")).agg(F.count(F.lit(1)).alias("hanging"))
    sized = nodes.join(hanging, ["conv", "depth"], "left").join(chains.select("conv", "top", "last"), "conv")
    sized = sized.withColumn("n_children", F.coalesce("hanging", F.lit(0)) + (F.col("depth") < F.col("last")).cast("long"))
    sized = sized.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    sized = run.stored(sized.select("conv", "depth", "top", "n_convs", "n_children", "leaf", "saved", "ends_sha256"), "sized")
    totals = _totals(tops, sized.groupBy("conv").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved")), run)
    branches = tops.join(totals, "conv").groupBy(F.col("parent").alias("conv"), F.col("at").alias("depth"))
    branches = branches.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("more"))
    sums = sized.join(branches, ["conv", "depth"], "left")
    sums = sums.withColumn("leaf", F.col("leaf") + F.coalesce("leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more", F.lit(0)))
    sums = run.stored(sums.drop("leaves", "more"), "sums")
    summed = scan(sums, run, "conv", [F.col("depth").desc()], ["leaf", "saved"], Sums(), "suffixes")
    found = summed.join(tops.select("conv", "parent"), "conv", "left")
    return run.close(
        found.select(
            "conv",
            "depth",
            F.when(F.col("depth") > F.col("top"), F.col("conv")).otherwise(F.col("parent")).alias("parent"),
            "n_convs",
            "n_children",
            F.col("sum_a").alias("n_leaves"),
            F.col("sum_b").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
        ),
        "prefix-trie",
    )
