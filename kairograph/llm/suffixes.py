"""Removal of repeated byte strings by sorting sampled suffixes.

A byte goes when a string of `LENGTH` bytes that covers it also starts earlier. Sorting every
suffix of the corpus is not needed: in each window of that length the least hash of `GRAM` bytes
marks an anchor, and equal windows have equal anchors, so only suffixes at anchors are compared.

1. Anchors with equal bytes all around (the whole `SPAN` before and `LENGTH` after) form a class.
   Each one but the first of its class is covered on the whole of these bytes.
2. The first anchors of classes with the same gram can still agree in part. The strings after
   them and, reversed, before them are sorted by deep-shallow sorting. Two anchors have the same
   window from d bytes before if they agree in d bytes to the left and LENGTH - d to the right.
3. Grams with very many classes are cut by longer common strings until groups are small.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kairograph.llm.common import ship, stored, text_or_empty
from kairograph.llm.deepshallow import common_prefix, deep_shallow_order

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM
SEGMENT = 4 << 20
GROUP_ROWS = 8192
HOT_ROWS = 1000
HOT_IN_TASK = 32
HOT_KEYS = 10_000
FACTORS = [np.uint64(f) for f in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
LAST = (1 << 63) - 1


def _mix(h: np.ndarray, factor: np.uint64) -> np.ndarray:
    h *= factor
    h ^= h >> np.uint64(29)
    return h


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the `GRAM` bytes from each position on."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    h = data.astype(np.uint64)
    for width in (1, 2, 4):
        h = h[:-width] | (h[width:] << np.uint64(8 * width))
    h = _mix(h, FACTORS[0])
    for width, factor in ((8, FACTORS[1]), (16, FACTORS[2])):
        h = _mix(h[:-width] * FACTORS[3] + h[width:], factor)
    return h


def _slide(values: np.ndarray, width: int, choose: np.ufunc) -> np.ndarray:
    """The least or greatest of each run of `width` values, by doubling."""
    done = 1
    while done * 2 <= width:
        values = choose(values[:-done], values[done:])
        done *= 2
    if done < width:
        values = choose(values[: len(values) - (width - done)], values[width - done :])
    return values


@dataclass
class Anchors:
    """Anchors of the texts of one batch; `at` is the place in the joined bytes."""

    at: np.ndarray
    text: np.ndarray
    gram: np.ndarray
    around: np.ndarray
    left: np.ndarray
    right: np.ndarray


def _segments(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `SEGMENT` bytes; a longer text comes alone."""
    first = 0
    while first < len(starts) - 1:
        last = int(np.searchsorted(starts, starts[first] + SEGMENT, side="right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def _anchors_in(data: np.ndarray, begin: int, end: int, closed: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of all windows in data[begin:end] and their hashes; `closed` are starts of no window."""
    low, high = max(0, begin - SPAN), min(len(data), end + LENGTH)
    grams = gram_hashes(data[low:high])
    if end - begin < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    own = grams[begin - low : end - low - GRAM + 1]
    order = (own >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _slide(order, SPAN + 1, np.minimum)
    least[closed[closed < len(least)]] = 0
    pad = np.zeros(SPAN, np.uint32)
    highest = _slide(np.concatenate([pad, least, pad]), SPAN + 1, np.maximum)
    at = np.flatnonzero(highest == order)
    whole = at + (begin - low)
    fits = (whole >= SPAN) & (whole + LENGTH <= high - low)
    around = np.zeros(len(at), np.uint64)
    inner = whole[fits]
    mixed = np.zeros(len(inner), np.uint64)
    for i, shift in enumerate((-SPAN, -SPAN + GRAM, -SPAN + 2 * GRAM, -SPAN + 3 * GRAM, -SPAN + 4 * GRAM, LENGTH - GRAM)):
        mixed = _mix(mixed * FACTORS[3] + grams[inner + shift], FACTORS[i % 3])
    around[fits] = mixed
    return at + begin, grams[whole], around


def find_anchors(data: np.ndarray, starts: np.ndarray) -> Anchors:
    """Anchors of the texts data[starts[i]:starts[i + 1]]; memory depends on `SEGMENT`, not on the longest text."""
    found = []
    raw = data.tobytes() if not data.flags.c_contiguous else memoryview(data)
    for first, last in _segments(starts):
        begin, end = int(starts[first]), int(starts[last])
        if last - first > 1 or end - begin <= 2 * SEGMENT:
            ends = starts[first + 1 : last + 1] - begin
            lengths = np.minimum(LENGTH - 1, np.diff(starts[first : last + 1]))
            closed = np.repeat(ends, lengths) - 1 - (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths))
            found.append(_anchors_in(data, begin, end, closed, starts))
        else:
            for at in range(begin, end - LENGTH + 1, SEGMENT):
                found.append(_anchors_in(data, at, min(end, at + SEGMENT + LENGTH - 1), np.zeros(0, np.int64), starts))
    at, gram, around = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    at, once = np.unique(at, return_index=True)
    gram, around = gram[once].astype(np.uint64), around[once].astype(np.uint64)
    text = np.searchsorted(starts, at, side="right") - 1
    left = np.minimum(at - starts[text], SPAN)
    right = np.minimum(starts[text + 1] - at, LENGTH)
    for i in np.flatnonzero((left < SPAN) | (right < LENGTH)).tolist():
        part = raw[at[i] - left[i] : at[i] + right[i]]
        around[i] = xxhash.xxh3_64_intdigest(part, int(left[i]) * 128 + int(right[i]))
    return Anchors(at, text, gram, around, left, right)


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, hash, joined bytes and starts of a batch of (doc, hash, bytes)."""
    column = batch.column(2)
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    joined = column.buffers()[2]
    data = np.frombuffer(joined, np.uint8) if joined is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]] if len(offsets) else data
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), data, offsets - offsets[0]


@dataclass
class Local:
    """The first anchor of each class in a batch, and what the others cover."""

    firsts: np.ndarray
    anchors: Anchors
    covered: np.ndarray


def _local(docs: np.ndarray, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray) -> Local:
    a = find_anchors(data, starts)
    order = np.lexsort((hashes, docs))
    new = np.concatenate([[False], (np.diff(docs[order]) != 0) | (np.diff(hashes[order]) != 0)])
    rank = np.empty(len(docs), np.int64)
    rank[order] = np.cumsum(new)
    place = (rank[a.text] << 36) + (a.at - starts[a.text])
    sort = np.lexsort((place, a.around, a.gram))
    gram, around, place = a.gram[sort], a.around[sort], place[sort]
    head = np.ones(len(sort), bool)
    head[1:] = (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])
    leader = place[np.maximum.accumulate(np.where(head, np.arange(len(sort)), 0))] if len(sort) else place
    return Local(sort[head], a, sort[~head & (place != leader)])


def _runs(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping intervals joined; intervals that only touch stay apart, as texts do."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, far = begin[order], np.maximum.accumulate(end[order])
    first = np.concatenate([[True], begin[1:] >= far[:-1]])
    return begin[first], far[np.concatenate([first[1:], [True]])]


def _scan_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered runs that a batch finds in itself (gram null), and frequent grams with their counts (doc null)."""
    counts: Counter[int] = Counter()
    names = ["doc", "hash", "begin", "end", "gram", "n"]
    for batch in batches:
        docs, hashes, data, starts = _texts(batch)
        if not len(docs):
            continue
        local = _local(docs, hashes, data, starts)
        a, c = local.anchors, local.covered
        begin, end = _runs(a.at[c] - a.left[c], a.at[c] + a.right[c])
        text = np.searchsorted(starts, begin, side="right") - 1
        none = pa.nulls(len(begin), pa.int64())
        columns = [docs[text], hashes[text], begin - starts[text], end - starts[text]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), none, none], names=names)
        gram, n = np.unique(a.gram[local.firsts], return_counts=True)
        counts.update(dict(zip(gram[n > 1].view(np.int64).tolist(), n[n > 1].tolist(), strict=True)))
        if len(counts) > 100 * HOT_KEYS:
            counts = Counter(dict(counts.most_common(10 * HOT_KEYS)))
    hot = [(g, n) for g, n in counts.most_common(HOT_KEYS) if n >= HOT_IN_TASK]
    none = pa.nulls(len(hot), pa.int64())
    values = [pa.array([h[i] for h in hot], pa.int64()) for i in (0, 1)]
    yield pa.RecordBatch.from_arrays([none, none, none, none, *values], names=names)


def _scan_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, hashes, data, starts = _texts(batch)
        if not len(docs):
            continue
        local = _local(docs, hashes, data, starts)
        a, f = local.anchors, local.firsts
        f = f[np.argsort(a.at[f])]
        text = a.text[f]
        columns = {
            "gram": a.gram[f].view(np.int64),
            "around": a.around[f].view(np.int64),
            "doc": docs[text],
            "hash": hashes[text],
            "at": a.at[f] - starts[text],
            "sides": (a.left[f] * 128 + a.right[f]).astype(np.int32),
        }
        yield pa.RecordBatch.from_pydict(columns)


def _classes(hot: frozenset[int]):
    """Streams anchors sorted by gram, surroundings and place; makes covers and the firsts of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_grams = np.array(sorted(hot), dtype=np.int64)
        last: tuple | None = None  # gram, around, place of its first, number of the class, first class of the gram
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            gram, around, doc, hash_, at, sides = (batch.column(i).to_numpy() for i in range(6))
            new_gram = np.ones(n, bool)
            new_gram[1:] = gram[1:] != gram[:-1]
            new_class = new_gram.copy()
            new_class[1:] |= around[1:] != around[:-1]
            if last is not None and last[0] == gram[0]:
                new_gram[0] = False
                new_class[0] = last[1] != around[0]
            index = np.arange(n)
            head = np.maximum.accumulate(np.where(new_class, index, -1))
            known = head >= 0
            lead = [np.where(known, x[head], last[2][i] if last else 0) for i, x in enumerate((doc, hash_, at))]
            same_place = (doc == lead[0]) & (hash_ == lead[1]) & (at == lead[2])
            covered = ~new_class & ~same_place
            gram_start = np.maximum.accumulate(np.where(new_gram, index, -1))
            total = np.cumsum(new_class)
            base = np.where(gram_start >= 0, total[gram_start] - 1, -1 - (last[3] if last else 0))
            number = total - 1 - base  # of the class within its gram, from 0
            firsts = new_class & ((number > 0) | np.isin(gram, hot_grams))
            # The first class of a gram is told only when a second one shows up.
            second = np.flatnonzero(new_class & (number == 1) & ~np.isin(gram, hot_grams))
            opening = gram_start[second]
            rows = [np.flatnonzero(covered), np.flatnonzero(firsts), opening[opening >= 0]]
            kind = np.repeat([0, 1, 1], [len(r) for r in rows])
            pick = np.concatenate(rows)
            left, right = sides[pick] // 128, sides[pick] % 128
            begin = np.where(kind == 0, at[pick] - left, at[pick])
            end = np.where(kind == 0, at[pick] + right, 0)
            columns = [kind, gram[pick], doc[pick], hash_[pick], begin, end]
            if (opening < 0).any():
                first_doc, first_hash, first_at = last[4]
                for c, v in enumerate((1, last[0], first_doc, first_hash, first_at, 0)):
                    columns[c] = np.append(columns[c], v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.astype(np.int64)) for c in columns], names=["kind", "gram", "doc", "hash", "begin", "end"]
            )
            opened = gram_start[-1]
            first = tuple(int(x[opened]) for x in (doc, hash_, at)) if opened >= 0 else last[4]
            last = (gram[-1], around[-1], tuple(int(x[-1]) for x in lead), int(number[-1]), first)

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the wanted anchors of each text; those before it are reversed."""
    names = ["gram", "n", "doc", "hash", "at", "left", "right"]
    for batch in batches:
        rows: list[tuple] = []
        for doc, hash_, data, wanted in zip(*(batch.column(i) for i in range(4)), strict=True):
            data = data.as_py()
            for w in wanted.as_py():
                at = w["begin"]
                rows.append(
                    (w["gram"], w["n"], doc.as_py(), hash_.as_py(), at, data[max(0, at - SPAN) : at][::-1], data[at : at + LENGTH])
                )
        types = [pa.int64()] * 5 + [pa.binary()] * 2
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _sorted_side(strings: list[bytes], groups: np.ndarray, agree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order within each group and common prefixes of neighbours, -1 where a group begins."""
    order: list[int] = []
    prefix: list[int] = []
    for begin, end in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True):
        own = strings[begin:end]
        places = deep_shallow_order(own, int(agree[begin]))
        order += [begin + i for i in places]
        prefix.append(-1)
        prefix += [common_prefix(own[i], own[j]) for i, j in zip(places, places[1:], strict=False)]
    return np.array(order, np.int64), np.array(prefix, np.int64)


def covered_windows(
    groups: np.ndarray, place: np.ndarray, left: list[bytes], right: list[bytes], low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Per row the least and greatest d such that its window from d bytes before also starts earlier (-1: none).

    `groups` are the limits of groups of rows, `place` orders rows by where they start; `low` to
    `high` are the d that are asked for, the same within a group.
    """
    n = len(place)
    sides = []
    for strings, agree in ((left, low), (right, LENGTH - high)):
        order, prefix = _sorted_side(strings, groups, agree)
        sides.append((order, prefix, np.fromiter(map(len, strings), np.int64, n)))
    (left_order, left_prefix, left_length), (right_order, right_prefix, right_length) = sides
    by_place = np.argsort(place, kind="stable")
    least, most = np.full(n, -1), np.full(n, -1)
    for d in range(SPAN + 1):
        rows = by_place[((left_length >= d) & (right_length >= LENGTH - d) & (low <= d) & (d <= high))[by_place]]
        if len(rows) < 2:
            continue
        left_class, right_class = np.empty(n, np.int64), np.empty(n, np.int64)
        left_class[left_order] = np.cumsum(left_prefix < d)
        right_class[right_order] = np.cumsum(right_prefix < LENGTH - d)
        both = left_class[rows] * (n + 1) + right_class[rows]
        sort = np.argsort(both, kind="stable")
        rows, both = rows[sort], both[sort]
        head = np.concatenate([[True], both[1:] != both[:-1]])
        leader = rows[np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))]
        repeated = rows[place[rows] > place[leader]]
        least[repeated] = np.where(least[repeated] < 0, d, least[repeated])
        most[repeated] = d
    return least, most


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covers from groups of anchors (g1, g2, low, high, doc, hash, at, left, right) that come sorted by group."""
    held: pa.Table | None = None

    def made(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        g1, g2, low, high, doc, hash_, at = (rows.column(i).to_numpy() for i in range(7))
        limits = np.flatnonzero(np.concatenate([[True], (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1]), [True]]))
        order = np.lexsort((at, hash_, doc))
        new = np.concatenate([[False], np.any([np.diff(x[order]) != 0 for x in (doc, hash_, at)], axis=0)])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new)
        least, most = covered_windows(limits, place, rows.column(7).to_pylist(), rows.column(8).to_pylist(), low, high)
        hit = np.flatnonzero(most >= 0)
        columns = [doc[hit], hash_[hit], at[hit] - most[hit], at[hit] - least[hit] + LENGTH]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["doc", "hash", "begin", "end"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        g1, g2 = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        open_ = (g1 == g1[-1]) & (g2 == g2[-1])
        cut = int(np.flatnonzero(~open_)[-1]) + 1 if not open_.all() else 0
        held = rows.slice(cut)
        if cut:
            yield made(rows.slice(0, cut))
    if held is not None and held.num_rows:
        yield made(held)


COVER = "doc long, hash long, begin long, end long"


def _sort(rows: DataFrame) -> DataFrame:
    columns = ("g1", "g2", "low", "high", "doc", "hash", "at", "left", "right")
    return rows.select(*columns).repartition("g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(_sort_groups, COVER)


def _bytes_of(name: str, n: Column) -> Column:
    return F.substring(name, F.lit(1), n.cast("int"))


def _halves(rows: DataFrame) -> DataFrame:
    """Each anchor in the groups of the lower and the upper half of its d.

    Groups (g1, g2) share the bytes that all windows of the half have in common. Anchors that
    also agree in every byte of any of these windows have the same (u1, u2). `least` and `most` are
    the ends of the d for which an anchor near an end of its text has a window at all.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2)
    lower = F.struct(F.col("low").alias("low"), middle.alias("high"))
    upper = F.struct((middle + 1).alias("low"), F.col("high").alias("high"))
    # A range of one d has no upper half.
    parts = F.filter(F.array(lower, upper), lambda part: part["low"] <= part["high"])
    both = rows.withColumn("part", F.explode(parts)).withColumns({"low": F.col("part.low"), "high": F.col("part.high")})
    both = both.withColumns(
        {
            "least": F.greatest("low", LENGTH - F.octet_length("right")),
            "most": F.least("high", F.octet_length("left").cast("long")),
        }
    ).where(F.col("least") <= F.col("most"))
    shared = ["low", "high", _bytes_of("left", F.col("low")), _bytes_of("right", LENGTH - F.col("high"))]
    every = ["low", "high", _bytes_of("left", F.col("high")), _bytes_of("right", LENGTH - F.col("low"))]
    return both.select(
        *[F.xxhash64(F.lit(seed), *shared).alias(f"g{seed}") for seed in (1, 2)],
        *[F.xxhash64(F.lit(seed), *every).alias(f"u{seed}") for seed in (1, 2)],
        "low", "high", "least", "most", "doc", "hash", "at", "left", "right",
    )


def _place(*names: str) -> Column:
    return F.struct(*[F.col(n) for n in names])


def partial_repeats(contexts: DataFrame, most: int = GROUP_ROWS) -> list[DataFrame]:
    """Covers among the firsts of classes, exact for groups of any size.

    A group of up to `most` rows is sorted in one task. In larger ones the d are halved; anchors
    that agree in all bytes of a half are settled at once, so that only the first of them goes on
    and the rows of a level do not outgrow those of the first.
    """
    zero = F.lit(0).cast("long")
    rows = contexts.withColumns({"g1": F.col("gram"), "g2": zero, "low": zero, "high": F.lit(SPAN).cast("long")})
    covers = [_sort(rows.where(F.col("n") <= most))]
    rows = rows.where(F.col("n") > most)
    while not rows.isEmpty():
        halves = _halves(rows)
        place = _place("doc", "hash", "at")
        firsts = halves.groupBy("u1", "u2").agg(F.min(place).alias("first"))
        halves = stored(halves.join(firsts, ["u1", "u2"]).withColumn("later", place > F.col("first")), "suffix-halves")
        begin, end = F.col("at") - F.col("most"), F.col("at") - F.col("least") + LENGTH
        covers.append(halves.where("later").select("doc", "hash", begin.alias("begin"), end.alias("end")))
        ahead = halves.where("NOT later").drop("later", "first", "u1", "u2", "least", "most")
        sizes = ahead.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        ahead = stored(ahead.join(sizes, ["g1", "g2"]), "suffix-groups")
        covers.append(_sort(ahead.where(F.col("n") <= most)))
        rows = ahead.where(F.col("n") > most)
    return covers


def _cut_out(text: str):
    """Removed spans and what is left of the text column of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "n_bytes", "spans", "kept"]
        span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans, kept, sizes = [], [], []
            for value, runs in zip(pc.struct_field(batch.column(0), [text]), batch.column(1), strict=True):
                data = (value.as_py() or "").encode()
                joined: list[list[int]] = []
                for run in sorted((r["begin"], r["end"]) for r in runs.as_py() or ()):
                    if joined and run[0] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], run[1])
                    else:
                        joined.append(list(run))
                edges = [0, *(x for run in joined for x in run), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"begin": a, "end": b} for a, b in joined])
                sizes.append(len(data))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span_type), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


LARGE_GRAMS = 10_000


def repeats(texts: DataFrame) -> DataFrame:
    """Covers (doc, hash, begin, end) of texts given as (doc, hash, data)."""
    local = stored(texts.mapInArrow(_scan_local, f"{COVER}, gram long, n long"), "suffix-local")
    counts = local.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_ROWS)
    hot = frozenset(r.gram for r in counts.orderBy(F.desc("n"), "gram").limit(HOT_KEYS).collect())
    anchors = texts.mapInArrow(_scan_anchors, "gram long, around long, doc long, hash long, at long, sides int")
    # Anchors of a frequent gram are dealt out by class; the others of a gram come together.
    salt = F.when(F.col("gram").isin(*sorted(hot)), F.col("around")).otherwise(F.lit(0).cast("long")) if hot else F.lit(0)
    dealt = anchors.repartition(F.col("gram"), salt).sortWithinPartitions("gram", "around", "doc", "hash", "at")
    found = stored(dealt.mapInArrow(_classes(hot), f"kind long, gram long, {COVER}"), "suffix-classes")
    firsts = found.where("kind = 1")
    sizes = firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # At most LARGE_GRAMS grams have this many rows; theirs go to the rows, so that these are not dealt out by gram.
    bar = max(256, -(-firsts.count() // LARGE_GRAMS))
    large = F.broadcast(sizes.where(F.col("n") >= bar))
    rest = firsts.join(large, "gram", "left_anti").join(sizes.where(F.col("n") < bar), "gram")
    counted = firsts.join(large, "gram").unionByName(rest)
    wanted = counted.groupBy("doc", "hash").agg(F.collect_list(F.struct("gram", "n", "begin")).alias("wanted"))
    around = texts.join(wanted, ["doc", "hash"]).select("doc", "hash", "data", "wanted")
    contexts = stored(
        around.mapInArrow(_contexts, "gram long, n long, doc long, hash long, at long, left binary, right binary"), "suffix-contexts"
    )
    covers = local.where("gram is null").select("doc", "hash", "begin", "end")
    for part in (found.where("kind = 0").select("doc", "hash", "begin", "end"), *partial_repeats(contexts)):
        covers = covers.unionByName(part)
    return covers


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row as `row` with n_bytes, spans (removed, maximal, in bytes) and kept (the remaining bytes).

    A byte is removed when some `LENGTH`-byte string that covers it also starts earlier: in a
    document with a smaller key, or earlier in the same one; all strings are taken from the input.
    Null texts are empty and stay empty. A null key counts as the largest. Rows with the same key are
    ordered by a hash of their texts; rows that repeat entirely are one document, so all of them keep
    the same bytes. Keys are integers. Other columns are untouched; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    data = F.encode(text_or_empty(text), "utf-8")
    doc = F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc")
    hash_ = F.xxhash64(text_or_empty(text)).alias("hash")
    covers = repeats(docs.select(doc, hash_, data.alias("data")))
    runs = covers.groupBy("doc", "hash").agg(F.collect_list(F.struct("begin", "end")).alias("runs"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    joined = docs.select(row, doc, hash_).join(runs, ["doc", "hash"], "left").select("row", "runs")
    span = "array<struct<begin:long,end:long>>"
    schema = StructType([joined.schema["row"], *StructType.fromDDL(f"n_bytes long, spans {span}, kept binary")])
    return joined.mapInArrow(_cut_out(text), schema)
