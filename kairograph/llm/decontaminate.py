"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned for in every document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import Scratch, ship, text_or_empty

WINDOW = 10
# Bytes of benchmark texts in one broadcast; a larger benchmark is scanned for in several passes.
SLICE_BYTES = 2 << 20
# Bytes of documents that one step of a scan looks at.
PIECE = 1 << 20
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LETTER, WORD, OTHER = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
FOUND = "n_words long, runs array<struct<word: long, words: long, start: long, stop: long>>, items array<string>"


@dataclass
class Words:
    """The words of some texts that lie one after the other in `data`, lower-cased: where they start, stop and to which text they belong."""

    data: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    text: np.ndarray
    code: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        """offsets: where each text starts, and the end of the last; words do not cross these."""
        data = LOWER[data]
        inside = IN_WORD[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = offsets[:-1][offsets[:-1] < len(data)]
        first[begins] = inside[begins]
        start = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        stop = np.flatnonzero(last) + 1
        lengths = stop - start
        if not len(start):
            code = np.zeros(0, np.uint64)
        else:
            at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            with np.errstate(over="ignore"):
                code = np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[at], np.cumsum(lengths) - lengths)
                code = (code ^ (code >> np.uint64(29))) * OTHER
        return cls(data, start, stop, np.searchsorted(offsets, start, "right") - 1, code)

    def windows(self, size: int, factor: np.uint64 = WORD) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of `size` words within one text."""
        n = len(self.start) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            code = np.zeros(n, np.uint64)
            for i in range(size):
                code = code * factor + self.code[i : i + n]
            code ^= code >> np.uint64(32)
        at = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
        return at, code[at]

    def line(self, first: int, size: int) -> bytes:
        """The words with one blank between them."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[first : first + size], self.stop[first : first + size], strict=True))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, LETTER)]))


class WindowSet:
    """The distinct windows of some benchmark texts: by size, their hashes in order, the words of each and the items that hold it."""

    def __init__(self, texts: list[str], items: list[str], window: int):
        data = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        words = Words.of(np.frombuffer(b"".join(data), np.uint8), offsets)
        counts = np.bincount(words.text, minlength=len(texts))
        self.items, number = np.unique(np.array(items, dtype=object), return_inverse=True)
        self.sizes: dict[int, tuple] = {}
        for size in sorted({min(int(n), window) for n in counts if n}):
            at, code = words.windows(size)
            whole = (counts[words.text[at]] == size) | (size == window)
            at, code = at[whole], code[whole]
            other = words.windows(size, OTHER)[1][whole]
            item = number[words.text[at]]
            order = np.lexsort((item, other, code))
            at, code, other, item = at[order], code[order], other[order], item[order]
            new = np.append(True, (code[1:] != code[:-1]) | (other[1:] != other[:-1]))
            once = new | np.append(True, item[1:] != item[:-1])
            groups = np.cumsum(new) - 1
            bounds = np.append(np.searchsorted(groups[once], np.arange(groups[-1] + 1)), once.sum())
            lines = [words.line(int(i), size) for i in at[new]]
            bits = max(16, int(len(lines) * 16).bit_length())
            known = np.zeros(1 << bits, bool)
            known[code >> np.uint64(64 - bits)] = True
            self.sizes[size] = (known, np.uint64(64 - bits), code[new], lines, item[once], bounds)

    def hits(self, words: Words) -> Iterator[tuple[np.ndarray, int, list[np.ndarray]]]:
        """For each size, the first words of the windows that are in the set, the size, and their items."""
        for size, (known, shift, codes, lines, item, bounds) in self.sizes.items():
            at, code = words.windows(size)
            some = known[code >> shift]
            at, code = at[some], code[some]
            place = np.searchsorted(codes, code)
            found, items = [], []
            for i, c, p in zip(at.tolist(), code.tolist(), place.tolist(), strict=True):
                line = None
                while p < len(codes) and codes[p] == c:
                    line = words.line(i, size) if line is None else line
                    if lines[p] == line:
                        found.append(i)
                        items.append(item[bounds[p] : bounds[p + 1]])
                        break
                    p += 1
            if found:
                yield np.array(found, np.int64), size, items


def _merged(text: np.ndarray, first: np.ndarray, stop: np.ndarray, start_byte: np.ndarray, stop_byte: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of words of intervals that overlap or touch, by text."""
    order = np.lexsort((first, text))
    text, first, stop, start_byte, stop_byte = (x[order] for x in (text, first, stop, start_byte, stop_byte))
    reach = np.maximum.accumulate(stop + text * (1 << 40))
    new = np.flatnonzero(np.append(True, first[1:] + text[1:] * (1 << 40) > reach[:-1]))
    return text[new], first[new], np.maximum.reduceat(stop, new), start_byte[new], np.maximum.reduceat(stop_byte, new)


def _runs(columns: list[np.ndarray]) -> list[dict]:
    return [{"word": a, "words": b - a, "start": c, "stop": d} for a, b, c, d in zip(*(x.tolist() for x in columns), strict=True)]


def _word_end(data: np.ndarray, at: int) -> int:
    """The first place from `at` that is not inside a word."""
    while at < len(data):
        out = np.flatnonzero(~IN_WORD[LOWER[data[at : at + 4096]]])
        if len(out):
            return at + int(out[0])
        at = min(at + 4096, len(data))
    return at


class Scan:
    """What a window set finds in texts: their number of words, the hit runs and the items."""

    def __init__(self, windows: WindowSet):
        self.windows = windows
        self.longest = max(windows.sizes, default=1)

    def _piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, list[np.ndarray], list[tuple[int, np.ndarray]]]:
        words = Words.of(data, offsets)
        columns, items = [], []
        for at, size, found in self.windows.hits(words):
            last = at + size - 1
            columns.append(np.stack([words.text[at], at, at + size, words.start[at], words.stop[last]]))
            items += zip(words.text[at].tolist(), found, strict=True)
        return words, columns, items

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> list[dict]:
        """One result for each text, of texts that are looked at together."""
        words, columns, items = self._piece(data, offsets)
        counts = np.bincount(words.text, minlength=len(offsets) - 1)
        before = np.concatenate([[0], np.cumsum(counts)])
        out = [{"n_words": int(n), "runs": [], "items": []} for n in counts]
        if columns:
            text, first, stop, start_byte, stop_byte = _merged(*np.concatenate(columns, axis=1))
            for t, a, b, c, d in zip(text.tolist(), first.tolist(), stop.tolist(), start_byte.tolist(), stop_byte.tolist(), strict=True):
                out[t]["runs"].append({"word": a - int(before[t]), "words": b - a, "start": c - int(offsets[t]), "stop": d - int(offsets[t])})
            by_text: dict[int, list[np.ndarray]] = {}
            for t, found in items:
                by_text.setdefault(t, []).append(found)
            for t, found in by_text.items():
                out[t]["items"] = self.windows.items[np.unique(np.concatenate(found))].tolist()
        return out

    def long_text(self, data: np.ndarray) -> dict:
        """A text in pieces that end between words; a piece begins with the last words of the one before."""
        at, base, size, columns, items = 0, 0, PIECE, [], []
        while True:
            end = _word_end(data, min(at + size, len(data)))
            words, found, some = self._piece(data[at:end], np.array([0, end - at]))
            if end < len(data) and 0 < len(words.start) < self.longest:
                size *= 2
                continue
            columns += [c + np.array([[0], [base], [base], [at], [at]]) for c in found]
            items += [x for _, x in some]
            base += len(words.start)
            if end == len(data):
                break
            again = min(self.longest - 1, len(words.start))
            base, size = base - again, PIECE
            at = at + int(words.start[-again]) if again else end
        runs = []
        if columns:
            _, *rest = _merged(*np.concatenate(columns, axis=1))
            runs = _runs(rest)
        names = self.windows.items[np.unique(np.concatenate(items))].tolist() if items else []
        return {"n_words": base, "runs": runs, "items": names}

    def batch(self, texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        out, i = [], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
            piece = data[offsets[i] : offsets[j]]
            out += [self.long_text(piece)] if j == i + 1 and len(piece) > PIECE else self.texts(piece, offsets[i : j + 1] - offsets[i])
            i = j
        run = pa.struct([("word", pa.int64()), ("words", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("runs", pa.list_(run)), ("items", pa.list_(pa.string()))]))


def _chunks(benchmark: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """item, text: benchmark texts in chunks of up to PIECE words, which hold every window of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(whole.encode(), np.uint8)
                words = Words.of(data, np.array([0, len(data)]))
                step = 1 << 15
                for i in range(0, max(1, len(words.start) - window + 1), step):
                    if len(words.start):
                        n = min(step + window - 1, len(words.start) - i)
                        yield pa.RecordBatch.from_pydict({"item": [item], "text": [words.line(i, n).decode()]})

    texts = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), text_or_empty(text).alias("text"))
    return texts.mapInArrow(run, "item string, text string")


def _scanner(docs: DataFrame, part: DataFrame, window: int):
    """A column function that scans texts for the windows of one slice of the benchmark."""
    rows = part.collect()
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet([r.text for r in rows], [r.item for r in rows], window))

    @F.arrow_udf(FOUND)
    def scan(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scan = Scan(shared.value)
        for texts in parts:
            yield scan.batch(texts)

    return scan


def _union(found: DataFrame, others: DataFrame) -> DataFrame:
    """Results of several passes as one: runs are merged, items are united."""

    @F.arrow_udf("array<struct<word: long, words: long, start: long, stop: long>>")
    def merged(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for runs in parts:
            out = []
            for some in runs.to_pylist():
                if some:
                    a = np.array([[0, r["word"], r["word"] + r["words"], r["start"], r["stop"]] for r in some]).T
                    _, *rest = _merged(*a)
                    some = _runs(rest)
                out.append(some)
            yield pa.array(out, runs.type)

    both = found.select("number", "found").unionByName(others)
    both = both.groupBy("number").agg(
        F.max("found.n_words").alias("n_words"),
        F.flatten(F.collect_list("found.runs")).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("found.items")))).alias("items"),
    )
    both = both.withColumn("runs", merged("runs")).select("number", F.struct("n_words", "runs", "items").alias("found"))
    return found.drop("found").join(both, "number")


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """`row` (all columns of `docs`) and `found`: n_words, the hit runs (words and bytes, in order) and the items.

    Words are runs of 0-9, A-Z without case, and all characters from U+0080. A window is `window` words
    of an item in a row, or a whole shorter item. A word of a document is hit inside any occurrence of a
    window; runs are maximal. Hashes only name places, and every hit is compared word by word. Null and blank texts have no
    words and hit nothing; an item without an id is named by the empty string, rows of one id are one item.
    Equal rows are each scanned. An empty benchmark hits nothing.

    A benchmark of up to `slice_bytes` is broadcast, and the documents are scanned once without any shuffle.
    A larger one is dealt into slices below that size, one pass each; only documents that a pass
    finds something in are merged.
    """
    spark = docs.sparkSession
    ship(spark)
    run = Scratch(spark, "benchmark")
    chunks = run.stored(_chunks(benchmark, item, item_text, window).distinct(), "chunks")
    size = F.octet_length("text") + F.octet_length("item")
    n, total = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    slices = -(-total // slice_bytes) or 1
    while 1 < slices < 4 * n:
        dealt = chunks.groupBy(F.pmod(F.xxhash64("item", "text"), F.lit(slices))).agg(F.sum(size).alias("size"))
        # Chunks are different and small, so slices get as small as they have to.
        if dealt.agg(F.max("size")).first()[0] <= slice_bytes:
            break
        slices *= 2
    slice_of = F.pmod(F.xxhash64("item", "text"), F.lit(slices))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    texts = text_or_empty(f"row.`{text}`")
    if slices == 1:
        return whole.withColumn("found", _scanner(docs, chunks, window)(texts))
    rows = run.stored(whole.withColumn("number", F.monotonically_increasing_id()), "rows")
    found = rows.withColumn("found", _scanner(docs, chunks.where(slice_of == 0), window)(texts))
    others = None
    for i in range(1, slices):
        part = rows.select("number", _scanner(docs, chunks.where(slice_of == i), window)(texts).alias("found")).where(F.size("found.items") > 0)
        part = run.stored(part, "hits")
        others = part if others is None else others.unionByName(part)
    return _union(found, others).select("row", "found")


def n_hit() -> Column:
    return F.aggregate("found.runs", F.lit(0).cast("long"), lambda total, run: total + run["words"])


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "spans", **options) -> DataFrame:
    """`docs` without hit documents (remove="documents"), or with the hit runs cut from their texts (remove="spans").

    A cut run leaves one blank. Documents without hits, null texts included, stay as they are.
    """
    found = scan(docs, benchmark, text, **options)
    if remove == "documents":
        return found.where(F.size("found.runs") == 0).select("row.*")
    if remove != "spans":
        raise ValueError(f"remove is spans or documents, not {remove}")

    @F.arrow_udf("string")
    def cut(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, runs in parts:
            out = []
            for whole, some in zip(texts.to_pylist(), runs.to_pylist(), strict=True):
                data, kept, at = whole.encode(), [], 0
                for r in some:
                    kept.append(data[at : r["start"]])
                    at = r["stop"]
                out.append(b" ".join([*kept, data[at:]]).decode())
            yield pa.array(out, pa.string())

    hit = F.size("found.runs") > 0
    texts = found.withColumn("cut", F.when(hit, cut(F.when(hit, text_or_empty(f"row.`{text}`")).otherwise(""), F.col("found.runs"))).otherwise(F.col(f"row.`{text}`")))
    return texts.select(*[F.col("cut").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
