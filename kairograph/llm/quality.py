"""Quality by importance resampling: hashed n-gram models of good text and of all text, and a Gumbel top-k draw.

Each text is a bag of hashed n-grams: its words, pairs of neighbouring words, and pairs of word
shapes (case, digits, the sign at the end, and whether the word repeats the one before). One
multinomial model is fitted to the texts that are labelled good and one to all texts. The weight
of a text is the logarithm of the ratio of its probabilities under the two. Drawing k texts
without replacement in proportion to these weights is taking the k largest sums of log weight and
Gumbel noise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import ship, stored, text_or_empty, uniform

KINDS = 3
BUCKETS = 1 << 16
SHAPES = 1 << 10
CACHED = 1 << 18
PIECE = 4 << 20
BATCH = 1 << 17
WHITE = re.compile(rb"[\x20\x09-\x0D]")
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _shape(word: bytes) -> bytes:
    """Case, digits and last sign of a word."""
    core = word.strip(b".,;:!?\"'()[]-|*#$%&@~^_=+<>/\\")
    tail = word[-1:] if word[-1:] < b"\x80" and not word[-1:].isalnum() else b""
    if not core:
        kind = b"sign"
    elif core.isdigit():
        kind = b"number"
    elif core == core.upper() and core != core.lower():
        kind = b"upper"
    elif core[:1] != core[:1].lower():
        kind = b"title"
    else:
        kind = b"lower"
    return kind + tail + (b"0" if any(48 <= c < 58 for c in core) else b"")


class Words(dict):
    """Word -> hash of its lower-case form in the high bits and its shape in the low ones; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED:
            self.clear()
        shape = xxhash.xxh3_64_intdigest(_shape(word)) % SHAPES
        self[word] = code = (xxhash.xxh3_64_intdigest(word.lower()) >> 12) * SHAPES + shape
        return code


def _hashed(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind + 1)) * FACTOR
    x ^= x >> np.uint64(32)
    x *= FACTOR
    return (x >> np.uint64(48)).astype(np.int64) + kind * BUCKETS


def _pieces(text: str | None) -> Iterator[bytes]:
    """The bytes of a text, a very long one cut at white space into pieces of about `PIECE` bytes."""
    data = (text or "").encode()
    at = 0
    while at < len(data):
        space = WHITE.search(data, at + PIECE) if len(data) - at > PIECE else None
        end = space.end() if space else len(data)
        yield data[at:end]
        at = end


def batches_of_words(texts: Iterator[str | None], known: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes of words, the number of their text, and whether a word counts itself.

    A text that goes on in the next batch starts there with its last word, which counts for its pair only.
    """
    codes: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    size = 0
    for number, text in enumerate(texts):
        last = None
        for piece in _pieces(text):
            words = piece.split()
            if not words:
                continue
            before = [last] if last is not None else []
            n = len(before) + len(words)
            codes.append(np.fromiter(map(known.__getitem__, [*before, *words]), np.uint64, n))
            owners.append(np.full(n, number))
            counts.append(np.arange(n) >= len(before))
            size, last = size + n, words[-1]
            if size >= BATCH:
                yield np.concatenate(codes), np.concatenate(owners), np.concatenate(counts)
                codes, owners, counts, size = [], [], [], 0
    if codes:
        yield np.concatenate(codes), np.concatenate(owners), np.concatenate(counts)


def features(codes: np.ndarray, owner: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, each kind in a range of its own, and the texts they are from."""
    word, shape = codes // np.uint64(SHAPES), codes % np.uint64(SHAPES)
    # A pair lies within a text; a word that counts only for its pair is the second of none.
    inside = (owner[1:] == owner[:-1]) & own[1:]
    left, right = np.flatnonzero(inside), np.flatnonzero(inside) + 1
    again = (word[right] == word[left]).astype(np.uint64)
    # A word that repeats is no pair of its own: all repetitions count as one.
    pair = np.where(again == 1, np.uint64(1), word[left] * np.uint64(31) + word[right])
    shapes = (shape[left] * np.uint64(SHAPES) + shape[right]) * np.uint64(2) + again
    found = [_hashed(word[own], 0), _hashed(pair, 1), _hashed(shapes, 2)]
    return np.concatenate(found), np.concatenate([owner[own], owner[left], owner[left]])


def counts(texts: Iterator[str | None], known: Words) -> np.ndarray:
    found = np.zeros(KINDS * BUCKETS, np.int64)
    for batch in batches_of_words(texts, known):
        found += np.bincount(features(*batch)[0], minlength=len(found))
    return found


@dataclass(frozen=True)
class Model:
    """Log ratio of the two models by bucket, and the least log weight per word of a text to draw."""

    ratio: np.ndarray
    cut: float = -np.inf

    @classmethod
    def of(cls, target: np.ndarray, raw: np.ndarray, smoothing: float = 1.0) -> Model:
        ratio = np.zeros(KINDS * BUCKETS)
        for kind in range(KINDS):
            part = slice(kind * BUCKETS, (kind + 1) * BUCKETS)
            good, all_ = target[part] + 0.0, raw[part] + 0.0
            # What the smaller, labelled part does not show is taken from all texts.
            prior = (all_ + smoothing) / (all_.sum() + smoothing * BUCKETS)
            like = (good + smoothing * BUCKETS * prior) / (good.sum() + smoothing * BUCKETS)
            ratio[part] = np.log(like) - np.log(prior)
        return cls(ratio)

    def scores(self, texts: list[str | None], known: Words) -> np.ndarray:
        """Log weight per word of each text; 0 without words."""
        total, words = np.zeros(len(texts)), np.zeros(len(texts))
        for codes, owner, own in batches_of_words(iter(texts), known):
            found, of = features(codes, owner, own)
            total += np.bincount(of, weights=self.ratio[found], minlength=len(texts))
            words += np.bincount(owner[own], minlength=len(texts))
        return total / np.maximum(words, 1)


def best_cut(scores: np.ndarray, good: np.ndarray, lost_good: float = 5.0) -> float:
    """The cut of least cost on labelled scores: a good text below costs `lost_good`, another one above costs 1."""
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    scores, good = scores[order], good[order]
    below_good = np.concatenate([[0], np.cumsum(good)])
    above_bad = (~good).sum() - np.concatenate([[0], np.cumsum(~good)])
    cost = lost_good * below_good + above_bad
    # Of equal costs the middle; a cut lies between different scores.
    edges = np.concatenate([[scores[0] - 1], scores, [scores[-1] + 1]])
    cuts = (edges[:-1] + edges[1:]) / 2
    open_ = edges[:-1] < edges[1:]
    best = np.flatnonzero(open_ & (cost == cost[open_].min()))
    return float(cuts[best[len(best) // 2]])


# --- jobs ---------------------------------------------------------------------------------


def _count_job(labelled: dict[int, int]):
    """Non-zero counts of each task: all texts (kind 0) and good labelled texts of the fitting half (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        found = [np.zeros(KINDS * BUCKETS, np.int64) for _ in range(2)]
        for batch in batches:
            texts = batch.column(1)
            found[0] += counts((t.as_py() for t in texts), known)
            chosen = [i for i, d in enumerate(batch.column(0).to_pylist()) if labelled.get(d) == 1 and fits(d)]
            found[1] += counts((texts[i].as_py() for i in chosen), known)
        for kind, vector in enumerate(found):
            bucket = np.flatnonzero(vector)
            columns = [np.full(len(bucket), kind), bucket, vector[bucket]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "bucket", "n"])

    return run


def fits(doc_id: int) -> bool:
    """Which half of the labelled texts fits the model; the other half sets the cut."""
    return xxhash.xxh3_64_intdigest(str(doc_id).encode()) % 2 == 0


def label_sample(labels: DataFrame, most: int, key: str = "doc_id", label: str = "quality") -> dict[int, int]:
    """At most `most` labelled documents, by a hash of the key; null keys and labels do not count."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    rows = known.groupBy(F.col(key).alias("k")).agg(F.min(label).alias("v")).orderBy(F.xxhash64("k"), "k").limit(most)
    return {r.k: r.v for r in rows.collect()}


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = 20_000) -> Model:
    """The model of all texts and of the labelled good ones, with its cut.

    All texts are counted; of the labels at most `most` are used, one half to fit and the other to
    set the cut. Without good labels every text weighs the same; without others nothing is cut.
    """
    spark = docs.sparkSession
    ship(spark)
    labelled = label_sample(labels, most)
    texts = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    job = texts.mapInArrow(_count_job(labelled), "kind long, bucket long, n long")
    vectors = np.zeros((2, KINDS * BUCKETS))
    # One row per bucket, however large the corpus; as columns, since row objects take many times the memory.
    sums = job.groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    vectors[sums["kind"].to_numpy(), sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    if not vectors[1].any():
        return Model(np.zeros(KINDS * BUCKETS))
    model = Model.of(vectors[1], vectors[0])
    keys = spark.createDataFrame([(k, v) for k, v in labelled.items() if not fits(k)], "k long, v long")
    # A labelled sample of bounded size; its texts stay on the executors, only scores come back.
    held = texts.join(F.broadcast(keys), "k").select("v", "t")
    scored = held.select("v", _scorer(model)("t").alias("s")).collect()
    if not scored:
        return model
    return Model(model.ratio, best_cut(np.array([r.s for r in scored]), np.array([r.v == 1 for r in scored])))


def _scorer(model: Model):
    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Words()
        for part in parts:
            yield pd.Series(model.scores(part.tolist(), known))

    return score


def largest(rows: DataFrame, name: str, k: int, collected: int = 10_000) -> float:
    """The k-th largest number of a column, exactly, by counts in ever narrower ranges."""
    ends = rows.agg(F.min(name).alias("low"), F.max(name).alias("high")).first()
    low, high, before = ends["low"], ends["high"], 0
    while True:
        inside = rows.where(F.col(name).between(low, high))
        left = inside.count()
        if left <= collected or low == high:
            values = sorted((r[0] for r in inside.select(name).limit(collected).collect()), reverse=True)
            return values[min(k - before, len(values)) - 1]
        step = (high - low) / 4096
        cell = F.floor((F.col(name) - low) / step)
        cells = inside.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("low"), F.max(name).alias("high"))
        for row in sorted(cells.collect(), key=lambda r: -r["cell"]):
            if before + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            before += row["n"]


def draw_key(score: Column, key: Column, text: Column, temperature: float, seed: int) -> Column:
    """Log weight and Gumbel noise; the noise depends on key and text alone."""
    return score / F.lit(temperature) - F.log(-F.log(uniform(seed, key, F.xxhash64(text))))


def resample(
    docs: DataFrame,
    labels: DataFrame,
    k: int | None = None,
    key: str = "doc_id",
    text: str = "text",
    temperature: float = 0.02,
    seed: int = 11,
    most: int = 20_000,
    carry: bool = False,
) -> DataFrame:
    """The k drawn rows: key, log_weight, draw (and `row`); without k as many as pass the cut of the model.

    The weight of a text is its log ratio per word over the temperature, so that long texts do not
    outweigh all others. Texts without words and null texts weigh 0. Rows that repeat entirely have
    the same noise; rows that tie with the last one drawn are drawn too. Null keys are drawn like
    others. An empty table, and k of 0, give an empty result.
    """
    model = fit(docs, labels, key, text, most)
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"), *whole)
    score = texts.withColumn("log_weight", _scorer(model)("t"))
    scored = score.withColumn("draw", draw_key(F.col("log_weight"), F.col("key"), text_or_empty("t"), temperature, seed)).drop("t")
    scored = stored(scored, "quality")
    if k is None:
        k = scored.where(F.col("log_weight") >= F.lit(model.cut)).count()
    k = min(k, scored.count())
    return scored.where(F.col("draw") >= F.lit(largest(scored, "draw", k))) if k else scored.limit(0)
