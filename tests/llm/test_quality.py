import math
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import xxhash

from kairograph.llm import quality
from kairograph.llm.quality import BUCKETS, Model, Words, batches_of_words, best_cut, counts, features, fits, fit, largest, resample
from tests.llm.conftest import HARD_TEXTS


def plain_features(text):
    """n-grams word by word, as pairs of kind and value."""
    words = (text or "").encode().split()
    found = Counter(("word", w.lower()) for w in words)
    for a, b in zip(words, words[1:], strict=False):
        same = a.lower() == b.lower()
        found["pair", "again" if same else (a.lower(), b.lower())] += 1
        found["shape", quality._shape(a), quality._shape(b), same] += 1
    return found


def test_features_of_hard_texts(monkeypatch):
    monkeypatch.setattr(quality, "BATCH", 50)
    monkeypatch.setattr(quality, "PIECE", 30)
    texts = [t for t in HARD_TEXTS if len(t or "") < 5000]
    known = Words()
    found = [features(*b) for b in batches_of_words(iter(texts), known)]
    total = Counter(f // BUCKETS for b, _ in found for f in b.tolist())
    want = [plain_features(t) for t in texts]
    for kind, name in enumerate(("word", "pair", "shape")):
        assert total[kind] == sum(n for c in want for k, n in c.items() if k[0] == name)
    by_text = Counter(o for _, owner in found for o in owner.tolist())
    assert by_text == Counter({i: c.total() for i, c in enumerate(want) if c})


def test_scores_do_not_depend_on_batches(monkeypatch):
    rng = np.random.default_rng(2)
    model = Model(rng.normal(size=3 * BUCKETS))
    whole = model.scores(HARD_TEXTS, Words())
    assert counts(iter(HARD_TEXTS), Words()).sum() == sum(plain_features(t).total() for t in HARD_TEXTS)
    monkeypatch.setattr(quality, "BATCH", 10)
    monkeypatch.setattr(quality, "PIECE", 17)
    assert np.allclose(model.scores(HARD_TEXTS, Words()), whole)
    assert whole[0] == whole[1] == whole[2] == 0


def test_ratio_is_of_smoothed_shares():
    target, raw = np.zeros(3 * BUCKETS), np.zeros(3 * BUCKETS)
    target[5], raw[5], raw[6] = 10, 10, 30
    ratio = Model.of(target, raw).ratio
    prior = np.array([11, 31]) / (40 + BUCKETS)
    like = (np.array([10, 0]) + BUCKETS * prior) / (10 + BUCKETS)
    assert ratio[5:7] == pytest.approx(np.log(like / prior))


def test_best_cut():
    assert 1 < best_cut(np.array([0.0, 1, 2, 3]), np.array([False, False, True, True])) < 2
    assert best_cut(np.array([1.0, 2]), np.array([True, True])) == -math.inf
    assert best_cut(np.array([0.0, 1, 2, 3, 4]), np.array([False, True, False, True, True])) < 1, "good texts weigh more"


@pytest.mark.parametrize("collected", [3, 10_000])
def test_kth_largest(spark, collected):
    values = [float(x % 97) ** 3 - 5 for x in range(500)] + [7.0] * 50
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 60, 61, 549, 550):
        assert largest(rows, "x", k, collected) == sorted(values, reverse=True)[k - 1]


def labelled(documents, spark, n=600):
    """Good prose and shouted junk; all are labelled."""
    rng = np.random.default_rng(4)
    words = ["river", "stone", "quiet", "morning", "walked", "under", "green", "hill", "and", "the"]
    rows, marks = [], []
    for i in range(n):
        own = rng.choice(words, 30)
        bad = i % 5 == 0
        rows.append((i, " ".join(f"{w.upper()}!!" if bad else w for w in own), "a"))
        marks.append((i, 0 if bad else 1, 0))
    return documents(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(documents, spark):
    docs, labels = labelled(documents, spark)
    drawn = {r.key for r in resample(docs, labels.where("doc_id < 300")).collect()}
    held = range(300, 600)
    assert sum((i in drawn) == (i % 5 != 0) for i in held) / 300 > 0.97


def test_given_data(spark):
    """Labels that fit neither the model nor its cut: nearly all good documents stay, nearly all others go."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    marks = {r.doc_id: r.quality for r in labels.collect()}
    seen = labels.where("doc_id % 4 > 0")
    drawn = {r.key for r in resample(docs, seen).collect()}
    held = {i: q for i, q in marks.items() if i % 4 == 0}
    good = [i in drawn for i, q in held.items() if q == 1]
    bad = [i in drawn for i, q in held.items() if q == 0]
    assert np.mean(good) > 0.95
    assert np.mean(bad) < 0.2


def gumbel(key, print_, seed):
    """The noise again, from Spark's hash chain: each column is hashed with the hash before as seed."""
    h = 42
    for value in (seed.to_bytes(4, "little"), None if key is None else key.to_bytes(8, "little", signed=True), print_.to_bytes(8, "little")):
        h = h if value is None else xxhash.xxh64_intdigest(value, seed=h)
    u = ((h >> 11) + 0.5) / (1 << 53)
    return -math.log(-math.log(u))


def test_draw_is_the_top_of_weight_and_noise(documents, spark, hard_rows):
    labels = spark.createDataFrame([(i * 3, i % 2, 0) for i in range(14)], "doc_id long, quality int, toxic int")
    docs = documents(hard_rows).withColumnRenamed("lang", "draw").withColumnRenamed("n_chars", "log_weight")
    model = fit(docs, labels)
    scores = model.scores([t for _, t, _ in hard_rows], Words())
    keys = [s / 0.02 + gumbel(i, xxhash.xxh64_intdigest((t or "").encode(), seed=42), 11) for (i, t, _), s in zip(hard_rows, scores, strict=True)]
    for k in (1, 5, len(hard_rows)):
        found = resample(docs, labels, k, carry=True).collect()
        bar = sorted(keys, reverse=True)[k - 1]
        want = Counter((i, t) for (i, t, _), x in zip(hard_rows, keys, strict=True) if x >= bar - 1e-6)
        assert Counter((r.row.doc_id, r.row.text) for r in found) == want


@pytest.mark.parametrize("marks", [[], [(1, 1, 0)], [(1, 0, 0), (None, 1, 0), (2, None, 1)]])
def test_few_labels(documents, spark, hard_rows, marks):
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    assert resample(documents(hard_rows), labels).count() == len(hard_rows)
    assert resample(documents(hard_rows), labels, 0).count() == 0


def test_empty_table(documents, spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert resample(documents([]), labels).count() == 0


def test_halves_are_even():
    assert 0.4 < np.mean([fits(i) for i in range(1000)]) < 0.6


def test_counts_reach_the_driver_as_columns(documents, spark):
    """A row object for each of the buckets would take some hundred bytes of the driver."""
    text = " ".join(f"w{i}" for i in range(60_000))
    docs = documents([(0, text, "a")])
    labels = spark.createDataFrame([(None, 1)], "doc_id long, quality int")
    fit(docs, labels)
    tracemalloc.start()
    assert not fit(docs, labels).ratio.any()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 << 20
