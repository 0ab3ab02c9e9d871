import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from kairograph.llm import simhash
from kairograph.llm.common import Scratch
from kairograph.llm.components import components
from kairograph.llm.simhash import connect, fingerprint, links, near_duplicates, one_of_each


def plain_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(prints):
    prints = np.array(prints, dtype=np.uint64)
    pairs = []
    for i in range(len(prints)):
        near = np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 3)
        pairs += [(i, i + 1 + j) for j in near.tolist()]
    return roots(len(prints), pairs)


def expected(rows):
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    group = brute(prints)
    least = defaultdict(lambda: None)
    for g, (key, _, _) in zip(group, rows, strict=True):
        if key is not None:
            least[g] = key if least[g] is None else min(key, least[g])
    return Counter((k, p, least[g]) for (k, _, _), p, g in zip(rows, prints, group, strict=True)), len(set(group))


def check(rows, docs):
    want, groups = expected(rows)
    found = near_duplicates(docs).collect()
    assert Counter((r.doc, r.fp % (1 << 64), r.component) for r in found) == want
    assert len({r.root for r in found}) == groups
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == groups


def test_hard_rows(documents, hard_rows):
    check(hard_rows, documents(hard_rows).withColumnRenamed("lang", "fp").withColumnRenamed("n_chars", "root"))


def test_edited_texts(documents):
    rng = np.random.default_rng(5)
    rows = []
    for base in range(40):
        words = [f"w{x}" for x in rng.integers(0, 500, 200)]
        for copy in range(12):
            own = list(words)
            for _ in range(copy // 3):
                own[rng.integers(0, 200)] = "edit"
            rows.append((1000 - len(rows), " ".join(own), "a"))
    check(rows, documents(rows))


def test_all_rows_without_keys(documents):
    check(rows := [(None, "one two three", "a"), (None, "other words all over", "a"), (None, "one two three", "b")], documents(rows))


def test_empty_table(documents):
    assert near_duplicates(documents([])).count() == 0
    assert one_of_each(documents([])).count() == 0


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 77} É" for i in range(3000))
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert fingerprint(text) == plain_fingerprint(text)


def clusters(rng, centres, members, flips):
    prints = set()
    for _ in range(centres):
        centre = int(rng.integers(0, 1 << 64, dtype=np.uint64))
        for _ in range(members):
            for bit in rng.choice(64, rng.integers(0, flips + 1), replace=False):
                prints.add(centre ^ (1 << int(bit)))
                centre = centre if rng.random() < 0.7 else centre ^ (1 << int(bit))
    return sorted(prints)


@pytest.mark.parametrize("most", [4, 512])
def test_links_connect_all_that_are_close(spark, most):
    """Also when every bucket has to be cut to the last level."""
    rng = np.random.default_rng(most)
    prints = clusters(rng, 20, 40, 3) + rng.integers(0, 1 << 64, 300, dtype=np.uint64).tolist()
    prints = sorted(set(prints))
    place = {p: i for i, p in enumerate(prints)}
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = [(place[r.u % (1 << 64)], place[r.v % (1 << 64)]) for r in links(frame, most).collect()]
    assert roots(len(prints), found) == brute(prints)


def test_groups_in_sorted_buckets():
    rng = np.random.default_rng(3)
    prints = np.array(clusters(rng, 4, 30, 4), dtype=np.uint64)
    buckets = np.sort(rng.integers(0, 3, len(prints)))
    want = [
        (i, j)
        for i in range(len(prints))
        for j in range(i + 1, len(prints))
        if buckets[i] == buckets[j] and int(prints[i] ^ prints[j]).bit_count() <= 3
    ]
    assert connect(buckets, prints).tolist() == roots(len(prints), want)


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 4000), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert found == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1300), 1000), 4000: 4000, 5000: 4000}


@pytest.mark.parametrize(
    ("pairs", "want", "rounds"),
    [([(2, 1), (1, 3), (3, 2)], {1: 1, 2: 1, 3: 1}, 1), ([(9, 1), (8, 1), (7, 2)], {9: 1, 8: 1, 1: 1, 7: 2, 2: 2}, 0), ([], {}, 0)],
)
def test_components_take_no_round_to_confirm(spark, pairs, want, rounds):
    """Each round is a table, several shuffles and broadcasts that the driver plans and holds."""
    run = Scratch(spark, "rounds")
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long"), run).collect()}
    assert found == want
    assert run.n == 1 + rounds
