import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from kairograph.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:])
    return out


def brute(rows):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt(rows).items():
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        own = (len(convs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += own
    return {
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    }


def found(spark, rows, **options):
    out = [tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), **options).collect()]
    assert len(out) == len(set(out))
    return set(out)


def conversations(seed, n=90, turns=7, words=3):
    rng = np.random.default_rng(seed)
    text = lambda: " ".join(rng.choice(["a", "b b", "c\tc", ""], int(rng.integers(0, words))))
    rows = []
    for c in rng.choice(np.arange(-40, 200), n, replace=False).tolist():
        rows += [(c, int(rng.integers(0, 4)) if rng.random() < 0.9 else None, str(rng.choice(["user", "bot"])), text()) for _ in range(int(rng.integers(1, turns)))]
    rng.shuffle(rows)
    return [tuple(r) for r in rows]


def as_rows(rows):
    return [(int(a) if a is not None else None, int(b) if b is not None else None, c, d) for a, b, c, d in rows]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = as_rows(conversations(seed))
        want = brute(rows)
        assert any(r[4] > 2 for r in want) and any(r[6] for r in want)
        assert found(spark, rows) == want


def test_hard_rows(spark):
    rows = [
        (1, None, None, None), (1, None, "", ""), (1, 0, "user", "x " * 40_000), (20, 1, "user", "Ünï \U0001f600"), (21, 1, "user", "Ünï \U0001f600"),
        (None, 1, "user", "belongs to none"), (40, 2, "a", "b"), (40, 2, "a", "b"), (40, 2, "ab", ""), (41, 0, "a", "b"), (-1, 0, "a", "b"), (-20, 0, "a", "b"),
    ]
    rows += [(c, 0, "user", "one turn") for c in range(100, 125)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in got), "a turnless conversation ends at the root"


def test_one_conversation_holds_most_turns(spark):
    """It lies on several tasks; half of its turns are one repeated row."""
    rows = [(20, i, "user", f"t{i % 5}") for i in range(300)] + [(20, 7, "user", "again")] * 300
    rows += [(c, i, "user", f"t{i % 5}") for c in (21, 22, 23, 60, 61) for i in range(40)]
    assert found(spark, rows) == brute(rows)


def test_many_equal_conversations(spark):
    rows = [(c, i, "user", f"hello {i}") for c in range(400) for i in range(3)]
    assert found(spark, rows) == brute(rows)


def test_nested_chains(spark):
    """Every conversation hangs on the one before, so that totals climb many steps."""
    rows = [(c, i, "u", f"{i} x" if i < c else f"end {c}") for c in range(40, 60) for i in range(c - 38)]
    assert found(spark, rows) == brute(rows)


def test_colliding_fingerprints_are_noticed(spark, monkeypatch):
    """With a fingerprint of two values only, verification fails and another base is taken."""
    rows = as_rows(conversations(3, 30))
    tried = []

    class Weak(prefix_trie.Products):
        def element(self, digest):
            if len(tried) == 1:
                return 1, digest[0] % 2
            return super().element(digest)

    def bases():
        for base in (3, 0x123456789ABCDEF0123):
            tried.append(base)
            monkeypatch.setattr(prefix_trie, "Products", weak_products if len(tried) == 1 else Products)
            yield base

    Products = prefix_trie.Products

    def weak_products(base):
        made = Products(base)
        made.element = lambda digest: (1, digest[0] % 2)
        return made

    assert found(spark, rows, bases=bases()) == brute(rows)
    assert len(tried) == 2


def test_empty_and_clashing_names(spark):
    assert found(spark, []) == set()
    assert found(spark, [(None, 1, "a", "b")]) == set()
    rows = as_rows(conversations(4, 20))
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("conv", "depth", "print", "sha", "words", "number", "place", "task", "row"):
        docs = docs.withColumn(name, F.lit("x"))
    assert {tuple(r) for r in prefix_trie.prefix_trie(docs).collect()} == brute(rows)


def test_registered_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op11_prefix_trie"](spark, sf_dir)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {tuple(r) for r in got.select(*names).collect()} == brute(rows)
