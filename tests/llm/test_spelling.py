import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairograph.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_counts(rows):
    counts = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return counts


def near(a, b):
    """One insertion, deletion or replacement, tried out."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, letters=6, least=5, times=5):
    n = {w: c for w, c in plain_counts(rows).items() if len(w) >= letters and c >= least}
    form, out = {}, set()
    around = {w: [v for v in n if near(w, v)] for w in n}
    for w, others in around.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n[w], len(around[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


def found(docs, **options):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs, **options).collect()}


def many(word, n):
    return (word + " ") * n


def test_chains_ties_and_alphabet(documents):
    rows = [
        (1, many("Schöne", 500) + many("schonE", 60) + many("sChone", 20) + many("schon", 900), "a"),
        (2, many("schones", 10) + many("xschonex", 5) + many("aabbaabb", 7) + many("aabbabb", 7) + many("aabbaabbb", 40), "a"),
        (3, many("letter", 5) + many("lettre", 50) + many("setter", 25) + many("better", 25) + many("let×ter", 5) + many("ÀÁÂÃÄÅ", 6) + many("ÀÁÂÃÄÆ", 30), "b"),
        (4, many("rareword", 4), "b"),
        (4, many("rareword", 4), "b"),
    ]
    got = found(documents(rows))
    assert got == brute([r[:2] for r in rows])
    assert ("letter", 5, 3, "better", 25, "better") in got
    assert {r[0] for r in got} >= {"rareword", "let×ter", "ÀÁÂÃÄÅ"}


@pytest.mark.parametrize(("seed", "trie_letters"), [(1, 40), (2, 8), (3, 6)])
def test_against_brute_force(documents, seed, trie_letters):
    """Few letters, so that many words are near each other; with short tries the longer words take the other way."""
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join("".join(rng.choice(list("abé"), int(n))) for n in rng.integers(5, 11, 250)), "a") for i in range(60)]
    rows += [(i, many("".join(rng.choice(list("abé"), int(rng.integers(6, 10)))), 30), "a") for i in range(100, 140)]
    got = found(documents(rows), trie_letters=trie_letters)
    assert got == brute([r[:2] for r in rows])
    assert sum(r[2] > 3 for r in got) > 30 and any(r[3] for r in got)


def test_very_long_words(documents):
    word = "abcdefghij" * 3000
    other, longer = word[:20_000] + "x" + word[20_001:], word[:500] + "q" + word[500:]
    rows = [(1, many(word, 25), "a"), (2, many(other, 5), "a"), (3, many(longer, 5), "a"), (4, many("a" * 41, 5) + many("a" * 40, 5) + many("a" * 39, 5), "a")]
    got = {(r[0], r[2], r[3]) for r in found(documents(rows))}
    assert got == {(word, 2, None), (other, 1, word), (longer, 1, word), ("a" * 41, 1, None), ("a" * 40, 2, None), ("a" * 39, 1, None)}


def test_one_start_and_one_text_hold_most(documents):
    """Half of all words begin alike and sit in one text."""
    rng = np.random.default_rng(5)
    tails = ["".join(rng.choice(list("abcdef"), 4)) for _ in range(300)]
    rows = [(1, " ".join(f"common{t}" for t in tails) * 6 + " " + many("commonaaaa", 40), "a"), (2, " ".join(f"{t}{t}" for t in tails) * 6, "a")]
    assert found(documents(rows)) == brute([r[:2] for r in rows])


def test_hard_rows(documents, hard_rows):
    docs = documents(hard_rows).withColumn("word", F.lit(1)).withColumn("n", F.lit(2))
    want = {r for r in brute([r[:2] for r in hard_rows]) if len(r[0]) < 1000}
    assert {r for r in found(docs) if len(r[0]) < 1000} == want


def test_empty(documents):
    assert found(documents([])) == found(documents([(1, None, "a"), (2, "", "a"), (3, "short", "a")])) == set()


def test_deletions():
    for word in ("aabca", "zz", "é"):
        rest = {}
        for at, last, code in spelling._deletions(word):
            text = word if at < 0 else word[:at] + word[at + 1 :]
            assert rest.setdefault(text, code) == code
            assert at < 0 or last == (at + 1 == len(word) or word[at + 1] != word[at])
        assert len(set(rest.values())) == len(rest)
    assert spelling.one_edit("abc", "ab") and spelling.one_edit("abc", "abd") and spelling.one_edit("", "a")
    assert not spelling.one_edit("abc", "abc") and not spelling.one_edit("abc", "acb") and not spelling.one_edit("abcd", "ab")


def test_registered_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.QUERIES["op12_spelling_variants"](spark, sf_dir).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert {tuple(r) for r in got} == brute(rows)
