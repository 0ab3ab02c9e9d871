import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairograph.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items):
    """(n_words, runs of hit words, item names) of each text."""
    windows = {}
    for item, text in items:
        words = plain_words(text)
        size = min(len(words), 10)
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for text in texts:
        words, hit, names = plain_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if found := windows.get(tuple(words[i : i + size])):
                    hit |= set(range(i, i + size))
                    names |= found
        runs = [(i, next(j for j in range(i, len(words) + 1) if j not in hit) - i) for i in sorted(hit) if i - 1 not in hit]
        out.append((len(words), runs, sorted(names)))
    return out


@pytest.fixture(scope="module")
def benchmark(spark):
    def make(rows):
        return spark.createDataFrame(rows, "item_id long, text string")

    return make


def found_in(docs, items, **options):
    rows = decontaminate.scan(docs, items, **options).select("row.doc_id", "row.text", "found").collect()
    return {(r.doc_id, r.text): (r.found.n_words, [(x.word, x.words) for x in r.found.runs], list(r.found.items)) for r in rows}


def cases(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ünï", "ÀB", "漢字", "x9"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 40, 12))]
    items += [(50, "one Two"), (51, "ÀB"), (52, items[3][1]), (52, text(12)), (None, text(15)), (53, None), (54, "..."), (55, "one, two!")]
    texts = [text(int(n)) for n in rng.integers(0, 60, 40)]
    for i in range(0, 40, 2):
        inner = items[int(rng.integers(0, len(items)))][1] or ""
        texts[i] += rng.choice([" ", ", ", "\n\n", " - "]) + inner.upper().replace(" ", rng.choice([" ", "--", "\x00"])) + " " + texts[i]
    return texts, items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(documents, benchmark, hard_rows, seed):
    texts, items = cases(seed)
    rows = [(100 + i, t, "a") for i, t in enumerate(texts)] + hard_rows
    want = {(r[0], r[1]): b for r, b in zip(rows, brute([r[1] for r in rows], items), strict=True)}
    assert sum(bool(b[1]) for b in want.values()) > 10
    assert found_in(documents(rows), benchmark(items)) == want
    # A benchmark over the bound of a broadcast gives the same by several passes.
    assert found_in(documents(rows), benchmark(items), slice_bytes=200) == want


def test_long_texts_in_pieces(monkeypatch):
    """Pieces of a few bytes: windows that reach over them, words and blanks longer than a piece."""
    monkeypatch.setattr(decontaminate, "PIECE", 7)
    rng = np.random.default_rng(3)
    items = [(1, "a b c d e f g h i j k l"), (2, "b b"), (3, "c"), (4, "longword" * 5 + " d")]
    for n in range(60):
        words = list(rng.choice(list("abcd") + ["longword" * 5], int(rng.integers(0, 40)))) + (["A b C d e f", "g h i j k l"] if n % 2 else [])
        text = "".join(w + str(rng.choice([" ", ".. ", " " * 20])) for w in words)
        scan = decontaminate.Scan(decontaminate.WindowSet([t for _, t in items], [str(i) for i, _ in items], 10))
        got = scan.long_text(np.frombuffer(text.encode(), np.uint8))
        assert (got["n_words"], [(r["word"], r["words"]) for r in got["runs"]], got["items"]) == brute([text], items)[0]


def test_items_longer_than_a_chunk(documents, benchmark):
    text = " ".join(f"n{i}" for i in range(70_000))
    docs = documents([(1, text[300_000:300_200], "a"), (2, text, "a"), (3, "n1 n3 n5", "a")])
    assert found_in(docs, benchmark([(9, text)])) == {(r.doc_id, r.text): b for r, b in zip(docs.collect(), brute([r.text for r in docs.collect()], [(9, text)]), strict=True)}


def test_equal_hashes_are_told_apart(monkeypatch):
    """With one hash for all windows every place is looked up, and only equal words count."""
    windows_of = decontaminate.Words.windows

    def weak(words, size, factor=decontaminate.WORD):
        at, code = windows_of(words, size, factor)
        return at, np.zeros_like(code) if factor == decontaminate.WORD else code

    monkeypatch.setattr(decontaminate.Words, "windows", weak)
    items = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k")]
    windows = decontaminate.WindowSet([t for _, t in items], ["1", "2"], 10)
    data = "x a b c d e f g h i k x".encode()
    got = decontaminate.Scan(windows).texts(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
    assert got["items"] == ["2"] and [(r["word"], r["words"]) for r in got["runs"]] == [(1, 10)]


def test_clean(documents, benchmark):
    docs = documents([(1, "keep this, A b-c d e f g h i J. and this", "a"), (2, "nothing here", "a"), (3, None, "a"), (4, "", "b"), (1, "nothing", "a")])
    items = benchmark([(1, "a b c d e f g h i j")])
    cut = {(r.doc_id, r.text) for r in decontaminate.clean(docs, items).collect()}
    assert cut == {(1, "keep this,  . and this"), (2, "nothing here"), (3, None), (4, ""), (1, "nothing")}
    kept = decontaminate.clean(docs, items, remove="documents")
    assert kept.columns == docs.columns and {(r.doc_id, r.text) for r in kept.collect()} == {(2, "nothing here"), (3, None), (4, ""), (1, "nothing")}
    with pytest.raises(ValueError):
        decontaminate.clean(docs, items, remove="all")


def test_empty_tables_and_clashing_names(documents, benchmark):
    assert decontaminate.scan(documents([]), benchmark([(1, "a")])).count() == 0
    docs = documents([(1, "a b", "x")]).withColumn("found", F.lit(1)).withColumn("row", F.lit(2)).withColumn("number", F.lit(3))
    empty = decontaminate.scan(docs, benchmark([])).select("row.*", "found.n_words", "found.items").collect()
    assert [(r.row, r.number, r.n_words, r.items) for r in empty] == [(2, 3, 2, [])]
    assert decontaminate.clean(docs, benchmark([(1, "A")])).columns == docs.columns


def test_registered_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = set()
    for (key, _), (n, runs, names) in zip(docs, brute([t for _, t in docs], items), strict=True):
        n_hit = sum(x for _, x in runs)
        want.add((key, n, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0))
    found = queries.QUERIES["op13_benchmark_hits"](spark, sf_dir)
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert {tuple(r) for r in found.collect()} == want and any(r[5] for r in want)
    assert not re.search("Exchange|Join", found._jdf.queryExecution().executedPlan().toString())
