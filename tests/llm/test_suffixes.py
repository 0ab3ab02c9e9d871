from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kairograph.llm import suffixes
from kairograph.llm.deepshallow import common_prefix, deep_shallow_order
from kairograph.llm.suffixes import LENGTH, covered_windows, find_anchors, remove_repeats


def brute(rows):
    """Spans and rest of each row by looking at every string of the length."""
    first: dict[bytes, tuple] = {}
    order = sorted({(i is None, i or 0, t or "") for i, t, _ in rows}, key=lambda r: r[:2])
    for none, key, text in order:
        data = text.encode()
        for at in range(len(data) - LENGTH + 1):
            place = (none, key, at)
            part = data[at : at + LENGTH]
            if part not in first or place < first[part]:
                first[part] = place
    found = Counter()
    for key, text, _ in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - LENGTH + 1):
            if first[data[at : at + LENGTH]] < (key is None, key or 0, at):
                gone[at : at + LENGTH] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        spans = tuple(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        found[key, len(data), spans, bytes(np.frombuffer(data, np.uint8)[~gone])] += 1
    return found


def check(rows, docs):
    found = Counter(
        (r.row.doc_id, r.n_bytes, tuple((s.begin, s.end) for s in r.spans), bytes(r.kept)) for r in remove_repeats(docs).collect()
    )
    assert found == brute(rows)


def passages(rng, n):
    """Texts from shared passages, edited here and there, with periodic runs and copies."""
    words = [f"wörd{x} " if x % 9 == 0 else f"word{x} " for x in range(300)]
    shared = ["".join(rng.choice(words, rng.integers(5, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.integers(0, 6)):
            kind = rng.random()
            if kind < 0.5:
                part = shared[rng.integers(0, len(shared))]
                cut = rng.integers(0, len(part))
                parts.append(part[cut:] if rng.random() < 0.4 else part)
            elif kind < 0.6:
                parts.append("ab"[: rng.integers(1, 3)] * int(rng.integers(1, 200)))
            else:
                parts.append("".join(rng.choice(words, rng.integers(1, 40))))
        rows.append((int(rng.integers(0, 2 * n)) * 100_000 + i, "".join(parts), "a"))
    rows += [(rows[j][0] + 50_000, rows[j][1], "b") for j in range(0, n, 7)]
    return rows


@pytest.mark.parametrize(("seed", "most"), [(1, 1024), (2, 3)])
def test_against_all_strings(documents, monkeypatch, seed, most):
    """With a small bound on groups the halving of d does the work."""
    monkeypatch.setattr(suffixes.partial_repeats, "__defaults__", (most,))
    rows = passages(np.random.default_rng(seed), 120)
    check(rows, documents(rows).repartition(5))


def test_frequent_grams_are_dealt_out(documents, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_ROWS", 2)
    monkeypatch.setattr(suffixes, "HOT_IN_TASK", 2)
    rows = passages(np.random.default_rng(3), 120)
    check(rows, documents(rows).repartition(3))


def test_hard_rows(documents, hard_rows):
    rows = [r for r in hard_rows if len(r[1] or "") < 50_000]
    rows += [(7, "same key, " * 30, "a"), (7, "other text, " * 30, "a"), (None, "same key, " * 20, None), (-5, "x" * 150, "a")]
    check(rows, documents(rows).withColumnRenamed("lang", "kept").withColumnRenamed("n_chars", "spans"))


def test_long_texts(documents):
    """Strings that overlap count, so a text with a period keeps one period, a copy nothing."""
    docs = documents([(1, "x" * 300_000, "a"), (2, "x" * 300_000, "a"), (3, "long " * 60_000, "a")])
    found = {r.row.doc_id: len(r.kept) for r in remove_repeats(docs).collect()}
    assert found == {1: 1, 2: 0, 3: 5}


def test_empty_table(documents):
    assert remove_repeats(documents([])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), max_size=40), st.integers(0, 20))
def test_deep_shallow_order(strings, agree):
    strings = [b"\x01" * agree + s for s in strings]
    order = deep_shallow_order(strings, agree)
    assert sorted(order) == list(range(len(strings)))
    assert [strings[i] for i in order] == sorted(strings)


@given(st.binary(), st.binary(), st.binary())
def test_common_prefix(a, b, c):
    n = common_prefix(a + b, a + c)
    assert (a + b)[:n] == (a + c)[:n] and (len(a + b) == n or len(a + c) == n or (a + b)[n] != (a + c)[n])


@pytest.mark.parametrize("segment", [500, 1 << 22])
def test_anchors_do_not_depend_on_segments(monkeypatch, segment):
    """Every window holds an anchor, and equal windows the same one, wherever segments are cut."""
    monkeypatch.setattr(suffixes, "SEGMENT", segment)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 4, 3000).astype(np.uint8)
    texts = [base[:10], base, base[1000:1600], np.zeros(400, np.uint8), base[:0], base[200:2900]]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = find_anchors(np.concatenate(texts), starts)
    seen: dict[bytes, list[int]] = {}
    for i, text in enumerate(texts):
        own = found.at[found.text == i] - starts[i]
        for at in range(len(text) - LENGTH + 1):
            inside = [int(p - at) for p in own if at <= p <= at + LENGTH - suffixes.GRAM]
            assert inside
            window = text[at : at + LENGTH].tobytes()
            common = set(seen.setdefault(window, inside)) & set(inside)
            assert common
            seen[window] = sorted(common)


def test_windows_of_small_groups():
    rng = np.random.default_rng(9)
    left = [bytes(rng.integers(0, 2, rng.integers(0, 69)).astype(np.uint8)) for _ in range(60)]
    right = [b"k" * 32 + bytes(68)[: rng.integers(40, 69)] for _ in range(60)]
    groups = np.array([0, 1, 20, 60])
    place = rng.permutation(60)
    low, high = np.zeros(60, np.int64), np.full(60, suffixes.SPAN)
    least, most = covered_windows(groups, place, left, right, low, high)
    for begin, end in zip(groups, groups[1:], strict=False):
        for i in range(begin, end):
            hit = [
                d
                for d in range(suffixes.SPAN + 1)
                for j in range(begin, end)
                if place[j] < place[i] and min(len(left[i]), len(left[j])) >= d and left[i][:d] == left[j][:d]
                and min(len(right[i]), len(right[j])) >= LENGTH - d and right[i][: LENGTH - d] == right[j][: LENGTH - d]
            ]
            assert (least[i], most[i]) == ((min(hit), max(hit)) if hit else (-1, -1))
