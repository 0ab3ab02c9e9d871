import hashlib
from collections import defaultdict

import numpy as np
import pytest

from kairograph.llm import exact
from kairograph.llm.exact import WHITE_SPACE, Shape, exact_dedup, fuse_filter, may_hold


def plain(text):
    return "".join(c for c in text or "" if c not in WHITE_SPACE)


def expected(rows):
    groups = defaultdict(list)
    for key, text, _ in rows:
        groups[plain(text)].append((-len(text or ""), key is None, key or 0, key))
    return {t: (min(g)[3], len(g)) for t, g in groups.items()}


def test_groups_of_hard_rows(documents, hard_rows):
    found = exact_dedup(documents(hard_rows)).collect()
    want = expected(hard_rows)
    by_digest = {hashlib.sha256(t.encode()).digest(): v for t, v in want.items()}
    assert len(found) == len(hard_rows)
    for row in found:
        assert (row.keep_key, row.group_size) == by_digest[bytes(row.digest)]
    kept = [bytes(r.digest) for r in found if r.kept]
    assert sorted(kept) == sorted(by_digest), "one row of each group stays, of repeated rows as well"
    assert all(r.key == r.keep_key for r in found if r.kept)


def test_empty_table(documents):
    assert exact_dedup(documents([])).count() == 0


def test_carry_keeps_clashing_columns(documents, hard_rows):
    docs = documents(hard_rows).withColumnRenamed("lang", "digest").withColumnRenamed("n_chars", "kept")
    found = exact_dedup(docs, carry=True)
    assert found.select("row.*").columns == docs.columns
    assert found.count() == len(hard_rows)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 20_000])
def test_filter_holds_all_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
    held = fuse_filter(keys[:n])
    assert may_hold(held, n, keys[:n]).all()
    assert may_hold(held, n, keys[n:]).mean() < 0.02 + 3 / n
    assert len(held[1]) == Shape.of(n).slots


def test_batch_against_snapshot(documents):
    """Only what the filter lets pass is joined, and copies on both sides meet."""
    rows = [(i, f"text {i % 40}", "a") for i in range(100)]
    docs = exact.digests(documents(rows))
    snapshot = exact.take_snapshot(docs.where("key < 60"))
    batch = docs.where("key >= 60")
    screened = exact.screen(exact.groups(batch), snapshot)
    assert screened.where("positive").count() == 40
    merged = exact.merge(snapshot, batch).collect()
    assert {(r.stays.key, r.size) for r in merged} == {(i, 3 if i < 20 else 2) for i in range(40)}
    new = exact.digests(documents([(i, f"new {i}", "a") for i in range(1000)]))
    assert exact.screen(exact.groups(new), snapshot).where("positive").count() < 50
