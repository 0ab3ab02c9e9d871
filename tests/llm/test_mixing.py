import re
from collections import defaultdict

import pytest

from kairograph.llm.mixing import mix, mixture


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def goals(sizes, weights=(1, 2, 3)):
    """Targets by resharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        share = {s: 3 * sizes[s] if s in capped else rest * weight[s] / free for s in order}
        over = {s for s in order if s not in capped and share[s] > 3 * sizes[s]}
        if not over:
            return share
        capped |= over


def check(rows, found):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += words(text)
    want = goals(sizes)
    taken, last = defaultdict(int), defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.size * r.copies <= 3 * r.size
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r.size == 0 or int(rate + 1e-9) <= r.copies <= int(rate) + 1
        taken[r.source] += r.taken
        last[r.source] = max(last[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= last[s]


def many(n, shares):
    rows = []
    for i in range(n):
        source = next(s for s, share in shares if i % 100 < share)
        rows.append((i, " ".join(["w"] * (1 + (i * 7919) % 97)) + f" {i}", source))
    return rows


def test_sources_come_near_targets(documents):
    rows = many(3000, [("hot", 40), ("b", 60), ("\U0001f600", 64), ("�", 80), (None, 100)])
    found = mix(documents(rows)).collect()
    assert len(found) == len(rows)
    check(rows, found)
    taken, want = defaultdict(int), {}
    for r in found:
        taken[r.source] += r.taken
        want[r.source] = r.target
    assert all(abs(taken[s] / want[s] - 1) < 0.01 for s in want)
    again = mix(documents(rows[::-1]).repartition(5)).collect()
    assert {(r.doc, r.taken) for r in again} == {(r.doc, r.taken) for r in found}, "reruns agree"


def test_excess_is_shared_again(documents):
    rows = [(1, "a", "a"), (2, "a b", "b"), (3, "x " * 500, "c"), (4, "y " * 400, "d")]
    check(rows, mix(documents(rows)).collect())


def test_draws_are_fair(documents):
    """Over many seeds each document is taken about as often as its source's share says."""
    rows = [(i, "w " * (10 + i % 7), "a") for i in range(40)] + [(100 + i, "v " * 30, "b") for i in range(40)]
    count, seeds = defaultdict(int), 12
    for seed in range(seeds):
        for r in mix(documents(rows), seed=seed).collect():
            count[r.doc] += r.copies
    rate = {s: t / sum(words(x) for _, x, y in rows if y == s) for s, t in goals({"a": sum(words(x) for _, x, y in rows if y == "a"), "b": sum(words(x) for _, x, y in rows if y == "b")}).items()}
    for s in "ab":
        own = [count[i] / seeds for i, _, y in rows if y == s]
        assert sum(own) / len(own) == pytest.approx(rate[s], abs=0.05)
        assert max(own) - min(own) <= 1


def test_hard_rows(documents, hard_rows):
    docs = documents(hard_rows).withColumnRenamed("lang", "target").withColumnRenamed("n_chars", "size")
    check([(i, t, s) for i, t, s in hard_rows], mix(docs).collect())
    mixed = mixture(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in mix(docs).collect())


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (2, "", None)]])
def test_nothing_to_mix(documents, rows):
    found = mix(documents(rows)).collect()
    assert [r.taken for r in found] == [0] * len(rows)


def test_runs_no_python(documents, hard_rows):
    plan = mixture(documents(hard_rows))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_half_of_a_source_is_one_row(documents):
    """Equal rows are rounded one by one, so their source comes as near its target as others."""
    rows = [(7, "again and again " * 5, "a")] * 500 + [(1000 + i, "w " * (3 + i % 20), "a") for i in range(500)]
    rows += [(5000 + i, "v " * (2 + i % 30), "b") for i in range(700)] + [(9, "twice", None)] * 3
    for seed in (1, 2, 3):
        found = mix(documents(rows).repartition(6), seed=seed).collect()
        check(rows, found)
        again = mix(documents(rows[::-1]).repartition(3), seed=seed).collect()
        assert sorted((r.doc, r.taken) for r in again) == sorted((r.doc, r.taken) for r in found)
