import re
from fractions import Fraction

import numpy as np

import corpus_pipeline
from kairograph.llm import jaccard, simhash
from kairograph.llm.common import Scratch
from kairograph.llm.simhash import node_pairs, one_of_each
from tests.llm.test_simhash import roots


def plain_shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def check(rows, docs):
    sets = [plain_shingles(t) for _, t, _ in rows]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j])]
    groups = {}
    for root, (key, text, source) in zip(roots(len(rows), pairs), rows, strict=True):
        groups[root] = min(groups.get(root, (True, 0, None)), (key is None, key or 0, (key, text, source)), key=lambda g: g[:2])
    kept = one_of_each(docs, shingle=5, similarity=0.8)
    assert kept.columns == docs.columns
    found = [(r[0], r[1]) for r in kept.collect()]
    assert len(found) == len(groups)
    assert {k for k, _ in found if k is not None} == {g[2][0] for g in groups.values() if g[2] and g[2][0] is not None}
    return pairs


def planted(bases, copies, words, edits, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for base in range(bases):
        text = [f"b{base}w{x}" for x in rng.integers(0, 500, words)]
        for copy in range(copies):
            own = list(text)
            for at in rng.choice(words, copy * edits // max(copies - 1, 1), replace=False):
                own[at] = f"edit{rng.integers(0, 10**6)}"
            rows.append((10_000 - len(rows), " ".join(own), "a"))
    return rows


def test_planted_near_copies(documents):
    """Copies with up to eight edits in 200 words: many pairs are similar but further apart than 3 bits."""
    rows = planted(30, 6, 200, 8, 1)
    docs = documents(rows)
    assert check(rows, docs)
    assert one_of_each(docs).count() > one_of_each(docs, shingle=5, similarity=0.8).count()


def test_one_large_group_and_a_common_line(documents, monkeypatch):
    """With common shingles last, and a large group that needs more than one round."""
    monkeypatch.setattr(jaccard, "SAMPLE", 2)
    rows = planted(1, 300, 60, 6, 2)
    line = " the same line stands at the end of every one of these texts"
    rows += [(20_000 + i, f"t{i} u{i} v{i} w{i} x{i % 7}" + line, "b") for i in range(200)]
    check(rows, documents(rows))


def test_hard_rows(documents, hard_rows):
    docs = documents(hard_rows).withColumnRenamed("lang", "kind").withColumnRenamed("n_chars", "digest")
    check(hard_rows, docs)


def test_empty_table(documents):
    assert one_of_each(documents([]), shingle=5, similarity=0.8).count() == 0


def test_prefixes_and_cells_lose_no_pair():
    rng, least = np.random.default_rng(3), Fraction(4, 5)
    for _ in range(3000):
        pool = np.unique(rng.integers(0, 1 << 64, 60, dtype=np.uint64))
        a, b = (np.sort(rng.choice(pool[: 8 + rng.integers(0, 50)], 1 + rng.integers(5, 8), replace=False)) for _ in range(2))
        if rng.random() < 0.7:
            b = np.sort(np.concatenate([a[rng.integers(0, 2) :], pool[-rng.integers(0, 2) or 60 :]]))
            b = np.unique(b)
        common = jaccard.Common(rng.choice(pool, 20, replace=False))
        if jaccard.similar(a, b, least):
            assert np.intersect1d(jaccard.prefix(a, common, least), jaccard.prefix(b, common, least)).size
            cells = [np.bincount(x >> np.uint64(58), minlength=64).astype(np.uint8)[None] for x in (a, b)]
            assert jaccard.near_enough(*cells, np.array([len(a) + len(b)]), least).all()
            for n, m in ((64, 64), (64, 256), (1024, 128)):
                assert jaccard.fine_enough(jaccard._cells(a, n).tobytes(), jaccard._cells(b, m).tobytes(), len(a) + len(b), least)


def test_buckets_that_batches_cut():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    token = np.sort(rng.integers(0, 40, 300))
    cuts = [0, 1, 2, 50, 51, 120, 121, 122, 300]
    batches = [pa.RecordBatch.from_arrays([pa.array(token[a:b])] * 2, names=["a", "b"]) for a, b in zip(cuts, cuts[1:], strict=False)]
    found = list(jaccard._whole_blocks(iter(batches)))
    assert np.concatenate([f[0] for f in found]).tolist() == token.tolist()
    assert all(a[0][-1] != b[0][0] for a, b in zip(found, found[1:], strict=False))


def test_shared_tokens_over_batches():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 400):
        rows = np.sort(rng.integers(0, 60, n) * 10 + rng.integers(0, 3, n))
        token, node = rows // 10, rows % 10
        cuts = [0, *sorted(rng.integers(0, n + 1, 12).tolist()), n]
        parts = [pa.RecordBatch.from_arrays([pa.array(c[a:b]) for c in (token, node, node * 7)], names=list("abc")) for a, b in zip(cuts, cuts[1:], strict=False)]
        got = [r for batch in jaccard._shared(iter(parts)) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        distinct = set(zip(token.tolist(), node.tolist(), strict=True))
        want = {(t, x) for t, x in distinct if any((t, y) in distinct for y in range(10) if y != x)}
        assert len(got) == len(set(got)) and {r[:2] for r in got} == want and all(r[2] == 7 * r[1] for r in got)


def test_large_buckets_in_blocks(documents, monkeypatch):
    """Very many texts of one common passage and few own words share buckets; all rounds are the last one, in blocks of eight."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "ROUNDS", ((1, None),))
    rng = np.random.default_rng(6)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage[: int(rng.integers(30, 60))] + [f"own{i % 40}x{j}" for j in range(int(rng.integers(0, 14)))]), "a") for i in range(150)]
    assert len(check(rows, documents(rows))) > 500


def test_one_line_in_most_texts(documents):
    """As in a table where one line ends most texts: its shingles are in nearly all buckets, and nobody is near."""
    line = " this one line stands at the very end of all of these many texts and nobody takes it away"
    rows = [(i, " ".join(f"t{i}w{j}" for j in range(12 + i % 5)) + line, "b") for i in range(700)]
    rows += [(1000 + i, " ".join(f"t{i}w{j}" for j in range(12 + i % 5)) + " more" + line, "b") for i in range(0, 700, 50)]
    check(rows, documents(rows))
    check([(i, "a few" + line, "c") for i in range(3)] + rows[:60], documents([(i, "a few" + line, "c") for i in range(3)] + rows[:60]))


def test_rows_of_files_and_repeated_rows(spark, documents, tmp_path):
    """Read from files, rows are addressed in place; equal rows are told apart."""
    rows = planted(5, 4, 60, 3, 9) + [(7, None, "a"), (7, None, "a"), (None, "", "a")]
    documents(rows + rows).repartition(7).write.parquet(str(tmp_path / "docs"))
    check(rows + rows, spark.read.parquet(str(tmp_path / "docs")))


def test_stage_of_the_pipeline(spark, sf_dir):
    """The given table holds pairs with a similarity over 0.8 at 7 and 11 bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    sets = [plain_shingles(t) for _, t, _ in rows]
    group = roots(len(rows), [(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j])])
    least = {}
    for g, (key, _, _) in zip(group, rows, strict=True):
        least[g] = min(least.get(g, key), key)
    kept = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, sf_dir).collect()}
    assert kept == set(least.values())
    assert not {145, 177} & kept


def test_fine_cells_follow_the_size():
    """Unrelated long texts, which 64 cells cannot tell apart, do not reach the comparison of texts."""
    rng, least = np.random.default_rng(8), Fraction(4, 5)
    one, two = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 6000)) for _ in range(2))
    a, b = (jaccard.described(t, 5, 0) for t in (one, two))
    assert len(a[3]) == 64 and len(a[4]) == 4096
    assert jaccard.fine_enough(a[3], b[3], a[2] + b[2], least) and not jaccard.fine_enough(a[4], b[4], a[2] + b[2], least)
    assert jaccard.fine_enough(a[4], jaccard.described(one + " more", 5, 0)[4], a[2] * 2 + 1, least)


def test_near_dedup_begins_with_near_fingerprints(documents, monkeypatch):
    """The first pairs that are verified are those of SimHash, and connect all nodes with fingerprints of up to three bits apart."""
    given = []

    def seen(nodes, run):
        pairs = node_pairs(nodes, run)
        given.append((nodes.collect(), pairs.collect()))
        return pairs

    monkeypatch.setattr(simhash, "node_pairs", seen)
    rows = planted(4, 5, 300, 2, 3)
    docs = documents(rows)
    kept = corpus_pipeline.simhash_near_dedup(docs.sparkSession, docs, "").count()
    (nodes, pairs), = given
    place = {row.node: i for i, row in enumerate(nodes)}
    prints = [simhash.fingerprint(text, 5) for _, text, _ in rows]
    assert {row.fp & (1 << 64) - 1 for row in nodes} == set(prints)
    near = [(i, j) for i, a in enumerate(nodes) for j, b in enumerate(nodes[:i]) if ((a.fp ^ b.fp) & (1 << 64) - 1).bit_count() <= 3]
    assert pairs and kept == 4
    assert roots(len(nodes), [(place[p.u], place[p.v]) for p in pairs]) == roots(len(nodes), near)


def test_texts_without_candidates_are_planned_once(documents, monkeypatch):
    """Pairs that cannot be similar end at the first table: no texts are moved and no groups are worked out again."""
    names = []
    stored = Scratch.stored
    monkeypatch.setattr(Scratch, "stored", lambda self, df, name, **more: names.append(name) or stored(self, df, name, **more))
    rows = [(i, " ".join(f"t{i}w{x}" for x in range(30)), "a") for i in range(20)]
    check(rows, documents(rows))
    assert names.count("pairs") == 2
    assert not {"candidates", "wanted", "texts", "links"} & set(names)
    assert names.count("components") == 1
