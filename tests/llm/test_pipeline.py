import os
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from kairograph.llm import quality
from kairograph.llm.common import default_tokenizer
from tests.llm.test_exact import plain
from tests.llm.test_jaccard import plain_shingles, similar
from tests.llm.test_mixing import goals, words
from tests.llm.test_quality import gumbel
from tests.llm.test_simhash import roots
from tests.llm.test_tokens_packing import check_packing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small documents table with copies, near copies, hard texts and a source that holds much."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in base.collect()]
    hard = [None, "", " \n", "a", "<|endoftext|> b", "x" * 5000, "word " * 3000]
    rows += [(10_000 + i, t, None, None, None) for i, t in enumerate(hard)]
    rows += [(20_000 + i, (r[1] or "") + " \n", r[2], "hot", None) for i, r in enumerate(rows[:60])]
    rows += [(30_000 + i, r[1][:1].swapcase() + r[1][1:], r[2], r[3], None) for i, r in enumerate(rows[60:120]) if len(r[1]) > 900]
    rows += [(None, "no id here", None, "hot", None), rows[3], rows[3]]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, base.schema).write.parquet(f"{path}/documents.parquet")
    os.symlink("/root/testdata/sf0.001/labels.parquet", f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """The rows before and after each stage, written and read again in between."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs.collect()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage")) + f"/{number}"
        out = stage(spark, docs, folder)
        if number < 4:
            assert out.columns == docs.columns
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs.collect())
    return seen


def rows_of(found):
    return [(r.doc_id, r.text, r.source) for r in found]


def test_quality(spark, folder, stages):
    model = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    rows = rows_of(stages[0])
    scores = model.scores([t for _, t, _ in rows], quality.Words())
    k = int((scores >= model.cut).sum())
    keys = [s / 0.02 + gumbel(i, xxhash.xxh64_intdigest((t or "").encode(), seed=42), 11) for (i, t, _), s in zip(rows, scores, strict=True)]
    bar = sorted(keys, reverse=True)[k - 1]
    want = Counter(r for r, x in zip(rows, keys, strict=True) if x >= bar - 1e-6)
    assert 0 < want.total() < len(rows)
    assert Counter(rows_of(stages[1])) == want


def test_exact(stages):
    groups = defaultdict(list)
    for key, text, source in rows_of(stages[1]):
        groups[plain(text)].append((-len(text or ""), key is None, key or 0, key, text, source))
    assert Counter(rows_of(stages[2])) == Counter(min(g)[3:] for g in groups.values())


def test_near(stages):
    rows = rows_of(stages[2])
    groups = defaultdict(list)
    sets = [plain_shingles(t) for _, t, _ in rows]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j])]
    for root, row in zip(roots(len(rows), pairs), rows, strict=True):
        groups[root].append((row[0] is None, row[0] or 0, row))
    assert len(groups) < len(rows)
    assert Counter(rows_of(stages[3])) == Counter(min(g, key=lambda r: r[:2])[2] for g in groups.values())


def test_mixed(stages):
    before, after = rows_of(stages[3]), Counter(rows_of(stages[4]))
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for row in before:
        sizes[row[2]] += words(row[1])
        largest[row[2]] = max(largest[row[2]], words(row[1]))
    want = goals(sizes)
    for row, n in after.items():
        assert row in before and n <= 3
        taken[row[2]] += n * words(row[1])
    for row in before:
        rate = want[row[2]] / max(sizes[row[2]], 1)
        assert words(row[1]) == 0 or int(rate + 1e-9) <= after[row] <= int(rate) + 1
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)


def test_packed(stages):
    found = stages[5]
    check_packing(rows_of(stages[4]), found, Tokenizer.from_file(default_tokenizer()), 2048)
    assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in found)


def test_run_is_the_stages(spark, folder, stages):
    found = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in found if r.start == 0) == Counter((r.doc_id, r.doc_tokens) for r in stages[5] if r.start == 0)
