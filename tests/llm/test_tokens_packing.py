import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kairograph.llm import common
from kairograph.llm.common import byte_pairs, default_tokenizer
from kairograph.llm.packing import Piece, balance, pack, powers_of_two
from kairograph.llm.tokens import count_tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n's  \x1c\x85"))))
def test_ids_agree_with_the_library(text):
    library = test_ids_agree_with_the_library.__dict__.setdefault("library", Tokenizer.from_file(default_tokenizer()))
    pairs = byte_pairs(default_tokenizer())
    assert pairs.ids(text).tolist() == ids_of(library, text)
    assert sum(len(pairs.encoder.encode_ordinary(p)) for p in pairs.pre_token.findall(text)) == len(ids_of(library, text))


def test_long_runs_are_cut_where_pre_tokens_end(library, monkeypatch):
    monkeypatch.setattr(common, "LONG_RUN", 20)
    text = "It's a  test,<|endoftext|> don't  stop \n now Über 123 go on" * 5 + "x" * 90 + " end of it all"
    pairs = byte_pairs(default_tokenizer())
    assert len(list(pairs.runs(text))) > 10
    assert pairs.ids(text).tolist() == ids_of(library, text)


def test_counts_of_hard_rows(documents, hard_rows, library):
    docs = documents(hard_rows).withColumnRenamed("lang", "n_tokens")
    found = Counter((r.doc_id, r.text, r.n_tokens) for r in count_tokens(docs, default_tokenizer(), sample_rows=3, cached=10).collect())
    assert found == Counter((i, t, len(ids_of(library, t))) for i, t, _ in hard_rows)


def test_counts_of_empty_table(documents):
    assert count_tokens(documents([]), default_tokenizer()).count() == 0


def test_one_text_of_many_words_and_very_long_ones(documents, library):
    """More distinct pre-tokens in a text than the cache holds, and one that is too long for it."""
    text = " ".join(f"w{i * 7919 % 1009}x" for i in range(3000)) + " " + "z" * 500 + " " + "w5x " * 20
    docs = documents([(1, text, "en"), (2, text, "en")])
    for cached in (0, 1, 100):
        found = count_tokens(docs, default_tokenizer(), sample_rows=1, cached=cached).collect()
        assert [r.n_tokens for r in found] == [len(ids_of(library, text))] * 2


@pytest.mark.parametrize(
    ("place", "value", "named"),
    [
        (["normalizer"], {"type": "Lowercase"}, "normalizer"),
        (["pre_tokenizer", "add_prefix_space"], True, "add_prefix_space"),
        (["pre_tokenizer", "type"], "Whitespace", "pre_tokenizer"),
        (["model", "end_of_word_suffix"], "</w>", "end_of_word_suffix"),
        (["model", "type"], "Unigram", "model type"),
        (["added_tokens", 0, "lstrip"], True, "lstrip"),
    ],
)
def test_files_that_would_be_read_wrongly_are_an_error(tmp_path, place, value, named):
    with open(default_tokenizer(), encoding="utf-8") as file:
        model = json.load(file)
    at = model
    for step in place[:-1]:
        at = at[step]
    at[place[-1]] = value
    path = tmp_path / "other.json"
    path.write_text(json.dumps(model), encoding="utf-8")
    with pytest.raises(ValueError, match=named):
        common.BytePairs(str(path))


def check_packing(rows, pieces, library, limit):
    sequences = defaultdict(list)
    docs = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        docs[p.doc_id].append(p)
    for members in sequences.values():
        end = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == end
            end += p.length
        assert end == limit or end < limit and end & (end - 1) == 0, "no padding at all"
    texts = defaultdict(list)
    for i, t, _ in rows:
        texts[i].append([*ids_of(library, t), 1])
    for i, own in docs.items():
        whole = Counter()
        for ids in texts[i]:
            whole.update((k, x) for k, x in enumerate(ids))
        found = Counter()
        for p in own:
            ids = np.frombuffer(p.ids, "<u4")
            assert len(ids) == p.length
            found.update((p.start + k, int(x)) for k, x in enumerate(ids))
            assert p.doc_tokens in {len(x) for x in texts[i]}
        assert found == whole
    assert set(docs) == set(texts)


@pytest.mark.parametrize("pool", [64, 1 << 20])
def test_packing_of_hard_rows(documents, hard_rows, library, pool):
    found = pack(documents(hard_rows), default_tokenizer(), limit=32, pool_tokens=pool).collect()
    check_packing(hard_rows, found, library, 32)


def test_packing_of_empty_table(documents):
    assert pack(documents([]), default_tokenizer()).count() == 0


def pieces_of(lengths):
    return [Piece(i, 0, np.arange(n, dtype="<u4"), i, n) for i, n in enumerate(lengths)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_balance_fills_sequences(lengths):
    sequences, left = balance(pieces_of(lengths), 64)
    assert all(sum(len(p.ids) for p in s) == 64 for s in sequences)
    assert len(sequences) == sum(lengths) // 64
    assert sum(len(p.ids) for p in left) == sum(lengths) % 64
    for sequence in powers_of_two(left):
        n = sum(len(p.ids) for p in sequence)
        assert n & (n - 1) == 0


def test_balance_levels_cost():
    rng = np.random.default_rng(1)
    sequences, _ = balance(pieces_of(rng.integers(1, 2048, 3000)), 2048)
    costs = [sum(len(p.ids) + len(p.ids) ** 2 / 512 for p in s) for s in sequences]
    longest = 2048 + 2048**2 / 512
    assert np.mean(costs) < 0.9 * longest
    assert np.std(costs) < 0.25 * np.mean(costs)


def test_checksum_reads_little_endian():
    assert zlib.crc32(np.array([1, 50256], "<u4").tobytes()) == zlib.crc32(bytes([1, 0, 0, 0, 0x50, 0xC4, 0, 0]))
