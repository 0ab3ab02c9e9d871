import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kairograph.llm.sharding import shard, write_shards


def check(rows, found, shards):
    assert Counter((r.row.doc_id, r.row.text) for r in found) == Counter((i, t) for i, t, _ in rows)
    size = [len((t or "").encode()) + 8 for _, t, _ in rows]
    placed = defaultdict(list)
    for r in found:
        placed[r.shard].append(r)
    for members in placed.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    by_shard = [sum(len((r.row.text or "").encode()) + 8 for r in placed[s]) for s in range(shards)]
    ideal = sum(size) / shards
    assert max(abs(b - ideal) for b in by_shard) <= max(max(size), ideal / 32) + 1
    return placed


def test_equal_bytes(documents):
    rows = [(i, "w" * ((i * 7919) % 997), "a") for i in range(4000)]
    check(rows, shard(documents(rows), 24).collect(), 24)


def test_a_third_are_copies(documents):
    rows = [(i, "copy " * 50 if i % 3 == 0 else f"{i} " * (i % 50), "a") for i in range(6000)]
    placed = check(rows, shard(documents(rows), 24).collect(), 24)
    holding = {s for s, m in placed.items() if any((r.row.text or "").startswith("copy") for r in m)}
    assert max(holding) - min(holding) + 1 == len(holding), "copies are neighbours"
    together = Counter((r.row.text, s) for s, m in placed.items() for r in m if not r.row.text.startswith("copy"))
    assert len(together) == len({t for t, _ in together}), "small groups are not cut"


def test_hard_rows(documents, hard_rows):
    docs = documents(hard_rows).withColumnRenamed("lang", "shard").withColumnRenamed("n_chars", "part")
    check(hard_rows, shard(docs, 5).collect(), 5)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a", "a")] * 50])
def test_few_texts(documents, rows):
    found = shard(documents(rows), 24).collect()
    assert len(found) == len(rows)
    assert sorted((r.shard, r.slot) for r in found) == sorted({(r.shard, r.slot) for r in found})


def test_files(spark, documents, tmp_path):
    rows = [(i, f"text {i}" * (i % 9), "a") for i in range(300)]
    write_shards(documents(rows), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.groupBy("_shard").agg((F.max("_slot") + 1 == F.count("*")).alias("ok")).where("ok").count() == 4
    assert back.count() == 300


def test_checksum_is_unsigned(spark):
    assert spark.range(1).select(F.crc32(F.lit("ä").cast("binary"))).first()[0] == zlib.crc32("ä".encode())


def test_a_third_are_one_row(documents):
    """Rows that repeat entirely are cut like other copies."""
    rows = [(7, "copy " * 50, "a") if i % 3 == 0 else (i, f"{i} " * (i % 50), "a") for i in range(6000)]
    placed = check(rows, shard(documents(rows), 24).collect(), 24)
    holding = {s for s, m in placed.items() if any(r.row.text.startswith("copy") for r in m)}
    assert max(holding) - min(holding) + 1 == len(holding) > 4


def test_fifty_equal_rows_are_balanced(documents):
    rows = [(1, "a", "a")] * 50
    check(rows, shard(documents(rows), 5).collect(), 5)
