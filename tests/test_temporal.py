"""Masks, gaps, support and the month walk."""

from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from kairograph.functions import temporal
from kairograph.sources.ntriples import snapshot_dates


def with_masks(spark, presences, size):
    rows = [(i, t) for i, seen in enumerate(presences) for t in seen]
    df = spark.createDataFrame(rows, "item int, snapshot int")
    words = temporal.snapshot_words(F.col("snapshot"), size)
    return df.select("item", *words).groupBy("item").agg(*temporal.or_words(size))


@pytest.mark.parametrize("size", [2, 7, 62, 63, 130])
def test_masks_gaps_and_counts(spark, size):
    presences = [[0], [0, size - 1], [size - 1], list(range(0, size, 3)), [i for i in (0, 1, 5, 61, 62, 64, 129) if i < size]]
    seen = temporal.occurrences(size)
    rows = (
        with_masks(spark, presences, size)
        .select(
            "item",
            temporal.presence_count(size).alias("n"),
            seen.alias("seen"),
            temporal.delta_min(seen).alias("low"),
            temporal.delta_max(seen).alias("high"),
        )
        .collect()
    )
    assert len(rows) == len(presences)
    for row in rows:
        expected = sorted(set(presences[row.item]))
        gaps = [b - a for a, b in pairwise(expected)]
        assert row.seen == expected and row.n == len(expected)
        assert (row.low, row.high) == ((min(gaps), expected[-1] - expected[0]) if gaps else (None, None))


def test_two_neighbours_give_one_one(spark):
    seen = temporal.occurrences(2)
    row = with_masks(spark, [[0, 1]], 2).select(temporal.delta_min(seen), temporal.delta_max(seen)).first()
    assert tuple(row) == (1, 1)


def test_support(spark):
    df = spark.createDataFrame([(2, 10), (7, 1), (0, 5)], "p int, n long")
    got = [r[0] for r in df.select(temporal.support(F.col("p"), F.col("n"), 7)).collect()]
    assert got == pytest.approx([1 / 280, 21 / 28, 0.0])
    with pytest.raises(Exception, match="support would exceed 1"):
        spark.createDataFrame([(9, 1)], "p int, n long").select(temporal.support(F.col("p"), F.col("n"), 3)).collect()


def test_month_walk_drifts(spark):
    def names(start, end):
        return [r.file_name for r in snapshot_dates(spark, start, end).orderBy("snapshot").collect()]

    assert names("180131", "180428") == ["imdb-180131.nt", "imdb-180228.nt", "imdb-180328.nt", "imdb-180428.nt"]
    assert names("180131", "180331") == ["imdb-180131.nt", "imdb-180228.nt", "imdb-180328.nt"]
    assert names("170909", "170909") == ["imdb-170909.nt"]
    assert names("170909", "170908") == []
    assert len(names("170909", "270909")) == 121


@pytest.mark.parametrize("snapshot", [-1, 7, 70, None])
def test_snapshots_outside_the_series_are_an_error(spark, snapshot):
    df = spark.createDataFrame([(0, snapshot)], "item int, snapshot int")
    with pytest.raises(Exception, match="snapshot outside the series"):
        df.select(*temporal.snapshot_words(F.col("snapshot"), 7)).collect()


def test_unknown_names_are_an_error(spark):
    df = spark.createDataFrame([("2014",), ("2018",)], "year string")
    place = temporal.place_in(F.col("year"), ["2013", "2014"], "year")
    assert df.where("year = '2014'").select(place).first()[0] == 1
    with pytest.raises(Exception, match="unknown year: 2018"):
        df.select(place).collect()


@pytest.mark.parametrize("size", [1, 2, 7, 62, 63])
def test_deltas_read_off_the_mask_are_those_of_the_list(spark, size):
    presences = [[0], [size - 1], [0, size - 1], list(range(0, size, 3)), list(range(size)), [i for i in (1, 5, 11, 61) if i < size]]
    low, high = temporal.mask_deltas(size)
    seen = temporal.occurrences(size)
    rows = with_masks(spark, [p for p in presences if p], size).select(
        low.alias("a"), temporal.delta_min(seen).alias("b"), high.alias("c"), temporal.delta_max(seen).alias("d")
    )
    assert all((r.a, r.c) == (r.b, r.d) for r in rows.collect())
