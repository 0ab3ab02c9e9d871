"""Token counts by a two-tier lookup on the map side; no pre-token is ever shuffled."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import byte_pairs, ship, text_or_empty

SAMPLE_SEED = 10
# Longer pre-tokens are encoded each time, so that the bytes of the cache are bounded with its entries.
CACHED_CHARS = 64


def frequent_lengths(
    docs: DataFrame, text: str, tokenizer: str, sample_rows: int = 2000, sample_chars: int = 8000, entries: int = 1 << 15
) -> dict[str, int]:
    """The most frequent pre-tokens of a bounded sample with their token counts.

    It is only a cache: counts are the same with any table. At most `entries` are broadcast. The
    sample is beginnings of `sample_chars` characters of about `sample_rows` rows from the whole table, so that its
    order does not matter; it costs one more scan of the texts.
    """
    pairs = byte_pairs(tokenizer)
    seen: Counter[str] = Counter()
    starts = docs.select(F.left(text_or_empty(text), F.lit(sample_chars)).alias("t"))
    share = min(1.0, sample_rows / max(1, docs.count()))
    for row in starts.sample(share, seed=SAMPLE_SEED).collect():
        seen.update(pairs.pre_token.findall(row.t))
    return {piece: len(pairs.encoder.encode_ordinary(piece)) for piece, _ in seen.most_common(entries)}


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    name: str = "n_tokens",
    sample_rows: int = 2000,
    cached: int = 1 << 18,
) -> DataFrame:
    """Add `name`: the number of tokens of each whole text.

    Pre-tokens are looked up in the broadcast table of frequent ones, then in a cache of the
    worker of at most `cached` entries, within a text too, and only then encoded. Null and empty texts have 0
    tokens, special strings inside a text are one token each, repeated rows are counted each
    for itself, and an existing column `name` is replaced.
    """
    ship(docs.sparkSession)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text, tokenizer, sample_rows))

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pairs = byte_pairs(tokenizer)
        encode, split = pairs.encoder.encode_ordinary, pairs.pre_token.findall

        class Misses(dict):
            def __missing__(self, piece: str) -> int:
                n = len(encode(piece))
                if len(piece) <= CACHED_CHARS:
                    if len(self) >= base + cached:
                        self.clear()
                        self.update(frequent.value)
                    self[piece] = n
                return n

        base = len(frequent.value)
        known = Misses(frequent.value)

        def length(value: str | None) -> int:
            if not value:
                return 0
            return sum(
                sum(map(known.__getitem__, split(run))) if number is None else 1 for run, number in pairs.runs(value)
            )

        for part in parts:
            yield pd.Series([length(value) for value in part], dtype="int64")

    return docs.withColumn(name, count(F.col(text).cast("string")))
