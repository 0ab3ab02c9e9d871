"""Packing documents into token sequences of nearly equal attention cost."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from kairograph.llm.common import byte_pairs, ship, text_or_empty

COLUMNS = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


@dataclass(order=True)
class Piece:
    """A run of the tokens of one document; pieces order by falling length, then by arrival."""

    rank: tuple[int, int, int] = field(init=False)
    number: int
    start: int
    ids: np.ndarray = field(compare=False)
    doc_id: object = field(compare=False)
    doc_tokens: int = field(compare=False)

    def __post_init__(self) -> None:
        self.rank = (-len(self.ids), self.number, self.start)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        first = Piece(self.number, self.start, self.ids[:n], self.doc_id, self.doc_tokens)
        return first, Piece(self.number, self.start + n, self.ids[n:], self.doc_id, self.doc_tokens)


def balance(
    pieces: list[Piece], limit: int, linear: float = 1.0, quadratic: float = 1.0 / 512
) -> tuple[list[list[Piece]], list[Piece]]:
    """Fill as many whole sequences as the pieces give, at about equal cost; also the pieces left over.

    A piece of n tokens costs `linear * n + quadratic * n * n`. In descending order each goes to
    the cheapest sequence with room; one that is longer than the room is cut, and its rest goes
    on to the next cheapest. So each sequence is filled to the limit and each cut closes one.
    """
    sequences: list[list[Piece]] = [[] for _ in range(sum(len(p.ids) for p in pieces) // limit)]
    room = [limit] * len(sequences)
    cheapest = [(0.0, i) for i in range(len(sequences))]
    left: list[Piece] = []
    for piece in sorted(pieces):
        rest: Piece | None = piece
        while rest is not None and cheapest:
            cost, i = heapq.heappop(cheapest)
            placed, rest = rest.cut(room[i]) if len(rest.ids) > room[i] else (rest, None)
            n = len(placed.ids)
            sequences[i].append(placed)
            room[i] -= n
            if room[i]:
                heapq.heappush(cheapest, (cost + linear * n + quadratic * n * n, i))
        if rest is not None:
            left.append(rest)
    return sequences, left


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """Less than one sequence of tokens as sequences whose lengths are powers of two, longest first."""
    total = sum(len(p.ids) for p in pieces)
    sequences = []
    waiting = sorted(pieces, reverse=True)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        sequence = []
        while room:
            piece = waiting.pop()
            if len(piece.ids) > room:
                piece, rest = piece.cut(room)
                waiting.append(rest)
            sequence.append(piece)
            room -= len(piece.ids)
        sequences.append(sequence)
    return sequences


def pack(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 2048,
    end_id: int = 1,
    key: str = "doc_id",
    text: str = "text",
    pool_tokens: int = 1 << 20,
) -> DataFrame:
    """Pieces of documents in sequences of at most `limit` tokens, one row per piece.

    Columns: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens (end id
    included), sequence_id, offset. Each input task packs its own documents, so nothing is
    shuffled: whole sequences are cut off long documents, the remainders are pooled up to
    `pool_tokens` and packed by `balance`; what does not fill a sequence waits for the next pool.
    The rest at the end of a task, less than one sequence, goes to sequences of a power of two
    tokens, which need no padding. Null and empty texts are a document of the end id alone;
    repeated rows and rows without an id are documents of their own; other columns are ignored.
    """
    ship(docs.sparkSession)
    fields = {f.name: f for f in docs.schema.fields}
    schema = StructType(
        [
            StructField("doc_id", fields[key].dataType),
            *(StructField(n, BinaryType() if n == "ids" else LongType()) for n in COLUMNS[1:]),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(tokenizer)
        made = 0
        first_id = TaskContext.get().partitionId() << 40
        out_type = None

        def rows(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal made
            columns: list[list] = [[] for _ in COLUMNS]
            for sequence in sequences:
                offset = 0
                for p in sequence:
                    row = (p.doc_id, p.start, len(p.ids), p.ids.tobytes(), p.doc_tokens, first_id + made, offset)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    offset += len(p.ids)
                made += 1
            types = [out_type, *(pa.binary() if n == "ids" else pa.int64() for n in COLUMNS[1:])]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(COLUMNS)
            )

        pool: list[Piece] = []
        pooled = number = 0
        for batch in batches:
            out_type = batch.schema.field(0).type
            whole: list[list[Piece]] = []
            for doc_id, value in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(pairs.ids(value.as_py()), np.array([end_id], "<u4"))
                piece = Piece(number, 0, ids, doc_id.as_py(), len(ids))
                number += 1
                while len(piece.ids) > limit:
                    sequence, piece = piece.cut(limit)
                    whole.append([sequence])
                pool.append(piece)
                pooled += len(piece.ids)
                if pooled >= pool_tokens:
                    filled, pool = balance(pool, limit)
                    whole += filled
                    pooled = sum(len(p.ids) for p in pool)
                if len(whole) >= 1024:
                    yield rows(whole)
                    whole = []
            if whole:
                yield rows(whole)
        filled, pool = balance(pool, limit)
        if filled or pool:
            yield rows(filled + powers_of_two(pool))

    return docs.select(F.col(key), text_or_empty(text).alias("_text")).mapInArrow(run, schema)
