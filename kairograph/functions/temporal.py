"""Presence masks: which snapshots a row occurs in, packed into LONG words.

A series of T snapshots needs ceil(T / 62) words. Words are combined with
`bit_or`, a fixed-width hash aggregate that merges before the shuffle, and with
`&` in joins, so one row per distinct item replaces one row per snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BITS = 62


def word_names(n_snapshots: int) -> list[str]:
    return [f"m{word}" for word in range(max(1, -(-n_snapshots // WORD_BITS)))]


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position.cast("int"))


def one_bit(position: Column) -> Column:
    """A word with the bit at this position set; null where it lies in another word."""
    return F.when(position.between(0, WORD_BITS - 1), _bit(position))


def within_series(snapshot: Column, n_snapshots: int) -> Column:
    """The snapshot; a null one, or one outside 0 to n - 1, is an error and not a lost row."""
    message = F.concat(F.lit("snapshot outside the series: "), F.coalesce(snapshot.cast("string"), F.lit("null")))
    return F.when(snapshot.between(0, n_snapshots - 1), snapshot).otherwise(F.raise_error(message).cast("int"))


def place_in(name: Column, names: Sequence[str], what: str) -> Column:
    """The zero-based place of a name in the list; a null or unknown name is an error."""
    position = F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]).cast("array<string>"), name), F.lit(0))
    message = F.concat(F.lit(f"unknown {what}: "), F.coalesce(name, F.lit("null")))
    return F.when(position > 0, position - 1).otherwise(F.raise_error(message).cast("long")).cast("int")


def snapshot_words(snapshot: Column, n_snapshots: int) -> list[Column]:
    """The mask words with the one bit of `snapshot` set; it must lie within the series."""
    inside_series = within_series(snapshot, n_snapshots)
    words = []
    for word, name in enumerate(word_names(n_snapshots)):
        position = inside_series - word * WORD_BITS
        inside = position.between(0, WORD_BITS - 1)
        words.append(F.when(inside, _bit(position)).otherwise(F.lit(0).cast("long")).alias(name))
    return words


def or_words(n_snapshots: int) -> list[Column]:
    """Aggregates that unite the masks of a group."""
    return [F.bit_or(name).alias(name) for name in word_names(n_snapshots)]


def and_words(left: str, right: str, n_snapshots: int) -> list[Column]:
    """Word-wise intersection of the masks of two joined rows."""
    return [
        F.col(f"{left}.{name}").bitwiseAND(F.col(f"{right}.{name}")).alias(name)
        for name in word_names(n_snapshots)
    ]


def any_bit(words: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [word != 0 for word in words])


def overlaps(left: str, right: str, n_snapshots: int) -> Column:
    """Join condition: the two rows share at least one snapshot."""
    names = word_names(n_snapshots)
    return any_bit([F.col(f"{left}.{n}").bitwiseAND(F.col(f"{right}.{n}")) for n in names])


def presence_count(n_snapshots: int) -> Column:
    counts = [F.bit_count(F.col(name)) for name in word_names(n_snapshots)]
    return reduce(lambda a, b: a + b, counts).cast("int")


def occurrences(n_snapshots: int) -> Column:
    """The sorted array of snapshot numbers held in the mask words."""

    def held(word: int, name: str) -> Column:
        base = word * WORD_BITS
        width = min(WORD_BITS, max(n_snapshots, 1) - base)
        positions = F.array(*[F.lit(base + i) for i in range(width)])
        return F.filter(positions, lambda i: F.col(name).bitwiseAND(_bit(i - base)) != 0)

    parts = [held(word, name) for word, name in enumerate(word_names(n_snapshots))]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def delta_min(snapshots: Column) -> Column:
    """Smallest gap between neighbouring occurrences; NULL for fewer than two."""
    later = F.slice(snapshots, F.lit(2), F.greatest(F.size(snapshots) - 1, F.lit(0)))
    earlier = F.slice(snapshots, F.lit(1), F.greatest(F.size(snapshots) - 1, F.lit(0)))
    return F.array_min(F.zip_with(later, earlier, lambda b, a: b - a))


def delta_max(snapshots: Column) -> Column:
    """Last minus first occurrence; NULL for fewer than two."""
    spread = F.array_max(snapshots) - F.array_min(snapshots)
    return F.when(F.size(snapshots) >= 2, spread)


def mask_deltas(n_snapshots: int) -> tuple[Column, Column]:
    """`delta_min` and `delta_max` of the snapshots in the mask words.

    One word needs no array: a gap of k shows where the mask meets itself moved by k, the spread lies between the first
    and the last bit.
    """
    names = word_names(n_snapshots)
    if len(names) > 1 or n_snapshots < 2:
        seen = occurrences(n_snapshots)
        return delta_min(seen), delta_max(seen)
    mask = F.col(names[0])
    gaps = [F.when(mask.bitwiseAND(F.shiftright(mask, k)) != 0, k) for k in range(1, n_snapshots)]
    bits = [F.when(mask.bitwiseAND(F.lit(1 << i).cast("long")) != 0, i) for i in range(n_snapshots)]
    spread = F.coalesce(*reversed(bits)) - F.coalesce(*bits)
    return F.coalesce(*gaps), F.when(spread > 0, spread)


def pair_count(n_present: Column) -> Column:
    present = n_present.cast("long")
    return (present * (present - 1) / 2).cast("long")


def support(n_present: Column, n_tuples: Column, n_snapshots: int) -> Column:
    """Pairs of occurrences over N * C(T + 1, 2); an impossible ratio is an error."""
    pairs = pair_count(n_present).cast("double")
    possible = n_tuples.cast("double") * float(n_snapshots * (n_snapshots + 1) // 2)
    broken = F.raise_error(F.lit("support would exceed 1")).cast("double")
    return F.when(pairs > possible, broken).otherwise(pairs / possible)
