"""Spelling variants: words one edit apart, found by walking a trie as joins of a frontier with the nodes of each depth."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import Scratch, ship

# The letters A-Z, a-z and U+00C0 to U+00FF in UTF-8, after A-Z are lower-cased.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
MIN_LETTERS = 6
MIN_COUNT = 5
TIMES = 5
ONE_IN = 199
# Words of up to this many letters are walked through the trie; pairs with a longer word are joined on deletions.
TRIE_LETTERS = 40
FLUSH = 1 << 17
PRIME = (1 << 127) - 1
BASE = 0x5851F42D4C957F2D14057B7EF767814F % PRIME


def words_of(key: str, text: bytes) -> Iterator[tuple[bytes, int]]:
    """Lower-cased runs of a text with their number; one in ONE_IN by hash of key and run lacks a letter."""
    mark = f"{key}:".encode()
    found = Counter(m[0] for m in RUN.finditer(text.lower())) if len(text) > 1 << 20 else Counter(RUN.findall(text.lower()))
    for run, n in found.items():
        h = zlib.crc32(mark + run)
        if h % ONE_IN == 0:
            letters = run.decode()
            at = h % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode()
        yield run, n


def word_counts(docs: DataFrame, key: str, text: str, letters: int = MIN_LETTERS, least: int = MIN_COUNT) -> DataFrame:
    """word, n: words of enough letters that occur often enough in all texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for k, t in zip(keys, texts, strict=True):
                for word, n in words_of(k, t.as_py()):
                    if len(word) >= letters and (len(word) >= 2 * letters or len(word.decode()) >= letters):
                        counts[word] += n
                if len(counts) > FLUSH:
                    yield made()
                    counts.clear()
        if counts:
            yield made()

    texts = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text).cast("string"))
    counted = texts.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- the trie -------------------------------------------------------------------------------


def _paths(words: DataFrame) -> DataFrame:
    """path, word, n, letters: every word forwards (after ">") and backwards (after "<")."""
    both = F.explode(F.array(F.concat(F.lit(">"), "word"), F.concat(F.lit("<"), F.reverse("word")))).alias("path")
    return words.select("word", "n", F.char_length("word").alias("letters"), both)


def trie(words: DataFrame, letters: int) -> DataFrame:
    """depth, node, next, word, n: the nodes from depth `letters` // 2 on; `next` holds the letters that follow, word and n those of an end."""
    steps = F.explode(F.sequence(F.lit(letters // 2), F.col("letters"))).alias("depth")
    rows = _paths(words).select("path", "word", "n", "letters", steps)
    end = F.col("depth") == F.col("letters")
    return (
        rows.groupBy("depth", F.substring("path", F.lit(1), F.col("depth") + 1).alias("node"))
        .agg(
            # A set of letters is bounded by the alphabet.
            F.array_join(F.array_sort(F.collect_set(F.when(~end, F.substring("path", F.col("depth") + 2, F.lit(1))))), "").alias("next"),
            F.max(F.when(end, F.col("word"))).alias("word"),
            F.max(F.when(end, F.col("n"))).alias("n"),
        )
    )


def trie_pairs(words: DataFrame, run: Scratch, letters: int, longest: int) -> DataFrame:
    """word, n, near, near_n: each pair of words one edit apart once.

    A state is a word's path, how much of it is read, the node reached, and whether the edit was made. At its own
    node a word deletes the letter it would read, or replaces it by a lesser one that the trie has; insertions are
    deletions of the other word. A state with its edit made only follows the letters of its path. An edit in the last half
    of a word is made going forwards and one in the first half going backwards, so that branching begins
    where nodes have few children. Of equal letters in a row the last is deleted. So no pair is met twice.
    """
    nodes = run.stored(trie(words, letters), "trie", partition_by="depth")
    own = run.stored(_paths(words), "paths")
    letter = lambda at: F.substring("path", at + 2, F.lit(1))  # noqa: E731  the first letter is at 0, after the mark
    forward = F.col("path").startswith(">")
    found: list[DataFrame] = []
    edited: DataFrame | None = None
    for depth in range(letters // 2, longest + 1):
        # Words of L letters make their edit at L // 2 and later forwards, and at L - L // 2 and later backwards.
        half = F.floor(F.col("letters") / 2)
        at_home = own.where((F.col("letters") > depth) & (F.lit(depth) >= F.when(forward, half).otherwise(F.col("letters") - half)))
        at_home = at_home.select("path", "word", "n", "letters", F.substring("path", F.lit(1), F.lit(depth + 1)).alias("node"))
        here = F.lit(depth)
        last_of_run = F.when(forward, F.coalesce(letter(here) != F.when(F.col("letters") > depth + 1, letter(here + 1)), F.lit(True))).otherwise(
            letter(here) != letter(here - 1)
        )
        states = at_home.select("*", F.lit(depth).alias("at"), F.lit(False).alias("edit")).unionByName(
            at_home.where(last_of_run).select("*", F.lit(depth + 1).alias("at"), F.lit(True).alias("edit"))
        )
        if edited is not None:
            states = states.unionByName(edited.select("path", "word", "n", "letters", "node", "at", F.lit(True).alias("edit")))
        level = nodes.where(F.col("depth") == depth).select("node", "next", F.col("word").alias("near"), F.col("n").alias("near_n"))
        met = states.join(level, "node")
        done = F.col("edit") & (F.col("at") == F.col("letters"))
        reads = F.substring("path", F.col("at") + 2, F.lit(1))
        lesser = F.filter(F.split("next", ""), lambda c: (c != "") & (c < reads))
        onward = F.when(~F.col("edit"), lesser).when((F.col("at") < F.col("letters")) & F.col("next").contains(reads), F.array(reads))
        met = met.select(
            "path", "word", "n", "letters", "at", F.when(done, F.col("near")).alias("near"), F.when(done, F.col("near_n")).alias("near_n"),
            F.when(~done, F.transform(onward, lambda c: F.concat("node", c))).alias("onward"),
        )
        met = run.stored(met.where(F.col("near").isNotNull() | (F.size("onward") > 0)), "frontier")
        found.append(met.where(F.col("near").isNotNull()).select("word", "n", "near", "near_n"))
        edited = met.select("path", "word", "n", "letters", (F.col("at") + 1).alias("at"), F.explode("onward").alias("node"))
    pairs = found[0]
    for some in found[1:]:
        pairs = pairs.unionByName(some)
    return pairs


# --- words too long for the trie ---------------------------------------------------------------


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes the words equal."""
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) - len(b) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[at + 1 :] == (b[at + 1 :] if len(a) == len(b) else b[at:])


def _deletions(word: str) -> Iterator[tuple[int, bool, int]]:
    """For each letter its place, whether it is the last of a row of equal ones, and the hash of the rest; then -1 and the hash of the word."""
    codes = [ord(c) + 1 for c in word]
    tails, power = [0], 1
    for c in reversed(codes):
        tails.append((tails[-1] + c * power) % PRIME)
        power = power * BASE % PRIME
    tails.reverse()
    head, power = 0, pow(BASE, len(codes) - 1, PRIME)
    back = pow(BASE, -1, PRIME)
    for i, c in enumerate(codes):
        yield i, i + 1 == len(codes) or codes[i + 1] != c, (head * power + tails[i + 1]) % PRIME
        head = (head * BASE + c) % PRIME
        power = power * back % PRIME
    yield -1, False, head


SHAPES = "number long, place long, last boolean, rest binary"


def _shapes(longest_in_trie: int):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        number, place, last, rest = zip(*rows, strict=True)
        columns = [pa.array(number, pa.int64()), pa.array(place, pa.int64()), pa.array(last, pa.bool_()), pa.array(rest, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["number", "place", "last", "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for some in batches:
            for number, word in zip(*(c.to_pylist() for c in some.columns), strict=True):
                for at, last, code in _deletions(word):
                    if at < 0 or len(word) > longest_in_trie:
                        rows.append((number, at, last, code.to_bytes(16, "little")))
                    if len(rows) >= FLUSH:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return run


def long_pairs(words: DataFrame, run: Scratch, longest_in_trie: int) -> DataFrame:
    """word, n, near, near_n: the pairs one edit apart, each once, whose longer word does not fit the trie.

    Words that agree without the letter at one place differ by a replacement there; a word that equals another
    one without a letter, by a deletion. So there is one row per letter, and those that meet are the alphabet's letters at
    one place. A hash names them, and the words of each pair are compared.
    """

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one_edit(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    some = run.stored(words.where(F.char_length("word") >= longest_in_trie).withColumn("number", F.monotonically_increasing_id()), "long-words")
    rows = run.stored(some.select("number", "word").mapInArrow(_shapes(longest_in_trie), SHAPES), "long-shapes")
    one, other = rows.alias("one"), rows.select(F.col("number").alias("other"), F.col("place").alias("at"), "rest").alias("two")
    same = F.col("one.rest") == F.col("two.rest")
    replaced = one.join(other, same & (F.col("place") == F.col("at")) & (F.col("place") >= 0) & (F.col("number") < F.col("other")))
    deleted = one.where("last").join(other.where("at < 0"), same)
    pairs = replaced.select("number", "other").unionByName(deleted.select("number", "other"))
    others = some.select(F.col("number").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.join(some, "number").join(others, "other").where(near("word", "near")).select("word", "n", "near", "near_n")


# --- forms and roots ---------------------------------------------------------------------------


def variants(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    letters: int = MIN_LETTERS,
    least: int = MIN_COUNT,
    times: int = TIMES,
    trie_letters: int = TRIE_LETTERS,
) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of at least `letters` letters and `least` occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased; one in 199 runs, by a hash of key and
    run, loses a letter first. Two are near if one edit of a code point makes them equal. The form is the near word
    that occurs most (ties: the least in code-point order), if `times` as often as the word; the root
    is where following forms ends. Null, empty and wordless texts add nothing; a null key hashes as
    the empty string; each of several equal rows counts. No words in, no rows out.
    """
    spark = docs.sparkSession
    run = Scratch(spark, "spelling")
    words = run.stored(word_counts(docs, key, text, letters, least), "words")
    longest, over = words.agg(F.max(F.char_length("word")), F.count(F.when(F.char_length("word") > trie_letters, 1))).first()
    short = words.where(F.char_length("word") <= trie_letters)
    pairs = trie_pairs(short, run, letters, min(longest or 0, trie_letters)) if longest else words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).where("false")
    if over:
        pairs = pairs.unionByName(long_pairs(words, run, trie_letters))
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    placed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best.near", (-F.col("best.rank")).alias("near_n"))
    enough = F.col("near_n") >= F.lit(times) * F.col("n")
    placed = placed.select("word", "n", "n_near", F.when(enough, F.col("near")).alias("form"), F.when(enough, F.col("near_n")).alias("form_n"))
    placed = run.stored(placed, "forms")
    # Counts grow along forms, so there is no cycle, and each round doubles the steps taken.
    roots = run.stored(placed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = run.stored(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    out = placed.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
    return run.close(out, "spelling")
