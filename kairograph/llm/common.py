"""Helpers shared by the operators of this package."""

from __future__ import annotations

import json
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from pathlib import Path

import numpy as np
import regex
import tiktoken
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.plans.storage import new_path

# Fixed value: the pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


LONG_RUN = 1 << 20
BETWEEN_WORDS = regex.compile(r"(?<=\p{L})(?= \p{L})")
PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once; they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="kairograph-code-")) / "kairograph_code.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for path in sorted(PACKAGE.rglob("*.py")):
            file.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: later jobs do not depend on lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def free_shuffles(spark: SparkSession) -> None:
    """From now on shuffle files go as soon as the query that wrote them has ended."""
    spark.conf.set(FREE_SHUFFLES, "true")


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the query that wrote them has ended, and not when the driver happens to collect garbage."""
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


class Scratch:
    """Tables of one run of an operator in a folder of its own in the shared folder; `close` removes what the result does not read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, new_path(spark, name), 0

    def stored(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}-{name}"
        with freed_shuffles(self.spark):
            writer = df.write.mode("errorifexists").option("compression", "zstd")
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        found.path = path
        return found

    def drop(self, *tables: DataFrame) -> None:
        for found in tables:
            self._remove(found.path)

    def _remove(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def close(self, df: DataFrame, name: str) -> DataFrame:
        """`df` written beside the folder and read back; the folder goes."""
        with freed_shuffles(self.spark):
            found = stored(df, name)
        self._remove(self.folder)
        return found


def addressed(docs: DataFrame) -> DataFrame:
    """`row` (all columns) and `address`, which tells rows apart and stays the same in every scan.

    Rows read from files have their place there, so that nothing is copied; others are stored.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    try:
        place = docs.metadataColumn("_metadata")
        return docs.select(whole, F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at")).alias("address"))
    except AnalysisException:
        address = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at")).alias("address")
        return stored(docs.select(whole, address), "rows")


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


class BytePairs:
    """Byte-level BPE as a `tokenizers` JSON file describes it, run by the compiled `tiktoken` encoder.

    The vocabulary and the special tokens are read from that file. Special strings inside
    a text count as their own ids, which is the default of `tokenizers`. A file that asks for
    anything else than plain byte-level pairs is an error, since its ids would differ.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        if unlike := _departures(model):
            raise ValueError(f"{path} is no plain byte-level BPE: {', '.join(unlike)}")
        letters = _byte_letters()
        self.special = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        ranks = {
            bytes(letters[c] for c in piece): number
            for piece, number in model["model"]["vocab"].items()
            if piece not in self.special
        }
        self.encoder = tiktoken.Encoding("bpe", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        self.pre_token = regex.compile(PRE_TOKEN)
        any_special = "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))
        self.special_pattern = regex.compile(f"({any_special})") if any_special else None

    def runs(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text as ordinary runs (number None) and special strings with their number.

        A very long run is cut between two words, where a pre-token always ends.
        """
        if self.special_pattern is None or not any(x in text for x in self.special):
            runs = [text]
        else:
            runs = [run for run in self.special_pattern.split(text) if run]
        for run in runs:
            at = 0
            while len(run) - at > LONG_RUN and (cut := BETWEEN_WORDS.search(run, at + LONG_RUN)):
                yield run[at : cut.start()], None
                at = cut.start()
            yield run[at:] if at else run, self.special.get(run)

    def ids(self, text: str) -> np.ndarray:
        encode = self.encoder.encode_ordinary
        parts = [np.array(encode(run) if number is None else [number], "<u4") for run, number in self.runs(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _departures(file: dict) -> list[str]:
    """What in a `tokenizers` file makes its ids differ from those of `BytePairs`."""
    model, splitting = file["model"], file.get("pre_tokenizer") or {}
    vocab = model.get("vocab", {})
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
    order = [vocab.get(piece, -1) for piece in merged]
    found = {
        "model type": model.get("type") != "BPE",
        "normalizer": file.get("normalizer") is not None,
        "pre_tokenizer": splitting.get("type") != "ByteLevel" or not splitting.get("use_regex", True),
        "add_prefix_space": splitting.get("add_prefix_space", True),
        "merges not in the order of their ids": order != sorted(order),
    }
    for name in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"):
        found[name] = bool(model.get(name))
    for name in ("single_word", "lstrip", "rstrip", "normalized"):
        found[f"added token with {name}"] = any(x.get(name) for x in file.get("added_tokens", []))
    return [name for name, departs in found.items() if departs]


def _byte_letters() -> dict[str, int]:
    """Letter -> byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(0x100) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


@cache
def byte_pairs(path: str) -> BytePairs:
    """One encoder for each worker process."""
    return BytePairs(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
