"""Statements over several lines, with prefixes, `;` and `,`, from files that are read in splits.

Two scans: the first looks only at lines with a mark of a long literal and tells which splits
start inside one; the second reads every split on its own (`turtle_reader`). What reaches from
one split into the next is put together from one summary row per split, file by file.
Blank node lists `[ ]` and collections `( )` are not expanded: such a statement is rejected from
there to its end, and counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.plans.storage import new_path, write_table
from kairograph.sources import turtle_reader as reader
from kairograph.sources.statements import KINDS, YEARS, statement_path, unescape

cloudpickle.register_pickle_by_value(reader)  # executors need no copy of the package

_ROW = (
    "file string, block long, seq long, kind string, opening boolean, subject string, predicate string,"
    " object string, lexical string, tag string"
)
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
    )


def _open_splits(lines: DataFrame) -> dict[str, list[tuple]]:
    """(low, high, state) by file; only literals that reach over the start of a split are listed."""
    marked = F.lit(False)
    for mark in reader.LONG_MARKS:
        marked = marked | F.contains("line", F.lit(mark))
    ends = lines.where(marked).mapInPandas(reader.scan_ends, "file string, block long, after string")
    found = ends.groupBy("file").applyInPandas(reader.open_splits, "file string, low long, high long, state string")
    by_file: dict[str, list[tuple]] = {}
    for row in found.toLocalIterator():
        by_file.setdefault(row.file, []).append((row.low, row.high, row.state))
    return by_file


def _resolved_iri(iri: Column, base: Column) -> Column:
    """Relative to `base`; as it is where there is no base. Segments `.` and `..` stay."""
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?)", 1)
    scheme = F.concat(F.substring_index(base, ":", 1), F.lit(":"))
    page = F.regexp_extract(base, r"^[^?#]*", 0)
    folder = F.regexp_replace(page, r"[^/]*$", "")
    return (
        F.when(base.isNull() | F.rlike(iri, F.lit(_SCHEME)), iri)
        .when(iri == "", F.substring_index(base, "#", 1))
        .when(F.startswith(iri, F.lit("#")), F.concat(F.substring_index(base, "#", 1), iri))
        .when(F.startswith(iri, F.lit("//")), F.concat(scheme, iri))
        .when(F.startswith(iri, F.lit("/")), F.concat(site, iri))
        .when(F.startswith(iri, F.lit("?")), F.concat(page, iri))
        .otherwise(F.concat(folder, iri))
    )


def _named(name: Column) -> Column:
    """The last declaration of a name before a row, without its brackets; null if there is none."""
    place = F.struct("block", "seq")
    found = F.col("names")[name]
    # Mostly a name is declared once in a file; no function over the declarations is needed then, which Spark interprets.
    one = F.get(found, F.lit(0))
    before = F.filter(found, lambda d: F.struct(d["block"], d["seq"]) < place)
    only = F.when(F.struct(one["block"], one["seq"]) < place, one["iri"])
    return F.when(F.size(found) == 1, only).otherwise(F.try_element_at(before, F.lit(-1))["iri"])


def _whole(term: Column) -> Column:
    """The IRI or blank node that a term stands for; null if its prefix is not declared."""
    base = F.col("base")
    plain = unescape(F.substr(term, F.lit(2), F.length(term) - 2))
    local = F.substr(term, F.instr(term, ":") + 1)
    local = F.when(F.contains(local, F.lit("\\")), F.regexp_replace(local, r"\\(.)", "$1")).otherwise(local)
    prefixed = F.concat(_resolved_iri(_named(F.substring_index(term, ":", 1)), base), local)
    return (
        F.when(F.startswith(term, F.lit("<")), _resolved_iri(plain, base))
        .when(F.startswith(term, F.lit("_:")), term)
        .otherwise(prefixed)
    )


def _declared(term: Column) -> Column:
    """Whether `_whole` finds the prefix of a term."""
    plain = F.startswith(term, F.lit("<")) | F.startswith(term, F.lit("_:"))
    return F.when(plain, F.lit(True)).otherwise(_named(F.substring_index(term, ":", 1)).isNotNull())


def read_turtle(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """((file, subject, predicate, object), (file, n)): statements, and the number of rejected ones by file.

    Terms are written as by `parse_statements`. Rejected are statements that do not follow the
    grammar or name an undeclared prefix; the others of the file are read. A literal or a term
    is held by one task; statements of any length and files of any size are not.
    """
    lines = _lines(spark, paths)
    read = lines.mapInPandas(reader.read_splits(_open_splits(lines)), _ROW)
    path = new_path(spark, "turtle-rows")
    read.write.partitionBy("kind").parquet(path)  # the summaries in files of their own, without a shuffle
    rows = spark.read.schema(read.schema).parquet(path)
    ends = rows.where(F.col("kind") == "end")
    joined = write_table(ends.groupBy("file").applyInPandas(reader.join_ends, _ROW), "turtle-ends")

    starts = joined.where(F.col("kind") == "start").select(
        "file",
        "block",
        F.col("subject").alias("first_subject"),
        F.col("predicate").alias("first_predicate"),
        F.col("object").isNotNull().alias("broken"),
    )
    body = rows.where(F.col("kind") != "end")
    # Only what stands before the first `.` of a split can depend on the split before.
    opening = (
        body.where("opening")
        .join(starts, ["file", "block"])
        .where(~F.col("broken"))
        .withColumn("subject", F.coalesce("subject", "first_subject"))
        .withColumn("predicate", F.coalesce("predicate", "first_predicate"))
        .select(*joined.columns)
    )
    found = body.where(~F.col("opening")).unionByName(opening).unionByName(joined.where(F.col("kind") != "start"))

    declared = found.where(F.col("kind") == "prefix").groupBy("file", "subject").agg(
        F.sort_array(F.collect_list(F.struct("block", "seq", unescape(F.btrim("object", F.lit("<>"))).alias("iri")))).alias("places")
    )
    names = declared.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("subject", "places"))).alias("names"))
    triples = found.where(F.col("kind") == "triple").join(names, "file", "left")
    tag = F.col("tag")
    has_type = F.col("lexical").isNotNull() & (tag != "") & ~F.startswith(tag, F.lit("@"))
    suffix = F.when(tag == "", "").when(F.startswith(tag, F.lit("@")), tag).otherwise(F.concat(F.lit("^^"), _whole(tag)))
    literal = F.concat(unescape(F.col("lexical")), suffix)
    based = triples.withColumn("base", _named(F.lit("@base")))
    whole = F.struct(
        _whole(F.col("subject")).alias("subject"),
        _whole(F.col("predicate")).alias("predicate"),
        F.when(F.col("lexical").isNotNull(), literal).otherwise(_whole(F.col("object"))).alias("object"),
    )
    # `inline` keeps the terms from being worked out a second time by a filter on them.
    inlined = based.select("file", F.inline(F.array(whole)))
    usable = F.col("subject").isNotNull() & F.col("predicate").isNotNull() & F.col("object").isNotNull()
    last = F.when(has_type, _declared(tag)).when(F.col("lexical").isNotNull(), F.lit(True)).otherwise(_declared(F.col("object")))
    undeclared = triples.where(~(_declared(F.col("subject")) & _declared(F.col("predicate")) & last))
    rejected = found.where(F.col("kind") == "rejected").select("file").unionAll(undeclared.select("file"))
    return inlined.where(usable), rejected.groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def scan_turtle(
    spark: SparkSession, base: str, years: Sequence[str] = YEARS, kinds: Sequence[str] = KINDS
) -> tuple[DataFrame, DataFrame]:
    """Statements and rejected counts of all yearly files, with (year, kind) instead of the file."""
    found, rejected = read_turtle(spark, [statement_path(base, year, kind) for year in years for kind in kinds])
    where = rf"/(\d+)/\d+({'|'.join(kinds)})\.ttl"
    key = [F.regexp_extract("file", where, i).alias(name) for i, name in ((1, "year"), (2, "kind"))]
    return (
        found.select(*key, "subject", "predicate", "object"),
        rejected.groupBy(*key).agg(F.sum("n").alias("n")),
    )
