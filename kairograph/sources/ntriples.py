"""Reading and writing dated N-Triples files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from kairograph.functions import rdf
from kairograph.functions.temporal import place_in

# The date format and name parts of snapshot files.
DATE_FORMAT = "yyMMdd"
FILE_PREFIX = "imdb-"
FILE_SUFFIX = ".nt"
FILE_LINES = 1 << 20


def month_series(start: Column, end: Column) -> Column:
    """Dates from start to end, each one month after the date before it.

    A step that is cut to a shorter month stays cut: 31 Jan, 28 Feb, 28 Mar. The
    `sequence` function would return to the 31st, so the steps are folded.
    """
    steps = F.greatest(F.ceil(F.months_between(end, start)) + 1, F.lit(1)).cast("int")
    walked = F.aggregate(
        F.sequence(F.lit(1), steps),
        F.array(start),
        lambda dates, _: F.concat(dates, F.array(F.add_months(F.element_at(dates, -1), 1))),
    )
    return F.filter(walked, lambda date: date <= end)


def name_snapshots(bounds: DataFrame, start: str, end: str, prefix: str = FILE_PREFIX) -> DataFrame:
    """(snapshot, snapshot_date, file_name) for the date columns `start` and `end` of one row."""
    dates = bounds.select(F.posexplode(month_series(F.col(start), F.col(end))).alias("snapshot", "snapshot_date"))
    name = F.concat(F.lit(prefix), F.date_format("snapshot_date", DATE_FORMAT), F.lit(FILE_SUFFIX))
    return dates.withColumn("file_name", name)


def snapshot_dates(spark: SparkSession, start: str, end: str, prefix: str = FILE_PREFIX) -> DataFrame:
    """The series of snapshot files between two `yyMMdd` dates, both included."""
    bounds = spark.range(1).select(
        F.to_date(F.lit(start), DATE_FORMAT).alias("start"), F.to_date(F.lit(end), DATE_FORMAT).alias("end")
    )
    return name_snapshots(bounds, "start", "end", prefix)


def _entry_name(file_path: Column) -> Column:
    """Name of the file, or of the folder when the text was written as a folder of parts."""
    path = F.split(file_path, "/")
    name = F.element_at(path, -1)
    folder = F.regexp_replace(F.element_at(path, -2), "^file=", "")
    entry = F.when(F.startswith(name, F.lit("part-")), folder).otherwise(name)
    # Paths come percent-encoded; a plus sign stands for itself.
    return F.url_decode(F.replace(entry, F.lit("+"), F.lit("%2B")))


def scan_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file_name, line) for one file, several files, or a folder and all below it."""
    reader = spark.read.option("recursiveFileLookup", "true")
    return reader.text(paths).select(_entry_name(F.col("_metadata.file_path")).alias("file_name"), F.col("value").alias("line"))


def _number_files(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    """(snapshot, line): the place of the file in the list of names as the snapshot."""
    return lines.select(place_in(F.col("file_name"), names, "file").alias("snapshot"), "line")


def load_folder(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """((snapshot, line), file names in order) of all files in a folder, by one scan."""
    lines = scan_lines(spark, path)
    # Listed by the executors from file metadata; one name per snapshot reaches the driver.
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    names = sorted(row.name for row in listed.select(_entry_name(F.col("_metadata.file_path")).alias("name")).distinct().collect())
    return _number_files(lines, names), names


def load_snapshots(
    spark: SparkSession, base_path: str, start: str, end: str, prefix: str = FILE_PREFIX
) -> tuple[DataFrame, int]:
    """((snapshot, line), number of snapshots) of the dated files under `base_path`.

    All files are read by one scan. The list of file names, one per month, is the only
    thing the driver sees; file names are appended to `base_path` as they are.
    """
    files = snapshot_dates(spark, start, end, prefix)
    names = [row.file_name for row in files.orderBy("snapshot").collect()]
    lines = scan_lines(spark, [base_path + name for name in names])
    return _number_files(lines, names), len(names)


def parse_triples(
    lines: DataFrame, types: Sequence[str] | None = rdf.IMDB_TYPES, strip_xsd: bool = True
) -> DataFrame:
    """Turn the `line` column into (subject, name, object, kind); other columns are kept.

    Two URIs and one literal make an attribute, three URIs make an edge, any other line
    is dropped. With `types`, the subject, and for edges the object, must mention one of
    the names. `strip_xsd` removes float and integer datatypes first; a datatype left in
    place is a third URI.
    """
    kept = [name for name in lines.columns if name != "line"]
    text = rdf.strip_terminator(F.col("line"))
    if strip_xsd:
        text = rdf.strip_xsd_number(text)
    found = lines.select(*kept, text.alias("text")).select(
        *kept, rdf.uris_in(F.col("text")).alias("uris"), rdf.literals_in(F.col("text")).alias("literals")
    )
    n_uris = F.size("uris")
    uri = [F.get("uris", F.lit(i)) for i in range(3)]
    is_attribute = (n_uris == 2) & (F.size("literals") == 1)
    is_edge = n_uris == 3
    if types is not None:
        is_attribute = is_attribute & rdf.mentions_type(uri[0], types)
        is_edge = is_edge & rdf.mentions_type(uri[0], types) & rdf.mentions_type(uri[2], types)

    def triple(obj: Column, kind: str) -> Column:
        return F.array(
            F.struct(
                uri[0].alias("subject"),
                rdf.local_name(uri[1]).alias("name"),
                obj.alias("object"),
                F.lit(kind).alias("kind"),
            )
        )

    literal = F.replace(F.get("literals", F.lit(0)), F.lit('"'), F.lit(""))
    parsed = F.when(is_attribute, triple(literal, "attribute")).when(is_edge, triple(uri[2], "edge"))
    # `inline` drops lines without a triple, and keeps the pattern matching below it
    # from being evaluated a second time by a pushed-down filter.
    return found.select(*kept, F.inline(parsed))


def _without_nulls(rows: DataFrame, parts: Sequence[str]) -> DataFrame:
    """A line is null where one of its parts is. A filter on the line itself would make it a second time."""
    return rows.where(reduce(lambda a, b: a & b, [F.col(part).isNotNull() for part in parts]))


def format_attributes(attributes: DataFrame, namespace: str = rdf.IMDB_NAMESPACE, clean: bool = True) -> DataFrame:
    """One `line` per attribute row; a vertex without attributes has no line."""
    value = rdf.clean_literal(F.col("value")) if clean else F.col("value")
    kept = [name for name in attributes.columns if name not in ("vtype", "uri", "attr", "value")]
    line = rdf.attribute_line(namespace, F.col("vtype"), F.col("uri"), F.col("attr"), value)
    return _without_nulls(attributes, ["vtype", "uri", "attr", "value"]).select(*kept, line.alias("line"))


def format_edges(edges: DataFrame, namespace: str = rdf.IMDB_NAMESPACE) -> DataFrame:
    """One `line` per edge row."""
    ends = ["src_type", "src_uri", "rel", "dst_type", "dst_uri"]
    kept = [name for name in edges.columns if name not in ends]
    line = rdf.edge_line(namespace, *[F.col(name) for name in ends])
    return _without_nulls(edges, ends).select(*kept, line.alias("line"))


def write_lines(lines: DataFrame, path: str, compression: str = "none") -> None:
    """Write (file, line) as text, all files in one job, as `path/file=<name>/part-*`.

    The rebalance step lets the adaptive planner split a file that holds most of the
    rows and merge small ones, so neither the tasks nor the output files are uneven.
    """
    named = lines.select("file", F.col("line").alias("value"))
    writer = text_writer(named.hint("rebalance", "file"), compression)
    writer.partitionBy("file").mode("errorifexists").text(path)


def text_writer(lines: DataFrame, compression: str = "none") -> DataFrameWriter:
    """A writer of text; compressed files are not split when they are read, so none has more than FILE_LINES lines."""
    writer = lines.write.option("compression", compression)
    return writer if compression == "none" else writer.option("maxRecordsPerFile", FILE_LINES)
