"""Reading RDF statements, one per line, from yearly `types`, `literals` and `objects` files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The years and file kinds of the input layout.
YEARS = ("2014", "2015", "2016", "2017")
KINDS = ("types", "literals", "objects")

_NODE = r"<[^>]*>|_:\S+"
_STATEMENT = rf"^\s*({_NODE})\s+(<[^>]*>)\s+(.+?)\s*\.\s*$"
_MARK = chr(2)
_LITERAL = r'^"((?:[^"\\]|\\.)*)"(.*)$'


# The escapes of literals, and those of characters by number.
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_PIECE = r"(?s)(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+|\\"
_PLANE_RUN = r"^(?:\\u(?![dD][89a-fA-F])[0-9A-Fa-f]{4}|\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2})+$"
_CODE_POINT = r"^\\U00(?:0[1-9A-Fa-f]|10)[0-9A-Fa-f]{4}$|^\\U0000(?![dD][89a-fA-F])[0-9A-Fa-f]{4}$"


def _bare(node: Column) -> Column:
    """A URI without its angle brackets; blank nodes stay as they are."""
    uri = unescape(F.substr(node, F.lit(2), F.length(node) - 2))
    return F.when(F.startswith(node, F.lit("<")), uri).otherwise(node)


def unescape(text: Column) -> Column:
    """Text with its escapes decoded, each once and from left to right.

    A number that is no character, such as half of a surrogate pair, stays as it is written.
    """
    simple = F.create_map(*[F.lit(x) for pair in _ESCAPES.items() for x in pair])

    def decoded(piece: Column) -> Column:
        number = F.unhex(F.replace(piece, F.lit("\\u"), F.lit("")))
        wide = F.unhex(F.substr(piece, F.lit(3)))
        short = F.coalesce(F.try_element_at(simple, F.substr(piece, F.lit(2))), piece)
        return (
            F.when(F.rlike(piece, F.lit(_PLANE_RUN)), F.decode(number, "UTF-16BE"))
            .when(F.rlike(piece, F.lit(_CODE_POINT)), F.decode(wide, "UTF-32"))
            .when(F.startswith(piece, F.lit("\\")) & (F.length(piece) == 2), short)
            .otherwise(piece)
        )

    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    joined = F.array_join(F.transform(pieces, decoded), "")
    return F.when(F.contains(text, F.lit("\\")), joined).otherwise(text)


def _object_text(node: Column) -> Column:
    """URIs bare; literals as `lexical`, `lexical^^datatype` or `lexical@language`."""
    lexical = unescape(F.regexp_extract(node, _LITERAL, 1))
    suffix = F.regexp_replace(F.regexp_extract(node, _LITERAL, 2), r"^\^\^<(.*)>$", "^^$1")
    literal = F.concat(lexical, suffix)
    return F.when(F.startswith(node, F.lit('"')), literal).otherwise(_bare(node))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Number of lines by the other columns that are no statement, blank line or comment: prefixes and the like."""
    kept = [name for name in lines.columns if name != "line"]
    plain = F.rlike(F.col("line"), F.lit(_STATEMENT)) | F.rlike(F.col("line"), F.lit(r"^\s*(#.*)?$"))
    return lines.where(~plain).groupBy(*kept).agg(F.count(F.lit(1)).alias("n"))


def parse_statements(lines: DataFrame) -> DataFrame:
    """Turn `line` into (subject, predicate, object); other lines are dropped, `rejected_lines` counts them."""
    kept = [name for name in lines.columns if name != "line"]
    # The pattern is matched once per line; a line that does not match stays in one piece.
    marked = F.regexp_replace("line", _STATEMENT, f"$1{_MARK}$2{_MARK}$3")
    parts = lines.select(*kept, F.split(marked, _MARK).alias("parts"))
    subject, predicate, node = (F.get("parts", F.lit(i)) for i in range(3))
    statement = F.struct(
        _bare(subject).alias("subject"), _bare(predicate).alias("predicate"), _object_text(node).alias("object")
    )
    return parts.select(*kept, F.inline(F.when(F.size("parts") == 3, F.array(statement))))


def statement_path(base: str, year: str, kind: str) -> str:
    return f"{base}/{year}/{year}{kind}.ttl"


def scan_statement_lines(
    spark: SparkSession, base: str, years: Sequence[str] = YEARS, kinds: Sequence[str] = KINDS
) -> DataFrame:
    """(year, kind, line) of all yearly files, by one scan."""
    paths = [statement_path(base, year, kind) for year in years for kind in kinds]
    lines = spark.read.text(paths)
    file_path = F.col("_metadata.file_path")
    where = rf"/(\d+)/\d+({'|'.join(kinds)})\.ttl"
    return lines.select(
        F.regexp_extract(file_path, where, 1).alias("year"),
        F.regexp_extract(file_path, where, 2).alias("kind"),
        F.col("value").alias("line"),
    )


def scan_statements(
    spark: SparkSession, base: str, years: Sequence[str] = YEARS, kinds: Sequence[str] = KINDS
) -> DataFrame:
    """(year, kind, subject, predicate, object) of all yearly files."""
    return parse_statements(scan_statement_lines(spark, base, years, kinds))
