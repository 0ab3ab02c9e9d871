"""Column expressions for N-Triples text: parsing, naming, ids and formatting.

Everything here is a plain Spark column expression; there is no Python UDF.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Patterns, namespaces and default names of the input format.
URI_PATTERN = "<[^>]+>"
LITERAL_PATTERN = '"[^"]+"'
XSD_NAMESPACE = "http://www.w3.org/2001/XMLSchema#"
XSD_NUMBER_SUFFIX = r"\^\^<http://www\.w3\.org/2001/XMLSchema#(float|integer)>"
IMDB_NAMESPACE = "http://imdb.org"
DBPEDIA_NAMESPACE = "http://dbpedia.org"
PREDICATE_NAMESPACE = "http://xmlns.com/foaf/0.1"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
UNKNOWN_NAME = "unknown"
UNKNOWN_TYPE = "unknownType"
UNKNOWN_RESOURCE = "unknownResource"
IMDB_TYPES = ("movie", "actor", "actress", "director", "country", "genre")
INVALID_VALUES = ("????", "")
SHORT_TEXT = 20
# ---------------------------------------------------------------------------

_BLANKS = "".join(chr(code) for code in range(1, 33))


def strip_terminator(line: Column) -> Column:
    """Trim a line and drop its last character, whatever that character is."""
    plain = F.startswith(line, F.lit("<")) & F.endswith(line, F.lit("."))  # cheap, and true for most lines
    trimmed = F.when(plain, line).otherwise(F.btrim(line, F.lit(_BLANKS)))
    return F.left(trimmed, F.length(trimmed) - 1)


def strip_xsd_number(text: Column) -> Column:
    """Cut the float/integer datatype so that typed numbers read as plain literals."""
    typed = F.contains(text, F.lit(XSD_NAMESPACE))  # cheap, and false for most lines
    return F.when(typed, F.regexp_replace(text, XSD_NUMBER_SUFFIX, "")).otherwise(text)


def uris_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URI_PATTERN), F.lit(0))


def literals_in(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(LITERAL_PATTERN), F.lit(0))
    return F.when(F.contains(text, F.lit('"')), found).when(text.isNotNull(), F.array().cast("array<string>"))  # edges have none


def mentions_type(uri: Column, types: Iterable[str]) -> Column:
    """True when the URI text contains any of the type names, anywhere in it."""
    found = F.lit(False)
    for name in types:
        found = found | F.contains(uri, F.lit(name))
    return found


def _without_bracket(uri: Column) -> Column:
    return F.left(uri, F.length(uri) - 1)


def local_name(predicate: Column) -> Column:
    """The last path segment of a `<...>` URI; a default when there is no slash or nothing after it."""
    name = F.substring_index(_without_bracket(predicate), "/", -1)
    usable = F.contains(predicate, F.lit("/")) & (name != "")
    return F.when(usable, name).otherwise(F.lit(UNKNOWN_NAME))


def _is_vertex(uri: Column, namespace: str) -> Column:
    """`<namespace/type/name>` with a type and a name; the name may contain slashes."""
    rest = _below(uri, namespace)
    slash = F.instr(rest, "/")
    return F.startswith(uri, F.lit(f"<{namespace}/")) & (slash > 1) & (slash < F.length(rest))


def _below(uri: Column, namespace: str) -> Column:
    """What follows the namespace, without the closing bracket."""
    start = len(namespace) + 3
    return F.substr(uri, F.lit(start), F.length(uri) - start)


def vertex_type(uri: Column, namespace: str = IMDB_NAMESPACE) -> Column:
    kind = F.substring_index(_below(uri, namespace), "/", 1)
    return F.when(_is_vertex(uri, namespace), kind).otherwise(F.lit(UNKNOWN_TYPE))


def vertex_name(uri: Column, namespace: str = IMDB_NAMESPACE) -> Column:
    rest = _below(uri, namespace)
    name = F.substr(rest, F.instr(rest, "/") + 1)
    return F.when(_is_vertex(uri, namespace), name).otherwise(F.lit(UNKNOWN_RESOURCE))


def last_uri_part(uri: Column) -> Column:
    return F.lower(F.substring_index(uri, "/", -1))


def literal_lexical(literal: Column) -> Column:
    return F.substring_index(literal, "^^", 1)


def clean_literal(value: Column) -> Column:
    """Drop one trailing ' \\' and then one trailing '\\'."""
    without_blank = F.regexp_replace(value, r" \\$", "")
    cleaned = F.regexp_replace(without_blank, r"\\$", "")
    return F.when(F.contains(value, F.lit("\\")), cleaned).otherwise(value)  # few values have any


def string_hash32(text: Column) -> Column:
    """31-polynomial hash over UTF-16 code units, as a signed 32-bit value in a LONG.

    Characters beyond the basic plane count as their two surrogates. Short ASCII text is summed place by place, which
    Spark compiles; a fold over the characters is interpreted, and costs many times as much.
    """
    mask = F.lit(0xFFFFFFFF).cast("long")
    places = [F.ascii(F.substring(text, -1 - i, 1)).cast("long") * pow(31, i, 2**32) for i in range(SHORT_TEXT)]
    short = (F.octet_length(text) == F.char_length(text)) & (F.char_length(text) <= SHORT_TEXT)

    def step(acc: Column, unit: Column) -> Column:
        return (acc * 31 + unit).bitwiseAND(mask)

    def fold(acc: Column, char: Column) -> Column:
        code = F.ascii(char).cast("long")
        beyond = code - 0x10000
        high = F.floor(beyond / 1024) + 0xD800
        low = F.pmod(beyond, F.lit(1024)) + 0xDC00
        return F.when(code > 0xFFFF, step(step(acc, high), low)).otherwise(step(acc, code))

    folded = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), fold)
    # The sign comes by moving the range, as a condition on the sum would work it out twice.
    half = F.lit(2**31).cast("long")
    return (F.when(short, reduce(lambda a, b: a + b, places)).otherwise(folded) + half).bitwiseAND(mask) - half


def vertex_id(uri: Column, vtype: Column) -> Column:
    return string_hash32(F.concat(uri, vtype))


def uri_text(namespace: str, vtype: Column, uri: Column) -> Column:
    return F.concat(F.lit(f"<{namespace}/"), vtype, F.lit("/"), uri, F.lit(">"))


def _predicate_text(name: Column) -> Column:
    return F.concat(F.lit(f"<{PREDICATE_NAMESPACE}/"), name, F.lit(">"))


def attribute_line(namespace: str, vtype: Column, uri: Column, attr: Column, value: Column) -> Column:
    """A value that holds line breaks stays on one line, with the breaks escaped."""
    subject = uri_text(namespace, vtype, uri)
    whole = F.replace(F.replace(value, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.concat(subject, F.lit(" "), _predicate_text(attr), F.lit(' "'), whole, F.lit('" .'))


def edge_line(
    namespace: str, src_type: Column, src_uri: Column, rel: Column, dst_type: Column, dst_uri: Column
) -> Column:
    return F.concat(
        uri_text(namespace, src_type, src_uri),
        F.lit(" "),
        _predicate_text(rel),
        F.lit(" "),
        uri_text(namespace, dst_type, dst_uri),
        F.lit(" ."),
    )


def part_file_name(file_name: Column, part: Column) -> Column:
    """`imdb-170909.nt`, 2 -> `imdb2-170909.nt`; the number goes last if there is no hyphen."""
    at = F.instr(file_name, "-")
    label = part.cast("string")
    head = F.substring_index(file_name, "-", 1)
    tail = F.substr(file_name, at)
    return F.when(at > 0, F.concat(head, label, tail)).otherwise(F.concat(file_name, label))
