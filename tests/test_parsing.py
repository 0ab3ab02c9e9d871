"""Line parsing, naming and formatting, one odd case each."""

import re

import pytest
from pyspark.sql import functions as F

from kairograph.functions import rdf
from kairograph.operators.assembly import build_attributes, build_edges, build_graph, graph_counts, vertex_maps
from kairograph.sources import ntriples
from kairograph.sources.ntriples import format_attributes, format_edges, parse_triples
from kairograph.sources.statements import parse_statements

M = "<http://imdb.org/movie/m1>"
A = "<http://imdb.org/actor/a1>"
P = "<http://xmlns.com/foaf/0.1/"
XSD = "<http://www.w3.org/2001/XMLSchema#"


def parse(spark, line, **options):
    lines = spark.createDataFrame([(0, line)], "snapshot int, line string")
    return [tuple(row)[1:] for row in parse_triples(lines, **options).collect()]


@pytest.mark.parametrize(
    ("line", "options", "expected"),
    [
        (f'{M} {P}name> "Heat" .', {}, [(M, "name", "Heat", "attribute")]),
        (f"{A} {P}acts_in> {M} .", {}, [(A, "acts_in", M, "edge")]),
        (f'{M} {P}rating> "7.5"^^{XSD}float> .', {}, [(M, "rating", "7.5", "attribute")]),
        (f'{M} {P}votes> "12"^^{XSD}integer> .', {}, [(M, "votes", "12", "attribute")]),
        # Without the suffix cut, the datatype is a third URI.
        (f'{M} {P}votes> "12"^^{XSD}integer> .', {"types": None, "strip_xsd": False}, [(M, "votes", f"{XSD}integer>", "edge")]),
        (f'{M} {P}seen> "1996-01-02"^^{XSD}date> .', {"types": None}, [(M, "seen", f"{XSD}date>", "edge")]),
        # The typed parse wants a known type in the object as well.
        (f'{M} {P}seen> "1996-01-02"^^{XSD}date> .', {}, []),
        (f'{M} {P}note> "say \\"hi\\" now" .', {}, []),
        (f'{M} {P}note> "" .', {}, []),
        (f'{M} {P}name> "Heat"', {}, []),
        (f'{M} {P}name> "Heat"x', {}, [(M, "name", "Heat", "attribute")]),
        (f'  \t{M} {P}name> "Heat" . \r', {}, [(M, "name", "Heat", "attribute")]),
        ('<http://other.org/x/1> <urn:tag> "v" .', {}, []),
        ('<http://other.org/x/1> <urn:tag> "v" .', {"types": None}, [("<http://other.org/x/1>", "unknown", "v", "attribute")]),
        # A type is searched in the whole URI.
        ('<http://other.org/x/my_movie> <http://a/b> "v" .', {}, [("<http://other.org/x/my_movie>", "b", "v", "attribute")]),
        (f'{M} <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> "t" .', {}, [(M, "22-rdf-syntax-ns#type", "t", "attribute")]),
        ("", {}, []),
        (f"{M} {P}a> {A} {A} .", {}, []),
    ],
)
def test_parse(spark, line, options, expected):
    assert parse(spark, line, **options) == expected


def test_uri_functions_equal_the_patterns(spark):
    uris = [
        "<http://imdb.org/movie/1>",
        "<http://imdb.org/movie/a/b>",
        "<http://imdb.org/movie/>",
        "<http://imdb.org/movie/x/>",
        "<http://imdb.org//x>",
        "<http://imdb.org/movie>",
        "<http://imdb.org/>",
        "<http://imdb.org>",
        "<http://elsewhere.org/a/b>",
        "<http://imdb.org/m/é>",
        "<urn:x>",
        "<http://x/a#b>",
        "<http://x/a/>",
    ]
    rows = spark.createDataFrame([(uri,) for uri in uris], "u string").select(
        "u", rdf.vertex_type(F.col("u")), rdf.vertex_name(F.col("u")), rdf.local_name(F.col("u"))
    )
    for uri, vtype, name, local in rows.collect():
        full = re.fullmatch(r"<http://imdb\.org/([^/]+)/([^>]+)>", uri)
        last = re.search(r"/([^/>]+)>$", uri)
        assert (vtype, name) == (full.groups() if full else ("unknownType", "unknownResource"))
        assert local == (last.group(1) if last else "unknown")


def java_hash(text):
    value = 0
    data = text.encode("utf-16-be")
    for i in range(0, len(data), 2):
        value = (value * 31 + int.from_bytes(data[i : i + 2], "big")) & 0xFFFFFFFF
    return value - 2**32 if value >= 2**31 else value


def test_string_hash32(spark):
    texts = ["", "a", "12order", "Aa", "BB", "Zoë", "漢字", "smile 😀 end", "x" * 200]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rdf.string_hash32(F.col("t")))
    assert [(t, h) for t, h in rows.collect()] == [(t, java_hash(t)) for t in texts]
    assert java_hash("Aa") == java_hash("BB") == 2112


def test_clean_literal_and_part_names(spark):
    values = ["plain", "end\\", "end \\", "two\\\\", "two\\ \\", "\\", " \\"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(rdf.clean_literal(F.col("v")))
    assert [r[0] for r in rows.collect()] == ["plain", "end", "end", "two\\", "two", "", ""]
    names = spark.createDataFrame([("imdb-170909.nt", 2), ("a-b-c", 0), ("plain", 3)], "f string, p int")
    got = [r[0] for r in names.select(rdf.part_file_name(F.col("f"), F.col("p"))).collect()]
    assert got == ["imdb2-170909.nt", "a0-b-c", "plain3"]


def lines_of(spark, *lines):
    return spark.createDataFrame([(0, line) for line in lines], "snapshot int, line string")


def test_graph_from_lines(spark):
    lines = lines_of(
        spark,
        f'{M} {P}name> "B" .',
        f'{M} {P}name> "A" .',
        f'{M} {P}year_of> "1995" .',
        f"{A} {P}acts_in> {M} .",
        f"{A} {P}acts_in> {M} .",
        f"{M} {P}of_genre> <http://imdb.org/genre/none> .",
    )
    triples = parse_triples(lines)
    maps = vertex_maps(build_attributes(triples)).collect()
    assert [(r.vtype, r.uri, r.attributes) for r in maps] == [("movie", "m1", {"name": "B", "year_of": "1995"})]
    assert build_edges(triples).count() == 3  # copies stay
    # The actor has no attribute, so it is no vertex and its edges dangle.
    counts = [tuple(r) for r in graph_counts(build_graph(triples, 2)).orderBy("snapshot").collect()]
    assert counts == [(0, 1, 3, 2), (1, 0, 0, 0)]


def test_format_and_parse_round_trip(spark):
    attributes = spark.createDataFrame(
        [(0, "movie", "m1", "name", "Heat"), (0, "actor", "a/1", "name", "Al P.")],
        "snapshot int, vtype string, uri string, attr string, value string",
    )
    edges = spark.createDataFrame(
        [(0, "actor", "a/1", "acts_in", "movie", "m1")] * 2,
        "snapshot int, src_type string, src_uri string, rel string, dst_type string, dst_uri string",
    )
    triples = parse_triples(format_attributes(attributes).unionByName(format_edges(edges)))
    assert sorted(build_attributes(triples).collect()) == sorted(attributes.collect())
    assert sorted(build_edges(triples).collect()) == sorted(edges.collect())


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("<http://a/s> <http://a/p> <http://a/o> .", ("http://a/s", "http://a/p", "http://a/o")),
        ("_:b1 <http://a/p> _:b2 .", ("_:b1", "http://a/p", "_:b2")),
        ('<s> <p> "x"^^<http://t#int> .', ("s", "p", "x^^http://t#int")),
        ('<s> <p> "x"@en  . ', ("s", "p", "x@en")),
        (r'<s> <p> "a \"b\" \\n c" .', ("s", "p", 'a "b" \\n c')),
        ('<s> <p> "ends with . dot" .', ("s", "p", "ends with . dot")),
        ("# a comment", None),
        ("<s> <p> .", None),
        ("", None),
    ],
)
def test_statements(spark, line, expected):
    rows = parse_statements(spark.createDataFrame([(line,)], "line string")).collect()
    assert [tuple(r) for r in rows] == ([expected] if expected else [])


def test_escapes_of_statements(spark):
    """Numbers, surrogate pairs and short escapes are decoded once; what is no character stays."""
    from kairograph.sources.statements import parse_statements, rejected_lines

    bs = chr(92)
    cases = {
        f"caf{bs}u00E9": "caf\xe9",
        f"{bs}U0001F600 {bs}uD83D{bs}uDE00": "\U0001f600 \U0001f600",
        f"a{bs}tb{bs}nc{bs}r{bs}\"{bs}{bs}n": f'a\tb\nc\r"{bs}n',
        f"{bs}{bs}u0041": f"{bs}u0041",
        f"{bs}uD83D alone": f"{bs}uD83D alone",
        f"{bs}U00110000": f"{bs}U00110000",
        chr(1) + "held": chr(1) + "held",
        f"{bs}u0041{bs}u0042C": "ABC",
    }
    lines = [(f'<http://a/{i}> <http://p> "{text}" .',) for i, text in enumerate(cases)]
    lines += [(f"<http://a/{bs}u0041> <http://p> <http://{bs}u00E9> .",), ("@prefix x: <http://x> .",), ("# note",), ("",)]
    frame = spark.createDataFrame(lines, "line string")
    found = {row.subject: row.object for row in parse_statements(frame).collect()}
    assert found == {f"http://a/{i}": text for i, text in enumerate(cases.values())} | {"http://a/A": "http://\xe9"}
    assert rejected_lines(frame.selectExpr("'f' AS file", "line")).collect() == [("f", 1)]


def test_line_breaks_stay_on_one_line(spark):
    from kairograph.sources.ntriples import format_attributes

    rows = spark.createDataFrame([(0, "t", "u", "a", "x\ny\rz")], "snapshot int, vtype string, uri string, attr string, value string")
    assert format_attributes(rows).first().line.endswith('"x\\ny\\rz" .')


def test_compressed_lines_are_read_back_in_small_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ntriples, "FILE_LINES", 100)
    rows = [(f"imdb-17090{i % 2}.nt", f"<a/{i}> <b> \"{i}\" .") for i in range(1000)]
    path = f"{tmp_path}/lines"
    ntriples.write_lines(spark.createDataFrame(rows, "file string, line string"), path, "gzip")
    assert sorted(map(tuple, ntriples.scan_lines(spark, path).collect())) == sorted(rows)
    files = [f for f in (tmp_path / "lines").rglob("part-*")]
    assert len(files) >= 10 and all(f.name.endswith(".gz") for f in files)
