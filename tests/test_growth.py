"""Work that is done once per vertex or once per line, and not once per edge or once per reading."""

import hashlib
import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from kairograph.functions import rdf
from kairograph.model import PropertyGraph
from kairograph.operators import assembly, partitioning, patterns, reduction, sampling
from kairograph.plans import incremental, jobs
from kairograph.sources import ntriples, turtle_reader

EDGES = "snapshot int, src_type string, src_uri string, rel string, dst_type string, dst_uri string"


def java_hash(text):
    value = 0
    for i in range(0, len(units := text.encode("utf-16-be")), 2):
        value = (value * 31 + int.from_bytes(units[i : i + 2], "big")) & 0xFFFFFFFF
    return value - 2**32 if value >= 2**31 else value


def test_hash_of_short_and_long_texts(spark):
    texts = ["", "a", "~" * 19, "~" * 20, "~" * 21, "x" * 300, "é" * 5, "a\U0001f600b", "\x00\x7f", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rdf.string_hash32(F.col("t")).alias("h"))
    assert {r.t: r.h for r in rows.collect()} == {t: None if t is None else java_hash(t) for t in texts}


def test_part_of_an_anchor_is_not_worked_out_for_edges(spark):
    vertices = spark.createDataFrame([(0, "a", "x"), (0, "b", "y"), (0, "a", "z")], "snapshot int, vtype string, uri string")
    edges = spark.createDataFrame([(0, "a", "x", "r", "a", "z"), (0, "a", "x", "r", "b", "y"), (0, "a", "none", "r", "b", "y")], EDGES)
    graph = PropertyGraph(vertices, vertices.withColumns({"attr": F.lit("n"), "value": F.lit("v")}), edges, 1)
    _, edge_parts = partitioning.parts_by_anchor(graph, "a", 7)
    plan = edge_parts._jdf.queryExecution().optimizedPlan().toString()
    assert "concat(dst_uri" not in plan and "concat(src_uri" not in plan
    x, z = ((h if h >= 0 else -h - 1) % 7 for h in (java_hash("xa"), java_hash("za")))
    expected = Counter({("x", "z", x): 1, ("x", "z", z): 1, ("x", "y", x): 1})
    assert Counter((r.src_uri, r.dst_uri, r.part) for r in edge_parts.collect()) == expected


def test_parsed_graph_is_the_graph_of_its_triples(spark):
    space = rdf.IMDB_NAMESPACE
    lines = [
        f'<{space}/a/1> <http://p/name> "x" .',
        f'<{space}/a/1> <http://p/name> "y" .',
        f"<{space}/a/1> <http://p/r> <{space}/b/2> .",
        f"<{space}/a/1> <http://p/r> <{space}/b/2> .",
        '<http://other/a/1> <http://p/name> "z" .',
    ]
    triples = ntriples.parse_triples(spark.createDataFrame([(0, line) for line in lines], "snapshot int, line string"), None)
    stored, plain = jobs.parsed_graph(triples, 1), assembly.build_graph(triples, 1)
    for name in ("vertices", "attributes", "edges"):
        assert Counter(map(tuple, getattr(stored, name).collect())) == Counter(map(tuple, getattr(plain, name).collect()))
    assert Counter(map(tuple, stored.attributes.collect())) == Counter(
        [(0, "a", "1", "name", "y"), (0, rdf.UNKNOWN_TYPE, rdf.UNKNOWN_RESOURCE, "name", "z")]
    )
    assert stored.edges.count() == 2


def test_a_growing_series_keeps_its_tuples_as_numbers(spark, tmp_path):
    """A value has one number for the whole series, and a tuple is new in one snapshot only."""
    edges = spark.createDataFrame(
        [(t, s, f"{s}{i}", "r", d, f"{d}{i}") for t in (0, 1) for s, d in (("a", "b"), ("b", "c")) for i in range(4)], EDGES
    )
    ends = [edges.select("snapshot", F.col(f"{e}_type").alias("vtype"), F.col(f"{e}_uri").alias("uri")) for e in ("src", "dst")]
    vertices = ends[0].unionByName(ends[1]).distinct()
    later = (F.col("snapshot") == 1) & (F.col("uri") == "c3")
    attributes = vertices.select("*", F.lit("n").alias("attr"), F.when(later, "new").otherwise(F.col("uri")).alias("value"))
    graph = PropertyGraph(vertices, attributes, edges, 2)
    folder = str(tmp_path / "state")
    incremental.begin(incremental.one_snapshot(graph, 0), folder, k=2, min_count=1, prune=False)
    for number in (0, 1):
        incremental.add_snapshot(incremental.one_snapshot(graph, number), folder)
    names = spark.read.parquet(f"{folder}/names")
    assert Counter(r.value for r in names.where("snapshot = 0").collect()) == Counter(f"{t}{i}" for t in "abc" for i in range(4))
    assert [r.value for r in names.where("snapshot = 1").collect()] == ["new"]
    assert names.select("id").distinct().count() == 13
    tuples = spark.read.parquet(f"{folder}/tuples-2")
    assert dict(tuples.dtypes)["value0"] == "bigint"
    assert Counter((r.snapshot, r.n) for r in tuples.collect()) == Counter({(0, 1): 4, (1, 0): 3, (1, 1): 1})


def test_plain_statements_are_read_like_their_terms(monkeypatch):
    rng = random.Random(11)
    parts = ["<a>", "p:b", "_:c", "a", "'x'", '"x"', '""', '"y"@en', '"y"@en-', '"5"^^x:int', '"5"^^<t>', '"5" ^^<t>', '"z\\"q"', "p:b.", "p:b.c",
             "x:é_1", ":n", "5", "5.5", "true", "# c .", "@prefix q: <i> .", "PREFIX r: <j>", ";", ",", ".", ".", "[", '"', "<a> p:b <c> .",
             "<a> a x:T ;", 'p:d "o", "q";', "x:s x:p x:o, x:q.", "\\", "\ufeff", "<a> <b>", "^^<t>"]

    def read(units, known, plain):
        reader = turtle_reader.Reader(known)
        if not plain:
            monkeypatch.setattr(reader, "_plain", lambda text, at: at)
            for unit in units:
                reader.text(unit)
        else:
            reader.texts(units)
        return reader.rows, reader.end()

    for _ in range(4000):
        units = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\t"]) for _ in range(rng.randint(0, 6))) + "\n" for _ in range(rng.randint(0, 5))]
        known = rng.random() < 0.7
        assert read(units, known, True) == read(units, known, False), units


def test_plain_statements_are_not_read_term_by_term(monkeypatch):
    reader, terms = turtle_reader.Reader(known=True), []
    monkeypatch.setattr(reader, "_token", lambda token: terms.append(token) if not token["skip"] else None)
    reader.texts([f'x:s{i}\n  a x:T ;\n  x:p "v{i}"^^x:t, <o>\n.\n' for i in range(100)])
    assert len(reader.rows) == 300 and not terms


def test_first_distinct_edges_when_copies_fill_the_first_rows(spark):
    """The first edges in hash order have many copies, so a histogram of rows stops too early at first."""
    keys = sorted((sampling_hash("s", ("a", f"x{i}", "r", "b", "y")), f"x{i}") for i in range(60))
    rows = [(t, "a", uri, "r", "b", "y") for t in (0, 1) for place, (_, uri) in enumerate(keys) for _ in range(30 if t and place < 5 else 1)]
    got = sampling._first_distinct(spark.createDataFrame(rows, EDGES), 20, "s").collect()
    assert Counter((r.snapshot, r.src_uri) for r in got) == Counter((t, uri) for t in (0, 1) for _, uri in keys[:20])
    everything = sampling._first_distinct(spark.createDataFrame(rows, EDGES), 100, "s")
    assert everything.count() == 120
    assert sampling._first_distinct(spark.createDataFrame([], EDGES), 5, "s").count() == 0


def sampling_hash(seed, key):
    return hashlib.md5(chr(31).join([seed, *key]).encode()).hexdigest()


def test_images_of_patterns_share_what_is_beyond_an_edge(spark):
    rng = random.Random(4)
    kinds = [("a", "r", "b"), ("c", "s", "b"), ("b", "t", "d")]
    rows = [(rng.randrange(3), s, f"{rng.randrange(9)}", rel, d, f"{rng.randrange(9)}") for s, rel, d in kinds for _ in range(14)]
    rows += [(0, "a", None, "r", "b", "1"), (1, "a", "77", "r", "b", None), (None, "a", "78", "r", "b", "1"), (2, "c", "1", "s", "b", None)]
    vertices = spark.createDataFrame([], "snapshot int, vtype string, uri string")
    graph = PropertyGraph(vertices, vertices, spark.createDataFrame(rows, EDGES), 3, closed=True)
    around = reduction.Surroundings(graph)
    for size in (1, 2, 3):
        for chosen in combinations(kinds, size):
            plain = set()
            for edge, table in reduction.reduced_edges(graph, chosen).items():
                plain |= {pair for r in table.collect() for pair in ((edge.src, r.src_uri), (edge.dst, r.dst_uri))}
            found = [tuple(r) for r in reduction.images(graph, chosen, around).collect()]
            assert sorted(found, key=str) == sorted(plain, key=str), chosen
            support = reduction.image_support(graph, patterns.make_pattern(chosen), around).first().support
            types = {t for s, _, d in chosen for t in (s, d)}
            assert support == min(sum(v == t for v, _ in plain) for t in types)
    assert len(around.found) == 6 + 6 + 3  # ends, ends with one branch, ends with both


def test_lines_are_formatted_once(spark):
    rows = [(0, "a", "1", "n", "x \\"), (0, "a", "2", "n", "y\\"), (0, "a", "3", "n", None), (0, None, "4", "n", "z"), (0, "a", "5", None, "z")]
    attributes = spark.createDataFrame(rows, "snapshot int, vtype string, uri string, attr string, value string")
    lines = ntriples.format_attributes(attributes)
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2
    assert sorted(r.line[-6:] for r in lines.collect()) == [">".join(["/n", ' "x" .'])[-6:], ">".join(["/n", ' "y" .'])[-6:]]
