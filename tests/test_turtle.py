"""Turtle over several lines equals its one-line form, however the file is split."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kairograph.sources import turtle_reader
from kairograph.sources.statements import parse_statements
from kairograph.sources.turtle import read_turtle

TURTLE = '''\ufeff@prefix ex: <http://x/> . # a comment with "quotes" and '''  + "'''" + '''
@prefix
  xsd:
  <http://www.w3.org/2001/XMLSchema#>
  .
PREFIX o: <http://o/>
@base <http://b/dir/page#top> .
ex:one a o:Thing ; ex:name "plain", "en"@en-GB ,
   "5"^^xsd:integer ; ;
   ex:text """first line # no comment
<not> <an> <iri> . ; ,
\'\'\' still "" inside \\""" and \\u00e9
last""" , 'single \\' quote' .
ex:two.a ex:p 5, -5.25 , 1e6, true.
<rel> <#frag> </abs> . <> <//other/x> _:b1 .
ex:odd [ ex:p ex:q ] ; ex:r "lost" .
ex:odd2 ex:p ( 1 2 ) .
no:where ex:p ex:q .
@prefix ex: <http://second/> .
ex:one ex:two\\,x \'\'\'long "single"
with """ in it\'\'\'^^<http://t> .
<http://full/s> <http://full/p> "tab\\tend" .
'''

X, O, XSD = "http://x/", "http://o/", "http://www.w3.org/2001/XMLSchema#"
EXPECTED = [
    (X + "one", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", O + "Thing"),
    (X + "one", X + "name", "plain"),
    (X + "one", X + "name", "en@en-GB"),
    (X + "one", X + "name", f"5^^{XSD}integer"),
    (X + "one", X + "text", "first line # no comment\n<not> <an> <iri> . ; ,\n''' still \"\" inside \"\"\" and é\nlast"),
    (X + "one", X + "text", "single ' quote"),
    (X + "two.a", X + "p", f"5^^{XSD}integer"),
    (X + "two.a", X + "p", f"-5.25^^{XSD}decimal"),
    (X + "two.a", X + "p", f"1e6^^{XSD}double"),
    (X + "two.a", X + "p", f"true^^{XSD}boolean"),
    ("http://b/dir/rel", "http://b/dir/page#frag", "http://b/abs"),
    ("http://b/dir/page", "http://other/x", "_:b1"),
    ("http://second/one", "http://second/two,x", 'long "single"\nwith """ in it^^http://t'),
    ("http://full/s", "http://full/p", "tab\tend"),
]
N_REJECTED = 3


def _read(spark, path):
    found, rejected = read_turtle(spark, [str(path)])
    return sorted(map(tuple, found.drop("file").collect())), sum(row.n for row in rejected.collect())


@pytest.mark.parametrize("size", [None, 300])
def test_any_split_gives_the_same_statements(spark, tmp_path, size):
    path = tmp_path / "a.ttl"
    path.write_text(TURTLE, encoding="utf-8")
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {name: spark.conf.get(name) for name in names}
    try:
        if size:
            spark.conf.set(names[0], size)
            spark.conf.set(names[1], 0)
        assert _read(spark, path) == (sorted(EXPECTED), N_REJECTED)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _cut_rows(text, cuts):
    """Rows of `text` read in splits that start at the given line numbers, ends joined."""
    lines = text.split("\n")
    block = [max(c for c in [0, *cuts] if c <= i) for i in range(len(lines))]
    frame = pd.DataFrame({"file": "f", "block": block, "line": lines})
    marked = frame[frame.line.map(lambda line: any(m in line for m in turtle_reader.LONG_MARKS))]
    ends = list(turtle_reader.scan_ends([marked])) if len(marked) else []
    spans = turtle_reader.open_splits(pd.concat(ends)) if ends else pd.DataFrame()
    open_at = {"f": [tuple(r[1:]) for r in spans.itertuples(index=False)]}
    rows = pd.concat(turtle_reader.read_splits(open_at)(iter([frame])))
    joined = turtle_reader.join_ends(rows[rows.kind == "end"])
    starts = {r.block: r for r in joined[joined.kind == "start"].itertuples()}
    out = []
    for row in pd.concat([rows, joined]).itertuples():
        if row.kind in ("end", "start"):
            continue
        start = starts.get(row.block)
        if row.opening and start.object == "broken":
            continue
        subject = row.subject or (start.subject if row.opening else None)
        predicate = row.predicate or (start.predicate if row.opening else None)
        if row.kind == "prefix":
            predicate = None
        out.append((row.kind, *([subject, predicate, row.object, row.lexical, row.tag] if row.kind != "rejected" else [None] * 5)))
    return sorted(out, key=json.dumps)


def test_random_splits_of_random_text():
    rng = random.Random(3)
    parts = ["<a>", "p:b", "_:c", "a", "'x'", '"""y\nz"""', "'''\n.\n'''", ";", ",", ".", ".", "[", "]", "@prefix q: <i> .",
             "PREFIX r:\n<j>", "5.5", "# c .", "\n", "\n", '"', "<a> p:b <c> .", "<a>\np:b\n'o',\n'q' ;\np:d 5 ."]
    for _ in range(150):
        text = "".join(rng.choice(parts) + rng.choice([" ", "\n"]) for _ in range(rng.randint(0, 25)))
        n = text.count("\n") + 1
        whole = _cut_rows(text, [])
        for cuts in ([*range(n)], sorted(rng.sample(range(n), min(n, rng.randint(0, 4))))):
            assert _cut_rows(text, cuts) == whole, (text, cuts)


def test_lines_equal_the_plain_reader(spark, tmp_path):
    lines = ['<s> <p> "v\\n\\"w"@en .', "<s> <p> <o> .", '<s> <q> "1"^^<http://t> .', "_:b <p> _:c .", "# none", ""]
    (tmp_path / "b.ttl").write_text("\r\n".join(lines), encoding="utf-8")
    plain = parse_statements(spark.createDataFrame([(line,) for line in lines], "line string"))
    assert _read(spark, tmp_path / "b.ttl") == (sorted(map(tuple, plain.collect())), 0)


def test_very_long_literal_and_statement_and_no_text(spark, tmp_path):
    long = "ab\\\\ \n" * 200_000
    many = ",\n".join(f"<o{i}>" for i in range(20_000))
    (tmp_path / "c.ttl").write_text(f'<s> <p> """{long}""" ; <q> {many} .', encoding="utf-8")
    (tmp_path / "d.ttl").write_text("", encoding="utf-8")
    found, rejected = read_turtle(spark, [str(tmp_path)])
    counts = {row.predicate: (row.n, row.size) for row in found.groupBy("predicate").agg(
        F.countDistinct("object").alias("n"), F.max(F.length("object")).alias("size")).collect()}
    assert counts == {"p": (1, 1_000_000), "q": (20_000, 6)}
    assert rejected.count() == 0
