"""What keeps the mining and cutting of large graphs short: rows are moved once, and choices that cannot matter are left out early."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from catalog import star_graph as star
from kairograph.functions import rdf
from kairograph.model import PropertyGraph
from kairograph.operators import matching, partitioning
from kairograph.operators.patterns import PatternEdge
from kairograph.plans import discovery
from kairograph.plans.storage import Once, together

EDGES = "snapshot int, src_type string, src_uri string, rel string, dst_type string, dst_uri string"
VERTICES = "snapshot int, vtype string, uri string"


def moved(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def rows(df, *names):
    return Counter(tuple(r) for r in df.select(*names).collect())


@pytest.fixture(scope="module")
def series(spark):
    """Many vertices `a`, each with a name of its own and one of few kinds, linked to few `b` and, over them, `c`."""
    rng = random.Random(3)
    edges = [(t, "a", f"a{i}", "r", "b", f"b{rng.randrange(6)}") for t in range(3) for i in range(60)]
    edges += [(t, "b", f"b{i}", "s", "c", f"c{i % 2}") for t in range(3) for i in range(6)]
    ends = sorted({(t, *end) for t, st, su, _, dt, du in edges for end in ((st, su), (dt, du))})
    attributes = [(t, v, u, "kind", f"k{v}{int(u[1:]) % 3}") for t, v, u in ends if (t, u) != (1, "b1")]
    attributes += [(t, v, u, "name", f"n{u}") for t, v, u in ends if v == "a"]
    return PropertyGraph(
        spark.createDataFrame(ends, VERTICES),
        spark.createDataFrame(attributes, f"{VERTICES}, attr string, value string"),
        spark.createDataFrame(edges, EDGES),
        3,
        closed=True,
    )


def by_choice(found):
    choices, out = sorted(c for c in found.columns if c.endswith(":choice")), defaultdict(set)
    for row in found.collect():
        out[tuple(row[c] for c in choices)].add(tuple(sorted(row.asDict().items())))
    return out


def test_a_choice_of_many_values_is_left_out_by_one_factor(spark, series):
    """No vertex has more than a few tuples, but a name of each vertex alone makes more than the bound."""
    masked, pattern = matching.compress(series), [("a", "r", "b"), ("b", "s", "c")]
    options = dict.fromkeys("abc")
    whole = by_choice(matching.presence_by_choice(masked, pattern, options))
    assert {choice: len(found) > 40 for choice, found in whole.items()} == {("kind",) * 3: False, ("name", "kind", "kind"): True}
    shared = Once()
    some = by_choice(matching.presence_by_choice(masked, pattern, options, 40, shared))
    assert some == {choice: found for choice, found in whole.items() if len(found) <= 40}
    assert len(shared) == 3
    matching.presence_by_choice(masked, [("b", "s", "c")], {"b": None, "c": None}, 40, shared)
    assert len(shared) == 3  # the values at b, and those of c beyond it, were there


def test_values_tell_their_attribute(spark, series):
    values, names, n_attrs = discovery.coded(matching.compress(series).values, 3)
    assert n_attrs == 2
    assert all(r.id % 2 == r.attr_id for r in names.collect()) and names.select("id").distinct().count() == names.count()
    assert rows(values, "attr") == Counter((r.value % 2,) for r in values.collect())


def test_only_edges_that_last_are_folded(spark, series):
    kinds = [PatternEdge("a", "r", "b"), PatternEdge("b", "s", "c")]
    plain = matching.compress(series, kinds, fold=False)
    assert moved(plain.edges) == 0
    kept = discovery.folded(discovery.stored_edges(plain))
    found = Counter((r.rel, r.src_uri, r.dst_uri) for r in kept.edges.collect())
    assert max(n for (rel, _, _), n in found.items() if rel == "s") == 1
    assert sum(n for (rel, _, _), n in found.items() if rel == "r") == 180
    masks = defaultdict(int)
    for r in kept.edges.collect():
        masks[r.src_type, r.src_uri, r.rel, r.dst_type, r.dst_uri] |= r.m0
    assert {(*k, m) for k, m in masks.items()} == {tuple(r) for r in matching.compress(series).edges.collect()}
    assert kept.sizes == {kinds[0]: 180, kinds[1]: 6}


def test_the_centre_is_where_most_rows_are():
    edges = [PatternEdge("c", "l", "n"), PatternEdge("o", "p", "c"), PatternEdge("o", "k", "t")]
    assert matching.center(edges) == "c"
    assert matching.center(edges, {edges[0]: 1, edges[1]: 5, edges[2]: 20}) == "o"


def test_edges_of_one_snapshot_are_not_moved(spark, series):
    one = PropertyGraph(series.vertices, series.attributes.where("snapshot = 0"), series.edges.where("snapshot = 0"), 1, closed=True)
    assert moved(matching.compress(one, [PatternEdge("a", "r", "b")]).edges) == 0


def odd_graph(spark, seed):
    """Two types with links in both directions and within them; copies, nulls and ends that do not exist."""
    rng = random.Random(seed)
    name = lambda: rng.choice([None, *map(str, range(9))])
    vertices = [(rng.randrange(2), rng.choice("ab"), name()) for _ in range(40)]
    edges = [(rng.choice([0, 1, None]), rng.choice(["a", "b", None]), name(), "r", rng.choice("ab"), name()) for _ in range(120)]
    return spark.createDataFrame(vertices, VERTICES), spark.createDataFrame(edges, EDGES)


def test_vertices_of_grids_are_moved_once(spark):
    vertices, edges = odd_graph(spark, 5)
    numbers = (4, 6, 100)
    placed = partitioning.placed_on_grids(edges, numbers)
    assert placed.count() == edges.count()
    found = partitioning.vertices_on_grids(vertices, placed, numbers)
    plain = partitioning.vertices_of_parts(vertices, partitioning.parts_on_grids(edges, numbers), "n_parts")
    names = ("snapshot", "vtype", "uri", "part", "n_parts")
    assert rows(found, *names) == rows(plain, *names)
    assert moved(found) == 1


@pytest.mark.parametrize("n", [3, 70, 600])
def test_parts_of_anchors_with_copies_and_nulls(spark, n):
    vertices, edges = odd_graph(spark, 8)
    graph = PropertyGraph(vertices, vertices, edges, 2)
    vertex_parts, edge_parts = partitioning.parts_by_anchor(graph, "a", n)
    assert all("anchor-edges" in path for path in edge_parts.inputFiles())
    own = vertices.where("vtype = 'a'").select("*", partitioning._anchor_part(F.col("vtype"), F.col("uri"), n).alias("part"))
    part = Counter((r.snapshot, r.uri, r.part) for r in own.collect() if r.uri is not None)
    copies = {(t, u): (p, k) for (t, u, p), k in part.items()}
    expected, gathered = Counter(), {tuple(r) for r in own.collect()}
    known = {tuple(r) for r in vertices.collect()}
    for edge in edges.collect():
        t, st, su, _, dt, du = edge
        found = [copies[t, u] for v, u in ((st, su), (dt, du)) if v == "a" and (t, u) in copies]
        times = 1
        for _, k in found:
            times *= k
        for p in {p for p, _ in found}:
            expected[(*edge, p)] += times
            gathered |= {(t, v, u, p) for v, u in ((st, su), (dt, du)) if (t, v, u) in known and None not in (t, v, u)}
    assert rows(edge_parts, *edges.columns, "part") == expected
    assert rows(vertex_parts, "snapshot", "vtype", "uri", "part") == Counter(gathered)


def test_hash_is_worked_out_once(spark):
    one = spark.createDataFrame([("x",)], "t string")
    assert one.select(rdf.string_hash32(F.col("t")).alias("h"))._jdf.queryExecution().optimizedPlan().toString().count("ascii(substring") <= 20


def test_stored_lines_give_the_same_edges(spark, tmp_path):
    """Repeated orders, lines and pairs, and null keys."""
    tables = {
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_mktsegment string", [(1, "x", 1, "s"), (2, "y", 1, "s")]),
        "nation": ("n_nationkey int, n_name string", [(1, "n")]),
        "part": ("p_partkey long, p_brand string, p_type string", [(1, "b", "t"), (2, "b", "t"), (2, "b", "t")]),
        "supplier": ("s_suppkey long, s_name string", [(1, "s1"), (2, "s2")]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string", None),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long", [(o, p, s) for o in (1, 2, 3, None) for p in (1, 2, None, 1) for s in (1, 2, None, 2)]),
    }
    for name, (schema, found) in tables.items():
        if name == "orders":
            from datetime import datetime

            found = [(o, c, "o", datetime(y, 5, 5), "p") for o, c, y in ((1, 1, 1995), (1, 2, 1996), (2, None, 1995), (2, None, 1995), (3, 1, 1997))]
        spark.createDataFrame(found, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    stored, plain = (star.star_graph(spark, str(tmp_path), keep_lines=keep) for keep in (True, False))
    for name in ("vertices", "attributes", "edges"):
        assert rows(getattr(stored, name), "*") == rows(getattr(plain, name), "*"), name
    contains = stored.edges.where("rel = 'contains'")
    assert contains.count() and moved(contains) == 0


def test_work_together_keeps_its_order_and_errors():
    assert together(lambda n: n * n, range(9)) == [n * n for n in range(9)]
    once, calls = Once(), []
    assert together(lambda n: once.get(n % 2, lambda: calls.append(n) or n % 2), range(20)) == [n % 2 for n in range(20)]
    assert len(calls) == len(once) == 2
    with pytest.raises(ZeroDivisionError):
        together(lambda n: 1 // n, [1, 0])
