"""Ranking, sampling, partitioning and mining against brute force on small graphs."""

import hashlib
import random
from collections import Counter, defaultdict
from dataclasses import replace
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from kairograph.model import EDGE_COLUMNS, EDGE_KEY, PropertyGraph
from kairograph.operators import filters, matching, partitioning, patterns, reduction, sampling
from kairograph.plans import discovery, incremental, ranking
from kairograph.plans.storage import write_table

EDGE_SCHEMA = "snapshot int, src_type string, src_uri string, rel string, dst_type string, dst_uri string"


def edge_frame(spark, rows):
    return spark.createDataFrame(rows, EDGE_SCHEMA)


def md5_order(seed, key):
    return hashlib.md5(chr(31).join([seed, *key]).encode()).hexdigest(), key


@pytest.fixture(scope="module")
def skewed_edges():
    """Two snapshots; one edge is a third of all rows, one hub has another third."""
    rng = random.Random(5)
    rows = []
    for snapshot in (0, 1):
        rows += [(snapshot, "a", "hot", "r", "b", "hot")] * 100
        rows += [(snapshot, "a", f"x{i}", "r", "b", "hub") for i in range(100)]
        rows += [(snapshot, "a", f"x{rng.randrange(40)}", rng.choice("rs"), "b", f"y{rng.randrange(40)}") for _ in range(100)]
    return rows


@pytest.mark.parametrize(
    ("size", "digits"), [(1, 2), (37, 1), (37, 2), (37, 4), (150, 1), (150, 2), (150, 4), (299, 2), (300, 2), (1000, 2)]
)
def test_sample_is_exact_and_follows_the_hash(spark, skewed_edges, size, digits):
    df = edge_frame(spark, skewed_edges)
    got = ranking.first_by_hash(df, ["snapshot"], EDGE_KEY, size, seed="s", digits=digits).collect()
    counted = ranking.first_by_hash(ranking.compact_copies(df), ["snapshot"], EDGE_KEY, size, "copies", "s", digits)
    assert Counter(map(tuple, got)) == Counter(map(tuple, ranking.expand_copies(counted).collect()))
    for snapshot in (0, 1):
        rows = [row for row in skewed_edges if row[0] == snapshot]
        expected = sorted(rows, key=lambda row: md5_order("s", row[1:]))[:size]
        assert Counter(tuple(r) for r in got if r.snapshot == snapshot) == Counter(expected)


def test_rank_with_copies_leaves_no_gaps(spark, skewed_edges):
    df = ranking.compact_copies(edge_frame(spark, skewed_edges))
    for digits in (1, 4):
        rows = ranking.rank_by_hash(df, ["snapshot", "rel"], EDGE_KEY, "copies", digits=digits).collect()
        spans = defaultdict(list)
        for row in rows:
            spans[row.snapshot, row.rel].append((row.rank, row.rank + row.copies))
        for found in spans.values():
            found.sort()
            assert found[0][0] == 0
            assert all(end == start for (_, end), (start, _) in zip(found, found[1:]))


def test_expand_copies_spreads_many(spark, monkeypatch):
    monkeypatch.setattr(ranking, "COPIES_PER_TASK", 10)
    monkeypatch.setattr(ranking, "COPIES_IN_PLACE", 5)
    df = spark.createDataFrame([("few", 3), ("edge", 10), ("many", 95), ("none", 0)], "item string, copies long")
    got = Counter(row.item for row in ranking.expand_copies(df).collect())
    assert got == {"few": 3, "edge": 10, "many": 95}


def test_stable_sample(spark, skewed_edges):
    extra = [(2, *row[1:]) for row in skewed_edges if row[0] == 1 and row[2] != "hot"]
    rows = skewed_edges + extra + [(4, "a", "z", "r", "b", "z")]
    size = 120
    got = sampling.stable_sample_edges(edge_frame(spark, rows), 5, size, "s").collect()
    previous = []
    for snapshot in range(5):
        current = [row[1:] for row in rows if row[0] == snapshot]
        kept = set(current) & set(previous)
        rest = sorted((e for e in current if e not in kept), key=lambda e: md5_order("s", e))
        expected = [*kept, *rest[: max(0, size - len(kept))]]
        assert Counter(tuple(r)[1:] for r in got if r.snapshot == snapshot) == Counter(expected)
        previous = expected


def test_edge_label_parts_are_even(spark, skewed_edges):
    parts = partitioning.parts_by_edge_label(edge_frame(spark, skewed_edges), 4)
    rows = partitioning.edge_rows(parts).collect()
    assert Counter(tuple(r)[:6] for r in rows) == Counter(skewed_edges)
    sizes = Counter((r.snapshot, r.rel, r.part) for r in rows)
    for snapshot, rel in {(r.snapshot, r.rel) for r in rows}:
        counts = [sizes[snapshot, rel, part] for part in range(4)]
        assert max(counts) - min(counts) <= 1


def test_vertex_type_parts_are_even(spark):
    rows = [(0, "a", str(i)) for i in range(31)] + [(0, "b", str(i)) for i in range(6)] + [(1, "a", "0")]
    parts = partitioning.parts_by_vertex_type(spark.createDataFrame(rows, "snapshot int, vtype string, uri string"), 4)
    sizes = Counter((r.snapshot, r.vtype, r.part) for r in parts.collect())
    assert sorted(sizes[0, "a", p] for p in range(4)) == [7, 8, 8, 8]
    assert sorted(sizes[0, "b", p] for p in range(4)) == [1, 1, 2, 2]


@pytest.mark.parametrize("n", range(1, 13))
def test_grid_parts(spark, n):
    rng = random.Random(n)
    pairs = [(rng.randrange(-(2**31), 2**31), rng.randrange(-(2**31), 2**31)) for _ in range(50)]
    pairs += [(0, 0), (-(2**31), 2**31 - 1)]

    def wrapped(number):
        low = number * 1125899906842597 % 2**64
        return abs(low - 2**64 if low >= 2**63 else low)

    def part(src, dst):
        columns = next(c for c in range(1, n + 1) if c * c >= n)
        if columns * columns == n:
            return (wrapped(src) % columns * columns + wrapped(dst) % columns) % n
        rows = -(-n // columns)
        column = wrapped(src) % n // rows
        height = rows if column < columns - 1 else n - rows * (columns - 1)
        return column * rows + wrapped(dst) % height

    df = spark.createDataFrame(pairs, "s long, d long")
    got = df.select("s", "d", partitioning.grid_part(F.col("s"), F.col("d"), n)).collect()
    assert [(s, d, p) for s, d, p in got] == [(s, d, part(s, d)) for s, d in pairs]


def random_graph(spark, seed, snapshots=4):
    """A small graph with repeated edges, hubs, missing and invalid values, over several snapshots."""
    rng = random.Random(seed)
    types = {"a": 6, "b": 5, "c": 4, "d": 3}
    vertices, attributes, edges = [], [], []
    for snapshot in range(snapshots):
        for vtype, count in types.items():
            for i in range(count):
                if rng.random() < 0.85:
                    vertices.append((snapshot, vtype, str(i)))
                    for attr in ("p", "q"):
                        if rng.random() < 0.9:
                            value = rng.choice(["u", "v", "w", "????", ""]) if attr == "p" else f"{vtype}{i}"
                            attributes.append((snapshot, vtype, str(i), attr, value))
        for src, rel, dst in (("a", "r", "b"), ("b", "s", "c"), ("d", "t", "b")):
            for _ in range(12):
                target = 0 if rng.random() < 0.4 else rng.randrange(types[dst])
                edges.append((snapshot, src, str(rng.randrange(types[src])), rel, dst, str(target)))
    return PropertyGraph(
        spark.createDataFrame(vertices, "snapshot int, vtype string, uri string"),
        spark.createDataFrame(attributes, "snapshot int, vtype string, uri string, attr string, value string"),
        edge_frame(spark, edges),
        snapshots,
    ), (vertices, attributes, edges)


def lasting_graph(spark, seed, snapshots):
    """A graph of which most edges and values go on from snapshot to snapshot."""
    rng = random.Random(seed)
    _, (vertices, attributes, edges) = random_graph(spark, seed, 1)
    times = range(snapshots)
    attributes = [(t, *row[1:4], row[4] if rng.random() < 0.9 else f"other{t}") for t in times for row in attributes]
    return PropertyGraph(
        spark.createDataFrame([(t, *row[1:]) for t in times for row in vertices], "snapshot int, vtype string, uri string"),
        spark.createDataFrame(attributes, "snapshot int, vtype string, uri string, attr string, value string"),
        edge_frame(spark, [(t, *row[1:]) for t in times for row in edges if rng.random() < 0.85]),
        snapshots,
    )


def brute_matches(data, pattern, snapshot):
    """Instances as {type: uri}, copies of edges included."""
    vertices = {v[1:] for v in data[0] if v[0] == snapshot}
    found = [{}]
    for src, rel, dst in pattern:
        rows = [e for e in data[2] if e[0] == snapshot and (e[1], e[3], e[4]) == (src, rel, dst)]
        rows = [e for e in rows if (src, e[2]) in vertices and (dst, e[5]) in vertices]
        found = [
            {**m, src: e[2], dst: e[5]}
            for m, e in product(found, rows)
            if m.get(src, e[2]) == e[2] and m.get(dst, e[5]) == e[5]
        ]
    return found


def brute_presence(data, pattern, dependency, snapshots):
    values = {row[:4]: row[4] for row in data[1]}
    seen = defaultdict(set)
    for snapshot in range(snapshots):
        for match in brute_matches(data, pattern, snapshot):
            found = tuple(values.get((snapshot, t, match[t], a), "") for t, a in dependency)
            if not any(value in ("", "????") for value in found):
                seen[found].add(snapshot)
    return seen


PATTERNS = [
    [("a", "r", "b"), ("b", "s", "c")],
    [("a", "r", "b"), ("d", "t", "b")],
    [("a", "r", "b"), ("b", "s", "c"), ("d", "t", "b")],
    [("a", "r", "b")],
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_matching_against_brute_force(spark, pattern):
    from kairograph.functions import temporal

    graph, data = random_graph(spark, 3)
    types = sorted({t for e in pattern for t in (e[0], e[2])})
    expected = [brute_matches(data, pattern, t) for t in range(4)]
    matches = matching.motif_match(graph, pattern).collect()
    names = [f"{t}_uri" for t in types]
    got = Counter((r.snapshot, *[r[n] for n in names]) for r in matches)
    assert got == Counter((t, *[m[x] for x in types]) for t in range(4) for m in expected[t])
    counts = {r.snapshot: r.n for r in matching.instance_counts(graph, pattern).collect()}
    assert counts == {t: len(found) for t, found in enumerate(expected) if found}
    dependency = [(t, "pq"[i % 2]) for i, t in enumerate(types)]
    tuples = matching.presence_by_tuple(matching.compress(graph), pattern, dependency)
    rows = tuples.select(*[matching.column_name(a) for a in dependency], temporal.occurrences(4).alias("seen")).collect()
    assert {tuple(r)[:-1]: set(r.seen) for r in rows} == brute_presence(data, pattern, dependency, 4)


def test_presence_for_some_types_only(spark):
    from kairograph.functions import temporal

    graph, data = random_graph(spark, 4)
    pattern, dependency = PATTERNS[2], [("a", "p"), ("c", "q")]
    tuples = matching.presence_by_tuple(matching.compress(graph), pattern, dependency)
    rows = tuples.select("a_p", "c_q", temporal.occurrences(4).alias("seen")).collect()
    assert {tuple(r)[:-1]: set(r.seen) for r in rows} == brute_presence(data, pattern, dependency, 4)


def test_patterns_must_be_connected_trees(spark):
    graph, _ = random_graph(spark, 3, 1)
    with pytest.raises(ValueError, match="connected"):
        matching.motif_match(graph, [("a", "r", "b"), ("c", "s", "d")])
    with pytest.raises(ValueError, match="tree"):
        matching.instance_counts(graph, [("a", "r", "b"), ("a", "s", "b")])


@pytest.mark.parametrize("snapshots", [4, 66])
def test_discovery_against_brute_force(spark, snapshots):
    graph, data = random_graph(spark, 7, snapshots)
    options = {"a": ["p", "q"], "b": ["q"], "c": ["p"], "d": ["q"]}
    found = discovery.discover(graph, k=3, min_count=1, attributes=options, prune=False).collect()
    edges = [("a", "r", "b"), ("b", "s", "c"), ("d", "t", "b")]
    expected = {}
    for size in (2, 3):
        for pattern in combinations(edges, size):
            types = sorted({t for e in pattern for t in (e[0], e[2])})
            for attrs in product(*[options[t] for t in types]):
                dependency = list(zip(types, attrs))
                seen = brute_presence(data, pattern, dependency, snapshots)
                for i, (vtype, attr) in enumerate(dependency):
                    groups = defaultdict(list)
                    for values in seen:
                        groups[values[:i] + values[i + 1 :]].append(values)
                    for lhs, rows in groups.items():
                        times = sorted(seen[rows[0]])
                        if len(rows) == 1 and len(times) >= 2:
                            lhs_map = tuple(
                                (f"{t}.{a}", v) for (t, a), v in zip(dependency[:i] + dependency[i + 1 :], lhs)
                            )
                            gaps = [b - a for a, b in zip(times, times[1:])]
                            pairs = len(times) * (len(times) - 1) / 2
                            expected[
                                size, patterns.make_pattern(pattern).pattern_id, lhs_map, f"{vtype}.{attr}", rows[0][i]
                            ] = (
                                min(gaps),
                                times[-1] - times[0],
                                len(times),
                                len(seen),
                                pytest.approx(pairs / (len(seen) * snapshots * (snapshots + 1) / 2)),
                            )
    got = {
        (r.level, r.pattern_id, tuple(sorted(r.lhs.items())), r.rhs_attr, r.rhs_value): (
            r.delta_min,
            r.delta_max,
            r.n_present,
            r.n_tuples,
            r.support,
        )
        for r in found
    }
    assert len(got) == len(found) and expected
    assert got == {(k[0], k[1], tuple(sorted(k[2])), *k[3:]): v for k, v in expected.items()}


@pytest.mark.parametrize("pattern", PATTERNS)
def test_full_reduction_against_brute_force(spark, pattern):
    """What is left is what matches use; matches from it are the same."""
    graph, data = random_graph(spark, 5)
    found = [(t, m) for t in range(4) for m in brute_matches(data, pattern, t)]
    tables = reduction.reduced_edges(graph, pattern)
    for (src, _, dst), rows in tables.items():
        got = {tuple(r) for r in rows.collect()}
        assert got == {(t, m[src], m[dst]) for t, m in found}
    types = sorted({t for e in pattern for t in (e[0], e[2])})
    names = ["snapshot", *[f"{t}_uri" for t in types]]
    plain, reduced = (matching.motif_match(graph, pattern, t).select(*names) for t in (None, tables))
    assert Counter(map(tuple, plain.collect())) == Counter(map(tuple, reduced.collect()))
    support = reduction.image_support(graph, patterns.make_pattern(pattern)).first().support
    assert support == min((len({m[t] for _, m in found}) for t in types), default=0)


def test_supported_growth_equals_the_filtered_lattice(spark):
    graph, data = random_graph(spark, 7)
    edges = [("a", "r", "b"), ("b", "s", "c"), ("d", "t", "b")]
    support = {}
    for size in (1, 2, 3):
        for pattern in combinations(edges, size):
            found = [m for t in range(4) for m in brute_matches(data, pattern, t)]
            types = {t for e in pattern for t in (e[0], e[2])}
            support[patterns.make_pattern(pattern)] = min((len({m[t] for m in found}) for t in types), default=0)
    values = sorted(set(support.values()))
    assert len(values) > 1
    for least in (0, values[-1], 100):
        levels = discovery.supported_patterns(graph, 3, least, min_count=1)
        got = {p: n for level in levels for p, n in level}
        assert got == {p: n for p, n in support.items() if n >= least}
    found = discovery.discover(graph, k=3, min_count=1, min_support=values[1]).select("pattern_id").distinct().collect()
    assert {r.pattern_id for r in found} <= {p.pattern_id for p, n in support.items() if n >= values[1] and len(p.edges) > 1}


@pytest.mark.parametrize("theta", [1e-4, 2e-3, 6e-3, 2e-2, 0.3])
def test_threshold_leaves_out_choices_but_no_result(spark, theta):
    graph, _ = random_graph(spark, 7, 66)
    whole = discovery.discover(graph, k=3, min_count=1, prune=False)
    text = lambda df: {tuple(str(x) for x in r) for r in df.collect()}
    assert text(discovery.discover(graph, k=3, min_count=1, prune=False, theta=theta)) == text(whole.where(F.col("support") >= theta))


def test_a_hub_of_many_values_is_not_multiplied(spark):
    """Two branches of 10^5 values meet in one vertex: 10^10 tuples, which a threshold rules out before they are made."""
    n = 100_000
    ids = spark.range(n).select(F.col("id").cast("string").alias("i"))
    both = ids.crossJoin(spark.range(2).select(F.col("id").cast("int").alias("snapshot")))
    hub = spark.createDataFrame([(t, "c", "hub") for t in range(2)], "snapshot int, vtype string, uri string")
    vertices, edges = [hub], []
    for vtype, rel in (("a", "r"), ("b", "s")):
        vertices.append(both.select("snapshot", F.lit(vtype).alias("vtype"), F.col("i").alias("uri")))
        edges.append(both.select("snapshot", F.lit(vtype).alias("src_type"), F.col("i").alias("src_uri"), F.lit(rel).alias("rel"), F.lit("c").alias("dst_type"), F.lit("hub").alias("dst_uri")))
    vertices = vertices[0].unionByName(vertices[1]).unionByName(vertices[2])
    names = vertices.select("*", F.lit("name").alias("attr"), F.concat("vtype", "uri").alias("value"))
    kinds = vertices.select("*", F.lit("kind").alias("attr"), F.concat(F.lit("k"), F.pmod(F.hash("uri"), F.lit(3))).alias("value"))
    graph = PropertyGraph(vertices, names.unionByName(kinds), edges[0].unionByName(edges[1]), 2, closed=True)
    found = discovery.discover(graph, k=2, theta=1e-3, min_count=1, prune=False)
    rows = found.collect()
    # Only the choices of few values are left: kinds on both sides, with either attribute of the hub.
    assert {r.n_tuples for r in rows} <= {9} and rows
    assert all(r.support >= 1e-3 for r in rows)


def test_a_growing_series_equals_the_whole_one(spark, tmp_path):
    """After every addition, what is reported is what mining all snapshots so far finds."""
    graph = lasting_graph(spark, 7, 3)
    folder = str(tmp_path / "state")
    text = lambda df: Counter(tuple(str(x) for x in r) for r in df.collect())
    incremental.begin(incremental.one_snapshot(graph, 0), folder, k=3, min_count=1, prune=False)
    assert incremental.report(spark, folder).count() == 0
    before = None
    for number in range(3):
        if number == 2:  # an addition that was stopped before its end leaves rows that do not count
            wrong = spark.createDataFrame([(2, "x", ["a"], 0, ["b"], 1, "c")], incremental._GROUPS.removesuffix(", snapshot int"))
            wrong.write.parquet(f"{folder}/groups/snapshot=2")
            assert text(incremental.report(spark, folder)) == before
        assert incremental.add_snapshot(incremental.one_snapshot(graph, number), folder) == number
        assert incremental.length(spark, folder) == number + 1
        so_far = F.col("snapshot") <= number
        tables = {name: getattr(graph, name).where(so_far) for name in ("vertices", "attributes", "edges")}
        found = text(incremental.report(spark, folder))
        whole = discovery.discover(replace(graph, **tables, n_snapshots=number + 1), k=3, min_count=1, prune=False)
        assert found == text(whole)
        assert number == 0 or found != before
        before = found
    supports = sorted(r.support for r in incremental.report(spark, folder).collect())
    theta = supports[len(supports) // 2]
    assert supports[0] < theta
    assert [r for r in supports if r >= theta] == sorted(r.support for r in incremental.report(spark, folder, theta).collect())
    with pytest.raises(ValueError, match="at a time"):
        incremental.add_snapshot(graph, folder)
    with pytest.raises(Exception, match="already exists"):
        incremental.begin(incremental.one_snapshot(graph, 0), folder, k=3, min_count=1)


def test_a_series_longer_than_a_mask_word(spark, tmp_path):
    """One tuple seen at 0, 61, 62 and 70 of 71 snapshots, and a group that a second tuple joins at 70."""
    folder = str(tmp_path / "state")
    spark.range(71).select(F.col("id").cast("int").alias("snapshot")).write.parquet(f"{folder}/added")
    rows = [(2, "x", ["a", "b", "c"], 0, ["p", "q"], int(t == 0), "u", t) for t in (0, 61, 62, 70)]
    rows += [(2, "x", ["a", "b", "c"], 1, ["u", "q"], 1, v, t) for v, t in (("p", 0), ("o", 70))]
    spark.createDataFrame(rows, incremental._GROUPS).write.partitionBy("snapshot").parquet(f"{folder}/groups")
    (row,) = incremental.report(spark, folder).collect()
    assert (row.lhs, row.rhs_attr, row.rhs_value) == ({"b": "p", "c": "q"}, "a", "u")
    assert (row.delta_min, row.delta_max, row.n_present, row.n_tuples) == (1, 70, 4, 1)
    assert row.support == pytest.approx(6 / (71 * 72 / 2))


def test_theta_and_empty_results(spark):
    graph, _ = random_graph(spark, 7)
    assert discovery.discover(graph, k=2, min_count=10**6).count() == 0
    assert discovery.discover(graph, k=2, theta=1.0, min_count=1).count() == 0


def test_pattern_growth_follows_the_ranking():
    types = ["order", "part", "customer", "supplier", "nation"]
    frequent = [
        ("order", "contains", "part"),
        ("supplier", "supplies", "part"),
        ("order", "placed_by", "customer"),
        ("customer", "located_in", "nation"),
    ]
    levels = patterns.grow_patterns(types, frequent, 2)
    rels = [[sorted(e.rel for e in p.edges) for p in level] for level in levels[1:]]
    assert rels[0] == [["contains"], ["placed_by"], ["supplies"], ["located_in"]]
    assert rels[1] == [["contains", "supplies"], ["contains", "placed_by"], ["located_in", "placed_by"]]


def test_lattice_equals_unpruned_growth(spark):
    types = ["a", "b", "c", "d"]
    edges = [("a", "r", "b"), ("b", "s", "c"), ("d", "t", "b"), ("c", "u", "a"), ("a", "v", "b")]
    grown = patterns.grow_patterns(types, edges, 3, prune=False)
    lattice = patterns.pattern_lattice(
        spark.createDataFrame([(t,) for t in types], "vtype string"),
        spark.createDataFrame(edges, "src_type string, rel string, dst_type string"),
        3,
    ).collect()
    expected = {(level, p.pattern_id) for level, found in enumerate(grown) for p in found}
    assert {(r.level, r.pattern_id) for r in lattice} == expected
    assert len(lattice) == len(expected)


def test_hub_filter_counts_edges_from_unknown_sources(spark):
    vertices = spark.createDataFrame([(0, "m", "1"), (0, "m", "2"), (0, "x", "1")], "snapshot int, vtype string, uri string")
    attributes = vertices.select("*", F.lit("name").alias("attr"), F.lit("n").alias("value"))
    rows = [(0, "x", str(i), "r", "m", "1") for i in range(3)] + [(0, "x", "1", "r", "m", "2")]
    graph = PropertyGraph(vertices, attributes, edge_frame(spark, rows), 1)
    kept = filters.without_hubs(graph, "m", 2)
    assert [tuple(r) for r in kept.edges.collect()] == [(0, "x", "1", "r", "m", "2")]
    assert {(r.vtype, r.uri) for r in kept.vertices.collect()} == {("m", "2"), ("x", "1")}
    assert kept.attributes.count() == 2


def test_skewed_join_is_split(spark, tmp_path):
    """The adaptive planner splits a hub that holds a third of all edges."""
    from kairograph.operators.assembly import edges_within

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    old = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        ids = spark.range(60000)
        hub = F.when(F.col("id") % 3 == 0, "hub").otherwise(F.col("id").cast("string"))
        edges = ids.select(
            F.lit(0).alias("snapshot"),
            F.lit("a").alias("src_type"),
            hub.alias("src_uri"),
            F.lit("r").alias("rel"),
            F.lit("b").alias("dst_type"),
            F.col("id").cast("string").alias("dst_uri"),
        )
        edges = write_table(edges.repartition(16), "skew-test")
        vertices = write_table(
            edges.select("snapshot", F.col("src_type").alias("vtype"), F.col("src_uri").alias("uri"))
            .unionByName(edges.select("snapshot", F.col("dst_type").alias("vtype"), F.col("dst_uri").alias("uri")))
            .distinct(),
            "skew-vertices",
        )
        joined = edges_within(edges, vertices)
        assert len(joined.collect()) == 60000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in old.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def test_instance_counts_beyond_long_on_the_way(spark):
    """A product of two branches is taken in decimals; only a final count beyond LONG is an error."""
    big = spark.createDataFrame([(0, "h", "3100000000"), (0, "k", "2")], "snapshot int, uri string, n string")
    big = big.withColumn("n", F.col("n").cast(matching.COUNT))
    product = (F.col("n") * F.col("n")).cast(matching.COUNT)
    assert str(big.select(product.alias("p")).agg(F.max("p")).first()[0]) == str(3100000000**2)


def test_discovery_moves_numbers_and_no_names(spark, tmp_path_factory, monkeypatch):
    """The tuples of a level, which are most of its rows, are stored as longs."""
    folder = tmp_path_factory.mktemp("coded")
    monkeypatch.setattr(discovery, "new_path", lambda _, name: f"{folder}/{name}")
    discovery.discover(random_graph(spark, 7)[0], k=3, min_count=1, prune=False)
    for level in (2, 3):
        types = dict(spark.read.parquet(f"{folder}/tuples-{level}").dtypes)
        assert len([name for name in types if name.startswith("value")]) == level + 1
        assert set(types.values()) == {"int", "bigint"}
