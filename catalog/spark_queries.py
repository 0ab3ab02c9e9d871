"""One Spark query per operator, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import star_graph as star
from kairograph.functions import rdf, temporal
from kairograph.model import EDGE_COLUMNS, EDGE_KEY, VERTEX_KEY, PropertyGraph
from kairograph.operators import assembly, dependencies, filters, matching, partitioning, patterns, profile
from kairograph.operators import rdf_graph, reduction, sampling
from kairograph.plans import discovery, incremental, jobs
from kairograph.plans.storage import new_path
from kairograph.session import configure
from kairograph.sources import ntriples, statements, turtle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MIN_COUNT = 100
N_PARTS = 4
GRID_PARTS = 6
SAMPLE_SIZE = 500
STABLE_SIZE = 5000
HUB_TYPE, HUB_DEGREE = "part", 10
HIGH_DEGREE = 12
THETA = 2e-5
THETA_THREE = 1e-4
MIN_IMAGES = 20

CONTAINS = ("order", "contains", "part")
SUPPLIES = ("supplier", "supplies", "part")
PLACED_BY = ("order", "placed_by", "customer")
LOCATED_IN = ("customer", "located_in", "nation")
HOME_PATTERN = [PLACED_BY, LOCATED_IN]
HOME_DEPENDENCY = [("order", "priority"), ("customer", "name"), ("nation", "name")]
HOME_NAMES = [matching.column_name(attribute) for attribute in HOME_DEPENDENCY]
BUY_PATTERN = [CONTAINS, PLACED_BY]
BUY_DEPENDENCY = [("order", "status"), ("part", "brand"), ("customer", "name")]


def query(function: Query) -> Query:
    """Register a query under the name of its function."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


def count_rows(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def map_text(column: str) -> Column:
    """A map as sorted `key=value` text."""
    entries = F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.array_join(F.sort_array(entries), ";")


def snapshot_list(n_snapshots: int) -> Column:
    return F.array_join(temporal.occurrences(n_snapshots), ",")


def length(spark: SparkSession, sf_dir: str) -> int:
    """Number of snapshots of the series."""
    return star.series(spark, sf_dir)[1]


def graph_rows(graph: PropertyGraph) -> DataFrame:
    """A whole graph as one table (kind, snapshot, item)."""
    items = {
        "vertex": (graph.vertices, F.concat_ws("/", "vtype", "uri")),
        "attribute": (graph.attributes, F.concat_ws("/", "vtype", "uri", "attr", "value")),
        "edge": (graph.edges, F.concat_ws("/", *EDGE_KEY)),
    }
    rows = [df.select(F.lit(kind).alias("kind"), "snapshot", item.alias("item")) for kind, (df, item) in items.items()]
    return reduce(DataFrame.unionByName, rows)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntriples.parse_triples(star.text_lines(spark, sf_dir), None)


def text_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph read from its text form, with foreign subjects and dangling edges."""
    return jobs.parsed_graph(parsed(spark, sf_dir), length(spark, sf_dir))


def all_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.parse_statements(star.statement_lines(spark, sf_dir))


def stored_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed once, for queries that read them several times."""
    return jobs.write_table(all_statements(spark, sf_dir), "statements", ["kind"])


def home_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = matching.compress(star.star_graph(spark, sf_dir))
    return matching.presence_by_tuple(masked, HOME_PATTERN, HOME_DEPENDENCY)


def home_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = dependencies.as_value_arrays(home_tuples(spark, sf_dir), HOME_NAMES)
    return dependencies.lhs_groups(values, len(HOME_NAMES), length(spark, sf_dir))


# --- sources and sinks ---------------------------------------------------------------


@query
def scan_ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "scan")
    ntriples.text_writer(star.text_lines(spark, sf_dir).select("line"), "gzip").text(f"{path}/imdb-170909.nt")
    return ntriples.scan_lines(spark, f"{path}/imdb-170909.nt")


@query
def snapshot_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = star.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    # From the last day of the month, so that shorter months show.
    bounds = order.agg(F.last_day(F.min("date")).alias("start"), F.max("date").alias("end"))
    named = ntriples.name_snapshots(bounds, "start", "end").withColumn("month", F.trunc("snapshot_date", "month"))
    per_month = count_rows(order, F.trunc("date", "month").alias("month"))
    joined = named.join(per_month, "month", "left")
    return joined.select("snapshot", "snapshot_date", "file_name", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query
def load_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "snapshots")
    named = star.text_lines(spark, sf_dir).select(star.file_name(F.col("snapshot")).alias("file"), "line")
    ntriples.write_lines(named, path, "gzip")
    # The folder names carry the column name; it is part of the prefix.
    last = star.last_file_date(length(spark, sf_dir))
    lines, _ = ntriples.load_snapshots(spark, f"{path}/file=", star.FIRST_FILE_DATE, last)
    return ntriples.parse_triples(lines, star.TYPES)


@query
def scan_ntriples_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "folder")
    named = star.text_lines(spark, sf_dir).select(star.file_name(F.col("snapshot")).alias("file"), "line")
    ntriples.write_lines(named, path, "gzip")
    lines, names = ntriples.load_folder(spark, path)
    return lines.select(F.get(F.array(*[F.lit(name) for name in names]), "snapshot").alias("file_name"), "line")


@query
def scan_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = new_path(spark, "statements")
    lines = jobs.write_table(star.statement_lines(spark, sf_dir), "statement-lines", ["year", "kind"])
    for year in statements.YEARS:
        for kind in statements.KINDS:
            wanted = (F.col("year") == year) & (F.col("kind") == kind)
            lines.where(wanted).select("line").write.text(statements.statement_path(base, year, kind))
    return statements.scan_statements(spark, base)


@query
def scan_turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = new_path(spark, "turtle")
    blocks = jobs.write_table(star.turtle_blocks(star.statement_lines(spark, sf_dir)), "turtle-blocks", ["year", "kind"])
    header = "".join(f"@prefix {name}: <{iri}> .\n" for name, iri in star.TURTLE_PREFIXES.items())
    first = F.monotonically_increasing_id().bitwiseAND(2**33 - 1) == 0  # of its task, and so of its file
    for year in statements.YEARS:
        for kind in statements.KINDS:
            wanted = blocks.where((F.col("year") == year) & (F.col("kind") == kind))
            text = F.concat(F.when(first, header).otherwise(""), F.col("text"))
            wanted.select(text.alias("value")).write.text(statements.statement_path(base, year, kind))
    found, rejected = turtle.scan_turtle(spark, base)
    lost = rejected.select("year", "kind", *[F.lit(None).cast("string").alias(name) for name in ("subject", "predicate", "object")])
    return found.unionByName(lost)


@query
def sink_ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "sink")
    lines = jobs.graph_lines(star.star_graph(spark, sf_dir, keep_lines=True))
    ntriples.write_lines(lines.select(star.file_name(F.col("snapshot")).alias("file"), "line"), path, "gzip")
    return ntriples.scan_lines(spark, path)


@query
def part_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = star.orders(spark, sf_dir)
    plain = F.concat(F.lit("plain"), F.col("snapshot").cast("string"))
    name = F.when(F.col("o_orderkey") % 2 == 0, star.file_name(F.col("snapshot"))).otherwise(plain)
    part = (F.col("o_custkey") % N_PARTS).cast("int")
    rows = order.select(name.alias("file_name"), part.alias("part"))
    return count_rows(rows.withColumn("name", rdf.part_file_name(F.col("file_name"), F.col("part"))), "file_name", "name")


@query
def sink_tgfds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "dependencies")
    discover_tgfds(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


# --- parsing and scalar functions ----------------------------------------------------


@query
def parse_triples_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = star.text_lines(spark, sf_dir)
    return ntriples.parse_triples(lines, ("order", "nation", "/part/"))


@query
def parse_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir)


@query
def parse_triples_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntriples.parse_triples(star.text_lines(spark, sf_dir), None, strip_xsd=False)


def _uri_column(spark: SparkSession, sf_dir: str, position: int, name: str) -> DataFrame:
    uris = rdf.uris_in(rdf.strip_terminator(F.col("line")))
    return star.text_lines(spark, sf_dir).select(F.get(uris, F.lit(position)).alias(name)).where(F.col(name).isNotNull())


@query
def predicate_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicates = _uri_column(spark, sf_dir, 1, "predicate")
    return count_rows(predicates, "predicate", rdf.local_name(F.col("predicate")).alias("name"))


@query
def uri_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects = count_rows(_uri_column(spark, sf_dir, 0, "subject"), "subject")
    subject = F.col("subject")
    return subjects.select("subject", rdf.vertex_type(subject).alias("vtype"), rdf.vertex_name(subject).alias("uri"), "n")


@query
def vertex_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices = star.star_graph(spark, sf_dir).vertices.select("vtype", "uri").distinct()
    return vertices.withColumn("vertex_id", rdf.vertex_id(F.col("uri"), F.col("vtype")))


@query
def project_dependency_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star.star_graph(spark, sf_dir)
    matches = matching.motif_match(graph, HOME_PATTERN)
    wanted = [("order", "priority"), ("customer", "segment"), ("nation", "unknown")]
    projected = matching.dependency_columns(matches, graph.attributes, wanted)
    return count_rows(projected, "snapshot", *[matching.column_name(a) for a in wanted])


@query
def last_uri_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = all_statements(spark, sf_dir)
    return count_rows(rows, "predicate", rdf.last_uri_part(F.col("object")).alias("last_part"))


@query
def literal_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = all_statements(spark, sf_dir).where(F.col("kind") == "literals")
    return count_rows(rows, "object", rdf.literal_lexical(F.col("object")).alias("lexical"))


@query
def clean_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = assembly.of_kind(parsed(spark, sf_dir), "attribute").select(F.col("object").alias("value"))
    return count_rows(values, "value", rdf.clean_literal(F.col("value")).alias("cleaned"))


@query
def format_vertex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntriples.format_attributes(assembly.build_attributes(parsed(spark, sf_dir)))


@query
def format_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntriples.format_edges(assembly.build_edges(parsed(spark, sf_dir)))


@query
def rdf_type_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf_graph.rdf_type_names(all_statements(spark, sf_dir))


@query
def attr_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = assembly.vertex_maps(star.star_graph(spark, sf_dir).attributes)
    keys = maps.select("snapshot", "vtype", F.explode(F.map_keys("attributes")).alias("attr"))
    return count_rows(keys, "snapshot", "vtype", "attr")


# --- filters -------------------------------------------------------------------------


@query
def split_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = parsed(spark, sf_dir)
    attributes = count_rows(assembly.of_kind(triples, "attribute"), "snapshot", "kind")
    return attributes.unionByName(count_rows(assembly.of_kind(triples, "edge"), "snapshot", "kind"))


@query
def drop_invalid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_invalid_values(star.star_graph(spark, sf_dir).attributes)


@query
def statement_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rdf_graph.is_type_statement() | rdf_graph.is_attribute_statement() | rdf_graph.is_edge_statement()
    return count_rows(all_statements(spark, sf_dir).where(kept), "year", "kind", "predicate")


@query
def non_null_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = text_graph(spark, sf_dir)
    holed = replace(
        graph,
        vertices=graph.vertices.withColumn("vtype", F.nullif("vtype", F.lit(rdf.UNKNOWN_TYPE))),
        attributes=graph.attributes.withColumn("vtype", F.nullif("vtype", F.lit(rdf.UNKNOWN_TYPE))),
        edges=graph.edges.withColumn("rel", F.nullif("rel", F.lit("placed_on"))),
    )
    kept = filters.non_null_graph(holed)
    return graph_rows(kept)


@query
def filter_hub_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_rows(filters.without_hubs(jobs.stored_graph(star.star_graph(spark, sf_dir, keep_lines=True)), HUB_TYPE, HUB_DEGREE))


@query
def filter_high_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_rows(filters.without_high_degree(jobs.stored_graph(star.star_graph(spark, sf_dir, keep_lines=True)), HIGH_DEGREE))


@query
def vertices_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.vertices_of_type(star.star_graph(spark, sf_dir).vertices, "customer")


@query
def edges_valid_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = text_graph(spark, sf_dir)
    return assembly.edges_within(graph.edges, graph.vertices).select(*EDGE_COLUMNS)


# --- graph assembly ------------------------------------------------------------------


@query
def build_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = assembly.vertex_maps(assembly.build_attributes(parsed(spark, sf_dir)))
    return maps.select(*VERTEX_KEY, map_text("attributes").alias("attributes"))


@query
def build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.build_edges(parsed(spark, sf_dir))


@query
def integrate_rdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = rdf_graph.integrate_rdf(stored_statements(spark, sf_dir))
    maps = assembly.vertex_maps(graph.attributes).withColumn("attributes", map_text("attributes"))
    with_maps = graph.vertices.join(maps, VERTEX_KEY, "left")
    full = with_maps.join(profile.degrees(graph.edges), VERTEX_KEY, "left")
    counts = [F.coalesce(name, F.lit(0)).alias(name) for name in ("in_degree", "out_degree")]
    return full.select(*VERTEX_KEY, F.coalesce("attributes", F.lit("")).alias("attributes"), *counts)


@query
def integrated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.integrated_lines(stored_statements(spark, sf_dir))


@query
def connected_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_rows(assembly.connected_graph(text_graph(spark, sf_dir)))


@query
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.graph_counts(text_graph(spark, sf_dir))


@query
def statement_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with the number of their statements, their statements, and labelled edges, as one table."""
    rows = stored_statements(spark, sf_dir)
    subjects = rdf_graph.statement_vertices(rows).select(
        "year", "subject", F.lit("").alias("predicate"), F.col("n_statements").cast("string").alias("object")
    )
    kinds = {
        "subject": subjects,
        "statement": rdf_graph.subject_statements(rows),
        "edge": rdf_graph.statement_edges(rows),
    }
    return reduce(DataFrame.unionByName, [df.withColumn("kind", F.lit(kind)) for kind, df in kinds.items()])


@query
def restrict_vertices_to_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star.star_graph(spark, sf_dir)
    return assembly.vertices_on_edges(graph.vertices, graph.edges.where(F.col("rel") == "contains"))


# --- joins ---------------------------------------------------------------------------


@query
def motif_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.motif_match(star.star_graph(spark, sf_dir), HOME_PATTERN)


def _payload_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with the attributes of their ends as text, which is made once per vertex, before it goes to the edges."""
    graph = star.star_graph(spark, sf_dir, keep_lines=True)
    maps = assembly.vertex_maps(graph.attributes).withColumn("attributes", map_text("attributes"))
    return assembly.edges_with_vertices(graph.edges, maps)


@query
def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rows(_payload_edges(spark, sf_dir), "snapshot", "rel", "src_attributes", "dst_attributes")


@query
def edges_with_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payload_edges(spark, sf_dir).select(*EDGE_COLUMNS, "src_attributes", "dst_attributes")


@query
def typed_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.typed_degrees(star.star_graph(spark, sf_dir), "part")


# --- aggregations --------------------------------------------------------------------


@query
def vertex_type_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.vertex_type_histogram(star.star_graph(spark, sf_dir))


@query
def edge_type_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.edge_label_histogram(star.star_graph(spark, sf_dir))


@query
def attribute_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.attribute_histogram(star.star_graph(spark, sf_dir))


@query
def type_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.type_attributes(star.star_graph(spark, sf_dir).attributes)
    return rows.withColumn("attrs", F.array_join("attrs", ","))


@query
def predicate_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.descending(profile.label_counts(assembly.build_edges(parsed(spark, sf_dir))), "snapshot", "rel")


@query
def edge_combo_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.descending(profile.edge_type_counts(text_graph(spark, sf_dir)), "snapshot", "src_type", "rel", "dst_type")


@query
def frequent_edge_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.frequent_edge_types(star.star_graph(spark, sf_dir), min_count=MIN_COUNT)


@query
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.degrees(star.star_graph(spark, sf_dir).edges)


@query
def typed_degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.typed_degree_stats(star.star_graph(spark, sf_dir), "customer")


@query
def max_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.max_degrees(star.star_graph(spark, sf_dir).edges)


@query
def degree_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.degree_distribution(profile.degrees(star.star_graph(spark, sf_dir).edges))


@query
def vertex_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.vertex_type_counts(text_graph(spark, sf_dir).vertices)


@query
def rdf_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rows(rdf_graph.rdf_type_names(all_statements(spark, sf_dir)), "year", "type_name")


@query
def presence_by_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return home_tuples(spark, sf_dir).select(*HOME_NAMES, snapshot_list(length(spark, sf_dir)).alias("snapshots"))


@query
def constant_fd_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    lhs = F.array_join("lhs", "|").alias("lhs")
    seen = snapshot_list(length(spark, sf_dir)).alias("snapshots")
    return home_groups(spark, sf_dir).select("rhs", lhs, "n", "rhs_value", seen)


@query
def tuple_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dependencies of a pattern from one pass over its edges."""
    masked = matching.compress(star.star_graph(spark, sf_dir))
    options = {"order": ["status", "priority"], "customer": ["name", "segment"], "nation": ["name"]}
    tuples = matching.presence_by_choice(masked, HOME_PATTERN, options)
    chosen = [F.concat(F.lit(f"{vtype}."), F.col(f"`{matching.choice_name(vtype)}`")) for vtype in options]
    return count_rows(tuples, F.concat_ws(",", *chosen).alias("dependency"))


# --- sampling ------------------------------------------------------------------------


@query
def sample_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = jobs.write_table(star.star_graph(spark, sf_dir).edges, "edges")
    return sampling.sample_edges(edges, SAMPLE_SIZE, seed="s1")


@query
def stable_sample_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = jobs.write_table(star.star_graph(spark, sf_dir, keep_lines=True).edges, "edges")
    return sampling.stable_sample_edges(edges, length(spark, sf_dir), STABLE_SIZE, seed="s2")


@query
def custom_graph_imdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = star.text_lines(spark, sf_dir)
    graph = jobs.sample_movie_graph(lines, length(spark, sf_dir), STABLE_SIZE, star.TYPES, anchor="nation", max_in=HUB_DEGREE, seed="s3")
    return jobs.graph_lines(graph)


@query
def custom_graph_dbpedia(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = star.text_lines(spark, sf_dir, rdf.DBPEDIA_NAMESPACE)
    graph = jobs.sample_encyclopedia_graph(lines, length(spark, sf_dir), STABLE_SIZE, HIGH_DEGREE, seed="s4")
    return jobs.graph_lines(graph, rdf.DBPEDIA_NAMESPACE)


# --- set operations and partitions ---------------------------------------------------


def _edges_and_last(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The edges of every snapshot, and those of the snapshot before it under the same number."""
    edges = star.star_graph(spark, sf_dir).edges
    return edges, edges.withColumn("snapshot", F.col("snapshot") + 1)


@query
def edge_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.edge_intersection(*_edges_and_last(spark, sf_dir), EDGE_COLUMNS)


@query
def edge_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.edge_subtract(*_edges_and_last(spark, sf_dir), EDGE_COLUMNS)


@query
def partition_by_vertex_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star.star_graph(spark, sf_dir, keep_lines=True)
    vertex_parts = jobs.write_table(partitioning.parts_by_vertex_type(graph.vertices, N_PARTS), "vertex-parts")
    inside = partitioning.edges_inside_parts(graph.edges, vertex_parts)
    return _part_rows(vertex_parts, inside)


def _part_rows(vertex_parts: DataFrame, edge_parts: DataFrame, *keep: str) -> DataFrame:
    """Vertex and edge parts as one table (kind, snapshot, part, item, and the columns to keep)."""
    vertices = vertex_parts.select(
        F.lit("vertex").alias("kind"), "snapshot", "part", F.concat_ws("/", "vtype", "uri").alias("item"), *keep
    )
    edges = partitioning.edge_rows(edge_parts).select(
        F.lit("edge").alias("kind"), "snapshot", "part", F.concat_ws("/", *EDGE_KEY).alias("item"), *keep
    )
    return vertices.unionByName(edges)


@query
def partition_by_edge_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star.star_graph(spark, sf_dir, keep_lines=True)
    edge_parts = jobs.write_table(partitioning.parts_by_edge_label(graph.edges, N_PARTS), "edge-parts")
    return _part_rows(partitioning.vertices_of_parts(graph.vertices, edge_parts), edge_parts)


@query
def partition_by_anchor_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star.star_graph(spark, sf_dir, keep_lines=True)
    graph = replace(graph, vertices=jobs.write_table(graph.vertices, "vertices"))  # read several times; the edges are read once
    return _part_rows(*partitioning.parts_by_anchor(graph, "part", N_PARTS))


@query
def partition_edges_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, and the vertices that follow them, for a square and another number of parts."""
    graph = star.star_graph(spark, sf_dir, keep_lines=True)
    numbers = (N_PARTS, GRID_PARTS)
    placed = jobs.write_table(partitioning.placed_on_grids(graph.edges, numbers), "grid-parts")
    vertex_parts = partitioning.vertices_on_grids(graph.vertices, placed, numbers)
    return _part_rows(vertex_parts, partitioning.on_each_grid(placed, numbers), "n_parts")


@query
def write_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star.star_graph(spark, sf_dir, keep_lines=True)
    vertex_parts = jobs.write_table(partitioning.parts_by_vertex_type(graph.vertices, N_PARTS), "vertex-parts")
    lines = jobs.part_lines(graph, vertex_parts, partitioning.edges_inside_parts(graph.edges, vertex_parts))
    names = spark.range(length(spark, sf_dir)).select(F.col("id").cast("int").alias("snapshot"))
    names = names.withColumn("file_name", star.file_name(F.col("snapshot")))
    path = new_path(spark, "parts")
    ntriples.write_lines(jobs.name_parts(lines, names), path, "gzip")
    return ntriples.scan_lines(spark, path)


# --- discovery -----------------------------------------------------------------------


def _lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star.star_graph(spark, sf_dir)
    types = profile.vertex_type_histogram(graph)
    return patterns.pattern_lattice(types, profile.frequent_edge_types(graph, min_count=MIN_COUNT), 2)


@query
def pattern_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lattice(spark, sf_dir)
    return rows.select("level", "pattern_id", F.array_join("vertices", ",").alias("vertices"), F.size("edges").alias("n_edges"))


@query
def pattern_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star.star_graph(spark, sf_dir, keep_lines=True)
    counted = [
        matching.instance_counts(graph, pattern.edges).select(F.lit(pattern.pattern_id).alias("pattern_id"), "*")
        for pattern in discovery.candidate_patterns(graph, 2, MIN_COUNT)[2]
    ]
    return reduce(DataFrame.unionByName, counted)


@query
def pattern_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns with up to three edges by their least number of distinct images, grown from supported ones."""
    graph = jobs.stored_graph(star.star_graph(spark, sf_dir, keep_lines=True), attributes=False)
    levels = discovery.supported_patterns(graph, 3, MIN_IMAGES, MIN_COUNT)
    rows = [(level, p.pattern_id, n) for level, found in enumerate(levels, 1) for p, n in found]
    return spark.createDataFrame(rows, "level int, pattern_id string, support long")


@query
def matched_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of a pattern with three edges that are left by its full reduction."""
    graph = star.star_graph(spark, sf_dir)
    found = reduction.reduced_edges(graph, [CONTAINS, *HOME_PATTERN])
    rows = [table.distinct().select("snapshot", F.lit(edge.rel).alias("rel"), "src_uri", "dst_uri") for edge, table in found.items()]
    return reduce(DataFrame.unionByName, rows)


def _dependency_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    two_edges = _lattice(spark, sf_dir).where(F.col("level") == 2)
    return dependencies.dependency_candidates(two_edges, star.star_graph(spark, sf_dir).attributes, 3)


def _labels(column: str) -> Column:
    return F.array_join(F.transform(column, lambda label: F.concat_ws(".", label["vtype"], label["attr"])), ",")


@query
def dependency_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dependency_rows(spark, sf_dir).select("pattern_id", _labels("dependency").alias("dependency"))


@query
def lhs_rhs_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = dependencies.lhs_rhs_splits(_dependency_rows(spark, sf_dir))
    return splits.select("pattern_id", _labels("lhs").alias("lhs"), F.concat_ws(".", "rhs.vtype", "rhs.attr").alias("rhs"))


@query
def one_hot_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = matching.compress(star.star_graph(spark, sf_dir, keep_lines=True))
    tuples = matching.presence_by_tuple(masked, BUY_PATTERN, BUY_DEPENDENCY)
    size = masked.n_snapshots
    seen = temporal.occurrences(size)
    flags = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(seen, i).cast("int").cast("string")
    )
    return tuples.select(*[matching.column_name(a) for a in BUY_DEPENDENCY], F.array_join(flags, ",").alias("flags"))


@query
def delta_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = home_tuples(spark, sf_dir).select(*HOME_NAMES, temporal.occurrences(length(spark, sf_dir)).alias("seen"))
    low, high = temporal.delta_min(F.col("seen")), temporal.delta_max(F.col("seen"))
    return seen.select(*HOME_NAMES, low.alias("delta_min"), high.alias("delta_max"))


@query
def tgfd_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = length(spark, sf_dir)
    tuples = home_tuples(spark, sf_dir).withColumn("n_present", temporal.presence_count(size))
    total = tuples.agg(F.count(F.lit(1))).scalar()
    support = temporal.support(F.col("n_present"), F.col("n_tuples"), size)
    pairs = temporal.pair_count(F.col("n_present"))
    return tuples.withColumn("n_tuples", total).select(*HOME_NAMES, "n_present", pairs.alias("pairs"), F.round(support, 12).alias("support"))


@query
def constant_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    constant = dependencies.constant_dependencies(home_groups(spark, sf_dir))
    found = dependencies.with_deltas(constant, length(spark, sf_dir))
    return found.select("rhs", F.array_join("lhs", "|").alias("lhs"), "rhs_value", "n_present", "delta_min", "delta_max")


def _discovered(spark: SparkSession, sf_dir: str, theta: float) -> DataFrame:
    found = discovery.discover(star.star_graph(spark, sf_dir, keep_lines=True), k=2, theta=theta, min_count=MIN_COUNT)
    return found.withColumn("lhs", map_text("lhs")).withColumn("support", F.round("support", 12))


@query
def discover_tgfds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discovered(spark, sf_dir, 0.0)


@query
def discover_growing_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same dependencies as `discover_tgfds`, with the snapshots added one after the other."""
    graph = jobs.stored_graph(star.star_graph(spark, sf_dir, keep_lines=True), by_snapshot=True)
    folder = new_path(spark, "growing-series")
    for snapshot in range(graph.n_snapshots):
        one = incremental.one_snapshot(graph, snapshot)
        if snapshot == 0:
            incremental.begin(one, folder, k=2, min_count=MIN_COUNT)
        incremental.add_snapshot(one, folder)
    found = incremental.report(spark, folder)
    return found.withColumn("lhs", map_text("lhs")).withColumn("support", F.round("support", 12))


@query
def discover_three_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All patterns with two and three edges that have enough images, with a threshold that leaves out choices with many tuples."""
    graph = star.star_graph(spark, sf_dir, keep_lines=True)
    graph = replace(graph, edges=graph.edges.where(F.col("rel") != "supplies"))
    found = discovery.discover(graph, k=3, theta=THETA_THREE, min_count=MIN_COUNT, min_support=MIN_IMAGES)
    return found.withColumn("lhs", map_text("lhs")).withColumn("support", F.round("support", 12))


@query
def discover_supported_tgfds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a threshold in the middle of the supports of the given tables."""
    return _discovered(spark, sf_dir, THETA)
