"""The batch jobs around mining: sampling, partitioning and integrating graphs, as text lines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.functions import rdf
from kairograph.model import VERTEX_KEY, PropertyGraph
from kairograph.operators.assembly import build_graph as build_graph  # also under the name of this module
from kairograph.operators.assembly import connected_graph, edges_within, keyed_graph, keyed_triples, restrict, vertices_on_edges
from kairograph.operators.filters import (
    MAX_ANCHOR_IN_DEGREE,
    non_null_graph,
    without_high_degree,
    without_hubs,
)
from kairograph.operators.partitioning import edge_rows
from kairograph.operators.rdf_graph import integrate_rdf, shorten_uris
from kairograph.operators.sampling import stable_sample_edges
from kairograph.plans.storage import write_table
from kairograph.sources.ntriples import format_attributes, format_edges, parse_triples
from kairograph.sources.statements import YEARS


def stored_triples(triples: DataFrame) -> DataFrame:
    """Parse once: the triples as a table that later steps read by kind."""
    return write_table(triples, "triples", ["kind"])


def parsed_graph(triples: DataFrame, n_snapshots: int, namespace: str = rdf.IMDB_NAMESPACE) -> PropertyGraph:
    """The graph of triples that are parsed and cut to vertex keys once. Stored as they come, without a shuffle."""
    return keyed_graph(write_table(keyed_triples(triples, namespace), "keyed-triples"), n_snapshots)


def stored_graph(graph: PropertyGraph, attributes: bool = True, by_snapshot: bool = False) -> PropertyGraph:
    """The tables of a graph written once; the attributes only where they are read.

    Split by snapshot, which costs a shuffle, only for jobs that read the snapshots one after the other.
    """
    split = ["snapshot"] if by_snapshot else []
    return replace(
        graph,
        vertices=write_table(graph.vertices, "vertices", split),
        attributes=write_table(graph.attributes, "attributes", split) if attributes else graph.attributes,
        edges=write_table(graph.edges, "edges", split),
    )


def graph_lines(graph: PropertyGraph, namespace: str = rdf.IMDB_NAMESPACE, clean: bool = True) -> DataFrame:
    """(snapshot, line): attribute lines and the lines of edges between existing vertices."""
    edges = graph.edges if graph.closed else edges_within(graph.edges, graph.vertices)
    return format_attributes(graph.attributes, namespace, clean).unionByName(format_edges(edges, namespace))


def sample_movie_graph(
    lines: DataFrame,
    n_snapshots: int,
    size: int,
    types: tuple[str, ...] = rdf.IMDB_TYPES,
    anchor: str = "movie",
    max_in: int = MAX_ANCHOR_IN_DEGREE,
    seed: str = "",
) -> PropertyGraph:
    """Typed parse, stable edge sample, then removal of anchors with too many incoming edges."""
    graph = parsed_graph(parse_triples(lines, types), n_snapshots)
    sampled = stable_sample_edges(graph.edges, n_snapshots, size, seed)
    selected = restrict(graph, vertices_on_edges(graph.vertices, sampled), sampled)
    return without_hubs(non_null_graph(selected), anchor, max_in)


def sample_encyclopedia_graph(
    lines: DataFrame, n_snapshots: int, size: int, max_degree: int, seed: str = ""
) -> PropertyGraph:
    """Raw parse, removal of high-degree vertices, then a stable edge sample of the rest."""
    parsed = parsed_graph(parse_triples(lines, None, strip_xsd=False), n_snapshots, rdf.DBPEDIA_NAMESPACE)
    low = without_high_degree(parsed, max_degree)
    graph = replace(low, edges=write_table(low.edges, "edges"))
    sampled = stable_sample_edges(graph.edges, n_snapshots, size, seed)
    return restrict(graph, vertices_on_edges(graph.vertices, sampled), sampled)


def part_lines(
    graph: PropertyGraph, vertex_parts: DataFrame, edge_parts: DataFrame, namespace: str = rdf.IMDB_NAMESPACE
) -> DataFrame:
    """(snapshot, part, line) of every part of a partitioned graph."""
    attributes = graph.attributes.join(vertex_parts, VERTEX_KEY)
    kept = edges_within(edge_parts, graph.vertices) if not graph.closed else edge_parts
    return format_attributes(attributes, namespace).unionByName(format_edges(edge_rows(kept), namespace))


def name_parts(lines: DataFrame, file_of_snapshot: DataFrame) -> DataFrame:
    """(file, line): each part goes to a file named after that of its snapshot.

    `file_of_snapshot` has one row (snapshot, file_name) per snapshot.
    """
    named = lines.join(F.broadcast(file_of_snapshot), "snapshot")
    return named.select(rdf.part_file_name(F.col("file_name"), F.col("part")).alias("file"), "line")


def integrated_lines(statements: DataFrame, years: Sequence[str] = YEARS) -> DataFrame:
    """(snapshot, line): the connected typed resources of every year."""
    attributes, edges = shorten_uris(connected_graph(integrate_rdf(statements, years)))
    lines = format_attributes(attributes, rdf.DBPEDIA_NAMESPACE, clean=False)
    return lines.unionByName(format_edges(edges, rdf.DBPEDIA_NAMESPACE))
