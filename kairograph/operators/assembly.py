"""Building graphs from triples, and cutting them to connected or selected parts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.functions import rdf
from kairograph.model import ATTRIBUTE_COLUMNS, EDGE_COLUMNS, VERTEX_KEY, PropertyGraph

ENDS = (("src_type", "src_uri"), ("dst_type", "dst_uri"))


def of_kind(triples: DataFrame, kind: str) -> DataFrame:
    return triples.where(F.col("kind") == kind)


def build_attributes(triples: DataFrame, namespace: str = rdf.IMDB_NAMESPACE) -> DataFrame:
    """One value per (snapshot, vtype, uri, attr); the greatest of repeated values stays.

    The vertex for all foreign subjects may be very large, so repeats are merged per
    attribute, before and after the shuffle, and never gathered per vertex.
    """
    return keyed_attributes(keyed_triples(of_kind(triples, "attribute"), namespace))


def build_edges(triples: DataFrame, namespace: str = rdf.IMDB_NAMESPACE) -> DataFrame:
    """One row per edge triple; copies stay copies."""
    return keyed_edges(keyed_triples(of_kind(triples, "edge"), namespace))


def keyed_triples(triples: DataFrame, namespace: str = rdf.IMDB_NAMESPACE) -> DataFrame:
    """(snapshot, kind, vtype, uri, name, dst_type, dst_uri, value): vertex keys in the place of URIs, for both kinds of triples."""
    is_edge = F.col("kind") == "edge"
    return triples.select(
        "snapshot",
        "kind",
        rdf.vertex_type(F.col("subject"), namespace).alias("vtype"),
        rdf.vertex_name(F.col("subject"), namespace).alias("uri"),
        "name",
        F.when(is_edge, rdf.vertex_type(F.col("object"), namespace)).alias("dst_type"),
        F.when(is_edge, rdf.vertex_name(F.col("object"), namespace)).alias("dst_uri"),
        F.when(~is_edge, F.col("object")).alias("value"),
    )


def keyed_attributes(keyed: DataFrame) -> DataFrame:
    rows = of_kind(keyed, "attribute").withColumnRenamed("name", "attr")
    # A greatest text is found by sorting, and the first of the keys should tell rows apart.
    merged = rows.groupBy("uri", "attr", "vtype", "snapshot").agg(F.max("value").alias("value"))
    return merged.select(*ATTRIBUTE_COLUMNS)


def keyed_edges(keyed: DataFrame) -> DataFrame:
    names = {"vtype": "src_type", "uri": "src_uri", "name": "rel"}
    return of_kind(keyed, "edge").withColumnsRenamed(names).select(*EDGE_COLUMNS)


def keyed_graph(keyed: DataFrame, n_snapshots: int) -> PropertyGraph:
    """The graph of a table of keyed triples, which should be stored: it is read once for each of the three tables."""
    vertices = of_kind(keyed, "attribute").select(*VERTEX_KEY).distinct()
    return PropertyGraph(vertices, keyed_attributes(keyed), keyed_edges(keyed), n_snapshots)


def build_graph(triples: DataFrame, n_snapshots: int, namespace: str = rdf.IMDB_NAMESPACE) -> PropertyGraph:
    """A vertex exists in a snapshot when it has at least one attribute there."""
    return keyed_graph(keyed_triples(triples, namespace), n_snapshots)


def vertex_maps(attributes: DataFrame) -> DataFrame:
    """(snapshot, vtype, uri, attributes): the attributes of each vertex as a map.

    A map has one entry per attribute name, so its size is that of the vocabulary.
    """
    pairs = F.collect_list(F.struct("attr", "value"))
    return attributes.groupBy(*VERTEX_KEY).agg(F.map_from_entries(pairs).alias("attributes"))


def as_end(vertices: DataFrame, type_name: str, uri_name: str) -> DataFrame:
    """Vertex keys renamed to match one end of the edges."""
    return vertices.withColumnsRenamed({"vtype": type_name, "uri": uri_name})


def endpoints(edges: DataFrame, *keep: str) -> DataFrame:
    """Distinct end vertices of the edges; the edges are read once and hubs merge map-side."""
    ends = F.array(*[F.struct(F.col(t).alias("vtype"), F.col(u).alias("uri")) for t, u in ENDS])
    return edges.select("snapshot", *keep, F.inline(ends)).distinct()


def edges_within(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges that have both ends among the vertices (unique keys)."""
    for type_name, uri_name in ENDS:
        keys = as_end(vertices.select(*VERTEX_KEY), type_name, uri_name)
        edges = edges.join(keys, ["snapshot", type_name, uri_name], "left_semi")
    return edges.select(*EDGE_COLUMNS, *[c for c in edges.columns if c not in EDGE_COLUMNS])


def edges_without(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges that have neither end among the vertices."""
    for type_name, uri_name in ENDS:
        keys = as_end(vertices.select(*VERTEX_KEY), type_name, uri_name)
        edges = edges.join(keys, ["snapshot", type_name, uri_name], "left_anti")
    return edges.select(*EDGE_COLUMNS)


def closed_edges(graph: PropertyGraph) -> DataFrame:
    """The edges whose both ends exist; no join when that is already known."""
    return graph.edges if graph.closed else edges_within(graph.edges, graph.vertices)


def close(graph: PropertyGraph) -> PropertyGraph:
    return replace(graph, edges=closed_edges(graph), closed=True)


def vertices_on_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The vertices that are an end of at least one of the edges."""
    return vertices.join(endpoints(edges), VERTEX_KEY, "left_semi")


def restrict(graph: PropertyGraph, vertices: DataFrame, edges: DataFrame) -> PropertyGraph:
    """The graph with these vertices (a subset) and edges, and the attributes that remain."""
    attributes = graph.attributes.join(vertices.select(*VERTEX_KEY), VERTEX_KEY, "left_semi")
    return replace(graph, vertices=vertices, attributes=attributes, edges=edges)


def connected_graph(graph: PropertyGraph) -> PropertyGraph:
    """Without the vertices of degree zero."""
    return restrict(graph, vertices_on_edges(graph.vertices, graph.edges), graph.edges)


def graph_counts(graph: PropertyGraph) -> DataFrame:
    """Vertices, edges and end vertices that do not exist, per snapshot.

    Snapshots without any row are listed with zeros.
    """
    known = graph.vertices.select(*VERTEX_KEY, F.lit(1).alias("known"))
    seen = endpoints(graph.edges).withColumn("known", F.lit(0))
    keys = known.unionByName(seen).groupBy(*VERTEX_KEY).agg(F.max("known").alias("known"))
    zero = F.lit(0).cast("long")
    counted = [
        keys.groupBy("snapshot").agg(
            F.sum("known").alias("vertices"),
            zero.alias("edges"),
            F.sum(1 - F.col("known")).alias("dangling_endpoints"),
        ),
        graph.edges.groupBy("snapshot").agg(
            zero.alias("vertices"), F.count(F.lit(1)).alias("edges"), zero.alias("dangling_endpoints")
        ),
        keys.sparkSession.range(graph.n_snapshots).select(
            F.col("id").cast("int").alias("snapshot"),
            zero.alias("vertices"),
            zero.alias("edges"),
            zero.alias("dangling_endpoints"),
        ),
    ]
    union = counted[0].unionByName(counted[1]).unionByName(counted[2])
    names = ["vertices", "edges", "dangling_endpoints"]
    return union.groupBy("snapshot").agg(*[F.sum(name).alias(name) for name in names])


def edges_with_vertices(edges: DataFrame, payload: DataFrame) -> DataFrame:
    """Each edge with the `attributes` of its source and target, as `src_attributes`, `dst_attributes`.

    `payload` has one row per vertex, so a hub repeats on the edge side only and the
    adaptive skew join can split it.
    """
    columns = edges.columns
    for prefix, (type_name, uri_name) in zip(("src", "dst"), ENDS, strict=True):
        side = as_end(payload, type_name, uri_name).withColumnRenamed("attributes", f"{prefix}_attributes")
        edges = edges.join(side, ["snapshot", type_name, uri_name])
    return edges.select(*columns, "src_attributes", "dst_attributes")
