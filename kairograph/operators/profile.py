"""Histograms, degree statistics and frequent edge types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.model import VERTEX_KEY, PropertyGraph
from kairograph.operators.assembly import ENDS, closed_edges

# List length, edge type threshold and degree buckets.
TOP = 10
MIN_EDGE_COUNT = 1000
BUCKET_SIZE = 100
MAX_DEGREE = 1000


def count_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def most_frequent(counts: DataFrame, *names: str, top: int = TOP) -> DataFrame:
    """The `top` rows with the greatest `n`; equal counts by name, ascending."""
    return counts.orderBy(F.desc("n"), *names).limit(top)


def descending(counts: DataFrame, *names: str) -> DataFrame:
    """All rows by falling `n`; equal counts by name, ascending."""
    return counts.orderBy(F.desc("n"), *names)


def vertex_type_counts(vertices: DataFrame) -> DataFrame:
    return count_by(vertices, "snapshot", "vtype")


def label_counts(edges: DataFrame) -> DataFrame:
    return count_by(edges, "snapshot", "rel")


def vertex_type_histogram(graph: PropertyGraph, snapshot: int = 0, top: int = TOP) -> DataFrame:
    return most_frequent(count_by(graph.at(snapshot).vertices, "vtype"), "vtype", top=top)


def edge_label_histogram(graph: PropertyGraph, snapshot: int = 0, top: int = TOP) -> DataFrame:
    return most_frequent(count_by(graph.at(snapshot).edges, "rel"), "rel", top=top)


def attribute_histogram(graph: PropertyGraph, snapshot: int = 0, top: int = TOP) -> DataFrame:
    return most_frequent(count_by(graph.at(snapshot).attributes, "attr"), "attr", top=top)


def type_attributes(attributes: DataFrame) -> DataFrame:
    """The attribute names seen on each vertex type, per snapshot."""
    pairs = attributes.select("snapshot", "vtype", "attr").distinct()
    return pairs.groupBy("snapshot", "vtype").agg(F.sort_array(F.collect_list("attr")).alias("attrs"))


def edge_type_counts(graph: PropertyGraph) -> DataFrame:
    """Edges per (source type, label, target type), between different types."""
    edges = closed_edges(graph).where(F.col("src_type") != F.col("dst_type"))
    return count_by(edges, "snapshot", "src_type", "rel", "dst_type")


def frequent_edge_types(
    graph: PropertyGraph, snapshot: int = 0, min_count: int = MIN_EDGE_COUNT, top: int = TOP
) -> DataFrame:
    """The most frequent label between each ordered pair of types, if frequent enough."""
    counts = edge_type_counts(graph.at(snapshot))
    leader = F.min(F.struct((-F.col("n")).alias("negated"), "rel"))
    best = counts.groupBy("src_type", "dst_type").agg(leader.alias("best"))
    rows = best.select("src_type", F.col("best.rel").alias("rel"), "dst_type", (-F.col("best.negated")).alias("n"))
    return most_frequent(rows.where(F.col("n") >= min_count), "src_type", "rel", "dst_type", top=top)


def degrees(edges: DataFrame) -> DataFrame:
    """In, out and total degree of every end vertex; one pass over the edges."""
    marks = []
    for (type_name, uri_name), (n_in, n_out) in zip(ENDS, ((0, 1), (1, 0)), strict=True):
        marks.append(
            F.struct(
                F.col(type_name).alias("vtype"),
                F.col(uri_name).alias("uri"),
                F.lit(n_in).alias("is_in"),
                F.lit(n_out).alias("is_out"),
            )
        )
    ends = edges.select("snapshot", F.inline(F.array(*marks)))
    sums = ends.groupBy(*VERTEX_KEY).agg(F.sum("is_in").alias("in_degree"), F.sum("is_out").alias("out_degree"))
    return sums.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def typed_degrees(graph: PropertyGraph, vtype: str) -> DataFrame:
    """Degrees of the existing vertices of one type that have edges."""
    ours = graph.edges.where((F.col("src_type") == vtype) | (F.col("dst_type") == vtype))
    typed = degrees(ours).where(F.col("vtype") == vtype)
    return typed.join(graph.vertices.where(F.col("vtype") == vtype), VERTEX_KEY, "left_semi")


def typed_degree_stats(graph: PropertyGraph, vtype: str) -> DataFrame:
    return typed_degrees(graph, vtype).groupBy("snapshot").agg(
        F.sum("in_degree").alias("total_in"),
        F.sum("out_degree").alias("total_out"),
        F.max("in_degree").alias("max_in"),
        F.max("out_degree").alias("max_out"),
    )


def max_degrees(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("snapshot").agg(
        F.max("in_degree").alias("max_in"), F.max("out_degree").alias("max_out")
    )


def degree_distribution(
    degree_rows: DataFrame, bucket_size: int = BUCKET_SIZE, max_degree: int = MAX_DEGREE
) -> DataFrame:
    """Vertices per degree range, for in- and out-degrees above zero.

    Degrees beyond the last range are counted in it.
    """
    both = F.array(
        F.struct(F.lit("in").alias("direction"), F.col("in_degree").alias("value")),
        F.struct(F.lit("out").alias("direction"), F.col("out_degree").alias("value")),
    )
    values = degree_rows.select("snapshot", F.inline(both)).where(F.col("value") > 0)
    last = F.lit(max_degree // bucket_size - 1).cast("long")
    first = F.least(F.floor(F.col("value") / bucket_size), last) * bucket_size
    label = F.concat_ws("-", first, first + (bucket_size - 1))
    return count_by(values.select("snapshot", "direction", label.alias("bucket")), "snapshot", "direction", "bucket")
