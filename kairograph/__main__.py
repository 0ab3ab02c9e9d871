"""Command line: `spark-submit -m kairograph <job> ...` or `python -m kairograph <job> ...`."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.functions import rdf
from kairograph.operators import assembly, filters, partitioning, profile
from kairograph.plans import discovery, incremental, jobs
from kairograph.session import configure
from kairograph.sources import ntriples, statements, turtle

NAMESPACES = {"imdb": rdf.IMDB_NAMESPACE, "dbpedia": rdf.DBPEDIA_NAMESPACE}


def _file_names(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "snapshot int, file_name string")


def _write(spark: SparkSession, lines: DataFrame, names: list[str], path: str) -> None:
    named = lines.join(F.broadcast(_file_names(spark, names)), "snapshot")  # one row per file
    ntriples.write_lines(named.select(F.col("file_name").alias("file"), "line"), path)


def _chosen(options: list[str]) -> dict[str, list[str]] | None:
    return {vtype: names.split(",") for vtype, _, names in (x.partition("=") for x in options)} or None


def discover(spark: SparkSession, args: argparse.Namespace) -> None:
    lines, n_snapshots = ntriples.load_snapshots(spark, args.base, args.start, args.end, args.prefix)
    triples = jobs.stored_triples(ntriples.parse_triples(lines, args.types))
    graph = jobs.stored_graph(assembly.close(assembly.build_graph(triples, n_snapshots)))
    found = discovery.discover(graph, args.k, args.theta, args.min_count, args.top, _chosen(args.attributes), not args.no_prune, args.min_support)
    found.write.parquet(args.output)


def extend(spark: SparkSession, args: argparse.Namespace) -> None:
    """Add one snapshot file to a mined series; with --begin K, make the series first."""
    lines = ntriples.scan_lines(spark, args.input).select(F.lit(0).alias("snapshot"), "line")
    triples = jobs.stored_triples(ntriples.parse_triples(lines, args.types))
    graph = jobs.stored_graph(assembly.close(assembly.build_graph(triples, 1)))
    if args.begin is not None:
        chosen = _chosen(args.attributes)
        incremental.begin(graph, args.state, args.begin, args.min_count, args.top, chosen, not args.no_prune)
    incremental.add_snapshot(graph, args.state)


def report(spark: SparkSession, args: argparse.Namespace) -> None:
    incremental.report(spark, args.state, args.theta).write.parquet(args.output)


def sample_movies(spark: SparkSession, args: argparse.Namespace) -> None:
    lines, names = ntriples.load_folder(spark, args.input)
    graph = jobs.sample_movie_graph(
        lines, len(names), args.size, tuple(args.types), args.anchor, args.max_in, seed=args.seed
    )
    _write(spark, jobs.graph_lines(graph), names, args.output)


def sample_encyclopedia(spark: SparkSession, args: argparse.Namespace) -> None:
    lines, names = ntriples.load_folder(spark, args.input)
    graph = jobs.sample_encyclopedia_graph(lines, len(names), args.size, args.max_degree, seed=args.seed)
    _write(spark, jobs.graph_lines(graph, rdf.DBPEDIA_NAMESPACE), names, args.output)


def partition(spark: SparkSession, args: argparse.Namespace) -> None:
    namespace = NAMESPACES[args.namespace]
    lines, names = ntriples.load_folder(spark, args.input)
    triples = jobs.stored_triples(ntriples.parse_triples(lines, None))
    graph = jobs.stored_graph(assembly.build_graph(triples, len(names), namespace))
    if args.by == "vertex-type":
        vertex_parts = partitioning.parts_by_vertex_type(graph.vertices, args.parts)
        edge_parts = partitioning.edges_inside_parts(graph.edges, vertex_parts)
    elif args.by == "anchor":
        vertex_parts, edge_parts = partitioning.parts_by_anchor(graph, args.anchor, args.parts)
    else:
        cut = partitioning.parts_by_edge_label if args.by == "edge-label" else partitioning.parts_on_grid
        edge_parts = cut(graph.edges, args.parts)
        vertex_parts = partitioning.vertices_of_parts(graph.vertices, edge_parts)
    vertex_parts, edge_parts = (jobs.write_table(parts, "parts") for parts in (vertex_parts, edge_parts))
    partitioning.part_counts(vertex_parts, edge_parts).write.parquet(args.counts or f"{args.output}-counts")
    lines = jobs.part_lines(graph, vertex_parts, edge_parts, namespace)
    ntriples.write_lines(jobs.name_parts(lines, _file_names(spark, names)), args.output)


def integrate(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.turtle:
        found, rejected = turtle.scan_turtle(spark, args.input, args.years)
    else:
        source = statements.scan_statement_lines(spark, args.input, args.years)
        found, rejected = statements.parse_statements(source), statements.rejected_lines(source)
    rejected.write.parquet(args.rejected or f"{args.output}-rejected")
    parsed = jobs.write_table(found, "statements", ["kind"])
    _write(spark, jobs.integrated_lines(parsed, args.years), [f"{year}.nt" for year in args.years], args.output)


def describe(spark: SparkSession, args: argparse.Namespace) -> None:
    lines, names = ntriples.load_folder(spark, args.input)
    triples = jobs.stored_triples(ntriples.parse_triples(lines, None))
    graph = jobs.stored_graph(assembly.build_graph(triples, len(names), NAMESPACES[args.namespace]))
    closed = assembly.closed_edges(graph)
    tables = {
        "counts": assembly.graph_counts(graph),
        "vertex_types": profile.vertex_type_counts(graph.vertices),
        "labels": profile.label_counts(graph.edges),
        "anchor_degrees": profile.typed_degree_stats(graph, args.anchor),
        "max_degrees": profile.max_degrees(graph.edges),
        "degree_distribution": profile.degree_distribution(profile.degrees(closed)),
    }
    for name, table in tables.items():
        table.write.parquet(f"{args.output}/{name}")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="kairograph", description=__doc__)
    commands = parser.add_subparsers(required=True)

    def command(function, *arguments: str) -> argparse.ArgumentParser:
        added = commands.add_parser(function.__name__.replace("_", "-"))
        added.set_defaults(run=function)
        for name in arguments:
            added.add_argument(name)
        return added

    mine = command(discover, "base")
    mine.add_argument("k", type=int)
    mine.add_argument("start", help="yyMMdd")
    mine.add_argument("end", help="yyMMdd")
    mine.add_argument("theta", type=float)
    mine.add_argument("output")
    mine.add_argument("--prefix", default=ntriples.FILE_PREFIX)
    mine.add_argument("--min-support", type=int, help="grow patterns by distinct images of their types, at least so many")
    grown = command(extend, "state", "input")
    grown.add_argument("--begin", type=int, metavar="K", help="make the series with this first file, for patterns with 2 to K edges")
    for mining in (mine, grown):
        mining.add_argument("--types", nargs="+", default=list(rdf.IMDB_TYPES))
        mining.add_argument("--min-count", type=int, default=profile.MIN_EDGE_COUNT)
        mining.add_argument("--top", type=int, default=profile.TOP, help="most frequent types and edge types that patterns use")
        mining.add_argument("--no-prune", action="store_true", help="all patterns of a level, in any order of growth")
        mining.add_argument("--attributes", nargs="*", default=[], metavar="TYPE=NAME,NAME")
    told = command(report, "state", "output")
    told.add_argument("--theta", type=float, default=0.0)
    for function in (sample_movies, sample_encyclopedia):
        sample = command(function, "input", "output")
        sample.add_argument("size", type=int)
        sample.add_argument("--seed", default="")
        if function is sample_encyclopedia:
            sample.add_argument("max_degree", type=int)
        else:
            sample.add_argument("--types", nargs="+", default=list(rdf.IMDB_TYPES))
            sample.add_argument("--anchor", default="movie")
            sample.add_argument("--max-in", type=int, default=filters.MAX_ANCHOR_IN_DEGREE)
    cut = command(partition, "input", "output")
    cut.add_argument("--by", choices=["vertex-type", "edge-label", "anchor", "grid"], required=True)
    cut.add_argument("--parts", type=int, default=partitioning.PARTS)
    cut.add_argument("--anchor", default="movie")
    cut.add_argument("--counts", help="folder for the vertices and edges of each part; beside the output unless given")
    cut.add_argument("--namespace", choices=sorted(NAMESPACES), default="imdb")
    joined = command(integrate, "input", "output")
    joined.add_argument("--years", nargs="+", default=list(statements.YEARS))
    joined.add_argument("--rejected", help="folder for the number of lines of each file that are no statement; beside the output unless given")
    joined.add_argument("--turtle", action="store_true", help="statements may have prefixes and go over several lines")
    about = command(describe, "input", "output")
    about.add_argument("--anchor", default="movie")
    about.add_argument("--namespace", choices=sorted(NAMESPACES), default="imdb")
    return parser


def main(arguments: list[str] | None = None) -> None:
    args = _parser().parse_args(arguments)
    args.run(configure(SparkSession.builder.appName("kairograph").getOrCreate()), args)


if __name__ == "__main__":
    main()
