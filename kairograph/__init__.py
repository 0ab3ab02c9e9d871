"""Temporal graph dependency mining on DataFrames."""

from kairograph.model import PropertyGraph
from kairograph.operators.assembly import build_graph, connected_graph, graph_counts
from kairograph.operators.matching import compress, instance_counts, motif_match, presence_by_tuple
from kairograph.operators.patterns import grow_patterns, pattern_lattice
from kairograph.operators.rdf_graph import integrate_rdf
from kairograph.plans.discovery import discover
from kairograph.session import configure
from kairograph.sources.ntriples import load_snapshots, parse_triples, scan_lines, snapshot_dates
from kairograph.sources.statements import scan_statements
from kairograph.sources.turtle import scan_turtle

__all__ = [
    "PropertyGraph",
    "build_graph",
    "compress",
    "configure",
    "connected_graph",
    "discover",
    "graph_counts",
    "grow_patterns",
    "instance_counts",
    "integrate_rdf",
    "load_snapshots",
    "motif_match",
    "parse_triples",
    "pattern_lattice",
    "presence_by_tuple",
    "scan_lines",
    "scan_statements",
    "scan_turtle",
    "snapshot_dates",
]
