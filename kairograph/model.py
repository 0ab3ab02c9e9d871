"""The data model: a series of property graph snapshots as three long tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERTEX_KEY = ["snapshot", "vtype", "uri"]
ATTRIBUTE_COLUMNS = [*VERTEX_KEY, "attr", "value"]
EDGE_KEY = ["src_type", "src_uri", "rel", "dst_type", "dst_uri"]
EDGE_COLUMNS = ["snapshot", *EDGE_KEY]


@dataclass(frozen=True)
class PropertyGraph:
    """All snapshots of a graph.

    vertices    one row per (snapshot, vtype, uri)
    attributes  one row per (snapshot, vtype, uri, attr) with its value
    edges       a directed multigraph, one row per copy
    n_snapshots length of the series, counting empty snapshots
    closed      True when every edge is known to have both end vertices
    """

    vertices: DataFrame
    attributes: DataFrame
    edges: DataFrame
    n_snapshots: int
    closed: bool = False

    def at(self, snapshot: int) -> PropertyGraph:
        here = F.col("snapshot") == snapshot
        return replace(
            self,
            vertices=self.vertices.where(here),
            attributes=self.attributes.where(here),
            edges=self.edges.where(here),
        )
