"""Tree patterns over vertex types, grown one edge at a time."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class PatternEdge(NamedTuple):
    src: str
    rel: str
    dst: str


class Pattern(NamedTuple):
    """Vertices are named by their type, so each type occurs once."""

    vertices: tuple[str, ...]
    edges: tuple[PatternEdge, ...]

    @property
    def pattern_id(self) -> str:
        return ";".join(">".join(edge) for edge in sorted(self.edges)) or self.vertices[0]


def make_pattern(edges: Sequence[tuple[str, str, str]]) -> Pattern:
    named = tuple(sorted({PatternEdge(*edge) for edge in edges}))
    vertices = sorted({name for edge in named for name in (edge.src, edge.dst)})
    return Pattern(tuple(vertices), named)


def grow_patterns(
    types: Sequence[str], frequent: Sequence[tuple[str, str, str]], k: int, prune: bool = True
) -> list[list[Pattern]]:
    """Patterns by number of edges, 0 to k, from short ranked lists of types and edge types.

    An edge extends a pattern when exactly one of its types is already there. With
    `prune`, a level takes an extension only while one of the edge's types is new to the
    level, which depends on the ranking; without it, every distinct pattern is kept.
    """
    levels = [[Pattern((name,), ()) for name in types]]
    edges = [PatternEdge(*edge) for edge in frequent]
    for _ in range(k):
        covered: set[str] = set()
        grown: dict[Pattern, None] = {}
        for pattern in levels[-1]:
            for edge in edges:
                if (edge.src in pattern.vertices) == (edge.dst in pattern.vertices):
                    continue
                if prune and {edge.src, edge.dst} <= covered:
                    continue
                extended = make_pattern([*pattern.edges, edge])
                covered.update(extended.vertices)
                grown[extended] = None
        if not grown:
            break
        levels.append(list(grown))
    return levels


def extend_patterns(patterns: Sequence[Pattern], frequent: Sequence[tuple[str, str, str]]) -> list[Pattern]:
    """Every distinct pattern with one more edge that brings one new type."""
    grown = {
        make_pattern([*pattern.edges, edge]): None
        for pattern in patterns
        for edge in (PatternEdge(*e) for e in frequent)
        if (edge.src in pattern.vertices) != (edge.dst in pattern.vertices)
    }
    return list(grown)


def _pattern_text(edges: Column) -> Column:
    return F.array_join(F.transform(edges, lambda e: F.concat_ws(">", e["src"], e["rel"], e["dst"])), ";")


def pattern_lattice(types: DataFrame, frequent: DataFrame, k: int) -> DataFrame:
    """(level, pattern_id, vertices, edges) of all distinct patterns with up to k edges.

    `types` has a `vtype` column, `frequent` has `src_type`, `rel`, `dst_type`. Each step
    is an equi-join of the patterns' types with the edges' ends.
    """
    edge = F.struct(F.col("src_type").alias("src"), "rel", F.col("dst_type").alias("dst"))
    links = frequent.select(
        edge.alias("edge"),
        F.inline(
            F.array(
                F.struct(F.col("src_type").alias("anchor"), F.col("dst_type").alias("added")),
                F.struct(F.col("dst_type").alias("anchor"), F.col("src_type").alias("added")),
            )
        ),
    )
    no_edges = F.array().cast("array<struct<src:string,rel:string,dst:string>>")
    level = types.select(F.array("vtype").alias("vertices"), no_edges.alias("edges"))
    levels = [level.withColumn("level", F.lit(0))]
    for size in range(1, k + 1):
        anchored = level.select("vertices", "edges", F.explode("vertices").alias("anchor"))
        extended = anchored.join(links, "anchor").where(~F.array_contains("vertices", F.col("added")))
        level = extended.select(
            F.sort_array(F.concat("vertices", F.array("added"))).alias("vertices"),
            F.sort_array(F.concat("edges", F.array("edge"))).alias("edges"),
        ).distinct()
        levels.append(level.withColumn("level", F.lit(size)))
    union = levels[0]
    for rows in levels[1:]:
        union = union.unionByName(rows)
    name = F.when(F.col("level") == 0, F.get("vertices", F.lit(0))).otherwise(_pattern_text(F.col("edges")))
    return union.select("level", name.alias("pattern_id"), "vertices", "edges")
