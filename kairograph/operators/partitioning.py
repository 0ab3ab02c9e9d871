"""Four ways of cutting a graph into parts; every part column is `part`, from zero."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.functions import rdf
from kairograph.functions.temporal import WORD_BITS, one_bit
from kairograph.model import EDGE_COLUMNS, EDGE_KEY, VERTEX_KEY, PropertyGraph
from kairograph.operators.assembly import ENDS, as_end, endpoints
from kairograph.plans.ranking import compact_copies, expand_copies, rank_by_hash
from kairograph.plans.storage import write_table

# Default number of parts, and the prime of the two-dimensional scheme.
PARTS = 4
# Parts are gathered as bits up to this number of them.
MOST_BITS = 8 * WORD_BITS
MIXING_PRIME = 1125899906842597
MIXING_LESS = 2**50 - MIXING_PRIME


def parts_by_vertex_type(vertices: DataFrame, n_parts: int = PARTS) -> DataFrame:
    """Deal the vertices of each type out to the parts in turn."""
    ranked = rank_by_hash(vertices.select(*VERTEX_KEY), ["snapshot", "vtype"], ["uri"])
    return ranked.select(*VERTEX_KEY, F.pmod("rank", F.lit(n_parts)).cast("int").alias("part"))


def edges_inside_parts(edges: DataFrame, vertex_parts: DataFrame) -> DataFrame:
    """The edges whose two ends are in the same part."""
    for index, (type_name, uri_name) in enumerate(ENDS):
        side = as_end(vertex_parts, type_name, uri_name)
        keys = ["snapshot", type_name, uri_name] + (["part"] if index else [])
        edges = edges.join(side, keys)
    return edges.select(*EDGE_COLUMNS, "part")


def parts_by_edge_label(edges: DataFrame, n_parts: int = PARTS) -> DataFrame:
    """Deal the edges of each label out to the parts in turn, as (edge, part, copies).

    Copies of an edge have consecutive ranks, so the number that falls to each part
    follows from the first rank and the number of copies alone.
    """
    counted = compact_copies(edges.select(*EDGE_COLUMNS))
    ranked = rank_by_hash(counted, ["snapshot", "rel"], EDGE_KEY, weight="copies")
    turns = F.sequence(F.lit(0).cast("long"), F.least(F.col("copies"), F.lit(n_parts).cast("long")) - 1)
    dealt = ranked.select(*EDGE_COLUMNS, "copies", "rank", F.explode(turns).alias("turn"))
    part = F.pmod(F.col("rank") + F.col("turn"), F.lit(n_parts)).cast("int")
    share = F.floor((F.col("copies") - 1 - F.col("turn")) / n_parts) + 1
    return dealt.select(*EDGE_COLUMNS, part.alias("part"), share.alias("copies"))


def vertices_of_parts(vertices: DataFrame, edge_parts: DataFrame, *keep: str) -> DataFrame:
    """(vertex, part, and the columns to keep) for the existing end vertices of the edges of each part."""
    ends = endpoints(edge_parts, "part", *keep)
    return ends.join(vertices.select(*VERTEX_KEY), VERTEX_KEY, "left_semi").select(*VERTEX_KEY, "part", *keep)


def vertices_on_grids(vertices: DataFrame, placed: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """(vertex, part, n_parts) for the existing end vertices of the edges that `placed_on_grids` has placed.

    The parts of a vertex are gathered as bits, one row per vertex for all grids. An edge with a null end is in the part null,
    which has the bit after the others.
    """
    names = [F.coalesce(f"part_{n}", F.lit(n)).alias(f"part_{n}") for n in numbers]
    ends = F.array(*[F.struct(F.col(t).alias("vtype"), F.col(u).alias("uri")) for t, u in ENDS])
    rows = _gathered_parts(vertices, placed.select("snapshot", *names, F.inline(ends)), numbers)
    part = {n: [*map(F.lit, range(n)), F.lit(None).cast("int")] for n in numbers}
    parts = [F.struct(F.lit(n).alias("n_parts"), part[n][p].alias("part"), _holds(n, p).alias("held")) for n in numbers for p in range(n + 1)]
    return rows.select(*VERTEX_KEY, F.inline(F.array(*parts))).where("held").select(*VERTEX_KEY, "part", "n_parts")


def _gathered_parts(vertices: DataFrame, ends: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """(vertex, bits of its parts by grid) of the vertices that are among the ends, whose columns `part_<n>` are up to n or null.

    `vertices` may have such columns as well. Copies are merged before the shuffle, and there is no join.
    """
    words = [(n, w) for n in numbers for w in range(n // WORD_BITS + 1)]

    def bits(rows: DataFrame, known: bool) -> DataFrame:
        place = {n: F.col(f"part_{n}") if f"part_{n}" in rows.columns else F.lit(None).cast("int") for n in numbers}
        inside = [one_bit(place[n] - w * WORD_BITS) for n, w in words]
        return rows.select(*VERTEX_KEY, F.lit(known).alias("known"), *[b.alias(f"bits_{n}_{w}") for b, (n, w) in zip(inside, words, strict=True)])

    # A null key is equal to none, as in a join.
    whole = reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in VERTEX_KEY])
    both = bits(vertices, True).unionByName(bits(ends.where(whole), False))
    united = [F.bit_or(f"bits_{n}_{w}").alias(f"bits_{n}_{w}") for n, w in words]
    return both.groupBy(*VERTEX_KEY).agg(F.max("known").alias("known"), *united).where("known").drop("known")


def _holds(n: int, part: int) -> Column:
    """Whether a vertex is in this part of n."""
    bit = F.lit(1 << part % WORD_BITS).cast("long")
    return F.col(f"bits_{n}_{part // WORD_BITS}").bitwiseAND(bit) != 0


def _anchor_part(vtype: Column, uri: Column, n_parts: int) -> Column:
    """Part of an anchor: the Java hash of its widened 32-bit id, which is never negative."""
    number = rdf.vertex_id(uri, vtype)
    return F.pmod(F.when(number < 0, -number - 1).otherwise(number), F.lit(n_parts)).cast("int")


def parts_by_anchor(graph: PropertyGraph, anchor: str, n_parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """(vertex parts, edge parts): the anchors of a part, their edges, and the neighbours.

    The part of an anchor is a function of its name, worked out once for each anchor; edges take it from
    the join that tells whether the anchor exists. An edge between anchors of two parts is in both. An edge with an anchor
    at one end only is moved once, to that end; the edges of the parts are stored, and their other ends are gathered with the
    vertices.
    """
    part = _anchor_part(F.col("vtype"), F.col("uri"), n_parts).alias("part")
    own = graph.vertices.where(F.col("vtype") == anchor).select(*VERTEX_KEY, part)
    at_src, at_dst = (F.coalesce(F.col(type_name) == anchor, F.lit(False)) for type_name, _ in ENDS)
    near = F.when(at_src, F.col("src_uri")).otherwise(F.col("dst_uri"))
    single = graph.edges.where(at_src != at_dst).withColumn("uri", near).join(own.drop("vtype"), ["snapshot", "uri"])
    edges = graph.edges.where(at_src & at_dst)
    found = []
    for end, (type_name, uri_name) in zip(("src", "dst"), ENDS, strict=True):
        known = as_end(own.withColumnRenamed("part", f"{end}_part"), type_name, uri_name)
        edges = edges.join(known, ["snapshot", type_name, uri_name], "left")
        found.append(F.col(f"{end}_part"))
    parts = F.array_distinct(F.array_compact(F.array(*found)))
    double = edges.select(*EDGE_COLUMNS, F.explode(parts).alias("part"))
    edge_parts = write_table(single.select(*EDGE_COLUMNS, "part").unionByName(double), "anchor-edges")
    if n_parts > MOST_BITS:
        return own.unionByName(vertices_of_parts(graph.vertices, edge_parts)).distinct(), edge_parts
    # An end is new to a part where the other end is its anchor.
    others = F.array(*[F.struct(F.when(at, F.col(t)).alias("vtype"), F.when(at, F.col(u)).alias("uri")) for at, (t, u) in zip((at_dst, at_src), ENDS, strict=True)])
    name = f"part_{n_parts}"
    ends = edge_parts.select("snapshot", F.col("part").alias(name), F.inline(others))
    is_anchor = F.col("vtype") == anchor
    placed = graph.vertices.select(*VERTEX_KEY, F.when(is_anchor, _anchor_part(F.col("vtype"), F.col("uri"), n_parts)).alias(name))
    held = [F.struct(F.lit(p).alias("part"), _holds(n_parts, p).alias("held")) for p in range(n_parts)]
    rows = _gathered_parts(placed, ends, [n_parts]).select(*VERTEX_KEY, F.inline(F.array(*held))).where("held").drop("held")
    nameless = own.where(F.col("uri").isNull()).distinct()  # is in no part
    return rows.unionByName(nameless), edge_parts


def _wrapped_product(number: Column) -> Column:
    """abs(number * prime) in 64-bit arithmetic that wraps around, of an id of 32 bits.

    ANSI mode rejects an overflow of LONG, so the product is taken in two parts: the prime is 2^50 - 27, a shift
    wraps without an error, and 27 ids need 37 bits. Their difference leaves the range only below the least LONG,
    from where it goes on at the greatest. The least LONG itself, which has no abs, is no product of such an id.
    """
    shifted = F.shiftleft(number, 50)
    small = number * F.lit(MIXING_LESS).cast("long")
    wraps = (shifted == F.lit(-(2**63))) & (small > 0)
    return F.abs(F.when(wraps, F.lit(2**63 - 1) - (small - 1)).otherwise(shifted - small))


def grid_part(src_id: Column, dst_id: Column, n_parts: int) -> Column:
    """Part of an edge on a grid of about sqrt(n) columns, from the ids of its ends."""
    columns = isqrt(n_parts - 1) + 1
    src, dst = _wrapped_product(src_id), _wrapped_product(dst_id)

    def modulo(value: Column, n: int | Column) -> Column:
        return F.pmod(value, F.lit(n) if isinstance(n, int) else n).cast("int")

    if columns * columns == n_parts:
        return F.pmod(modulo(src, columns) * columns + modulo(dst, columns), F.lit(n_parts))
    rows = ceil(n_parts / columns)
    last_rows = n_parts - rows * (columns - 1)
    column = F.floor(modulo(src, n_parts) / rows).cast("int")
    row = F.when(column < columns - 1, modulo(dst, rows)).otherwise(modulo(dst, last_rows))
    return column * rows + row


def parts_on_grid(edges: DataFrame, n_parts: int = PARTS) -> DataFrame:
    src, dst = (rdf.vertex_id(F.col(uri), F.col(vtype)) for vtype, uri in ENDS)
    return edges.select(*EDGE_COLUMNS, grid_part(src, dst, n_parts).cast("int").alias("part"))


def placed_on_grids(edges: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """Each edge once, with its part on the grid of n as `part_<n>`; its ids are worked out once for all of them."""
    ids = edges.select(*EDGE_COLUMNS, *[rdf.vertex_id(F.col(uri), F.col(vtype)).alias(uri[:3]) for vtype, uri in ENDS])
    return ids.select(*EDGE_COLUMNS, *[grid_part(F.col("src"), F.col("dst"), n).cast("int").alias(f"part_{n}") for n in numbers])


def on_each_grid(placed: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """A row for each grid by `n_parts`, from edges with their parts on all of them."""
    parts = [F.struct(F.lit(n).alias("n_parts"), F.col(f"part_{n}").alias("part")) for n in numbers]
    return placed.select(*EDGE_COLUMNS, F.inline(F.array(*parts)))


def parts_on_grids(edges: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """The parts of several grids by `n_parts`."""
    return on_each_grid(placed_on_grids(edges, numbers), numbers)


def edge_rows(edge_parts: DataFrame) -> DataFrame:
    """One row per edge copy, whether or not the parts carry a `copies` count."""
    return expand_copies(edge_parts) if "copies" in edge_parts.columns else edge_parts


def part_counts(vertex_parts: DataFrame, edge_parts: DataFrame) -> DataFrame:
    """(snapshot, part, vertices, edges)."""
    copies = F.sum("copies") if "copies" in edge_parts.columns else F.count(F.lit(1))
    zero = F.lit(0).cast("long")
    both = vertex_parts.groupBy("snapshot", "part").agg(
        F.count(F.lit(1)).alias("vertices"), zero.alias("edges")
    ).unionByName(edge_parts.groupBy("snapshot", "part").agg(zero.alias("vertices"), copies.alias("edges")))
    return both.groupBy("snapshot", "part").agg(F.sum("vertices").alias("vertices"), F.sum("edges").alias("edges"))
