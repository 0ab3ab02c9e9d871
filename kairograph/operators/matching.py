"""Matching patterns in all snapshots at once, and the attribute tuples of the matches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.functions.rdf import INVALID_VALUES
from kairograph.functions.temporal import and_words, occurrences, or_words, overlaps, snapshot_words, word_names
from kairograph.model import ATTRIBUTE_COLUMNS, EDGE_KEY, PropertyGraph
from kairograph.operators.assembly import closed_edges
from kairograph.operators.patterns import PatternEdge, make_pattern
from kairograph.plans.storage import Once, write_table

Attribute = tuple[str, str]  # (vertex type, attribute name)
# Products of counts of hubs can exceed LONG on the way.
COUNT = "decimal(38,0)"


def column_name(attribute: Attribute) -> str:
    return "_".join(attribute)


def is_kind(edge: PatternEdge) -> Column:
    return (F.col("src_type") == edge.src) & (F.col("rel") == edge.rel) & (F.col("dst_type") == edge.dst)


def edges_of(edges: DataFrame, edge: PatternEdge) -> DataFrame:
    return edges.where(is_kind(edge))


def _connected_order(edges: Sequence[PatternEdge]) -> list[PatternEdge]:
    """The edges in an order in which each one touches an earlier one."""
    rest, ordered, seen = list(edges), [], set()
    while rest:
        following = next((e for e in rest if not seen or e.src in seen or e.dst in seen), None)
        if following is None:
            raise ValueError("a pattern must be connected")
        rest.remove(following)
        ordered.append(following)
        seen.update((following.src, following.dst))
    return ordered


def _rarest_first(all_edges: DataFrame, edges: Sequence[PatternEdge]) -> list[PatternEdge]:
    """The edges of a pattern by the number of rows of their types, one row per type counted."""
    if len(edges) < 2:
        return list(edges)
    kinds = [(F.col("src_type") == e.src) & (F.col("rel") == e.rel) & (F.col("dst_type") == e.dst) for e in edges]
    wanted = all_edges.where(reduce(lambda a, b: a | b, kinds))
    rows = wanted.groupBy("src_type", "rel", "dst_type").agg(F.count(F.lit(1)).alias("n")).collect()
    found = {(row.src_type, row.rel, row.dst_type): row.n for row in rows}
    return sorted(edges, key=lambda e: found.get((e.src, e.rel, e.dst), 0))


def motif_match(
    graph: PropertyGraph, edges: Sequence[tuple[str, str, str]], tables: Mapping[PatternEdge, DataFrame] | None = None
) -> DataFrame:
    """Every instance of the pattern: (snapshot, `<type>_uri` for each vertex type).

    Listing instances is the purpose here, so a hub multiplies them. Use `instance_counts`
    to count them and `presence_by_tuple` for their attribute values; neither lists them.
    The joins begin with the rarest edge type, by one count of the types of the pattern, and go
    on with the rarest that is connected. `tables` may hold the edges that are left by
    `reduction.reduced_edges`: then every row of every step is part of a match.
    """
    all_edges = closed_edges(graph)
    wanted = [PatternEdge(*e) for e in edges]
    tables = tables or {e: edges_of(all_edges, e) for e in wanted}
    matches = None
    for edge in _connected_order(_rarest_first(all_edges, wanted)):
        ends = [F.col("src_uri").alias(f"{edge.src}_uri"), F.col("dst_uri").alias(f"{edge.dst}_uri")]
        rows = tables[edge].select("snapshot", *ends)
        if matches is None:
            matches = rows
        else:
            matches = matches.join(rows, [name for name in rows.columns if name in matches.columns])
    return matches


def dependency_columns(matches: DataFrame, attributes: DataFrame, dependency: Sequence[Attribute]) -> DataFrame:
    """(snapshot, `<type>_<attribute>` ...): attribute values of each match, '' when missing."""
    for vtype, attr in dependency:
        wanted = attributes.where((F.col("vtype") == vtype) & (F.col("attr") == attr))
        name = column_name((vtype, attr))
        side = wanted.select("snapshot", F.col("uri").alias(f"{vtype}_uri"), F.col("value").alias(name))
        joined = matches.join(side, ["snapshot", f"{vtype}_uri"], "left")
        matches = joined.withColumn(name, F.coalesce(name, F.lit("")))
    return matches.select("snapshot", *[column_name(a) for a in dependency])


@dataclass(frozen=True)
class TemporalGraph:
    """A graph series with one row per distinct item and a presence mask over time.

    edges   (src_type, src_uri, rel, dst_type, dst_uri, mask words)
    values  (vtype, uri, attr, value, mask words), valid values only
    n_attrs  0, or how many attributes there are when values are numbers that tell theirs: the number modulo n_attrs
    """

    edges: DataFrame
    values: DataFrame
    n_snapshots: int
    n_attrs: int = 0
    sizes: Mapping[PatternEdge, int] | None = None  # rows by kind of edge, if they have been counted


def compress(graph: PropertyGraph, kinds: Sequence[PatternEdge] | None = None, fold: bool = True) -> TemporalGraph:
    """Fold the snapshots of equal edges and equal values into masks.

    An edge that lives through the whole series costs one row instead of one per snapshot
    in every later join. With `kinds`, only edges of these kinds are folded, by the place of their kind and their ends, and
    only values of their types. Without `fold`, edges stay as they are, a row for each snapshot and copy: matching merges what it
    sends on, so the results are the same. Edges of a single snapshot have nothing to fold.
    """
    words = snapshot_words(F.col("snapshot"), graph.n_snapshots)
    valid = graph.attributes.where(F.col("value").isNotNull() & ~F.col("value").isin(*INVALID_VALUES))
    edges, key, named = closed_edges(graph), EDGE_KEY, [F.col(name) for name in EDGE_KEY]
    if kinds is not None:
        valid = valid.where(F.col("vtype").isin(sorted({vtype for e in kinds for vtype in (e.src, e.dst)})))
        place = F.coalesce(*[F.when(is_kind(e), i) for i, e in enumerate(kinds)])
        edges, key = edges.withColumn("kind", place).where(F.col("kind").isNotNull()), ["kind", "src_uri", "dst_uri"]
        parts = {name: F.get(F.array(*[F.lit(e[i]) for e in kinds]), F.col("kind")) for i, name in enumerate(("src_type", "rel", "dst_type"))}
        named = [parts.get(name, F.col(name)).alias(name) for name in EDGE_KEY]
    value_key = ATTRIBUTE_COLUMNS[1:]
    united = or_words(graph.n_snapshots)
    edges = edges.select(*key, *words)
    if fold and graph.n_snapshots > 1:
        edges = edges.groupBy(*key).agg(*united)
    return TemporalGraph(
        edges.select(*named, *word_names(graph.n_snapshots)),
        valid.select(*value_key, *words).groupBy(*value_key).agg(*united),
        graph.n_snapshots,
    )


def require_tree(edges: Sequence[PatternEdge]) -> None:
    _connected_order(edges)
    types = {name for edge in edges for name in (edge.src, edge.dst)}
    if len(types) != len(edges) + 1:
        raise ValueError("the edges of the pattern must form a tree")


def center(edges: Sequence[PatternEdge], sizes: Mapping[PatternEdge, int] | None = None) -> str:
    """The type with most edges of the pattern; of several that with most rows of them, which are then not sent on."""
    names = [name for edge in edges for name in (edge.src, edge.dst)]
    rows = {name: sum((sizes or {}).get(e, 0) for e in edges if name in (e.src, e.dst)) for name in names}
    return min(rows, key=lambda name: (-names.count(name), -rows[name], name))


def branches(edges: Sequence[PatternEdge], at: str) -> list[tuple[PatternEdge, str, str, str]]:
    """(edge, next type, column of this end, column of the next end) around a vertex type."""
    out = [(e, e.dst, "src_uri", "dst_uri") for e in edges if e.src == at]
    return out + [(e, e.src, "dst_uri", "src_uri") for e in edges if e.dst == at]


def reached_edges(edges: Sequence[PatternEdge], at: str) -> list[PatternEdge]:
    """The edges that hang together with a type."""
    found = []
    for edge, below, _, _ in branches(edges, at):
        found += [edge, *reached_edges([e for e in edges if e != edge], below)]
    return found


def _factors(
    temporal: TemporalGraph, edges: Sequence[PatternEdge], options: Mapping[str, Sequence[str] | None], at: str
) -> dict[tuple, DataFrame]:
    """The parts whose product at each `at` vertex is its tuples: its own values, and those of each branch.

    Each is (uri, choice and value columns, mask), distinct, under what it is made of. Values that tell their attribute go without the choices.
    """
    size = temporal.n_snapshots
    words = word_names(size)
    found_parts: dict[tuple, DataFrame] = {}
    if at in options:
        own = temporal.values.where(F.col("vtype") == at)
        if options[at] is not None:
            own = own.where(F.col("attr").isin(list(options[at])))
        columns = [] if temporal.n_attrs else [F.col("attr").alias(choice_name(at))]
        columns.append(F.col("value").alias(value_name(at)))
        found_parts[at, options[at] and tuple(options[at])] = own.select("uri", *columns, *words)
    for edge, below, here, there in branches(edges, at):
        rest = [e for e in edges if e != edge]
        links = edges_of(temporal.edges, edge).select(
            F.col(here).alias("uri"), F.col(there).alias("below_uri"), *words
        )
        subtree = _reduced(temporal, rest, options, below)
        if subtree is None:
            found: list[str] = []
            reached = links.select("uri", *words)
        else:
            found = [c for c in subtree.columns if c != "uri" and c not in words]
            matched = links.alias("a").join(
                subtree.withColumnRenamed("uri", "below_uri").alias("b"),
                (F.col("a.below_uri") == F.col("b.below_uri")) & overlaps("a", "b", size),
            )
            reached = matched.select("a.uri", *[F.col(f"b.`{n}`") for n in found], *and_words("a", "b", size))
        # Merging here, map-side first, is what keeps a hub from multiplying: however many
        # neighbours it has, only their distinct values go on.
        message = reached.groupBy("uri", *[f"`{n}`" for n in found]).agg(*or_words(size))
        below_edges = reached_edges(rest, below)
        types = sorted({vtype for e in [edge, *below_edges] for vtype in (e.src, e.dst)} - {at})
        chosen = tuple((vtype, options[vtype] and tuple(options[vtype])) for vtype in types if vtype in options)
        found_parts[at, edge, frozenset(below_edges), chosen] = message
    return found_parts


def _joined(factors: Sequence[DataFrame], size: int) -> DataFrame | None:
    """The product of the factors of each vertex, over the snapshots that they share."""
    result = None
    for factor in factors:
        if result is None:
            result = factor
            continue
        words = word_names(size)
        kept, found = ([c for c in rows.columns if c != "uri" and c not in words] for rows in (result, factor))
        both = result.alias("a").join(
            factor.alias("b"), (F.col("a.uri") == F.col("b.uri")) & overlaps("a", "b", size)
        )
        columns = [F.col(f"a.`{n}`") for n in kept] + [F.col(f"b.`{n}`") for n in found]
        result = both.select("a.uri", *columns, *and_words("a", "b", size))
    return result


def _reduced(
    temporal: TemporalGraph, edges: Sequence[PatternEdge], options: Mapping[str, Sequence[str] | None], at: str
) -> DataFrame | None:
    """(uri, choice and value columns, mask): the distinct value tuples of the subtree below each vertex."""
    return _joined([*_factors(temporal, edges, options, at).values()], temporal.n_snapshots)


def _choices(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c.endswith(":choice")]


def _values(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c.endswith(":value")]


def _quoted(names: Sequence[str]) -> list[str]:
    return [f"`{name}`" for name in names]


def _with_choices(rows: DataFrame, n_attrs: int) -> DataFrame:
    """The rows with the choices that their values tell."""
    if not n_attrs:
        return rows
    return rows.withColumns({f"{c.removesuffix('value')}choice": F.pmod(F.col(f"`{c}`"), F.lit(n_attrs)).cast("long") for c in _values(rows)})


def _least_tuples(factors: Sequence[DataFrame], size: int) -> DataFrame:
    """(choice columns, least): a number of tuples that each choice has at the least, found without making them.

    In one snapshot a vertex has as many tuples as the product of the sizes of its factors. These are
    counted factor by factor, so a hub of m and n values is m + n rows here and not m x n.
    """
    counted = None
    for factor in factors:
        keys = ["uri", "snapshot", *[f"`{c}`" for c in _choices(factor)]]
        seen = factor.select("uri", *[f"`{c}`" for c in _choices(factor)], F.explode(occurrences(size)).alias("snapshot"))
        own = seen.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"))
        if counted is None:
            counted = own
        else:
            both = counted.join(own.withColumnRenamed("n", "more"), ["uri", "snapshot"])
            counted = both.withColumn("n", F.col("n") * F.col("more")).drop("more")
    return counted.groupBy(*[f"`{c}`" for c in _choices(counted)]).agg(F.max("n").alias("least"))


@dataclass(frozen=True)
class Factor:
    """A stored factor, its choices with more values than asked for, and the greatest number of its rows at a vertex."""

    rows: DataFrame
    large: DataFrame | None
    most_rows: int


def _stored_factor(rows: DataFrame, n_attrs: int, most: float) -> Factor:
    rows = _with_choices(write_table(rows, "factor"), n_attrs)
    names, large = _quoted(_choices(rows)), None
    if names:
        sizes = rows.select(*names, *_quoted(_values(rows))).distinct().groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
        large = write_table(sizes.where(F.col("n") > most).select(*names), "large-choices")
        large = None if large.isEmpty() else large
    at_vertex = rows.groupBy("uri").agg(F.count(F.lit(1)).alias("n"))
    return Factor(rows, large, at_vertex.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])


def _without_many(found: Sequence[Factor], size: int, most: float) -> list[DataFrame]:
    """The factors without choices whose values alone make more than `most` tuples with every choice of the others.

    A row of a factor is in a tuple of a choice where the other factors of its vertex hold that choice, whatever the values, in a
    common snapshot. So the distinct rows that do are a bound of the tuples, found without a product.
    """
    held = [f.rows.groupBy("uri", *_quoted(_choices(f.rows))).agg(*or_words(size)) for f in found]
    out = []
    for place, factor in enumerate(found):
        rows = factor.rows
        if factor.large is not None:
            names = _quoted(_choices(rows))
            met = _joined([rows.join(factor.large, _choices(rows), "left_semi"), *held[:place], *held[place + 1 :]], size)
            every = _quoted(_choices(met))
            counted = met.select(*every, *_quoted(_values(rows))).distinct().groupBy(*every).agg(F.count(F.lit(1)).alias("n"))
            closed = counted.groupBy(*names).agg(F.min("n").alias("least")).where(F.col("least") > most).select(*names)
            rows = rows.join(write_table(closed, "closed-choices"), _choices(rows), "left_anti")
        out.append(rows)
    return out


def _bounded(
    made: Mapping[tuple, DataFrame], size: int, most: float, n_attrs: int, shared: Once
) -> tuple[list[DataFrame], DataFrame | None]:
    """The factors without what only serves choices that have more than `most` tuples for certain, and the choices left.

    The last is None where no vertex can have so many: no more than the product of the greatest numbers of rows.
    """
    found = [shared.get(key, lambda rows=rows: _stored_factor(rows, n_attrs, most)) for key, rows in made.items()]
    factors = _without_many(found, size, most)
    if prod(f.most_rows for f in found) <= most:
        return factors, None
    open_ = write_table(_least_tuples(factors, size).where(F.col("least") <= most).drop("least"), "choices")
    out = []
    for factor in factors:
        names = _choices(factor)
        kept = open_.select(*_quoted(names)).distinct() if names else open_.limit(1)
        out.append(factor.join(kept, names, "left_semi") if names else factor.join(kept, F.lit(True), "left_semi"))
    return out, open_


def choice_name(vtype: str) -> str:
    return f"{vtype}:choice"


def value_name(vtype: str) -> str:
    return f"{vtype}:value"


def presence_by_choice(
    temporal: TemporalGraph,
    edges: Sequence[tuple[str, str, str]],
    options: Mapping[str, Sequence[str] | None],
    most: float | None = None,
    shared: Once | None = None,
) -> DataFrame:
    """Distinct valid attribute tuples of all matches, for every choice of one attribute per type.

    `edges` form a tree and `options` lists the attributes of its types, None for all of
    them. The result has, for each type, the chosen attribute and its value, and the mask of the
    snapshots in which the tuple occurs. The choice is one more grouping column, so all
    dependencies of a pattern come from a single pass over its edges.

    Instances are not listed: values travel along the tree towards its centre and are
    merged at every step. Where branches meet, m values of one and n of another make m x n tuples. With `most`,
    the factors are counted before that, and choices that would have more tuples than that, at a single vertex or by the
    values of one factor alone, are left out; all others are whole. `shared` keeps the factors for other patterns of the
    same graph with the same `most`.
    """
    pattern = make_pattern(edges)
    require_tree(pattern.edges)
    made = _factors(temporal, pattern.edges, options, center(pattern.edges, temporal.sizes))
    factors, open_ = [*made.values()], None
    if most is not None:
        factors, open_ = _bounded(made, temporal.n_snapshots, most, temporal.n_attrs, Once() if shared is None else shared)
        if open_ is None and temporal.n_attrs:
            factors = [f.drop(*_choices(f)) for f in factors]
    reduced = _joined(factors, temporal.n_snapshots)
    if open_ is not None:
        reduced = reduced.join(open_, _choices(open_), "left_semi")
    names = [name(vtype) for vtype in options for name in (choice_name, value_name) if name is value_name or not temporal.n_attrs]
    merged = reduced.groupBy(*_quoted(names)).agg(*or_words(temporal.n_snapshots))
    return _with_choices(merged, temporal.n_attrs)


def presence_by_tuple(
    temporal: TemporalGraph, edges: Sequence[tuple[str, str, str]], dependency: Sequence[Attribute]
) -> DataFrame:
    """The tuples of one dependency, which names at most one attribute per type."""
    rows = presence_by_choice(temporal, edges, {vtype: [attr] for vtype, attr in dependency})
    values = [F.col(f"`{value_name(vtype)}`").alias(column_name((vtype, attr))) for vtype, attr in dependency]
    return rows.select(*values, *word_names(temporal.n_snapshots))


def _counted(all_edges: DataFrame, edges: Sequence[PatternEdge], at: str) -> DataFrame | None:
    """(snapshot, uri, n): instances of the subtree below each `at` vertex."""
    result = None
    for edge, below, here, there in branches(edges, at):
        rest = [e for e in edges if e != edge]
        links = edges_of(all_edges, edge).select("snapshot", F.col(here).alias("uri"), F.col(there).alias("below_uri"))
        subtree = _counted(all_edges, rest, below)
        if subtree is None:
            weighted = links.withColumn("n", F.lit(1).cast(COUNT))
        else:
            weighted = links.join(subtree.withColumnRenamed("uri", "below_uri"), ["snapshot", "below_uri"])
        message = weighted.groupBy("snapshot", "uri").agg(F.sum("n").cast(COUNT).alias("n"))
        if result is None:
            result = message
        else:
            joined = result.join(message.withColumnRenamed("n", "more"), ["snapshot", "uri"])
            result = joined.select("snapshot", "uri", (F.col("n") * F.col("more")).cast(COUNT).alias("n"))
    return result


def instance_counts(graph: PropertyGraph, edges: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(snapshot, n): number of instances of a tree pattern, without listing them.

    Products are taken in decimals; a number beyond LONG is an error only as the final result.
    """
    pattern = make_pattern(edges)
    require_tree(pattern.edges)
    counted = _counted(closed_edges(graph), pattern.edges, center(pattern.edges))
    return counted.groupBy("snapshot").agg(F.sum("n").cast("long").alias("n"))
