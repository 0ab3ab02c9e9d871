"""Graphs from RDF statements: integration of typed resources, and the statement graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.functions import rdf
from kairograph.functions.temporal import place_in
from kairograph.model import EDGE_COLUMNS, PropertyGraph
from kairograph.sources.statements import YEARS

# Markers that select statements.
TYPE_SUFFIX = "#type"
ONTOLOGY_MARK = "/ontology/"
SEE_ALSO = "seealso"


def is_type_statement() -> Column:
    return (F.col("kind") == "types") & F.endswith("predicate", F.lit(TYPE_SUFFIX))


def is_attribute_statement() -> Column:
    return (F.col("kind") == "literals") & F.contains("predicate", F.lit(ONTOLOGY_MARK))


def is_edge_statement() -> Column:
    see_also = F.endswith(F.lower("predicate"), F.lit(SEE_ALSO))
    return (F.col("kind") == "objects") & F.startswith("object", F.lit("http")) & ~see_also


def _number_years(statements: DataFrame, years: Sequence[str]) -> DataFrame:
    """Each year as a snapshot; a year that is not in the list is an error."""
    return statements.withColumn("snapshot", place_in(F.col("year"), years, "year"))


def typed_subjects(statements: DataFrame) -> DataFrame:
    """(snapshot, key, uri, vtype): the least (subject, type) pair of each subject, ignoring case."""
    pair = F.struct(F.col("subject").alias("uri"), rdf.last_uri_part(F.col("object")).alias("vtype"))
    typed = statements.where(is_type_statement()).select(
        "snapshot", F.lower("subject").alias("key"), pair.alias("pair")
    )
    return typed.groupBy("snapshot", "key").agg(F.min("pair").alias("pair")).select("snapshot", "key", "pair.*")


def integrate_rdf(statements: DataFrame, years: Sequence[str] = YEARS) -> PropertyGraph:
    """Typed subjects with their literals, and the objects that link two of them.

    Each year is a snapshot. Statements are a set: copies count once.
    """
    statements = _number_years(statements, years)
    subjects = typed_subjects(statements)
    literals = statements.where(is_attribute_statement()).select(
        "snapshot",
        F.lower("subject").alias("key"),
        rdf.last_uri_part(F.col("predicate")).alias("attr"),
        rdf.literal_lexical(F.col("object")).alias("value"),
    )
    values = literals.groupBy("snapshot", "key", "attr").agg(F.max("value").alias("value"))
    attributes = values.join(subjects, ["snapshot", "key"]).select("snapshot", "vtype", "uri", "attr", "value")
    links = (
        statements.where(is_edge_statement())
        .distinct()
        .select(
            "snapshot",
            F.lower("subject").alias("src_key"),
            F.lower("object").alias("dst_key"),
            rdf.last_uri_part(F.col("predicate")).alias("rel"),
        )
    )
    for end in ("src", "dst"):
        side = subjects.withColumnsRenamed({"key": f"{end}_key", "vtype": f"{end}_type", "uri": f"{end}_uri"})
        links = links.join(side, ["snapshot", f"{end}_key"])
    vertices = subjects.select("snapshot", "vtype", "uri")
    return PropertyGraph(vertices, attributes, links.select(*EDGE_COLUMNS), len(years), closed=True)


def shorten_uris(graph: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """(attributes, edges) with each full URI cut to its last part, ready for formatting."""
    attributes = graph.attributes.withColumn("uri", rdf.last_uri_part(F.col("uri")))
    edges = graph.edges.withColumn("src_uri", rdf.last_uri_part(F.col("src_uri"))).withColumn(
        "dst_uri", rdf.last_uri_part(F.col("dst_uri"))
    )
    return attributes, edges


def statement_vertices(statements: DataFrame) -> DataFrame:
    """URI subjects and how many distinct statements each has.

    The statements themselves stay in the long table: a subject can hold most of them.
    """
    return subject_statements(statements).groupBy("year", "subject").agg(F.count(F.lit(1)).alias("n_statements"))


def subject_statements(statements: DataFrame) -> DataFrame:
    """The distinct statements of URI subjects: (year, subject, predicate, object)."""
    uris = statements.where(~F.startswith("subject", F.lit("_:")))
    return uris.select("year", "subject", "predicate", "object").distinct()


def statement_edges(statements: DataFrame) -> DataFrame:
    """Distinct statements that link two URI subjects; the label is the full predicate."""
    triples = statements.select("year", "subject", "predicate", "object").distinct()
    uris = triples.where(~F.startswith("subject", F.lit("_:")))
    targets = uris.select("year", F.col("subject").alias("object")).distinct()
    return uris.join(targets, ["year", "object"], "left_semi").select("year", "subject", "predicate", "object")


def rdf_type_names(statements: DataFrame) -> DataFrame:
    """(year, subject, type_name) of every distinct rdf:type statement of a URI subject.

    Statements with a comma in any part are left out.
    """
    text = F.concat_ws(" ", "subject", "predicate", "object")
    typed = statements.where((F.col("predicate") == rdf.RDF_TYPE) & ~F.startswith("subject", F.lit("_:")))
    plain = typed.where(~F.contains(text, F.lit(","))).select("year", "subject", "object").distinct()
    name = F.substring_index(F.regexp_replace(F.regexp_replace("object", "[<>]", ""), "/+$", ""), "/", -1)
    return plain.select("year", "subject", name.alias("type_name"))
