"""A graph series, its N-Triples text and its RDF statements, derived from the star-schema tables.

A snapshot is a year of order dates. All rows of the tables take part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairograph.functions import rdf
from kairograph.model import PropertyGraph
from kairograph.plans.storage import write_table
from kairograph.sources.ntriples import format_attributes, format_edges

TYPES = ("order", "customer", "nation", "part", "supplier")
FIRST_FILE_DATE = "170909"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """(first year, number of snapshots) of the orders: one small aggregate."""
    year = F.year("o_orderdate")
    first, last = table(spark, sf_dir, "orders").agg(F.min(year), F.max(year)).first()
    return (first, last - first + 1) if first is not None else (0, 0)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    first_year, _ = series(spark, sf_dir)
    snapshot = (F.year("o_orderdate") - first_year).cast("int").alias("snapshot")
    return table(spark, sf_dir, "orders").select("*", snapshot)


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def dated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_partkey, l_suppkey, snapshot): the lines of all orders."""
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return lineitem.join(orders(spark, sf_dir).select("snapshot", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


def star_graph(spark: SparkSession, sf_dir: str, keep_lines: bool = False) -> PropertyGraph:
    """Orders, their customers, nations, parts and suppliers; every edge has both ends.

    `keep_lines` is for queries that read several of the tables that come from the lines of orders: the largest
    join is then made once and stored, and not again for each of them. The join has the lines of an order in one task, so
    the first line of each pair of order and part is marked there, and the pairs are not moved again to be made distinct.
    """
    order = orders(spark, sf_dir)
    lines = dated_lines(spark, sf_dir)
    if keep_lines:
        same = Window.partitionBy("l_orderkey", "snapshot", "l_partkey").orderBy("l_suppkey")
        lines = write_table(lines.withColumn("first", F.row_number().over(same) == 1), "dated-lines")
    contents = lines.where("first") if keep_lines else lines.select("snapshot", "l_orderkey", "l_partkey").distinct()
    # Keys of the tables are unique, so only what several orders share needs `distinct`.
    customer = table(spark, sf_dir, "customer")
    buyers = order.select("snapshot", F.col("o_custkey").alias("c_custkey")).distinct().join(customer, "c_custkey")
    nations = (
        buyers.select("snapshot", F.col("c_nationkey").alias("n_nationkey"))
        .distinct()
        .join(table(spark, sf_dir, "nation"), "n_nationkey")
    )
    parts = lines.select("snapshot", "l_partkey").distinct()
    parts = parts.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    suppliers = lines.select("snapshot", "l_suppkey").distinct()
    suppliers = suppliers.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    segment = (
        F.when(F.col("c_custkey") % 17 == 0, "????")
        .when(F.col("c_custkey") % 19 == 0, "")
        .otherwise(F.col("c_mktsegment"))
    )

    sources = [
        ("order", order, "o_orderkey", {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}),
        ("customer", buyers, "c_custkey", {"name": F.col("c_name"), "segment": segment}),
        ("nation", nations, "n_nationkey", {"name": F.col("n_name")}),
        ("part", parts, "p_partkey", {"brand": F.col("p_brand"), "kind": F.col("p_type")}),
        ("supplier", suppliers, "s_suppkey", {"name": F.col("s_name")}),
    ]
    vertices = [
        rows.select("snapshot", F.lit(vtype).alias("vtype"), _text(key).alias("uri")) for vtype, rows, key, _ in sources
    ]
    attributes = [
        rows.select(
            "snapshot",
            F.lit(vtype).alias("vtype"),
            _text(key).alias("uri"),
            F.inline(F.array(*[F.struct(F.lit(a).alias("attr"), v.alias("value")) for a, v in columns.items()])),
        )
        for vtype, rows, key, columns in sources
    ]

    def edge(rows: DataFrame, src_type: str, src: str, rel: str, dst_type: str, dst: str) -> DataFrame:
        return rows.select(
            "snapshot",
            F.lit(src_type).alias("src_type"),
            _text(src).alias("src_uri"),
            F.lit(rel).alias("rel"),
            F.lit(dst_type).alias("dst_type"),
            _text(dst).alias("dst_uri"),
        )

    edges = [
        edge(order, "order", "o_orderkey", "placed_by", "customer", "o_custkey"),
        edge(buyers, "customer", "c_custkey", "located_in", "nation", "c_nationkey"),
        # Distinct keys, before they are turned into texts.
        edge(contents, "order", "l_orderkey", "contains", "part", "l_partkey"),
        edge(lines.select("snapshot", "l_suppkey", "l_partkey").distinct(), "supplier", "l_suppkey", "supplies", "part", "l_partkey"),
    ]
    unite = DataFrame.unionByName
    return PropertyGraph(
        reduce(unite, vertices), reduce(unite, attributes), reduce(unite, edges), series(spark, sf_dir)[1], closed=True
    )


def text_lines(spark: SparkSession, sf_dir: str, namespace: str = rdf.IMDB_NAMESPACE) -> DataFrame:
    """(snapshot, line): the whole graph as text, plus awkward lines made from the orders.

    Per order: a typed number; for some orders a date literal, an escaped quote, an empty
    literal, a missing full stop, a foreign subject, a trailing backslash, a predicate
    without a slash, one with a hash, an edge to a vertex that does not exist, a repeated
    attribute, and blanks around the line.
    """
    graph = star_graph(spark, sf_dir, keep_lines=True)
    key = _text("o_orderkey")
    subject = rdf.uri_text(namespace, F.lit("order"), key)
    name = f"<{rdf.PREDICATE_NAMESPACE}/"
    xsd = "<http://www.w3.org/2001/XMLSchema#"
    whole = F.col("o_totalprice").cast("long").cast("string")

    def every(n: int, *parts: str | Column) -> Column:
        text = F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])
        return text if n == 1 else F.when(F.col("o_orderkey") % n == 0, text)

    extra = F.array(
        every(1, subject, f" {name}price> \"", whole, f".5\"^^{xsd}float> ."),
        every(3, subject, f" {name}units> \"", whole, f"\"^^{xsd}integer> ."),
        every(5, subject, f" {name}placed_on> \"", F.date_format("o_orderdate", "yyyy-MM-dd"), f"\"^^{xsd}date> ."),
        every(7, subject, f" {name}note> \"say \\\"hi\\\" now\" ."),
        every(8, subject, f" {name}remark> \"\" ."),
        every(11, subject, f" {name}loose> \"", key, "\""),
        every(13, "<http://elsewhere.example/order/", key, f"> {name}name> \"n", key, "\" ."),
        every(17, subject, f" {name}path> \"dir", key, " \\\" ."),
        every(19, subject, f" {name}path2> \"dir", key, "\\\" ."),
        every(23, subject, " <urn:tag> \"t", key, "\" ."),
        every(29, subject, " <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> \"t\" ."),
        every(31, subject, f" {name}placed_by> ", f"<{namespace}/customer/none", key, "> ."),
        every(37, subject, f" {name}status> \"", F.col("o_orderstatus"), "2\" ."),
        every(41, "  \t", subject, f" {name}padded> \"p\" . \t "),
    )
    awkward = orders(spark, sf_dir).select("snapshot", F.explode(F.array_compact(extra)).alias("line"))
    return format_attributes(graph.attributes, namespace).unionByName(format_edges(graph.edges, namespace)).unionByName(
        awkward
    )


def file_name(snapshot: Column) -> Column:
    date = F.add_months(F.to_date(F.lit(FIRST_FILE_DATE), "yyMMdd"), snapshot)
    return F.concat(F.lit("imdb-"), F.date_format(date, "yyMMdd"), F.lit(".nt"))


def last_file_date(n_snapshots: int) -> str:
    """The date of the last file, one month after the one before it."""
    months = 8 + n_snapshots - 1
    return f"{17 + months // 12:02d}{months % 12 + 1:02d}09"


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, kind, line): all orders, their customers and nations, dealt to the four years of the layout."""
    year = F.pmod(F.year("o_orderdate") - series(spark, sf_dir)[0], F.lit(4)) + 2014
    order = table(spark, sf_dir, "orders").withColumn("year", year.cast("string"))
    customer = table(spark, sf_dir, "customer")
    buyers = order.select("year", F.col("o_custkey").alias("c_custkey")).distinct().join(customer, "c_custkey")
    nations = (
        buyers.select("year", F.col("c_nationkey").alias("n_nationkey"))
        .distinct()
        .join(table(spark, sf_dir, "nation"), "n_nationkey")
    )
    resource, ontology = "<http://dbpedia.org/resource/", "<http://dbpedia.org/ontology/"
    xsd = "<http://www.w3.org/2001/XMLSchema#"

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])

    def res(prefix: str, key: str) -> Column:
        return text(resource + prefix + "_", _text(key), ">")

    order_uri, buyer_uri, nation_uri = res("Order", "o_orderkey"), res("Customer", "c_custkey"), res("Nation", "n_nationkey")
    rdf_type = f" <{rdf.RDF_TYPE}> "
    types = [
        order.select("year", text(order_uri, rdf_type, ontology + "Order> .").alias("line")),
        order.where(F.col("o_orderkey") % 6 == 0).select(
            "year", text(order_uri, rdf_type, ontology + "Document> .").alias("line")
        ),
        buyers.where(F.col("c_custkey") % 9 != 0).select(
            "year", text(buyer_uri, rdf_type, ontology, F.col("c_mktsegment"), "> .").alias("line")
        ),
        nations.select("year", text(nation_uri, rdf_type, ontology + "Nation> .").alias("line")),
        nations.select("year", text(nation_uri, rdf_type, "<http://example.org/a,b/Nation> .").alias("line")),
    ]
    total = F.col("o_totalprice").cast("long").cast("string")
    literals = [
        order.select("year", text(order_uri, f" {ontology}total> \"", total, f"\"^^{xsd}integer> .").alias("line")),
        order.where(F.col("o_orderkey") % 4 == 0).select(
            "year", text(order_uri, f" {ontology}total> \"", total, f"7\"^^{xsd}integer> .").alias("line")
        ),
        order.where(F.col("o_orderkey") % 11 == 0).select(
            "year",
            text(order_uri, f" {ontology}note> \"caf\\u00E9 \\U0001F600 \\uD83D\\uDE00 line\\nbreak ", _text("o_orderkey"), "\" .").alias("line"),
        ),
        buyers.select("year", text(buyer_uri, f" {ontology}Name> \"", F.col("c_name"), "\"@en .").alias("line")),
        buyers.select("year", text(buyer_uri, " <http://example.org/rank> \"1\" .").alias("line")),
        nations.select("year", text(nation_uri, f" {ontology}label> \"the \\\"", F.col("n_name"), "\\\"\" .").alias("line")),
    ]
    bought_by = text(resource + "Customer_", _text("o_custkey"), ">")
    lower_buyer = text("<http://dbpedia.org/resource/customer_", _text("o_custkey"), ">")
    in_nation = text(resource + "Nation_", _text("c_nationkey"), ">")
    objects = [
        order.select("year", text(order_uri, f" {ontology}placedBy> ", bought_by, " .").alias("line")),
        order.where(F.col("o_orderkey") % 5 == 0).select(
            "year", text(order_uri, f" {ontology}soldTo> ", lower_buyer, " .").alias("line")
        ),
        order.where(F.col("o_orderkey") % 7 == 0).select(
            "year", text(order_uri, " <http://www.w3.org/2000/01/rdf-schema#seeAlso> ", bought_by, " .").alias("line")
        ),
        order.where(F.col("o_orderkey") % 8 == 0).select(
            "year", text(order_uri, f" {ontology}placedBy> ", bought_by, "  . ").alias("line")
        ),
        buyers.select("year", text(buyer_uri, f" {ontology}locatedIn> ", in_nation, " .").alias("line")),
        buyers.where(F.col("c_custkey") % 10 == 0).select(
            "year", text("_:b", _text("c_custkey"), f" {ontology}locatedIn> ", in_nation, " .").alias("line")
        ),
    ]
    kinds = {"types": types, "literals": literals, "objects": objects}
    rows = [part.withColumn("kind", F.lit(kind)) for kind, parts in kinds.items() for part in parts]
    return reduce(DataFrame.unionByName, rows).select("year", "kind", "line")


# The prefixes of the Turtle form of the statements.
TURTLE_PREFIXES = {
    "res": "http://dbpedia.org/resource/",
    "dbo": "http://dbpedia.org/ontology/",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}


def turtle_blocks(lines: DataFrame) -> DataFrame:
    """(year, kind, text): the statements of a subject as one block over several lines, with prefixes."""
    # The pattern is matched once per line; a line that does not match has empty parts.
    mark = chr(2)
    marked = F.regexp_replace("line", r"^(\S+) (\S+) (.*\S)\s*\.\s*$", f"$1{mark}$2{mark}$3")
    cut = lines.select("year", "kind", F.split(marked, mark, 3).alias("parts"))
    parts = [F.when(F.size("parts") == 3, F.get("parts", F.lit(i))).when(F.col("parts").isNotNull(), "") for i in range(3)]
    terms = ("subject", "predicate", "node")
    cut = cut.select("year", "kind", *[part.alias(name) for part, name in zip(parts, terms, strict=True)])
    # A step for each prefix, so that a term is worked out once for the next.
    is_type = F.col("predicate") == f"<{rdf.RDF_TYPE}>"
    for name, iri in TURTLE_PREFIXES.items():
        pattern, short = rf"^((?:\".*\"\^\^)?)<{iri}(\w+)>$", f"$1{name}:$2"
        held = {t: F.contains(F.col(t), F.lit(f"<{iri}")) for t in terms}
        cut = cut.withColumns({t: F.when(held[t], F.regexp_replace(t, pattern, short)).otherwise(F.col(t)) for t in terms})
    predicate = F.when(is_type, "a").otherwise(F.col("predicate"))
    long = F.regexp_replace(F.replace("node", F.lit("\\n"), F.lit("\n")), r'(?s)^"(.*)"([^"]*)$', '"""$1"""$2')
    node = F.when(F.contains("node", F.lit("\\")), long).otherwise(F.col("node"))
    pairs = cut.select("year", "kind", "subject", F.concat(predicate, F.lit(" "), node).alias("pair"))
    blocks = pairs.groupBy("year", "kind", "subject").agg(F.array_join(F.collect_list("pair"), " ;\n  ").alias("pairs"))
    return blocks.select("year", "kind", F.concat("subject", F.lit("\n  "), "pairs", F.lit("\n.")).alias("text"))
