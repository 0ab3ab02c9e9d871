"""Independent SQL for the registered queries, over the given tables."""

from __future__ import annotations

from itertools import product

IMDB = "http://imdb.org"
DBPEDIA = "http://dbpedia.org"
FOAF = "http://xmlns.com/foaf/0.1"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RES, ONT = "<http://dbpedia.org/resource/", "<http://dbpedia.org/ontology/"
# Steps of the chain of samples: the number of years of the given orders.
CHAIN = 7
FIRST_YEAR = "(SELECT min(year(o_orderdate)) FROM orders)"

GRAPH = """
WITH RECURSIVE ord AS (
  SELECT *, CAST(year(o_orderdate) - (SELECT min(year(o_orderdate)) FROM orders) AS INTEGER) AS snapshot FROM orders),
lin AS (
  SELECT o.snapshot, l.l_orderkey, l.l_partkey, l.l_suppkey
  FROM lineitem l JOIN ord o ON o.o_orderkey = l.l_orderkey),
buy AS (SELECT DISTINCT o.snapshot, c.* FROM ord o JOIN customer c ON c.c_custkey = o.o_custkey),
nat AS (SELECT DISTINCT b.snapshot, n.* FROM buy b JOIN nation n ON n.n_nationkey = b.c_nationkey),
prt AS (SELECT DISTINCT l.snapshot, p.* FROM lin l JOIN part p ON p.p_partkey = l.l_partkey),
sup AS (SELECT DISTINCT l.snapshot, s.* FROM lin l JOIN supplier s ON s.s_suppkey = l.l_suppkey),
attrs AS (
  SELECT snapshot, 'order' AS vtype, CAST(o_orderkey AS VARCHAR) AS uri, 'status' AS attr, o_orderstatus AS value FROM ord
  UNION ALL SELECT snapshot, 'order', CAST(o_orderkey AS VARCHAR), 'priority', o_orderpriority FROM ord
  UNION ALL SELECT snapshot, 'customer', CAST(c_custkey AS VARCHAR), 'name', c_name FROM buy
  UNION ALL SELECT snapshot, 'customer', CAST(c_custkey AS VARCHAR), 'segment',
    CASE WHEN c_custkey % 17 = 0 THEN '????' WHEN c_custkey % 19 = 0 THEN '' ELSE c_mktsegment END FROM buy
  UNION ALL SELECT snapshot, 'nation', CAST(n_nationkey AS VARCHAR), 'name', n_name FROM nat
  UNION ALL SELECT snapshot, 'part', CAST(p_partkey AS VARCHAR), 'brand', p_brand FROM prt
  UNION ALL SELECT snapshot, 'part', CAST(p_partkey AS VARCHAR), 'kind', p_type FROM prt
  UNION ALL SELECT snapshot, 'supplier', CAST(s_suppkey AS VARCHAR), 'name', s_name FROM sup),
verts AS (SELECT DISTINCT snapshot, vtype, uri FROM attrs),
edges AS (
  SELECT snapshot, 'order' AS src_type, CAST(o_orderkey AS VARCHAR) AS src_uri, 'placed_by' AS rel,
    'customer' AS dst_type, CAST(o_custkey AS VARCHAR) AS dst_uri FROM ord
  UNION ALL SELECT snapshot, 'customer', CAST(c_custkey AS VARCHAR), 'located_in', 'nation', CAST(c_nationkey AS VARCHAR) FROM buy
  UNION ALL SELECT DISTINCT snapshot, 'order', CAST(l_orderkey AS VARCHAR), 'contains', 'part', CAST(l_partkey AS VARCHAR) FROM lin
  UNION ALL SELECT DISTINCT snapshot, 'supplier', CAST(l_suppkey AS VARCHAR), 'supplies', 'part', CAST(l_partkey AS VARCHAR) FROM lin)
"""

# The text form of the graph, its parse, and the graph built from it ------------------


def lines_cte(namespace: str = IMDB) -> str:
    subject = f"'<{namespace}/order/' || o_orderkey || '>'"
    key = "CAST(o_orderkey AS VARCHAR)"
    extras = [
        (1, f"{subject} || ' <{FOAF}/price> \"' || CAST(floor(o_totalprice) AS BIGINT) || '.5\"^^<{XSD}float> .'"),
        (3, f"{subject} || ' <{FOAF}/units> \"' || CAST(floor(o_totalprice) AS BIGINT) || '\"^^<{XSD}integer> .'"),
        (5, f"{subject} || ' <{FOAF}/placed_on> \"' || strftime(o_orderdate, '%Y-%m-%d') || '\"^^<{XSD}date> .'"),
        (7, f"{subject} || ' <{FOAF}/note> \"say \\\"hi\\\" now\" .'"),
        (8, f"{subject} || ' <{FOAF}/remark> \"\" .'"),
        (11, f"{subject} || ' <{FOAF}/loose> \"' || {key} || '\"'"),
        (13, f"'<http://elsewhere.example/order/' || {key} || '> <{FOAF}/name> \"n' || {key} || '\" .'"),
        (17, f"{subject} || ' <{FOAF}/path> \"dir' || {key} || ' \\\" .'"),
        (19, f"{subject} || ' <{FOAF}/path2> \"dir' || {key} || '\\\" .'"),
        (23, f"{subject} || ' <urn:tag> \"t' || {key} || '\" .'"),
        (29, f"{subject} || ' <{RDF_TYPE}> \"t\" .'"),
        (31, f"{subject} || ' <{FOAF}/placed_by> <{namespace}/customer/none' || {key} || '> .'"),
        (37, f"{subject} || ' <{FOAF}/status> \"' || o_orderstatus || '2\" .'"),
        (41, f"'  ' || chr(9) || {subject} || ' <{FOAF}/padded> \"p\" . ' || chr(9) || ' '"),
    ]
    awkward = "\n".join(
        f"  UNION ALL SELECT snapshot, {text} FROM ord WHERE o_orderkey % {n} = 0" for n, text in extras
    )
    return f""",
lines AS (
  SELECT snapshot, '<{namespace}/' || vtype || '/' || uri || '> <{FOAF}/' || attr || '> "' || value || '" .' AS line FROM attrs
  UNION ALL SELECT snapshot, '<{namespace}/' || src_type || '/' || src_uri || '> <{FOAF}/' || rel || '> <{namespace}/'
    || dst_type || '/' || dst_uri || '> .' FROM edges
{awkward})"""


def parse_cte(types: tuple[str, ...] | None = None, strip_xsd: bool = True, namespace: str = IMDB) -> str:
    text = "left(trimmed, length(trimmed) - 1)"
    if strip_xsd:
        text = f"regexp_replace({text}, '\\^\\^<http://www\\.w3\\.org/2001/XMLSchema#(float|integer)>', '', 'g')"
    blanks = " || ".join(f"chr({code})" for code in (9, 10, 11, 12, 13, 32))

    def wanted(uri: str) -> str:
        return "TRUE" if types is None else "(" + " OR ".join(f"contains({uri}, '{t}')" for t in types) + ")"

    def part(uri: str, group: int, default: str) -> str:
        return (
            f"CASE WHEN regexp_full_match({uri}, '<{namespace}/([^/]+)/([^>]+)>') "
            f"THEN regexp_extract({uri}, '^<{namespace}/([^/]+)/([^>]+)>$', {group}) ELSE '{default}' END"
        )

    return f""",
trimmed AS (SELECT snapshot, trim(line, {blanks}) AS trimmed FROM lines),
found AS (
  SELECT snapshot, regexp_extract_all(body, '<[^>]+>') AS uris, regexp_extract_all(body, '"[^"]+"') AS lits
  FROM (SELECT snapshot, {text} AS body FROM trimmed)),
kinds AS (
  SELECT *, CASE WHEN len(uris) = 2 AND len(lits) = 1 AND {wanted("uris[1]")} THEN 'attribute'
    WHEN len(uris) = 3 AND {wanted("uris[1]")} AND {wanted("uris[3]")} THEN 'edge' END AS kind FROM found),
triples AS MATERIALIZED (
  SELECT snapshot, uris[1] AS subject,
    CASE WHEN regexp_extract(uris[2], '/([^/>]+)>$', 1) = '' THEN 'unknown'
      ELSE regexp_extract(uris[2], '/([^/>]+)>$', 1) END AS name,
    CASE kind WHEN 'attribute' THEN replace(lits[1], '"', '') ELSE uris[3] END AS object, kind
  FROM kinds WHERE kind IS NOT NULL),
tattrs AS MATERIALIZED (
  SELECT snapshot, {part("subject", 1, "unknownType")} AS vtype, {part("subject", 2, "unknownResource")} AS uri,
    name AS attr, max(object) AS value
  FROM triples WHERE kind = 'attribute' GROUP BY ALL),
tverts AS MATERIALIZED (SELECT DISTINCT snapshot, vtype, uri FROM tattrs),
tedges AS MATERIALIZED (
  SELECT snapshot, {part("subject", 1, "unknownType")} AS src_type, {part("subject", 2, "unknownResource")} AS src_uri,
    name AS rel, {part("object", 1, "unknownType")} AS dst_type, {part("object", 2, "unknownResource")} AS dst_uri
  FROM triples WHERE kind = 'edge'),
tclosed AS (
  SELECT * FROM tedges
  WHERE (snapshot, src_type, src_uri) IN (SELECT snapshot, vtype, uri FROM tverts)
    AND (snapshot, dst_type, dst_uri) IN (SELECT snapshot, vtype, uri FROM tverts))"""


LINES = GRAPH + lines_cte()
TEXT = LINES + parse_cte()
FILE_NAME = "'imdb-' || strftime(DATE '2017-09-09' + to_months(snapshot), '%y%m%d') || '.nt'"

# The RDF statements --------------------------------------------------------------------


def _statement_rows() -> str:
    order_uri = f"'{RES[1:]}Order_' || o_orderkey"
    buyer_uri = f"'{RES[1:]}Customer_' || c_custkey"
    nation_uri = f"'{RES[1:]}Nation_' || n_nationkey"
    ont = ONT[1:]
    bought_by = f"'{RES[1:]}Customer_' || o_custkey"
    total = "CAST(floor(o_totalprice) AS BIGINT)"
    rows = [
        ("types", "sord", order_uri, f"'{RDF_TYPE}'", f"'{ont}Order'", "TRUE"),
        ("types", "sord", order_uri, f"'{RDF_TYPE}'", f"'{ont}Document'", "o_orderkey % 6 = 0"),
        ("types", "sbuy", buyer_uri, f"'{RDF_TYPE}'", f"'{ont}' || c_mktsegment", "c_custkey % 9 <> 0"),
        ("types", "snat", nation_uri, f"'{RDF_TYPE}'", f"'{ont}Nation'", "TRUE"),
        ("types", "snat", nation_uri, f"'{RDF_TYPE}'", "'http://example.org/a,b/Nation'", "TRUE"),
        ("literals", "sord", order_uri, f"'{ont}total'", f"{total} || '^^{XSD}integer'", "TRUE"),
        ("literals", "sord", order_uri, f"'{ont}total'", f"{total} || '7^^{XSD}integer'", "o_orderkey % 4 = 0"),
        ("literals", "sord", order_uri, f"'{ont}note'", "'café 😀 😀 line' || chr(10) || 'break ' || o_orderkey", "o_orderkey % 11 = 0"),
        ("literals", "sbuy", buyer_uri, f"'{ont}Name'", "c_name || '@en'", "TRUE"),
        ("literals", "sbuy", buyer_uri, "'http://example.org/rank'", "'1'", "TRUE"),
        ("literals", "snat", nation_uri, f"'{ont}label'", "'the \"' || n_name || '\"'", "TRUE"),
        ("objects", "sord", order_uri, f"'{ont}placedBy'", bought_by, "TRUE"),
        ("objects", "sord", order_uri, f"'{ont}soldTo'", "'http://dbpedia.org/resource/customer_' || o_custkey", "o_orderkey % 5 = 0"),
        ("objects", "sord", order_uri, "'http://www.w3.org/2000/01/rdf-schema#seeAlso'", bought_by, "o_orderkey % 7 = 0"),
        ("objects", "sord", order_uri, f"'{ont}placedBy'", bought_by, "o_orderkey % 8 = 0"),
        ("objects", "sbuy", buyer_uri, f"'{ont}locatedIn'", f"'{RES[1:]}Nation_' || c_nationkey", "TRUE"),
        ("objects", "sbuy", "'_:b' || c_custkey", f"'{ont}locatedIn'", f"'{RES[1:]}Nation_' || c_nationkey", "c_custkey % 10 = 0"),
    ]
    return "\n  UNION ALL ".join(
        f"SELECT year, '{kind}' AS kind, {s} AS subject, {p} AS predicate, {o} AS object FROM {source} WHERE {condition}"
        for kind, source, s, p, o, condition in rows
    )


STATEMENTS = f"""
WITH sord AS (
  SELECT *, CAST(2014 + (year(o_orderdate) - {FIRST_YEAR}) % 4 AS VARCHAR) AS year FROM orders),
sbuy AS (SELECT DISTINCT o.year, c.* FROM sord o JOIN customer c ON c.c_custkey = o.o_custkey),
snat AS (SELECT DISTINCT b.year, n.* FROM sbuy b JOIN nation n ON n.n_nationkey = b.c_nationkey),
st AS MATERIALIZED (
  {_statement_rows()}),
low AS MATERIALIZED (SELECT *, year || '|' || lower(subject) AS skey, year || '|' || lower(object) AS okey FROM st),
typed AS (
  SELECT year, lower(subject) AS key, min({{'u': subject, 't': lower(regexp_extract(object, '[^/]*$'))}}) AS p
  FROM st WHERE kind = 'types' AND predicate LIKE '%#type' GROUP BY ALL),
subs AS MATERIALIZED (SELECT CAST(CAST(year AS INTEGER) - 2014 AS INTEGER) AS snapshot, year || '|' || key AS key, p.u AS uri, p.t AS vtype FROM typed),
vals AS MATERIALIZED (
  SELECT s.snapshot, s.vtype, s.uri, lower(regexp_extract(predicate, '[^/]*$')) AS attr, max(split_part(object, '^^', 1)) AS value
  FROM low JOIN subs s ON s.key = low.skey
  WHERE kind = 'literals' AND contains(predicate, '/ontology/') GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a.snapshot, a.vtype AS src_type, a.uri AS src_uri, lower(regexp_extract(x.predicate, '[^/]*$')) AS rel,
    b.vtype AS dst_type, b.uri AS dst_uri
  FROM (SELECT DISTINCT * FROM low WHERE kind = 'objects' AND object LIKE 'http%' AND lower(predicate) NOT LIKE '%seealso') x
  JOIN subs a ON a.key = x.skey
  JOIN subs b ON b.key = x.okey)
"""

# Helpers ---------------------------------------------------------------------------------

EDGE = "src_type, src_uri, rel, dst_type, dst_uri"
EDGE_ITEM = "concat_ws('/', src_type, src_uri, rel, dst_type, dst_uri)"
ATTR_MAP = "string_agg(attr || '=' || value, ';' ORDER BY attr || '=' || value)"


LENGTH = "(SELECT max(snapshot) + 1 FROM ord)"
POSSIBLE = "(SELECT (max(snapshot) + 1) * (max(snapshot) + 2) / 2.0 FROM ord)"


def graph_rows(verts: str, attrs: str, edges: str) -> str:
    return f"""SELECT 'vertex' AS kind, snapshot, concat_ws('/', vtype, uri) AS item FROM {verts}
      UNION ALL SELECT 'attribute', snapshot, concat_ws('/', vtype, uri, attr, value) FROM {attrs}
      UNION ALL SELECT 'edge', snapshot, {EDGE_ITEM} FROM {edges}"""


def edge_hash(seed: str) -> str:
    return f"md5(concat_ws(chr(31), '{seed}', {EDGE}))"


def degree_cte(source: str = "edges", name: str = "deg") -> str:
    return f""",
{name} AS (
  SELECT snapshot, vtype, uri, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree,
    CAST(sum(i + o) AS BIGINT) AS degree
  FROM (SELECT snapshot, src_type AS vtype, src_uri AS uri, 0 AS i, 1 AS o FROM {source}
    UNION ALL SELECT snapshot, dst_type, dst_uri, 1, 0 FROM {source}) GROUP BY ALL)"""


def without_high_cte(verts: str, edges: str, degree: int) -> str:
    return degree_cte(edges, "rawdeg") + f""",
lowv AS (
  SELECT v.* FROM {verts} v JOIN rawdeg d USING (snapshot, vtype, uri) WHERE d.degree <= {degree}),
lowe AS (
  SELECT e.* FROM {edges} e
  WHERE EXISTS (SELECT 1 FROM lowv v WHERE v.snapshot = e.snapshot AND v.vtype = e.src_type AND v.uri = e.src_uri)
    AND EXISTS (SELECT 1 FROM lowv v WHERE v.snapshot = e.snapshot AND v.vtype = e.dst_type AND v.uri = e.dst_uri))"""


def stable_cte(edges: str, size: int, seed: str) -> str:
    """The chain of samples, one CTE per snapshot; copies of an edge are told apart by number."""
    steps = [
        f""",
num AS (SELECT *, row_number() OVER (PARTITION BY snapshot, {EDGE}) AS copy, {edge_hash(seed)} AS h FROM {edges}),
s0 AS (SELECT {EDGE} FROM num WHERE snapshot = 0 ORDER BY h, {EDGE}, copy LIMIT {size})"""
    ]
    for t in range(1, CHAIN):
        steps.append(
            f""",
k{t} AS (SELECT {EDGE} FROM num WHERE snapshot = {t} INTERSECT SELECT {EDGE} FROM s{t - 1}),
r{t} AS (
  SELECT n.*, row_number() OVER (ORDER BY h, {EDGE}, copy) AS place FROM num n ANTI JOIN k{t} USING ({EDGE}) WHERE snapshot = {t}),
s{t} AS (
  SELECT * FROM k{t} UNION ALL SELECT {EDGE} FROM r{t} WHERE place <= {size} - (SELECT count(*) FROM k{t}))"""
        )
    union = " UNION ALL ".join(f"SELECT {t} AS snapshot, * FROM s{t}" for t in range(CHAIN))
    return "".join(steps) + f",\nsampled AS ({union})"


def text_of(attrs: str, edges: str, namespace: str) -> str:
    value = "replace(regexp_replace(regexp_replace(value, ' \\\\$', ''), '\\\\$', ''), chr(10), '\\n')"
    return f"""SELECT snapshot, '<{namespace}/' || vtype || '/' || uri || '> <{FOAF}/' || attr || '> "' || {value} || '" .' AS line
      FROM {attrs}
      UNION ALL SELECT snapshot, '<{namespace}/' || src_type || '/' || src_uri || '> <{FOAF}/' || rel || '> <{namespace}/'
        || dst_type || '/' || dst_uri || '> .' FROM {edges}"""


def hash32(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS BIGINT))"
    raw = f"list_reduce({codes}, lambda a, c: (a * 31 + c) & 4294967295)"
    return f"(CASE WHEN {raw} >= 2147483648 THEN {raw} - 4294967296 ELSE {raw} END)"


def grid(n: int) -> str:
    def wrapped(number: str) -> str:
        product_ = f"(CAST({number} AS HUGEINT) * 1125899906842597)"
        low = f"((({product_} % 18446744073709551616) + 18446744073709551616) % 18446744073709551616)"
        return f"abs(CASE WHEN {low} >= 9223372036854775808 THEN {low} - 18446744073709551616 ELSE {low} END)"

    src, dst = wrapped("src_id"), wrapped("dst_id")
    cols = next(c for c in range(1, n + 1) if c * c >= n)
    if cols * cols == n:
        return f"CAST((({src} % {cols}) * {cols} + {dst} % {cols}) % {n} AS INTEGER)"
    rows = (n + cols - 1) // cols
    last = n - rows * (cols - 1)
    column = f"(({src} % {n}) // {rows})"
    row = f"(CASE WHEN {column} < {cols - 1} THEN {dst} % {rows} ELSE {dst} % {last} END)"
    return f"CAST({column} * {rows} + {row} AS INTEGER)"


def parts_sql(vertex_parts: str, edge_parts: str) -> str:
    return f"""SELECT 'vertex' AS kind, snapshot, part, concat_ws('/', vtype, uri) AS item FROM {vertex_parts}
      UNION ALL SELECT 'edge', snapshot, part, {EDGE_ITEM} FROM {edge_parts}"""


VERTEX_PARTS = """,
vparts AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY snapshot, vtype ORDER BY md5(concat_ws(chr(31), '', uri)), uri) - 1) % 4
    AS INTEGER) AS part FROM verts),
eparts AS (
  SELECT e.*, a.part FROM edges e
  JOIN vparts a ON a.snapshot = e.snapshot AND a.vtype = e.src_type AND a.uri = e.src_uri
  JOIN vparts b ON b.snapshot = e.snapshot AND b.vtype = e.dst_type AND b.uri = e.dst_uri AND b.part = a.part)"""

EDGE_PARTS = f""",
eparts AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY snapshot, rel ORDER BY {edge_hash("")}, {EDGE}) - 1) % 4 AS INTEGER) AS part
  FROM edges),
vparts AS (
  SELECT DISTINCT snapshot, src_type AS vtype, src_uri AS uri, part FROM eparts
  UNION SELECT DISTINCT snapshot, dst_type, dst_uri, part FROM eparts)"""

ANCHOR_PARTS = f""",
ids AS (
  SELECT *, {hash32("uri || vtype")} AS id FROM (SELECT DISTINCT vtype, uri FROM verts WHERE vtype = 'part')),
anchor AS (
  SELECT v.*, CAST((CASE WHEN id < 0 THEN -id - 1 ELSE id END) % 4 AS INTEGER) AS part FROM verts v JOIN ids USING (vtype, uri)),
eparts AS (
  SELECT DISTINCT e.*, a.part FROM edges e JOIN anchor a ON a.snapshot = e.snapshot
    AND ((a.vtype = e.src_type AND a.uri = e.src_uri) OR (a.vtype = e.dst_type AND a.uri = e.dst_uri))),
vparts AS (
  SELECT snapshot, vtype, uri, part FROM anchor
  UNION SELECT snapshot, src_type, src_uri, part FROM eparts
  UNION SELECT snapshot, dst_type, dst_uri, part FROM eparts)"""

# Matching and mining ---------------------------------------------------------------------

ATTRIBUTES = {
    "order": ["priority", "status"],
    "customer": ["name", "segment"],
    "nation": ["name"],
    "part": ["brand", "kind"],
    "supplier": ["name"],
}
CONTAINS = ("order", "contains", "part")
SUPPLIES = ("supplier", "supplies", "part")
PLACED_BY = ("order", "placed_by", "customer")
LOCATED_IN = ("customer", "located_in", "nation")
HOME = [PLACED_BY, LOCATED_IN]
TWO_EDGE_PATTERNS = [[CONTAINS, SUPPLIES], [CONTAINS, PLACED_BY], HOME]


def pattern_id(edges: list[tuple[str, str, str]]) -> str:
    return ";".join(">".join(edge) for edge in sorted(edges))


def pattern_types(edges: list[tuple[str, str, str]]) -> list[str]:
    return sorted({name for src, _, dst in edges for name in (src, dst)})


def pattern_dependencies(edges: list[tuple[str, str, str]]) -> list[list[tuple[str, str]]]:
    types = pattern_types(edges)
    return [list(zip(types, names, strict=True)) for names in product(*[ATTRIBUTES[t] for t in types])]


def match_from(edges: list[tuple[str, str, str]]) -> str:
    """FROM clause that joins one edge row per pattern edge on their shared vertices."""
    clauses, first_seen = [], {}
    for i, (src, rel, dst) in enumerate(edges):
        on = [f"e{i}.src_type = '{src}'", f"e{i}.rel = '{rel}'", f"e{i}.dst_type = '{dst}'"]
        if i:
            on.append(f"e{i}.snapshot = e0.snapshot")
        for vtype, column in ((src, "src_uri"), (dst, "dst_uri")):
            if vtype in first_seen:
                on.append(f"e{i}.{column} = {first_seen[vtype]}")
            else:
                first_seen[vtype] = f"e{i}.{column}"
        clauses.append((f"edges e{i}", " AND ".join(on)))
    tables = " JOIN ".join(
        table if i == 0 else f"{table} ON {on}" for i, (table, on) in enumerate(clauses)
    )
    return f"FROM {tables} WHERE {clauses[0][1]}", first_seen


def match_sql(edges: list[tuple[str, str, str]]) -> str:
    source, uris = match_from(edges)
    return f"SELECT e0.snapshot, {', '.join(f'{u} AS {t}_uri' for t, u in uris.items())} {source}"


def tuple_sql(edges: list[tuple[str, str, str]], dependency: list[tuple[str, str]]) -> str:
    """Distinct (snapshot, value columns) of all matches with valid values."""
    columns = ", ".join(f"a{i}.value AS {t}_{a}" for i, (t, a) in enumerate(dependency))
    joins = " ".join(
        f"JOIN attrs a{i} ON a{i}.snapshot = m.snapshot AND a{i}.vtype = '{t}' AND a{i}.attr = '{a}' "
        f"AND a{i}.uri = m.{t}_uri AND a{i}.value NOT IN ('????', '')"
        for i, (t, a) in enumerate(dependency)
    )
    return f"SELECT DISTINCT m.snapshot, {columns} FROM ({match_sql(edges)}) m {joins}"


def presence_cte(name: str, edges: list[tuple[str, str, str]], dependency: list[tuple[str, str]]) -> str:
    names = ", ".join(f"{t}_{a}" for t, a in dependency)
    return f""",
{name}_rows AS ({tuple_sql(edges, dependency)}),
{name} AS (SELECT {names}, list_sort(list(snapshot)) AS seen FROM {name}_rows GROUP BY ALL)"""


HOME_DEP = [("order", "priority"), ("customer", "name"), ("nation", "name")]
HOME_COLS = ["order_priority", "customer_name", "nation_name"]
HOME_PRESENCE = GRAPH + presence_cte("pres", HOME, HOME_DEP)
DELTA_MIN = "list_min(list_transform(range(1, len(seen)), lambda i: seen[i + 1] - seen[i]))"
DELTA_MAX = "seen[len(seen)] - seen[1]"
SEEN_TEXT = "array_to_string(seen, ',')"


def groups_cte(name: str, columns: list[str]) -> str:
    rows = []
    for rhs, column in enumerate(columns):
        lhs = ", ".join(c for c in columns if c != column)
        rows.append(
            f"SELECT {rhs} AS rhs, concat_ws('|', {lhs}) AS lhs, count(*) AS n, min({column}) AS rhs_value, "
            f"list_sort(list_distinct(flatten(list(seen)))) AS seen FROM {name} GROUP BY {lhs}"
        )
    return f",\ngrp AS ({' UNION ALL '.join(rows)})"


def constant_sql() -> str:
    return HOME_PRESENCE + groups_cte("pres", HOME_COLS) + f"""
SELECT rhs, lhs, rhs_value, CAST(len(seen) AS INTEGER) AS n_present, CAST({DELTA_MIN} AS INTEGER) AS delta_min,
  CAST({DELTA_MAX} AS INTEGER) AS delta_max FROM grp WHERE n = 1 AND len(seen) >= 2"""


THREE_EDGE_PATTERNS = [[CONTAINS, SUPPLIES, PLACED_BY], [CONTAINS, *HOME]]
MIN_IMAGES = 20


def images_sql() -> str:
    """The least number of distinct vertices of a type in all matches of a pattern, for the patterns with enough."""
    ones = [[CONTAINS], [SUPPLIES], *[[e] for e in HOME]]
    rows = []
    for edges in [*ones, *TWO_EDGE_PATTERNS, *THREE_EDGE_PATTERNS]:
        source, uris = match_from(edges)
        least = ", ".join(f"count(DISTINCT {u})" for u in uris.values())
        rows.append(f"SELECT {len(edges)} AS level, '{pattern_id(edges)}' AS pattern_id, least({least}) AS support {source}")
    return GRAPH + f"SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE support >= {MIN_IMAGES}"


def matched_edges_sql() -> str:
    edges = [CONTAINS, *HOME]
    rows = " UNION ".join(f"SELECT snapshot, '{rel}' AS rel, {src}_uri AS src_uri, {dst}_uri AS dst_uri FROM m" for src, rel, dst in edges)
    return GRAPH + f", m AS MATERIALIZED ({match_sql(edges)}) {rows}"


def keyed_presence_cte(name: str, match: str, dependency: list[tuple[str, str]]) -> str:
    """Like `presence_cte`, over a stored match; one key for each lookup keeps the join order as it is written."""
    columns = ", ".join(f"a{i}.value AS {t}_{a}" for i, (t, a) in enumerate(dependency))
    joins = " ".join(
        f"JOIN keyed a{i} ON a{i}.k = concat_ws('/', m.snapshot, '{t}', '{a}', m.{t}_uri)" for i, (t, a) in enumerate(dependency)
    )
    names = ", ".join(f"{t}_{a}" for t, a in dependency)
    return f""",
{name}_rows AS (SELECT DISTINCT m.snapshot, {columns} FROM {match} m {joins}),
{name} AS (SELECT {names}, list_sort(list(snapshot)) AS seen FROM {name}_rows GROUP BY ALL)"""


def discover_sql(theta: float = 0.0, patterns: list | None = None) -> str:
    ctes, rows = [], []
    number = 0
    if patterns:
        valid = "SELECT concat_ws('/', snapshot, vtype, attr, uri) AS k, value FROM attrs WHERE value NOT IN ('????', '')"
        ctes.append(f",\nkeyed AS MATERIALIZED ({valid})")
    for place, edges in enumerate(patterns or TWO_EDGE_PATTERNS):
        if patterns:
            ctes.append(f",\nmatch{place} AS MATERIALIZED ({match_sql(edges)})")
        for dependency in pattern_dependencies(edges):
            name = f"p{number}"
            number += 1
            keyed = patterns and keyed_presence_cte(name, f"match{place}", dependency)
            ctes.append(keyed or presence_cte(name, edges, dependency))
            for rhs_type, rhs_attr in dependency:
                lhs = [(t, a) for t, a in dependency if t != rhs_type]
                lhs_cols = ", ".join(f"{t}_{a}" for t, a in lhs)
                text = " || ';' || ".join(f"'{t}.{a}=' || {t}_{a}" for t, a in sorted(lhs, key=lambda x: f"{x[0]}.{x[1]}"))
                rows.append(
                    f"SELECT {len(edges)} AS level, '{pattern_id(edges)}' AS pattern_id, {text} AS lhs, '{rhs_type}.{rhs_attr}' AS rhs_attr, "
                    f"any_value({rhs_type}_{rhs_attr}) AS rhs_value, any_value(seen) AS seen, "
                    f"(SELECT count(*) FROM {name}) AS n_tuples FROM {name} GROUP BY {lhs_cols} HAVING count(*) = 1"
                )
    return GRAPH + "".join(ctes) + f""",
found AS ({' UNION ALL '.join(rows)})
SELECT level, pattern_id, lhs, rhs_attr, rhs_value, CAST({DELTA_MIN} AS INTEGER) AS delta_min,
  CAST({DELTA_MAX} AS INTEGER) AS delta_max, CAST(len(seen) AS INTEGER) AS n_present, n_tuples,
  round((len(seen) * (len(seen) - 1) / 2) / (n_tuples * {POSSIBLE}), 12) AS support
FROM found WHERE len(seen) >= 2
  AND (len(seen) * (len(seen) - 1) / 2) / (n_tuples * {POSSIBLE}) >= {theta}"""


def dependency_values(columns: str, rows: list[tuple[str, ...]]) -> str:
    values = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)
    return f"(VALUES {values}) v({columns})"


def lattice_sql() -> str:
    return GRAPH + """,
top_types AS (
  SELECT vtype FROM verts WHERE snapshot = 0 GROUP BY vtype ORDER BY count(*) DESC, vtype LIMIT 10),
combos AS (
  SELECT src_type, rel, dst_type, count(*) AS n FROM edges WHERE snapshot = 0 AND src_type <> dst_type GROUP BY ALL),
best AS (
  SELECT * FROM combos QUALIFY row_number() OVER (PARTITION BY src_type, dst_type ORDER BY n DESC, rel) = 1),
freq AS (SELECT * FROM best WHERE n >= 100 ORDER BY n DESC, src_type, rel, dst_type LIMIT 10),
l0 AS (SELECT [vtype] AS vs, CAST([] AS VARCHAR[]) AS es FROM top_types),
l1 AS (
  SELECT DISTINCT list_sort(list_append(vs, CASE WHEN list_contains(vs, src_type) THEN dst_type ELSE src_type END)) AS vs,
    list_sort(list_append(es, src_type || '>' || rel || '>' || dst_type)) AS es
  FROM l0 JOIN freq ON list_contains(vs, src_type) <> list_contains(vs, dst_type)),
l2 AS (
  SELECT DISTINCT list_sort(list_append(vs, CASE WHEN list_contains(vs, src_type) THEN dst_type ELSE src_type END)) AS vs,
    list_sort(list_append(es, src_type || '>' || rel || '>' || dst_type)) AS es
  FROM l1 JOIN freq ON list_contains(vs, src_type) <> list_contains(vs, dst_type)),
lattice AS (
  SELECT 0 AS level, vs[1] AS pattern_id, vs, es FROM l0
  UNION ALL SELECT 1, array_to_string(es, ';'), vs, es FROM l1
  UNION ALL SELECT 2, array_to_string(es, ';'), vs, es FROM l2),
opts AS (SELECT DISTINCT vtype, attr FROM attrs),
deps AS (
  SELECT pattern_id, [vs[1] || '.' || a.attr, vs[2] || '.' || b.attr, vs[3] || '.' || c.attr] AS dep FROM lattice
  JOIN opts a ON a.vtype = vs[1] JOIN opts b ON b.vtype = vs[2] JOIN opts c ON c.vtype = vs[3] WHERE level = 2)
"""


def _hub_cte() -> str:
    return """,
hubs AS (
  SELECT snapshot, dst_type AS vtype, dst_uri AS uri FROM edges WHERE dst_type = 'part' GROUP BY ALL HAVING count(*) > 10),
hubfree AS (
  SELECT e.* FROM edges e
  WHERE NOT EXISTS (SELECT 1 FROM hubs h WHERE h.snapshot = e.snapshot AND h.vtype = e.src_type AND h.uri = e.src_uri)
    AND NOT EXISTS (SELECT 1 FROM hubs h WHERE h.snapshot = e.snapshot AND h.vtype = e.dst_type AND h.uri = e.dst_uri))
"""


def movie_job_sql() -> str:
    types = ("order", "customer", "nation", "part", "supplier")
    on_edges = """SELECT DISTINCT snapshot, src_type AS vtype, src_uri AS uri FROM sampled
      UNION SELECT DISTINCT snapshot, dst_type, dst_uri FROM sampled"""
    return LINES + parse_cte(types) + stable_cte("tedges", 5000, "s3") + f""",
ends AS ({on_edges}),
chosen AS (SELECT v.* FROM tverts v SEMI JOIN ends USING (snapshot, vtype, uri)),
jobhubs AS (
  SELECT c.* FROM chosen c JOIN (
    SELECT snapshot, dst_type AS vtype, dst_uri AS uri, count(*) AS n FROM sampled GROUP BY ALL) d
  USING (snapshot, vtype, uri) WHERE c.vtype = 'nation' AND d.n > 10),
kept AS (SELECT * FROM chosen ANTI JOIN jobhubs USING (snapshot, vtype, uri)),
kattrs AS (SELECT a.* FROM tattrs a SEMI JOIN kept USING (snapshot, vtype, uri)),
kedges AS (
  SELECT e.* FROM sampled e
  JOIN kept a ON a.snapshot = e.snapshot AND a.vtype = e.src_type AND a.uri = e.src_uri
  JOIN kept b ON b.snapshot = e.snapshot AND b.vtype = e.dst_type AND b.uri = e.dst_uri)
{text_of("kattrs", "kedges", IMDB)}"""


def encyclopedia_job_sql() -> str:
    return (
        GRAPH
        + lines_cte(DBPEDIA)
        + parse_cte(None, False, DBPEDIA)
        + without_high_cte("tverts", "tedges", 12)
        + stable_cte("lowe", 5000, "s4")
        + f""",
ends AS (
  SELECT DISTINCT snapshot, src_type AS vtype, src_uri AS uri FROM sampled
  UNION SELECT DISTINCT snapshot, dst_type, dst_uri FROM sampled),
kattrs AS (SELECT a.* FROM tattrs a SEMI JOIN ends USING (snapshot, vtype, uri))
{text_of("kattrs", "sampled", DBPEDIA)}"""
    )


def presence_counts_sql() -> str:
    parts = []
    ctes = ""
    for i, (order_attr, buyer_attr) in enumerate(product(("status", "priority"), ("name", "segment"))):
        dependency = [("order", order_attr), ("customer", buyer_attr), ("nation", "name")]
        ctes += presence_cte(f"c{i}", HOME, dependency)
        parts.append(
            f"SELECT 'order.{order_attr},customer.{buyer_attr},nation.name' AS dependency, count(*) AS n FROM c{i}"
        )
    return GRAPH + ctes + " UNION ALL ".join(parts)


def support_counts_sql() -> str:
    return GRAPH + " UNION ALL ".join(
        f"SELECT '{pattern_id(edges)}' AS pattern_id, e0.snapshot, count(*) AS n {match_from(edges)[0]} GROUP BY e0.snapshot"
        for edges in TWO_EDGE_PATTERNS
    )


BUY_PRESENCE = GRAPH + presence_cte(
    "pres", [CONTAINS, PLACED_BY], [("order", "status"), ("part", "brand"), ("customer", "name")]
)
MAP_JOIN = f""",
maps AS (SELECT snapshot, vtype, uri, {ATTR_MAP} AS m FROM attrs GROUP BY ALL),
pay AS (
  SELECT e.*, s.m AS src_attributes, d.m AS dst_attributes FROM edges e
  JOIN maps s ON s.snapshot = e.snapshot AND s.vtype = e.src_type AND s.uri = e.src_uri
  JOIN maps d ON d.snapshot = e.snapshot AND d.vtype = e.dst_type AND d.uri = e.dst_uri)
"""
URI_AT = "regexp_extract_all(left(trimmed, length(trimmed) - 1), '<[^>]+>')"
TOP = "ORDER BY n DESC, 1 LIMIT 10"
MONTHS = """
WITH RECURSIVE b AS (
  SELECT last_day(CAST(min(o_orderdate) AS DATE)) AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders),
w AS (
  SELECT 0 AS snapshot, s AS d, e FROM b
  UNION ALL SELECT snapshot + 1, CAST(d + to_months(1) AS DATE), e FROM w WHERE CAST(d + to_months(1) AS DATE) <= e),
c AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL)
SELECT w.snapshot, w.d AS snapshot_date, 'imdb-' || strftime(w.d, '%y%m%d') || '.nt' AS file_name,
  coalesce(c.n, 0) AS n_orders FROM w LEFT JOIN c ON c.m = date_trunc('month', w.d)"""
PART_NAMES = f"""{GRAPH},
f AS (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN {FILE_NAME} ELSE 'plain' || snapshot END AS file_name, o_custkey % 4 AS part FROM ord)
SELECT file_name, CASE WHEN contains(file_name, '-') THEN
    regexp_replace(file_name, '^([^-]*)-', '\\1' || part || '-') ELSE file_name || part END AS name, count(*) AS n
FROM f GROUP BY ALL"""


def build() -> dict[str, str]:
    parsed_rows = "SELECT snapshot, subject, name, object, kind FROM triples"
    value_clean = "regexp_replace(regexp_replace(object, ' \\\\$', ''), '\\\\$', '')"
    line_of_attr = text_of("tattrs", "tedges", IMDB).split("UNION ALL")
    return {
        "scan_ntriples": LINES + "SELECT 'imdb-170909.nt' AS file_name, line FROM lines",
        "snapshot_dates": MONTHS,
        "load_snapshots": LINES
        + parse_cte(("order", "customer", "nation", "part", "supplier"))
        + parsed_rows,
        "scan_ntriples_dir": LINES + f"SELECT {FILE_NAME} AS file_name, line FROM lines",
        "scan_statements": STATEMENTS + "SELECT year, kind, subject, predicate, object FROM st",
        "scan_turtle": STATEMENTS + "SELECT year, kind, subject, predicate, object FROM st",
        "sink_ntriples": GRAPH
        + f", gl AS ({text_of('attrs', 'edges', IMDB)}) SELECT {FILE_NAME} AS file_name, line FROM gl",
        "part_file_name": PART_NAMES,
        "sink_tgfds": discover_sql(),
        "parse_triples_typed": LINES + parse_cte(("order", "nation", "/part/")) + parsed_rows,
        "parse_triples": TEXT + parsed_rows,
        "parse_triples_raw": LINES + parse_cte(None, False) + parsed_rows,
        "predicate_name": TEXT
        + f""", q AS (SELECT {URI_AT}[2] AS predicate FROM trimmed)
          SELECT predicate, CASE WHEN regexp_extract(predicate, '/([^/>]+)>$', 1) = '' THEN 'unknown'
            ELSE regexp_extract(predicate, '/([^/>]+)>$', 1) END AS name, count(*) AS n
          FROM q WHERE predicate IS NOT NULL GROUP BY ALL""",
        "uri_parts": TEXT
        + f""", q AS (SELECT {URI_AT}[1] AS subject FROM trimmed)
          SELECT subject, CASE WHEN starts_with(subject, '<{IMDB}/') THEN split_part(subject, '/', 4) ELSE 'unknownType' END AS vtype,
            CASE WHEN starts_with(subject, '<{IMDB}/') THEN rtrim(split_part(subject, '/', 5), '>') ELSE 'unknownResource' END AS uri,
            count(*) AS n FROM q WHERE subject IS NOT NULL GROUP BY ALL""",
        "vertex_id": GRAPH
        + f"SELECT vtype, uri, {hash32('uri || vtype')} AS vertex_id FROM (SELECT DISTINCT vtype, uri FROM verts)",
        "project_dependency_attrs": GRAPH
        + f""", m AS ({match_sql(HOME)})
          SELECT m.snapshot, a.value AS order_priority, b.value AS customer_segment, '' AS nation_unknown, count(*) AS n FROM m
          JOIN attrs a ON a.snapshot = m.snapshot AND a.vtype = 'order' AND a.attr = 'priority' AND a.uri = m.order_uri
          JOIN attrs b ON b.snapshot = m.snapshot AND b.vtype = 'customer' AND b.attr = 'segment' AND b.uri = m.customer_uri
          GROUP BY ALL""",
        "last_uri_part": STATEMENTS
        + "SELECT predicate, lower(regexp_extract(object, '[^/]*$')) AS last_part, count(*) AS n FROM st GROUP BY ALL",
        "literal_lexical": STATEMENTS
        + """SELECT object, split_part(object, '^^', 1) AS lexical, count(*) AS n FROM st
          WHERE kind = 'literals' GROUP BY ALL""",
        "clean_literal": TEXT
        + f"""SELECT object AS value, {value_clean} AS cleaned, count(*) AS n FROM triples
          WHERE kind = 'attribute' GROUP BY ALL""",
        "format_vertex_lines": TEXT + line_of_attr[0],
        "format_edge_lines": TEXT + line_of_attr[1].replace("|| '> .' FROM", "|| '> .' AS line FROM"),
        "rdf_type_name": STATEMENTS
        + f"""SELECT DISTINCT year, subject, regexp_extract(object, '[^/]*$') AS type_name FROM st
          WHERE predicate = '{RDF_TYPE}' AND NOT contains(object, ',')""",
        "attr_keys": GRAPH + "SELECT snapshot, vtype, attr, count(*) AS n FROM attrs GROUP BY ALL",
        "split_kinds": TEXT + "SELECT snapshot, kind, count(*) AS n FROM triples GROUP BY ALL",
        "drop_invalid_values": GRAPH
        + "SELECT snapshot, vtype, uri, attr, value FROM attrs WHERE value NOT IN ('????', '')",
        "statement_filters": STATEMENTS
        + """SELECT year, kind, predicate, count(*) AS n FROM st
          WHERE (kind = 'types' AND predicate LIKE '%#type') OR (kind = 'literals' AND contains(predicate, '/ontology/'))
            OR (kind = 'objects' AND object LIKE 'http%' AND lower(predicate) NOT LIKE '%seealso') GROUP BY ALL""",
        "non_null_graph": TEXT
        + graph_rows(
            "tverts WHERE vtype <> 'unknownType'", "tattrs WHERE vtype <> 'unknownType'", "tedges WHERE rel <> 'placed_on'"
        ),
        "filter_hub_vertices": GRAPH
        + _hub_cte()
        + graph_rows(
            "verts ANTI JOIN hubs USING (snapshot, vtype, uri)", "attrs ANTI JOIN hubs USING (snapshot, vtype, uri)", "hubfree"
        ),
        "filter_high_degree": GRAPH
        + without_high_cte("verts", "edges", 12)
        + graph_rows("lowv", "attrs SEMI JOIN lowv USING (snapshot, vtype, uri)", "lowe"),
        "vertices_of_type": GRAPH + "SELECT snapshot, vtype, uri FROM verts WHERE vtype = 'customer'",
        "edges_valid_endpoints": TEXT + f"SELECT snapshot, {EDGE} FROM tclosed",
        "build_vertices": TEXT + f"SELECT snapshot, vtype, uri, {ATTR_MAP} AS attributes FROM tattrs GROUP BY ALL",
        "build_edges": TEXT + f"SELECT snapshot, {EDGE} FROM tedges",
        "integrate_rdf": STATEMENTS
        + degree_cte("links")
        + f""", maps AS (SELECT snapshot, vtype, uri, {ATTR_MAP} AS m FROM vals GROUP BY ALL)
          SELECT s.snapshot, s.vtype, s.uri, coalesce(m.m, '') AS attributes, coalesce(d.in_degree, 0) AS in_degree,
            coalesce(d.out_degree, 0) AS out_degree
          FROM subs s LEFT JOIN maps m USING (snapshot, vtype, uri) LEFT JOIN deg d USING (snapshot, vtype, uri)""",
        "integrated_lines": STATEMENTS
        + degree_cte("links")
        + f""", con AS (SELECT v.* FROM vals v SEMI JOIN deg USING (snapshot, vtype, uri)),
          ca AS (SELECT snapshot, vtype, lower(regexp_extract(uri, '[^/]*$')) AS uri, attr, value FROM con),
          ce AS (SELECT snapshot, src_type, lower(regexp_extract(src_uri, '[^/]*$')) AS src_uri, rel, dst_type,
            lower(regexp_extract(dst_uri, '[^/]*$')) AS dst_uri FROM links)
          {text_of("ca", "ce", DBPEDIA)}""",
        "connected_graph": TEXT
        + degree_cte("tedges")
        + ", cv AS (SELECT v.* FROM tverts v SEMI JOIN deg USING (snapshot, vtype, uri)) "
        + graph_rows("cv", "tattrs SEMI JOIN cv USING (snapshot, vtype, uri)", "tedges"),
        "graph_counts": TEXT
        + degree_cte("tedges")
        + f""", gv AS (SELECT snapshot, count(*) AS n FROM tverts GROUP BY ALL),
          ge AS (SELECT snapshot, count(*) AS n FROM tedges GROUP BY ALL),
          gd AS (SELECT snapshot, count(*) AS n FROM deg ANTI JOIN tverts USING (snapshot, vtype, uri) GROUP BY snapshot)
          SELECT CAST(r.range AS INTEGER) AS snapshot, coalesce(gv.n, 0) AS vertices, coalesce(ge.n, 0) AS edges,
            coalesce(gd.n, 0) AS dangling_endpoints
          FROM (SELECT unnest(range({LENGTH})) AS range) r LEFT JOIN gv ON gv.snapshot = r.range LEFT JOIN ge ON ge.snapshot = r.range
          LEFT JOIN gd ON gd.snapshot = r.range""",
        "statement_graph": STATEMENTS
        + """, du AS MATERIALIZED (
            SELECT DISTINCT year, subject, predicate, object FROM st WHERE subject NOT LIKE '\\_:%' ESCAPE '\\')
          SELECT 'subject' AS kind, year, subject, '' AS predicate, CAST(count(*) AS VARCHAR) AS object FROM du GROUP BY year, subject
          UNION ALL SELECT 'statement', year, subject, predicate, object FROM du
          UNION ALL SELECT 'edge', u.year, u.subject, u.predicate, u.object FROM du u
            SEMI JOIN (SELECT DISTINCT year, subject AS object FROM du) t USING (year, object)""",
        "restrict_vertices_to_edges": GRAPH
        + """SELECT DISTINCT snapshot, src_type AS vtype, src_uri AS uri FROM edges WHERE rel = 'contains'
          UNION SELECT DISTINCT snapshot, dst_type, dst_uri FROM edges WHERE rel = 'contains'""",
        "motif_match": GRAPH + match_sql(HOME),
        "triplets": GRAPH
        + MAP_JOIN
        + "SELECT snapshot, rel, src_attributes, dst_attributes, count(*) AS n FROM pay GROUP BY ALL",
        "edges_with_vertices": GRAPH + MAP_JOIN + f"SELECT snapshot, {EDGE}, src_attributes, dst_attributes FROM pay",
        "typed_degrees": GRAPH + degree_cte() + "SELECT * FROM deg WHERE vtype = 'part'",
        "vertex_type_hist": GRAPH
        + f"SELECT vtype, count(*) AS n FROM verts WHERE snapshot = 0 GROUP BY ALL {TOP}",
        "edge_type_hist": GRAPH + f"SELECT rel, count(*) AS n FROM edges WHERE snapshot = 0 GROUP BY ALL {TOP}",
        "attribute_hist": GRAPH + f"SELECT attr, count(*) AS n FROM attrs WHERE snapshot = 0 GROUP BY ALL {TOP}",
        "type_attributes": GRAPH
        + """SELECT snapshot, vtype, string_agg(DISTINCT attr, ',' ORDER BY attr) AS attrs FROM attrs GROUP BY ALL""",
        "predicate_hist": TEXT + "SELECT snapshot, rel, count(*) AS n FROM tedges GROUP BY ALL",
        "edge_combo_hist": TEXT
        + """SELECT snapshot, src_type, rel, dst_type, count(*) AS n FROM tclosed
          WHERE src_type <> dst_type GROUP BY ALL""",
        "frequent_edge_types": lattice_sql() + "SELECT src_type, rel, dst_type, n FROM freq",
        "degrees": GRAPH + degree_cte() + "SELECT * FROM deg",
        "typed_degree_stats": GRAPH
        + degree_cte()
        + """SELECT snapshot, CAST(sum(in_degree) AS BIGINT) AS total_in, CAST(sum(out_degree) AS BIGINT) AS total_out,
          max(in_degree) AS max_in, max(out_degree) AS max_out FROM deg WHERE vtype = 'customer' GROUP BY ALL""",
        "max_degrees": GRAPH
        + degree_cte()
        + "SELECT snapshot, max(in_degree) AS max_in, max(out_degree) AS max_out FROM deg GROUP BY ALL",
        "degree_distribution": GRAPH
        + degree_cte()
        + """, d AS (SELECT snapshot, 'in' AS direction, in_degree AS v FROM deg WHERE in_degree > 0
            UNION ALL SELECT snapshot, 'out', out_degree FROM deg WHERE out_degree > 0)
          SELECT snapshot, direction, CAST(least(v // 100, 9) * 100 AS BIGINT) || '-' || CAST(least(v // 100, 9) * 100 + 99 AS BIGINT)
            AS bucket, count(*) AS n FROM d GROUP BY ALL""",
        "vertex_type_counts": TEXT + "SELECT snapshot, vtype, count(*) AS n FROM tverts GROUP BY ALL",
        "rdf_type_counts": STATEMENTS
        + f"""SELECT year, regexp_extract(object, '[^/]*$') AS type_name, count(*) AS n
          FROM (SELECT DISTINCT year, subject, object FROM st WHERE predicate = '{RDF_TYPE}' AND NOT contains(object, ','))
          GROUP BY ALL""",
        "presence_by_tuple": HOME_PRESENCE + f"SELECT {', '.join(HOME_COLS)}, {SEEN_TEXT} AS snapshots FROM pres",
        "constant_fd_groups": HOME_PRESENCE
        + groups_cte("pres", HOME_COLS)
        + f"SELECT rhs, lhs, n, rhs_value, {SEEN_TEXT} AS snapshots FROM grp",
        "tuple_count": presence_counts_sql(),
        "sample_edges": GRAPH
        + f"""SELECT snapshot, {EDGE} FROM edges
          QUALIFY row_number() OVER (PARTITION BY snapshot ORDER BY {edge_hash("s1")}, {EDGE}) <= 500""",
        "stable_sample_edges": GRAPH + stable_cte("edges", 5000, "s2") + f"SELECT snapshot, {EDGE} FROM sampled",
        "custom_graph_imdb": movie_job_sql(),
        "custom_graph_dbpedia": encyclopedia_job_sql(),
        "edge_intersection": GRAPH
        + f"SELECT snapshot, {EDGE} FROM edges INTERSECT SELECT CAST(snapshot + 1 AS INTEGER) AS snapshot, {EDGE} FROM edges",
        "edge_subtract": GRAPH
        + f""", em AS MATERIALIZED (SELECT * FROM edges),
          pm AS MATERIALIZED (SELECT DISTINCT CAST(snapshot + 1 AS INTEGER) AS snapshot, {EDGE}, 1 AS hit FROM em)
          SELECT snapshot, {EDGE} FROM em LEFT JOIN pm USING (snapshot, {EDGE}) WHERE hit IS NULL""",
        "partition_by_vertex_type": GRAPH + VERTEX_PARTS + parts_sql("vparts", "eparts"),
        "partition_by_edge_label": GRAPH + EDGE_PARTS + parts_sql("vparts", "eparts"),
        "partition_by_anchor_type": GRAPH + ANCHOR_PARTS + parts_sql("vparts", "eparts"),
        "partition_edges_2d": GRAPH
        + f""", vid AS (SELECT vtype, uri, {hash32("uri || vtype")} AS id FROM (SELECT DISTINCT vtype, uri FROM verts)),
          x AS (SELECT e.*, a.id AS src_id, b.id AS dst_id FROM edges e
            JOIN vid a ON a.vtype = e.src_type AND a.uri = e.src_uri JOIN vid b ON b.vtype = e.dst_type AND b.uri = e.dst_uri),
          g AS MATERIALIZED (
            SELECT 4 AS n_parts, {grid(4)} AS part, snapshot, {EDGE} FROM x
            UNION ALL SELECT 6, {grid(6)}, snapshot, {EDGE} FROM x),
          gends AS (
            SELECT n_parts, part, snapshot, src_type AS vtype, src_uri AS uri FROM g
            UNION SELECT n_parts, part, snapshot, dst_type, dst_uri FROM g)
          SELECT 'vertex' AS kind, snapshot, part, concat_ws('/', vtype, uri) AS item, n_parts FROM gends
          UNION ALL SELECT 'edge', snapshot, part, {EDGE_ITEM}, n_parts FROM g""",
        "write_partitions": GRAPH
        + VERTEX_PARTS
        + f""", pattrs AS (SELECT a.*, p.part FROM attrs a JOIN vparts p USING (snapshot, vtype, uri)),
          pl AS ({text_of("pattrs", "eparts", IMDB).replace("SELECT snapshot,", "SELECT snapshot, part,")})
          SELECT replace({FILE_NAME}, 'imdb-', 'imdb' || part || '-') AS file_name, line FROM pl""",
        "pattern_candidates": lattice_sql()
        + """SELECT level, pattern_id, array_to_string(vs, ',') AS vertices, CAST(len(es) AS INTEGER) AS n_edges FROM lattice""",
        "pattern_support": support_counts_sql(),
        "dependency_candidates": lattice_sql() + "SELECT pattern_id, array_to_string(dep, ',') AS dependency FROM deps",
        "lhs_rhs_splits": lattice_sql()
        + """SELECT pattern_id, array_to_string(list_filter(dep, lambda d: d <> r.rhs), ',') AS lhs, r.rhs AS rhs
          FROM deps, LATERAL (SELECT unnest(dep) AS rhs) r""",
        "one_hot_presence": BUY_PRESENCE
        + f"""SELECT order_status, part_brand, customer_name,
          array_to_string(list_transform(range({LENGTH}), lambda i: CASE WHEN list_contains(seen, i) THEN 1 ELSE 0 END), ',') AS flags
          FROM pres""",
        "delta_interval": HOME_PRESENCE
        + f"""SELECT {', '.join(HOME_COLS)},
          CASE WHEN len(seen) >= 2 THEN CAST({DELTA_MIN} AS INTEGER) END AS delta_min,
          CASE WHEN len(seen) >= 2 THEN CAST({DELTA_MAX} AS INTEGER) END AS delta_max FROM pres""",
        "tgfd_support": HOME_PRESENCE
        + f"""SELECT {', '.join(HOME_COLS)}, CAST(len(seen) AS INTEGER) AS n_present,
          CAST(len(seen) * (len(seen) - 1) // 2 AS BIGINT) AS pairs,
          round((len(seen) * (len(seen) - 1) / 2) / ((SELECT count(*) FROM pres) * {POSSIBLE}), 12) AS support FROM pres""",
        "constant_dependencies": constant_sql(),
        "discover_tgfds": discover_sql(),
        "discover_growing_series": discover_sql(),
        "discover_three_edges": discover_sql(1e-4, [[CONTAINS, PLACED_BY], HOME, [CONTAINS, *HOME]]),
        "pattern_images": images_sql(),
        "matched_edges": matched_edges_sql(),
        "discover_supported_tgfds": discover_sql(2e-5),
    }


ORACLES = build()
