"""The registered queries of this package and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm import (
    decontaminate,
    exact,
    mixing,
    packing,
    prefix_trie,
    quality,
    sharding,
    simhash,
    spelling,
    suffixes,
    tokens,
    topk,
    warc,
)
from kairograph.llm.common import default_tokenizer, table, text_or_empty

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("key").alias("doc_id"),
        F.col("keep_key").alias("keep_id"),
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLES["op8_exact_dedup"] = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents
), placed AS (
  SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size
  FROM plain
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM placed
"""


@query
def op9_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), default_tokenizer())
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), default_tokenizer())
    return counted.select(
        "doc_id",
        F.octet_length(text_or_empty("text")).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 512).alias("over_limit"),
    )


@query
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken"
    )


@query
def op2_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty("row.text")
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "row.doc_id",
        (F.octet_length(text) + F.lit(sharding.ROW_BYTES)).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("doc").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query
def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("kept").cast("long")
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).select(
        "row.doc_id",
        "n_bytes",
        (F.col("n_bytes") - size).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, index, with_payload=False).select(
        F.col("page").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query
def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are drawn."""
    drawn = quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return drawn.select(F.col("key").alias("doc_id"), "log_weight", "draw", F.lit(True).alias("kept"))


@query
def op7_norm_bucketed_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.exact_top(table(spark, sf_dir, "embeddings"), lambda key: key % 50 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score")


ORACLES["op7_norm_bucketed_top5"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""


# CRC-32 by its polynomial: eight shifts a byte, over a list of byte values.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, {bytes}), lambda c, b: list_reduce(
    list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT)))::UBIGINT)"""

# The UTF-8 bytes of "id:run", whose characters lie below U+0800.
_BYTES = """flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128
    THEN [unicode(x)::UBIGINT] ELSE [(192 + (unicode(x) >> 6))::UBIGINT, (128 + (unicode(x) & 63))::UBIGINT] END))"""


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        "ends_sha256",
    )


ORACLES["op11_prefix_trie"] = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS own
  FROM t GROUP BY conv_id
), hashed AS (
  SELECT *, CAST({_CRC32.format(bytes="list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)")} % 4 AS INTEGER) AS h
  FROM own
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS turns
  FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
), members AS (
  SELECT conv_id, CAST(d AS BIGINT) AS depth, turns[1:d] AS path, len(turns) AS n FROM (
    SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256,
         CASE depth WHEN 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(path[-1].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM members GROUP BY depth, path
), children AS (
  SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), whole AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (depth, path)
), subtrees AS (
  SELECT path[1:d] AS path, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM (
    SELECT *, unnest(range(0, depth + 1)) AS d FROM whole) GROUP BY ALL
)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
FROM whole w JOIN subtrees s ON s.path = w.path LEFT JOIN nodes p ON p.depth = w.depth - 1 AND p.path = w.path[1:w.depth - 1]
"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


ORACLES["op12_spelling_variants"] = rf"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT id, run, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT *, {_CRC32.format(bytes=_BYTES)} AS h FROM counted
), cut AS (
  SELECT n, CASE WHEN h % 199 = 0 THEN run[1:CAST(h % length(run) AS INTEGER)] || run[CAST(h % length(run) AS INTEGER) + 2:] ELSE run END AS word
  FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), shapes AS (
  SELECT word, n, i, word[1:i] || word[i + 2:] AS rest FROM (SELECT *, unnest(range(0, length(word))) AS i FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM shapes a JOIN shapes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM shapes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM shapes a JOIN words b ON a.rest = b.word
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near
), placed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form,
         CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
), roots AS (
  SELECT word, word AS root FROM placed WHERE form IS NULL
  UNION ALL SELECT p.word, r.root FROM roots r JOIN placed p ON p.form = r.word
)
SELECT word, form, root, n, n_near, form_n FROM placed JOIN roots USING (word)
"""


@query
def op13_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    found = found.select("row.doc_id", "found.n_words", decontaminate.n_hit().alias("n_hit"), "found.items")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES["op13_benchmark_hits"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents
), items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS line FROM (
    SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(len(w), 10) AS k FROM items WHERE len(w) > 0))
), places AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS line FROM (
    SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows))
), hits AS (
  SELECT r, i, k, item FROM places JOIN windows USING (k, line)
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""
