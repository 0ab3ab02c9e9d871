"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source of S words with a target of T words takes each document T/S times on average: floor(T/S)
whole copies and a fractional one. The fractional copies are rounded in a reduction tree.
Documents that are not settled meet in pairs, and the words that both take together move from
one to the other until one of them is taken wholly or not at all; the direction is drawn so that
the expected words of each do not change. The other goes on, and what is left of a group goes on
to the next level of the tree. Documents of a source meet others of about their size, so that one
document of each power of two is left in the end; these are rounded from the largest to the
smallest, each up if it fits into the words that they have together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.llm.common import stored, text_or_empty, uniform

WORD = r"[^\x20\x09-\x0D]+"
FAN_IN = 64
MOST_COPIES = 3
# A fraction of a copy below this is no copy at all.
LEAST_FRACTION = 1e-12
ITEM = ("doc", "print", "source")


def sized(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False
) -> DataFrame:
    """One stored row per document: doc, print (hash of its text), source, size in words (and `row`)."""
    words = F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")
    rows = docs.select(
        F.col(key).alias("doc"),
        F.xxhash64(text_or_empty(text)).alias("print"),
        F.col(source).cast("string").alias("source"),
        words.alias("size"),
        F.monotonically_increasing_id().alias("number"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )
    return stored(rows, "sized")


def ranked(sources: DataFrame) -> DataFrame:
    """Add `rank`, the zero-based place of each source by code point, null last.

    Each range of the sorted sources numbers its own rows; a table with one row per range has the offsets.
    """
    place = F.monotonically_increasing_id()
    rows = sources.orderBy(F.col("source").asc_nulls_last()).select(
        "*", F.shiftright(place, 33).alias("_range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_in")
    )
    rows = stored(rows, "sources")
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(offsets, "_range").withColumn("rank", F.col("_before") + F.col("_in")).drop("_range", "_in", "_before")


def targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, items, target: weights repeat over the ranked sources and share all words.

    A target stops at `MOST_COPIES` times the size of its source; the excess is shared again by
    weight. That is one level L of words per weight with the sum of min(L * weight, cap) equal to
    all words; L rises until no further source is capped, one small aggregate at a time.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("items"))
    choice = F.array(*[F.lit(w) for w in weights])[(F.col("rank") % len(weights)).cast("int")]
    found = stored(ranked(sizes).withColumn("weight", choice.cast("double")), "source-weights")
    cap = F.col("source_size") * float(MOST_COPIES)
    row = found.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words, level = float(row["words"] or 0), 0.0
    if words:
        risen = words / row["weight"]
        while risen > level:
            level = risen
            over = F.col("weight") * level > cap
            row = found.agg(
                F.sum(F.when(over, cap)).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("free")
            ).first()
            if not row["free"]:
                break
            risen = (words - (row["capped"] or 0.0)) / row["free"]
    return found.select("source", "source_size", "items", F.least(F.col("weight") * level, cap).alias("target"))


def _pair(seed: int, a: Column, b: Column, settled: Column) -> Column:
    """Settle one of two documents and go on with the other."""

    def kept(item: Column, mass: Column) -> Column:
        return F.struct(*[item[f].alias(f) for f in ("order", "doc", "print", "size")], mass.alias("mass"))

    def done(item: Column, extra: int) -> Column:
        return F.concat(
            settled, F.array(F.struct(item["doc"].alias("doc"), item["print"].alias("print"), F.lit(extra).alias("extra")))
        )

    def state(item: Column, mass: Column, settled_: Column) -> Column:
        return F.struct(kept(item, mass).alias("open"), settled_.alias("settled"))

    room_a, room_b = a["size"] - a["mass"], b["size"] - b["mass"]
    up, down = F.least(room_a, b["mass"]), F.least(a["mass"], room_b)
    rises = uniform(seed, a["order"], b["order"]) * (up + down) < down
    return (
        F.when(rises & (room_a <= b["mass"]), state(b, b["mass"] - room_a, done(a, 1)))
        .when(rises, state(a, a["mass"] + b["mass"], done(b, 0)))
        .when(a["mass"] <= room_b, state(b, b["mass"] + a["mass"], done(a, 0)))
        .otherwise(state(a, a["mass"] - room_b, done(b, 1)))
    )


def _fold(open_items: DataFrame, seed: int) -> DataFrame:
    """One level of the tree: each group leaves settled documents and one open one."""
    item = F.struct("order", "doc", "print", "size", "mass")
    group = ("source", "scale", "bucket", "buckets")
    grouped = open_items.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.array().cast(f"array<struct<doc:{open_items.schema['doc'].dataType.simpleString()},print:bigint,extra:int>>")
    start = F.struct(F.col("items")[0].alias("open"), none.alias("settled"))
    rest = F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(0)))
    folded = F.aggregate(rest, start, lambda state, b: _pair(seed, state["open"], b, state["settled"]))
    return grouped.select(*group, folded.alias("state")).select(*group, "state.open", "state.settled")


def _last(left: DataFrame) -> DataFrame:
    """Round the documents left of each source, one for each power of two of words at most."""
    item = F.struct("open.size", "open.order", "open.doc", "open.print", "open.mass")
    falling = left.groupBy("source").agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
    kind = f"array<struct<doc:{left.schema['open'].dataType['doc'].dataType.simpleString()},print:bigint,extra:int>>"
    words = F.aggregate("items", F.lit(0.0), lambda total, x: total + x["mass"])
    start = F.struct(words.alias("room"), F.array().cast(kind).alias("settled"))

    def step(state: Column, x: Column) -> Column:
        taken = x["size"] <= state["room"]
        done = F.struct(x["doc"].alias("doc"), x["print"].alias("print"), taken.cast("int").alias("extra"))
        return F.struct(
            (state["room"] - F.when(taken, x["size"]).otherwise(F.lit(0.0))).alias("room"),
            F.concat(state["settled"], F.array(done)).alias("settled"),
        )

    return falling.select("source", F.aggregate("items", start, step)["settled"].alias("settled"))


def round_copies(rows: DataFrame, goals: DataFrame, seed: int = 7, fan_in: int = FAN_IN) -> DataFrame:
    """doc, print, source, rows, sure, extra: the fractional copy of each document rounded to 0 or 1.

    Of n rows that repeat entirely, with a fraction f each, `sure` = floor(n * f) have a copy more; one further row has the
    fraction that is left of n * f, and only this one is rounded: that is `extra`.
    Groups are cut by a hash of the document, so a source that holds most rows is only more groups.
    """
    rate = F.col("target") / F.col("source_size")
    parts = goals.where("source_size > 0").select(F.col("source").alias("_of"), (rate - F.floor(rate)).alias("part"))
    scale = F.floor(F.log2(F.col("size").cast("double"))).cast("int")
    items = rows.where("size > 0").groupBy(*ITEM).agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("rows")).withColumn("scale", scale)
    groups = items.groupBy("source", "scale").agg(F.ceil(F.count(F.lit(1)) / fan_in).alias("buckets"))
    same = F.col("source").eqNullSafe(F.col("_of"))
    groups = groups.join(parts, same).where(F.col("part") > LEAST_FRACTION).select(
        F.col("_of"), F.col("scale").alias("_scale"), "buckets", "part"
    )
    order = F.xxhash64(F.lit(seed), "doc", "print", "source").alias("order")
    expected = F.col("rows") * F.col("part")
    placed = items.join(groups, same & (F.col("scale") == F.col("_scale"))).withColumn("sure", F.floor(expected + LEAST_FRACTION))
    placed = placed.withColumn("left", F.greatest(expected - F.col("sure"), F.lit(0.0)))
    level = placed.select(
        "source", "scale", "buckets", order, "doc", "print", F.col("size").cast("double").alias("size"), (F.col("size") * F.col("left")).alias("mass")
    ).withColumn("bucket", F.pmod(F.xxhash64("order"), F.col("buckets")))
    levels: list[DataFrame] = []
    while True:
        levels.append(stored(_fold(level, seed + len(levels)), "mix-level"))
        further = levels[-1].where("buckets > 1")
        if further.isEmpty():
            break
        level = further.select(
            "source",
            "scale",
            F.ceil(F.col("buckets") / fan_in).alias("buckets"),
            F.floor(F.col("bucket") / fan_in).alias("bucket"),
            "open.*",
        )
    folded = reduce(DataFrame.unionByName, levels)
    settled = folded.select("source", "settled").unionByName(_last(folded.where("buckets = 1")))
    settled = settled.select("source", F.explode("settled").alias("s")).select("s.doc", "s.print", "source", "s.extra")
    # Most documents are one row; the others' sure copies are joined to them.
    several = placed.where("rows > 1").select(F.col("doc").alias("_d"), F.col("print").alias("_p"), F.col("source").alias("_s"), "rows", "sure")
    one = F.col("print").eqNullSafe(F.col("_p")) & F.col("doc").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s"))
    joined = settled.join(several, one, "left")
    return joined.select("doc", "print", "source", F.coalesce("rows", F.lit(1)).alias("rows"), F.coalesce("sure", F.lit(0)).alias("sure"), "extra")


def _among_equals(rows: DataFrame) -> DataFrame:
    """Add `place`, 1 and up among rows that repeat entirely.

    Rows number themselves within the task that stored them; a table with one row for each document and such task has the
    offsets, so that a document with very many rows is never in one task.
    """
    task = F.shiftright("number", 33)
    rows = rows.withColumn("_task", task)
    own = Window.partitionBy(*ITEM, "_task").orderBy("number")
    before = Window.partitionBy(*ITEM).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*ITEM, "_task").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select(*[F.col(c).alias(f"_{c}") for c in ITEM], F.col("_task").alias("_of_task"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = (F.col("_task") == F.col("_of_task")) & F.col("print").eqNullSafe(F.col("_print"))
    same = same & F.col("doc").eqNullSafe(F.col("_doc")) & F.col("source").eqNullSafe(F.col("_source"))
    numbered = rows.withColumn("_own", F.row_number().over(own)).join(offsets, same)
    return numbered.withColumn("place", F.col("_before") + F.col("_own")).drop("_task", "_of_task", "_own", "_before", *[f"_{c}" for c in ITEM])


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = 7,
    carry: bool = False,
) -> DataFrame:
    """Every row with doc, source, size, source_size, target, copies and taken words (and `row`).

    Null texts have no words; rows without words are never drawn and take 0. Null sources are one
    source, ranked last. Null keys are documents told apart by their text. The draw depends on key,
    text, source and seed alone, so reruns agree; of rows that repeat entirely, equally many have a copy more.
    An empty table gives an empty result.
    """
    rows = sized(docs, key, text, source, carry)
    goals = stored(targets(rows, weights), "targets")
    extra = round_copies(rows, goals, seed).select(
        F.col("doc").alias("_doc"), F.col("print").alias("_print"), F.col("source").alias("_of"), "rows", "sure", "extra"
    )
    same = (
        F.col("print").eqNullSafe(F.col("_print"))
        & F.col("doc").eqNullSafe(F.col("_doc"))
        & F.col("source").eqNullSafe(F.col("_of"))
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    more = F.when(F.col("place") <= F.col("sure"), F.lit(1)).when(F.col("place") == F.col("sure") + 1, F.col("extra"))
    copies = F.when(F.col("size") > 0, whole + F.coalesce(more, F.lit(0))).otherwise(F.lit(0)).cast("int")
    goal = goals.select(F.col("source").alias("_source"), "source_size", "target")
    rows = rows.join(extra, same, "left").drop("_doc", "_print", "_of")
    alone = F.coalesce(F.col("rows"), F.lit(1)) == 1
    rows = rows.where(alone).withColumn("place", F.lit(1).cast("long")).unionByName(_among_equals(rows.where(~alone)))
    return (
        rows.join(goal, F.col("source").eqNullSafe(F.col("_source")))
        .select(
            *(["row"] if carry else []),
            "doc", "source", "size", "source_size", "target", copies.alias("copies"),
            (F.col("size") * copies).alias("taken"),
        )
    )


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken (at most `MOST_COPIES` times)."""
    taken = mix(docs, carry=True, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("row.*")
