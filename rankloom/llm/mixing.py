"""Mixing sources to target weights: a low-discrepancy schedule of slots joined with shuffled equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.llm.common import WORD, numbered, stored

GOLDEN = 2654435769  # 2**32 divided by the golden ratio
GRID = 1 << 32
CELLS = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Targets of the sources: (source, source_size) -> also idx, target.

    Sources by code point, null last, get the weights in turn. `share` of all sizes is dealt by weight; a target
    stops at `cap` times its source's size and the excess goes to the others by weight until none is above. That
    fixed point is target = min(cap * size, level * weight) with one level for all, found from running sums over the
    sources ordered by cap * size / weight: one row for each source, never for each document.
    """
    idx = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod("idx", F.lit(len(weights))).cast("int") + 1)
    out = sizes.withColumn("idx", idx).withColumn("w", w).withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    order = Window.orderBy("ratio", "idx")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy(F.lit(0))
    out = out.withColumn("level", (share * F.sum("source_size").over(everything) - before) / rest)
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    return out.withColumn("level", level).select("source", "source_size", "idx", F.least("most", F.coalesce(F.col("level") * F.col("w"), F.col("most"))).alias("target"))


def slot_counts(targets: DataFrame, least_block: int, blocks: int, few: int) -> DataFrame:
    """Add words (the target, rounded), block and slots of each source.

    A block is `least_block` words; more where a source would have over `blocks` of them, fewer where it would have
    under `few`. So a source's share of the slots is in proportion to how finely it is cut, and no source is too small
    to have its own.
    """
    words = F.floor(F.round("target", 6) + 0.5).cast("long")
    block = F.greatest(F.lit(1), F.least(F.greatest(F.lit(least_block), F.ceil(words / blocks)), F.floor(words / few))).cast("long")
    out = targets.withColumn("words", words).withColumn("block", block)
    return out.withColumn("slots", F.ceil(F.col("words") / F.col("block")).cast("long"))


def schedule(sources: DataFrame) -> DataFrame:
    """The order of the mix: (idx, rank, slot), a row for each block of each source.

    sources: idx, slots. As many points as there are slots go round the golden ratio (slot * GOLDEN mod 2**32, in
    integers, so reruns agree to the bit) and are mapped through the cumulative slot counts; a source's r-th point is
    the slot of its r-th block. A source has blocks for a few points more or fewer than it got: points beyond its
    blocks stay unused, blocks beyond its points follow after the last slot. So every prefix of the slots holds each
    source near its share, and the whole holds each exactly. Points are ranked within sources of a bounded number of
    slots each.
    """
    spark = sources.sparkSession
    some = sources.where("slots > 0").select("idx", "slots")
    upto = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(0))
    spans = some.withColumns({"n": F.sum("slots").over(everything), "upto": F.sum("slots").over(upto)})
    spans = spans.withColumn("hi", F.expr(f"cast(cast(upto as decimal(28,0)) * {GRID} div n as bigint)")).drop("upto")
    spans = stored(spans.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("idx")), F.lit(0).cast("long"))), "spans")
    total = spans.agg(F.max("n")).first()[0] or 0
    shift = GRID // CELLS
    wide = spans.where("lo < hi").select("idx", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / shift), F.floor((F.col("hi") - 1) / shift))).alias("cell"))
    points = spark.range(total).select(F.col("id").alias("slot"), F.pmod(F.col("id") % GRID * (GOLDEN - GRID), F.lit(GRID)).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / shift))
    got = points.join(wide, "cell").where("point >= lo and point < hi").select("slot", "idx")
    got = stored(got.withColumn("rank", F.row_number().over(Window.partitionBy("idx").orderBy("slot")) - 1), "points")
    counts = spans.join(got.groupBy("idx").agg(F.count("*").alias("got")), "idx", "left")
    late = counts.where(F.col("slots") > F.coalesce("got", F.lit(0)))
    late = late.select("idx", F.explode(F.sequence(F.coalesce("got", F.lit(0)), F.col("slots") - 1)).alias("rank")).withColumn("slot", F.col("rank") + total)
    used = got.join(spans.select("idx", "slots"), "idx").where("rank < slots").select("idx", "rank", "slot")
    return used.unionByName(late.select("idx", F.col("rank").cast("int").alias("rank"), "slot"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, least_block: int = 64, blocks: int = 4096, few: int = 64) -> DataFrame:
    """How many words of each document a mix of the sources takes, and when.

    docs: doc_id, source, text. The words of a source form one stream in the order of md5(doc_id), cut into blocks of
    equal size by source; see `slot_counts`. The r-th slot of a source in `schedule` takes block r, round after round
    through the stream until its target, rounded to a word, is dealt; so all sources meet their targets, the smallest
    too, at most `cap` rounds are made, and slots tell the order in which blocks are taken. Whole rounds and then a
    prefix of the stream are taken, so documents need no list of their blocks.
    Returns doc_id, source, size, source_size, target, taken, slot (that of the document's first word taken, -1 if
    none is).

    Defined results: a null or empty text has size 0 and nothing is taken; null sources form one source, the last;
    repeated rows are documents of their own; an empty table gives no rows; other columns are ignored.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")
    base = stored(docs.select("doc_id", "source", size.alias("size"), h.alias("h")), "sizes")
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, float(cap))
    targets = stored(slot_counts(targets, least_block, blocks, few), "targets")
    order = stored(schedule(targets), "slots")
    docs_of = base.join(targets, base["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    docs_of = docs_of.withColumn("cell", F.floor(F.col("h") / (1 << 38)))
    placed = numbered(docs_of, ["idx"], "cell", [F.col("h"), F.col("doc_id"), F.col("size")], F.col("size"), "start").drop("cell", "h")
    prefix = F.col("words") % F.col("source_size") - F.col("start")
    taken = F.floor(F.col("words") / F.col("source_size")) * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), prefix))
    placed = placed.withColumn("taken", F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long"))
    placed = placed.withColumn("rank", F.when(F.col("taken") > 0, F.floor(F.col("start") / F.col("block"))))
    # Documents of one block share its slot; a block's documents are as many as its words at most, so no key is hot.
    out = placed.join(order, ["idx", "rank"], "left")
    return out.select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.coalesce("slot", F.lit(-1).cast("long")).alias("slot"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """The documents as often as a mix takes them: a row for each whole round, a started round counting from a half.

    A document is never cut, so a source's words stay near what `mix` takes of it. Rows of equal doc_id, source and
    size are taken alike, each by its share of what is taken of them; documents without words go. All columns kept.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    took = mix(docs, weights, share, cap).where("taken > 0").groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("rows"))
    took = took.select("doc_id", "source", "size", F.round(F.col("taken") / F.col("rows") / F.col("size")).cast("int").alias("times")).where("times > 0")
    rows = docs.select("doc_id", "source", size.alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = rows["doc_id"].eqNullSafe(took["doc_id"]) & rows["source"].eqNullSafe(took["source"]) & (rows["size"] == took["size"])
    out = rows.join(took, same).select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("round"))
    return out.select([F.col(f"row.`{c}`").alias(c) for c in docs.columns])
