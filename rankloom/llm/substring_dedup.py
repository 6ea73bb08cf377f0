"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.llm.common import documents_apart, free_shuffles, join_counted, stored
from rankloom.llm.hashing import BYTE, SPACE, flat_bytes, run_hashes, sized, word_hashes, word_spans
from rankloom.llm.shared_keys import shared_keys

GEAR = (BYTE >> np.uint64(32)).astype(np.uint32)
GEAR_BYTES = 32
CHUNK_TEXT = 1_000_000
EDGE = 24
FOUND = "doc_id long, start long, end long, n_words int, d1 long, d2 long, next long"
BESIDE = "doc_id long, side int, at long, words array<int>, places array<long>"


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: sum of GEAR[byte] << age over the last 32 bytes, by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        moved = h[:-step] << np.uint32(step)
        h[step:] += moved
    return h


def single_spaced(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with every run of white space as one space, and where the bytes `at` stand in them."""
    space = SPACE[data]
    keep = ~space
    keep[1:] |= ~space[:-1]
    moved = np.cumsum(keep)[at] - 1
    return np.where(space, np.uint8(32), data)[keep], moved


def cut_points(hashes: np.ndarray, bounds: np.ndarray, radius: int) -> np.ndarray:
    """Which words begin a chunk: a text's first, and those of least hash among the `radius` words on either side."""
    docs = len(bounds) - 1
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(docs), counts)
    at = np.arange(len(hashes)) + radius * (owner + 1)
    keys = np.full(len(hashes) + radius * (docs + 1), np.iinfo(np.uint64).max, np.uint64)
    keys[at] = (hashes.astype(np.uint64) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    least, width = keys, 1
    while width < 2 * radius + 1:
        step = min(width, 2 * radius + 1 - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    begins = least[at - radius] == keys[at]
    begins[bounds[:-1][counts > 0]] = True
    return np.flatnonzero(begins)


@dataclass(frozen=True)
class Chunks:
    """Words of a batch of texts (hash, start and end byte in the text) and its chunks as runs of them.

    first and last: words of each chunk; owner: its text; digest: two 64-bit hashes of its words.
    """

    words: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    first: np.ndarray
    last: np.ndarray
    owner: np.ndarray
    digest: tuple[np.ndarray, np.ndarray]


def text_chunks(texts: pa.Array, radius: int) -> Chunks:
    """Content-defined chunks; white space counts as one space whatever it is, so other line breaks change nothing."""
    data, starts, ends = flat_bytes(texts, GEAR_BYTES)
    ws, we, bounds = word_spans(data, starts, ends)
    if not len(ws):
        none = np.zeros(0, np.int64)
        return Chunks(none.astype(np.uint64), none, none, bounds, none, none, none, (none.astype(np.uint64),) * 2)
    words = word_hashes(data, ws, we)
    plain, at = single_spaced(data, ws)
    first = cut_points(gear(plain)[at - 1], bounds, radius)
    owner = np.searchsorted(bounds, first, side="right") - 1
    last = np.append(first[1:], len(ws)) - 1
    text = np.repeat(starts, np.diff(bounds))
    return Chunks(words, ws - text, we - text, bounds, first, last, owner, tuple(run_hashes(words, first, last + 1, lane) for lane in (0, 1)))


def shared_chunks(docs: DataFrame, radius: int) -> DataFrame:
    """Chunks whose digest occurs twice or more in the corpus, and some others; see FOUND. docs: doc_id, text.

    Two passes over the texts: the first counts the digests of all chunks exactly and leaves a bitmap, the second
    emits only chunks whose bit is set; those met by chance are dropped by the exact grouping that follows.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def digests(column: pa.Array) -> np.ndarray:
        found = text_chunks(column, radius)
        owner, d = found.owner, found.digest[0]
        order = np.lexsort((d, owner))
        o, d = owner[order], d[order]
        fresh = np.ones(len(d), bool)
        fresh[1:] = (d[1:] != d[:-1]) | (o[1:] != o[:-1])
        return d[fresh]

    table = spark.sparkContext.broadcast(shared_keys(docs.select("text"), digests, total // 25 + 1, CHUNK_TEXT))
    free_shuffles(spark)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, 1, CHUNK_TEXT):
            c = text_chunks(batch.column(1), radius)
            hit = np.flatnonzero(table.value.repeated(c.digest[0]))
            if not len(hit):
                continue
            first, last, owner = c.first[hit], c.last[hit], c.owner[hit]
            inner = last + 1 < c.bounds[owner + 1]
            following = np.where(inner, c.starts[np.minimum(last + 1, len(c.starts) - 1)], -1)
            cols = [batch.column(0).take(pa.array(owner)), pa.array(c.starts[first]), pa.array(c.ends[last]), pa.array((last - first + 1).astype(np.int32))]
            cols += [pa.array(d[hit].view(np.int64)) for d in c.digest] + [pa.array(following)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in FOUND.split(", ")])

    return stored(docs.select("doc_id", "text").mapInArrow(emit, FOUND), "chunks")


def lists(at: np.ndarray, count: np.ndarray, side: int, values: np.ndarray) -> pa.Array:
    """For each place `at` a list of the `count` values next to it on one side, nearest first."""
    ends = np.cumsum(count)
    step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + 1
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values[np.repeat(at, count) + side * step]))


def words_beside(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Up to EDGE words next to places in texts, nearest first: their hashes, and the byte where each ends the way.

    docs: doc_id, text; asked: doc_id, side, at, the start of a word (side -1: the words before it) or the end of one
    (side 1: the words after it). Only texts that are asked for are read again.
    """
    per = asked.groupBy("doc_id").agg(F.collect_set(F.struct("side", "at")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, 1, CHUNK_TEXT):
            data, starts, ends = flat_bytes(batch.column(1))
            ws, we, bounds = word_spans(data, starts, ends)
            hashes = (word_hashes(data, ws, we) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            text = np.repeat(starts, np.diff(bounds))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(batch.column(2).offsets)))
            flat = batch.column(2).flatten()
            sides, places = np.asarray(flat.field("side")), np.asarray(flat.field("at"))
            for side, edge in ((-1, ws), (1, we)):
                mine = np.flatnonzero(sides == side)
                at = np.searchsorted(edge, starts[owner[mine]] + places[mine])
                limit = bounds[owner[mine]] if side < 0 else bounds[owner[mine] + 1] - 1
                count = np.minimum(abs(at - limit), EDGE)
                cols = [batch.column(0).take(pa.array(owner[mine])), pa.array(np.full(len(mine), side, np.int32)), pa.array(places[mine])]
                cols += [lists(at, count, side, hashes), lists(at, count, side, edge - text)]
                yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in BESIDE.split(", ")])

    out = docs.join(per, "doc_id").select("doc_id", "text", "asked").mapInArrow(run, BESIDE)
    return out.dropDuplicates(["doc_id", "side", "at"])  # of equal rows one


def extended(docs: DataFrame, found: DataFrame, runs: DataFrame) -> DataFrame:
    """How far runs go on beyond their first and last chunk: (doc_id, side, at, to, more).

    The words beside such a chunk are compared with those beside its digest's first chunk in the keeper, from the
    chunk outwards, up to the first that differ, EDGE at most.
    """
    ends = F.array(F.struct(F.lit(-1).alias("side"), F.col("start").alias("at"), "head.*"), F.struct(F.lit(1).alias("side"), F.col("end").alias("at"), "tail.*"))
    edges = stored(runs.where("not kept").select("doc_id", F.explode(ends).alias("e")).select("doc_id", "e.*"), "edges")
    digest = ["d1", "d2"]
    keepers = edges.groupBy("keeper", *digest, "side").agg(F.count("*").alias("__rows"))
    where = found.select(F.col("doc_id").alias("keeper"), *digest, "start", "end").join(keepers, ["keeper", *digest])
    spots = where.groupBy("keeper", *digest, "side").agg(F.min(F.when(F.col("side") < 0, F.col("start")).otherwise(F.col("end"))).alias("spot"), F.max("__rows").alias("__rows"))
    spots = stored(spots, "spots")
    asked = edges.select("doc_id", "side", "at").unionByName(spots.select(F.col("keeper").alias("doc_id"), "side", F.col("spot").alias("at")))
    beside = stored(words_beside(docs, asked), "beside")
    theirs = spots.join(beside.select(F.col("doc_id").alias("keeper"), "side", F.col("at").alias("spot"), F.col("words").alias("theirs")), ["keeper", "side", "spot"])
    mine = edges.select("doc_id", "side", "at", *digest).join(beside, ["doc_id", "side", "at"])
    met = join_counted(stored(mine, "beside-edges"), theirs.select(*digest, "side", "theirs", "__rows"), [*digest, "side"], edges.count())
    same = F.zip_with("words", "theirs", lambda x, y: F.coalesce(x == y, F.lit(False)))
    more = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same))
    out = met.withColumn("more", more.cast("int")).where("more > 0")
    return out.select("doc_id", "side", "at", F.element_at("places", F.col("more")).alias("to"), "more")


def passages(docs: DataFrame, radius: int, min_words: int) -> DataFrame:
    """`repeated_spans` of documents whose doc_id, never null, names one text."""
    found = shared_chunks(docs, radius)
    digest = ["d1", "d2"]
    per = found.groupBy(*digest).agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("__last"), F.count("*").alias("__rows"))
    per = stored(per.where("keeper < __last").drop("__last"), "digests")
    chunks = join_counted(found, per, digest, found.count())
    chunks = chunks.withColumn("kept", F.col("doc_id") == F.col("keeper"))
    order = Window.partitionBy("doc_id").orderBy("start")
    chunks = chunks.withColumn("__again", F.lag("start").over(order).eqNullSafe(F.col("start"))).where("not __again")  # of equal rows one
    apart = (F.lag("next").over(order) != F.col("start")) | (F.lag("kept").over(order) != F.col("kept"))
    runs = chunks.withColumn("__part", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("__part", F.sum("__part").over(order))
    chunk = F.struct("keeper", *digest)
    runs = runs.groupBy("doc_id", "__part", "kept").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").cast("int").alias("n_words"), F.max_by("keeper", F.struct("n_words", "start")).alias("first_doc_id"),
        F.min_by(chunk, "start").alias("head"), F.max_by(chunk, "start").alias("tail"),
    )
    runs = stored(runs, "runs")
    wider = stored(extended(docs, found, runs), "wider")
    before = wider.where("side < 0").select("doc_id", F.col("at").alias("start"), F.col("to").alias("__from"), F.col("more").alias("__before"))
    after = wider.where("side > 0").select("doc_id", F.col("at").alias("end"), F.col("to").alias("__to"), F.col("more").alias("__after"))
    out = runs.join(before, ["doc_id", "start"], "left").join(after, ["doc_id", "end"], "left")
    zero = F.lit(0)
    out = out.select(
        "doc_id", F.coalesce("__from", "start").alias("start"), F.coalesce("__to", "end").alias("end"),
        (F.col("n_words") + F.coalesce("__before", zero) + F.coalesce("__after", zero)).cast("int").alias("n_words"), "first_doc_id", "kept",
    )
    return out.where(F.col("n_words") >= min_words)


def repeated_spans(docs: DataFrame, radius: int = 3, min_words: int = 32) -> DataFrame:
    """Passages that stand in two documents or more: doc_id, start, end (bytes), n_words, first_doc_id, kept.

    docs: doc_id, text. A chunk begins at a word whose preceding 32 bytes have the least gear hash among the `radius`
    words on either side, so chunks depend on nearby text only, resist shifts and have more than `radius` words but
    at a text's ends; seven words is usual. A chunk is repeated when its 128-bit digest occurs in two documents; the
    smallest of them keeps it. Adjacent repeated chunks that the document does not keep are a passage to go (`kept`
    false, `first_doc_id` the keeper of its longest chunk); at both ends it is carried on, word by word up to EDGE
    words, as far as the keeper's text agrees, so head and tail of a passage go too. Runs that the document keeps are
    reported with `kept` true. Passages of under `min_words` words are left alone.

    Defined results: null and empty texts have no chunks; repeats within one document are not reported; white space
    between words, of any kind and length, does not count; rows with equal doc_id and text are one document, rows of
    one doc_id with other texts, and rows with a null doc_id, are documents of their own that keep nothing which a
    plain doc_id has (`first_doc_id` is null where one of them keeps); an empty table gives no rows; other columns
    are ignored.
    """
    keyed, surrogates = documents_apart(docs.select(F.col("doc_id").cast("long"), "text"))
    out = passages(keyed.select(F.col("key").alias("doc_id"), "text"), radius, min_words)
    if surrogates is None:
        return out
    names = keyed.where(F.col("key") >= surrogates).select(F.col("key").alias("doc_id"), F.col("row.doc_id").alias("__id")).distinct()
    plain = out.where(F.col("doc_id") < surrogates).withColumn("__id", F.col("doc_id"))
    named = plain.unionByName(out.join(names, "doc_id")).drop("doc_id").withColumnRenamed("__id", "doc_id")
    return named.withColumn("first_doc_id", F.when(F.col("first_doc_id") < surrogates, F.col("first_doc_id"))).select(*out.columns)


def without_repeats(docs: DataFrame, radius: int = 3, min_words: int = 32) -> DataFrame:
    """The documents with every repeated passage cut out but in its smallest document; all columns are kept.

    n_chars, where it is a column, is counted anew. Documents that lose all their words go; documents without repeats
    stay untouched, null and empty texts included. Cuts are made by text, never by doc_id alone: see `repeated_spans`
    for rows that share a doc_id or have none.
    """
    keyed, _ = documents_apart(docs)
    spans = passages(keyed.select(F.col("key").alias("doc_id"), "text"), radius, min_words).where("not kept")
    cuts = spans.groupBy(F.col("doc_id").alias("key")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    joined = keyed.join(cuts, "key", "left")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = names.index("text")
            texts, n_chars, stays = [], [], []
            for text, cuts_of in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if cuts_of and text:
                    raw, kept, done = text.encode(), [], 0
                    for c in cuts_of:
                        kept.append(raw[done : c["start"]])
                        done = max(done, c["end"])
                    text = b"".join([*kept, raw[done:]]).decode("utf-8", "replace")
                    stays.append(bool(text.strip(" \t\n\v\f\r")))
                else:
                    stays.append(True)
                texts.append(text)
                n_chars.append(None if text is None else len(text))
            cols = list(batch.columns[: len(names)])
            cols[at] = pa.array(texts, cols[at].type)
            if "n_chars" in names:
                cols[names.index("n_chars")] = pa.array(n_chars, cols[names.index("n_chars")].type)
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(stays))

    columns = [F.col(f"row.`{c}`").alias(c) for c in names]
    return joined.select(*columns, F.col("cuts").alias("__cuts")).mapInArrow(run, docs.schema)
