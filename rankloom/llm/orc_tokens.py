"""Token ids in ORC files: run-length encoded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.llm.common import partitions, small_batches, stored
from rankloom.llm.token_text import chunks, codec, with_end

SCHEMA = "doc_id long, row long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, stripe_mb: int = 16, stride: int = 1000) -> None:
    """Write the token ids of whole texts, ascending in doc_id over the files in the order of their names.

    docs: doc_id, text; tokenizer: path of the tokenizer's file. Texts are dealt by ranges of doc_id and encoded
    after that, so ids are never shuffled. ORC stores ids with its integer run-length encoding, an index entry for
    each `stride` rows and a Bloom filter on doc_id, so readers take stripes in parallel and skip stripes and row
    groups that cannot hold a document asked for. `row` numbers the rows of a file in their order. Defined results: a null or empty text is the end id alone; null
    ids come first; repeated rows are kept; an empty table gives no rows; other columns are ignored.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = codec(tokenizer).encode, 0
        for batch in chunks(batches):
            ids, offsets = with_end(*encode(batch.column(1)), end_id)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(row, row + len(lists))), lists], names=["doc_id", "row", "ids"])
            row += len(lists)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    out = rows.mapInArrow(run, SCHEMA).write.option("compression", "zstd")
    out = out.option("orc.stripe.size", str(stripe_mb << 20)).option("orc.row.index.stride", str(stride))
    out.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored documents (doc_id, row, ids); filters on doc_id reach the files' indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: doc_id, start, n_tokens, ids_crc32, all from the files.

    The ids before a document are those of the files before its own, from one total for each file, and those of the
    rows before it in its file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets = np.asarray(lists.offsets)
            values = np.asarray(lists.values).astype("<u4", copy=False)
            raw = memoryview(np.ascontiguousarray(values)).cast("B")
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            cols = [*batch.columns[:3], pa.array(np.diff(offsets), pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["file", "doc_id", "row", "n_tokens", "ids_crc32"])

    read = read_tokens(spark, path).select(F.col("_metadata.file_name").alias("file"), "doc_id", "row", "ids")
    rows = stored(read.mapInArrow(run, "file string, doc_id long, row long, n_tokens long, ids_crc32 long"), "index")
    order = Window.orderBy(F.col("first").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.min("doc_id").alias("first"), F.sum("n_tokens").alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return rows.join(files, "file").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")
