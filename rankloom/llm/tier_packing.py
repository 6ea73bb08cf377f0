"""Hierarchical multi-length packing of whole documents into windows of several sizes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.llm.common import numbered, small_batches, stored
from rankloom.llm.token_text import chunks, codec, with_end

PIECES = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long, tier int, bundle long"

BUNDLES_OF_CELL = 4096


class Packer:
    """Packs pieces as they come. tiers: window sizes, rising powers of two; step: tokens of a step group.

    A document's full longest windows become sequences of their own; the rest goes to the smallest tier that holds
    it whole. Each tier has one open window. Where a piece does not fit into what is left of its window, the gap is
    filled from the open windows of shorter tiers, and only then is the piece cut. `finish` packs the open windows
    into longest windows and cuts what is left into powers of two, so nothing is padded. Windows are bundled to the
    longest window's size. Memory: the open windows, under twice the longest window.
    """

    def __init__(self, tiers: tuple[int, ...], part: int):
        self.tiers, self.top, self.part = tiers, tiers[-1], part
        self.open: dict[int, list[list]] = {t: [] for t in tiers}
        self.fill = dict.fromkeys(tiers, 0)
        self.bundle = {t: (0, 0) for t in tiers}
        self.sequences = self.bundles = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.top:
            self.close([[doc_id, at, ids[at : at + self.top], total]], self.top)
            at += self.top
        if at < total:
            tier = next(t for t in self.tiers if t >= total - at)
            self.place([doc_id, at, ids[at:].copy(), total], tier)

    def place(self, piece: list, tier: int) -> None:
        room = tier - self.fill[tier]
        if len(piece[2]) > room:
            for got in self.borrow(room, tier):
                self.put(got, tier)
            room = tier - self.fill[tier]
            if self.fill[tier] and room < tier:  # shorter tiers had too little
                head, piece = cut(piece, room)
                self.put(head, tier)
        self.put(piece, tier)

    def put(self, piece: list, tier: int) -> None:
        self.open[tier].append(piece)
        self.fill[tier] += len(piece[2])
        if self.fill[tier] == tier:
            pieces, self.open[tier], self.fill[tier] = self.open[tier], [], 0
            self.close(pieces, tier)

    def borrow(self, room: int, tier: int) -> list[list]:
        out = []
        for t in reversed([t for t in self.tiers if t < tier]):
            while room and self.open[t]:
                piece = self.open[t].pop()
                self.fill[t] -= len(piece[2])
                if len(piece[2]) > room:
                    piece, rest = cut(piece, room)
                    self.open[t].append(rest)
                    self.fill[t] += len(rest[2])
                out.append(piece)
                room -= len(piece[2])
        return out

    def close(self, pieces: list[list], tier: int) -> None:
        bundle, room = self.bundle.get(tier, (0, 0))
        if not room:
            bundle, room = self.bundles, max(1, self.top // tier)
            self.bundles += 1
        self.bundle[tier] = (bundle, room - 1)
        offset = 0
        for doc_id, start, ids, total in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((self.part, doc_id, start, len(ids), crc, total, self.sequences, offset, tier, bundle))
            offset += len(ids)
        self.sequences += 1

    def finish(self) -> None:
        left = [p for t in reversed(self.tiers) for p in self.open[t]]
        size = sum(len(p[2]) for p in left)
        while size:
            window = min(self.top, 1 << (size.bit_length() - 1))
            pieces, room = [], window
            while room:
                piece = left.pop(0)
                if len(piece[2]) > room:
                    piece, rest = cut(piece, room)
                    left.insert(0, rest)
                pieces.append(piece)
                room -= len(piece[2])
            self.close(pieces, window)
            size -= window

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(10)]
        kinds = [pa.int32()] + [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = [f.split()[0] for f in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def cut(piece: list, at: int) -> tuple[list, list]:
    doc_id, start, ids, total = piece
    return [doc_id, start, ids[:at], total], [doc_id, start + at, ids[at:], total]


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = (256, 512, 1024, 2048), end_id: int = 1, step: int = 65536) -> DataFrame:
    """Pieces of the packed documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    docs: doc_id, text; tokenizer: path of the tokenizer's file. Each input partition is packed by its own task
    without a shuffle of tokens; a partition adds at most a dozen short sequences, all of them powers of two. The
    pieces are written to the shared folder; from the sequences and bundles of each partition, one row each, sequence
    ids are then numbered from 0 without gaps over all partitions, and bundles are dealt to step groups in turn by
    the tokens before them: a group takes bundles until it has `step` tokens, so all but the last hold that many, give
    or take a bundle. The table must be one whose partitions are read alike each time, such as files; split otherwise,
    its pieces get other numbers. Defined results: a null or empty text is the end id alone; repeated rows and null
    ids are packed like others; an empty table gives no rows; other columns are ignored; a text of any length is cut
    into full windows as it comes.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(tokenizer).encode
        packer = Packer(tuple(tiers), TaskContext.get().partitionId())
        for batch in chunks(batches):
            ids, offsets = with_end(*encode(batch.column(1)), end_id)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                packer.add(doc_id, ids[offsets[i] : offsets[i + 1]])
            yield packer.take()
        packer.finish()
        yield packer.take()

    pieces = stored(docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, PIECES), "pieces")
    cell = F.floor(F.col("bundle") / BUNDLES_OF_CELL)
    bundles = pieces.groupBy("part", "bundle").agg(F.sum("length").alias("tokens"))
    bundles = numbered(bundles.withColumns({"cell": cell, "cells": F.struct("part", cell.alias("cell"))}), [], "cells", [F.col("bundle")], F.col("tokens"), "before")
    bundles = bundles.select("part", "bundle", F.floor(F.col("before") / max(step, tiers[-1])).alias("step_group"))
    parts = pieces.groupBy("part").agg(F.max("sequence").alias("last"))
    earlier = F.coalesce(F.sum(F.col("last") + 1).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", earlier.alias("first"))  # a row for each partition
    out = pieces.join(F.broadcast(parts), "part").join(bundles, ["part", "bundle"])
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("sequence")).alias("sequence_id"), "offset", "tier", "step_group")
