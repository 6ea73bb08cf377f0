"""TIFF media: image directories, compressed strips and tiles, predictors; one row per page."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm.common import small_batches

# Fixed values of the TIFF 6.0 format: tags, compression schemes, bytes of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES = 256, 257, 258, 259, 262, 273, 277
ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}


MOST_BYTES = 1 << 28


def unpack_bits(data: bytes, most: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most)


def unpack_lzw(data: bytes, most: int) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table, 257 ends the data."""
    out, at, width, held, bits = bytearray(), 0, 9, 0, 0
    table: list[bytes] = []
    last = b""
    while True:
        while bits < width:
            if at >= len(data) or len(out) >= most:
                return bytes(out)
            held, bits, at = (held << 8) | data[at], bits + 8, at + 1
        code = (held >> (bits - width)) & ((1 << width) - 1)
        bits -= width
        held &= (1 << bits) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("LZW data without a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


DECODERS = {NONE: lambda data, most: bytes(data[:most]), LZW: unpack_lzw, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpack_bits}


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The fields of each image directory in turn; a directory met twice ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        fields = {}
        for i in range(n):
            tag, kind, count, _ = struct.unpack_from(order + "HHI4s", data, at + 2 + 12 * i)
            if kind in TYPES:
                size, letter = TYPES[kind]
                where = at + 2 + 12 * i + 8
                if size * count > 4:
                    where = struct.unpack_from(order + "I", data, where)[0]
                fields[tag] = struct.unpack_from(f"{order}{count}{letter}", data, where)
        yield fields
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def page_pixels(data: bytes, fields: dict[int, tuple], most: int = MOST_BYTES) -> np.ndarray:
    """Samples of a page as height x width x samples: bytes, 16-bit integers, or 0 and 1 of a page of one bit a sample.

    Chunky and planar data are read. A page that claims more than `most` bytes is refused before memory is taken, and
    no strip or tile is unpacked beyond the bytes its place holds.
    """
    one = lambda tag, default: fields.get(tag, (default,))[0]
    width, height, samples, planar = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(PLANAR, 1)
    depths = set(fields.get(BITS, (1,)))
    if len(depths) != 1 or not depths <= {1, 8, 16}:
        raise ValueError(f"samples of {sorted(depths)} bits are not read")
    depth = depths.pop()
    if one(COMPRESSION, 1) not in DECODERS or one(PREDICTOR, 1) not in (1, 2) or planar not in (1, 2) or (depth == 1 and one(PREDICTOR, 1) == 2):
        raise ValueError("unknown compression, predictor or order of planes")
    if not width or not height or not samples or width * height * samples * max(1, depth // 8) > most:
        raise ValueError(f"a page of {width} x {height} x {samples} samples")
    decode, predictor = DECODERS[one(COMPRESSION, 1)], one(PREDICTOR, 1)
    if TILE_OFFSETS in fields:
        wide, high, offsets, counts = one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0), fields[TILE_OFFSETS], fields[TILE_COUNTS]
    else:
        wide, high = width, min(one(ROWS_PER_STRIP, height), height)
        offsets, counts = fields[STRIP_OFFSETS], fields[STRIP_COUNTS]
    planes, together = (samples, 1) if planar == 2 else (1, samples)
    across, down = -(-width // wide), -(-height // high)
    if len(offsets) < planes * across * down or wide * high * together * max(1, depth // 8) > most:
        raise ValueError("strips or tiles are missing or too large")
    kind = {1: np.dtype("u1"), 8: np.dtype("u1"), 16: np.dtype("<u2" if data[:2] == b"II" else ">u2")}[depth]
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k in range(planes * across * down):
        plane, place = divmod(k, across * down)
        y, x = place // across * high, place % across * wide
        rows = high if TILE_OFFSETS in fields else min(high, height - y)
        line = -(-wide * together // 8) if depth == 1 else wide * together * kind.itemsize
        raw = decode(data[offsets[k] : offsets[k] + counts[k]], rows * line)
        if len(raw) < rows * line:
            raise ValueError("a strip or tile ends early")
        block = np.frombuffer(raw[: rows * line], kind)
        if depth == 1:
            block = np.unpackbits(block.reshape(rows, line), axis=1)[:, : wide * together]
        block = block.reshape(rows, wide, together).astype(out.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        part = out[y : y + rows, x : x + wide, plane : plane + together] if planar == 2 else out[y : y + rows, x : x + wide]
        part[:] = block[: part.shape[0], : part.shape[1]]
    return out


def write_pages(pages: list[np.ndarray], predictor: int = 2, strip_rows: int = 256, level: int = 1) -> bytes:
    """A little-endian TIFF of grey 8-bit pages in deflate strips."""
    out = bytearray(b"II" + struct.pack("<HI", 42, 8))
    link = 4
    for page in pages:
        height, width = page.shape
        if predictor == 2:
            moved = page.copy()
            moved[:, 1:] -= page[:, :-1]
            page = moved
        strips = [zlib.compress(page[y : y + strip_rows].tobytes(), level) for y in range(0, height, strip_rows)]
        offsets, at = [], len(out)
        for s in strips:
            offsets.append(at)
            at += len(s)
        out += b"".join(strips)
        out += bytes(len(out) % 2)
        arrays = {}
        for tag, values in ((STRIP_OFFSETS, offsets), (STRIP_COUNTS, [len(s) for s in strips])):
            arrays[tag] = values[0]
            if len(values) > 1:
                arrays[tag] = len(out)
                out += struct.pack(f"<{len(values)}I", *values)
        struct.pack_into("<I", out, link, len(out))
        n = len(strips)
        fields = [
            (WIDTH, 4, 1, width), (HEIGHT, 4, 1, height), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, DEFLATE), (PHOTOMETRIC, 3, 1, 1),
            (STRIP_OFFSETS, 4, n, arrays[STRIP_OFFSETS]), (SAMPLES, 3, 1, 1), (ROWS_PER_STRIP, 4, 1, strip_rows),
            (STRIP_COUNTS, 4, n, arrays[STRIP_COUNTS]), (PLANAR, 3, 1, 1), (PREDICTOR, 3, 1, predictor),
        ]
        out += struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields)
        link = len(out)
        out += bytes(4)
    return bytes(out)


def feature(page: np.ndarray) -> str:
    """Size, mean and a 64-bit hash of which of 8 x 8 blocks are above the mean."""
    grey = page.astype(np.float64).mean(axis=2)
    rows = np.array([b.mean(axis=0) if len(b) else np.zeros(grey.shape[1]) for b in np.array_split(grey, 8)])
    blocks = np.array([c.mean(axis=1) if c.shape[1] else np.zeros(8) for c in np.array_split(rows, 8, axis=1)]).T
    bits = sum(1 << i for i, up in enumerate((blocks > grey.mean()).ravel().tolist()) if up)
    return f"{grey.shape[1]}x{grey.shape[0]}:{grey.mean():.4f}:{bits:016x}"


PAGE_FIELDS = [("page", pa.int32()), ("pages", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("feature", pa.string()), ("error", pa.string())]


UNREADABLE = (ValueError, KeyError, IndexError, ZeroDivisionError, MemoryError, OverflowError, struct.error, zlib.error)


def page_rows(media: bytes | None, most: int = MOST_BYTES) -> Iterator[tuple]:
    """A row for each page in turn; one that cannot be read has its error and no pixels, and the others stay.

    A file whose walk of directories breaks off ends with a row for that error.
    """
    if media is None:
        return
    found, broken = [], None
    try:
        for fields in directories(media):
            found.append(fields)
    except UNREADABLE as e:
        broken = str(e)[:200]
    pages = len(found) + (broken is not None)
    for i, fields in enumerate(found):
        try:
            p = page_pixels(media, fields, most)
            yield i, pages, p.shape[1], p.shape[0], p.tobytes(), feature(p), None
        except UNREADABLE as e:
            yield i, pages, None, None, None, None, str(e)[:200] or type(e).__name__
    if broken is not None:
        yield len(found), pages, None, None, None, None, broken


def decode_pages(media: bytes | None, most: int = MOST_BYTES) -> list[tuple]:
    return list(page_rows(media, most))


def page_batches(batches: Iterator[pa.RecordBatch], media: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """A row for each page of each media value, with the kept columns; some megabytes of pixels at a time."""
    for batch in batches:
        at, rows, size = [], [], 0
        for i in range(batch.num_rows + 1):
            if rows and (i == batch.num_rows or size > 8 << 20):
                cols = [batch.column(k).take(pa.array(at)) for k in keep]
                cols += [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), PAGE_FIELDS, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *[n for n, _ in PAGE_FIELDS]])
                at, rows, size = [], [], 0
            if i < batch.num_rows:
                for row in page_rows(batch.column(media)[i].as_py()):
                    at.append(i)
                    rows.append(row)
                    size += len(row[4] or b"")


def tiff_pages(df: DataFrame, media: str, keep: list[str]) -> DataFrame:
    """One row per page of a column of TIFF files: the kept columns, page, pages, width, height, pixels, feature, error.

    pixels are the samples in rows, 16-bit ones in little-endian order. Defined results: a null media value has no
    rows; a page that cannot be read, or claims more than MOST_BYTES, has `error` and nulls while the file's other
    pages are given, and so has the end of a broken file; BigTIFF and floating-point samples are such errors; repeated rows are decoded each; an empty table gives no rows; kept columns named like an added one are refused.
    """
    names = {n for n, _ in PAGE_FIELDS}
    if names & set(keep):
        raise ValueError(f"columns {sorted(names & set(keep))} are added")
    small_batches(df.sparkSession)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    schema = f"{kept}, page int, pages int, width int, height int, pixels binary, feature string, error string"
    return df.select(*keep, media).mapInArrow(lambda it: page_batches(it, media, keep), schema)


def text_media(batches: Iterator[pa.RecordBatch], page_rows: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, n_bytes, media: UTF-8 bytes, filled with 0 to a positive multiple of 64, as rows of 64 samples."""
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for a in range(0, batch.num_rows, 256):
            raw = [t or b"" for t in texts.slice(a, 256).to_pylist()]
            media = []
            for t in raw:
                grid = np.frombuffer(t + bytes(-len(t) % 64 if t else 64), np.uint8).reshape(-1, 64)
                media.append(write_pages([grid[y : y + page_rows] for y in range(0, len(grid), page_rows)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 256), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def page_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the pages of a document, which come in turn, together again, and digests what was read."""
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    sha, size, tail, features = hashlib.sha256(), 0, b"", []
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["error"]:
                raise ValueError(r["error"])
            sha.update(r["pixels"])
            size, tail = size + len(r["pixels"]), (tail + r["pixels"])[-64:]
            features.append(r["feature"])
            if r["page"] == r["pages"] - 1:
                rows.append((r["doc_id"], r["n_bytes"], size, sha.hexdigest(), zlib.crc32(tail), r["media_bytes"], r["media_sha256"], ",".join(features)))
                sha, size, tail, features = hashlib.sha256(), 0, b"", []
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in DIGESTS.split(", ")])


def with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        media = b.column("media").to_pylist()
        shas = pa.array([hashlib.sha256(m).hexdigest() for m in media])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(len, media), pa.int64()), shas], names=[*b.schema.names, "media_bytes", "media_sha256"])


def text_round_trip(docs: DataFrame, page_rows: int = 16384) -> DataFrame:
    """Stores each whole text as a TIFF file, reads it back page by page and digests both, in one pass.

    docs: doc_id, text. A page has 64 columns and at most `page_rows` rows. A null or empty text is 64 zero bytes;
    equal texts give equal values; repeated rows are kept; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    keep = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    run = lambda it: page_digests(page_batches(with_digest(text_media(it, page_rows)), "media", keep))
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, DIGESTS)
