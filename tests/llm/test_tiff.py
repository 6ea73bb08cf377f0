import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from rankloom.llm import tiff_media as tm


def pack_bits(data):
    out, i = bytearray(), 0
    while i < len(data):
        n = 1
        while n < 128 and i + n < len(data) and data[i + n] == data[i]:
            n += 1
        if n > 1:
            out += bytes([257 - n, data[i]])
        else:
            out += bytes([0, data[i]])
        i += n
    return bytes(out)


def lzw(data):
    out, bits, width = 0, 0, 9
    table = {bytes([i]): i for i in range(256)}
    put = lambda code: (code, width)
    codes, last = [put(256)], b""
    size = 258
    for b in data:
        nxt = last + bytes([b])
        if nxt in table:
            last = nxt
            continue
        codes.append((table[last], width))
        table[nxt] = size
        size += 1
        if size == 4094:
            codes.append((256, 12))
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        else:
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        last = bytes([b])
    if last:
        codes.append((table[last], width))
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    codes.append((257, width))
    for code, w in codes:
        out, bits = (out << w) | code, bits + w
    pad = -bits % 8
    return (out << pad).to_bytes((bits + pad) // 8, "big")


CODERS = {1: bytes, 5: lzw, 8: zlib.compress, 32946: zlib.compress, 32773: pack_bits}


def tiff(image, order, compression, predictor=1, tile=None, rows=5):
    """A one-page file, strips of `rows` rows or tiles of `tile` (height, width)."""
    h, w, s = image.shape
    a = image.copy()
    blocks = []
    if tile:
        th, tw = tile
        for y in range(0, h, th):
            for x in range(0, w, tw):
                b = np.zeros((th, tw, s), np.uint8)
                part = a[y : y + th, x : x + tw]
                b[: part.shape[0], : part.shape[1]] = part
                blocks.append(b)
    else:
        blocks = [a[y : y + rows] for y in range(0, h, rows)]
    data, offsets, counts = bytearray(), [], []
    for b in blocks:
        if predictor == 2:
            b = b.copy()
            b[:, 1:] -= b[:, :-1].copy()
        raw = CODERS[compression](b.tobytes())
        offsets.append(8 + len(data))
        counts.append(len(raw))
        data += raw
    data += bytes(len(data) % 2)
    o = {"II": "<", "MM": ">"}[order]

    def arrayed(values):
        nonlocal data
        if len(values) == 1:
            return struct.pack(o + "I", values[0])
        at = 8 + len(data)
        data += struct.pack(f"{o}{len(values)}I", *values)
        return struct.pack(o + "I", at)

    short = lambda v: struct.pack(o + "H", v) + b"\0\0"
    fields = {256: (4, 1, struct.pack(o + "I", w)), 257: (4, 1, struct.pack(o + "I", h)), 259: (3, 1, short(compression)), 277: (3, 1, short(s)), 317: (3, 1, short(predictor))}
    if s == 1:
        fields[258] = (3, 1, short(8))
    else:
        at = 8 + len(data)
        data += struct.pack(f"{o}{s}H", *[8] * s)
        fields[258] = (3, s, struct.pack(o + "I", at))
    if tile:
        fields |= {322: (3, 1, short(tile[1])), 323: (3, 1, short(tile[0])), 324: (4, len(offsets), arrayed(offsets)), 325: (4, len(counts), arrayed(counts))}
    else:
        fields |= {273: (4, len(offsets), arrayed(offsets)), 278: (3, 1, short(rows)), 279: (4, len(counts), arrayed(counts))}
    ifd = struct.pack(o + "H", len(fields)) + b"".join(struct.pack(o + "HHI", t, k, n) + v for t, (k, n, v) in sorted(fields.items())) + bytes(4)
    return order.encode() + struct.pack(o + "HI", 42, 8 + len(data)) + bytes(data) + ifd


@pytest.mark.parametrize("compression", CODERS)
@pytest.mark.parametrize("order", ["II", "MM"])
def test_round_trips(compression, order):
    rng = np.random.default_rng(compression)
    for shape, kinds in (((13, 9, 1), 3), ((64, 70, 3), 256), ((1, 1, 1), 2), ((30, 200, 1), 256)):
        image = rng.integers(0, kinds, shape).astype(np.uint8)
        for predictor in (1, 2):
            for tile in (None, (16, 16)):
                data = tiff(image, order, compression, predictor, tile)
                rows = tm.decode_pages(data)
                assert len(rows) == 1 and rows[0][6] is None, rows[0][6]
                assert rows[0][4] == image.tobytes() and rows[0][2:4] == (shape[1], shape[0])


def test_pages(spark):
    pages = [np.full((3, 64), i, np.uint8) for i in range(3)]
    media = tm.write_pages(pages)
    frame = spark.createDataFrame([(1, bytearray(media)), (2, None), (3, bytearray(b"no tiff")), (4, bytearray(media[:40])), (1, bytearray(media))], "id long, media binary")
    rows = tm.tiff_pages(frame, "media", ["id"]).collect()
    assert [r["page"] for r in rows if r["id"] == 1] == [0, 1, 2, 0, 1, 2]
    assert [r["id"] for r in rows if r["error"]] == [3, 4] and not [r for r in rows if r["id"] == 2]
    assert bytes(rows[2]["pixels"]) == pages[2].tobytes() and rows[2]["pages"] == 3
    assert tm.tiff_pages(frame.limit(0), "media", ["id"]).count() == 0
    with pytest.raises(ValueError, match="are added"):
        tm.tiff_pages(frame.withColumnRenamed("id", "page"), "media", ["page"])


def test_loop_of_directories_ends():
    data = bytearray(tm.write_pages([np.zeros((2, 64), np.uint8)]))
    at = struct.unpack("<I", data[4:8])[0]
    n = struct.unpack_from("<H", data, at)[0]
    struct.pack_into("<I", data, at + 2 + 12 * n, at)
    assert len(tm.decode_pages(bytes(data))) == 1


def test_texts(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "x" * 64, "é" * 33, "".join(chr(rng.randrange(32, 3000)) for _ in range(200_000)), "a"]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = {r["doc_id"]: r for r in tm.text_round_trip(frame, page_rows=100).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert r["feature"].count(",") == -(-len(full) // 6400) - 1
    assert rows[2][1:] == rows[6][1:]
    assert tm.text_round_trip(frame.limit(0)).count() == 0


def test_a_bad_page_costs_no_other():
    pages = [np.full((40, 64), i, np.uint8) for i in range(3)]
    data = bytearray(tm.write_pages(pages))
    strip = [f[273][0] for f in tm.directories(bytes(data))][1]
    data[strip : strip + 4] = b"\xff" * 4
    rows = tm.decode_pages(bytes(data))
    assert [(r[0], r[1], r[6] is None) for r in rows] == [(0, 3, True), (1, 3, False), (2, 3, True)]
    assert rows[0][4] == pages[0].tobytes() and rows[2][4] == pages[2].tobytes()
    ends = [f[273][0] for f in tm.directories(bytes(data))][2]
    broken = tm.decode_pages(bytes(data[:ends]))  # the last directory is cut off
    assert broken[0][6] is None and broken[-1][6] and len(broken) == 3


def test_claims_are_bounded():
    small = bytearray(tm.write_pages([np.zeros((2, 64), np.uint8)]))
    at = struct.unpack("<I", small[4:8])[0]
    for k, value in ((0, 2**31), (1, 2**31)):  # width, height
        data = bytearray(small)
        struct.pack_into("<I", data, at + 2 + 12 * k + 8, value)
        assert tm.decode_pages(bytes(data))[0][6]
    assert len(tm.inflate(zlib.compress(bytes(10**7)), 100)) == 100
    assert len(tm.unpack_bits(b"\x81a" * 1000, 300)) <= 428


def test_other_samples():
    """Planar order, 16-bit samples and pages of one bit a sample, in strips without compression."""

    def page(fields, data):
        at = 8 + len(data) + len(data) % 2
        ifd = struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", t, 4, 1, v) if not isinstance(v, tuple) else struct.pack("<HHIHH", t, 3, 2, *v) for t, v in sorted(fields.items())) + bytes(4)
        return b"II" + struct.pack("<HI", 42, at) + data + bytes(len(data) % 2) + ifd

    rng = np.random.default_rng(0)
    wide = rng.integers(0, 65536, (5, 7)).astype("<u2")
    rows = tm.decode_pages(page({256: 7, 257: 5, 258: 16, 259: 1, 273: 8, 277: 1, 278: 5, 279: 70}, wide.tobytes()))
    assert rows[0][6] is None and rows[0][4] == wide.tobytes()
    bits = rng.integers(0, 2, (5, 11)).astype(np.uint8)
    rows = tm.decode_pages(page({256: 11, 257: 5, 258: 1, 259: 1, 273: 8, 277: 1, 278: 5, 279: 10}, np.packbits(bits, axis=1).tobytes()))
    assert rows[0][4] == bits.tobytes()
    both = rng.integers(0, 256, (3, 4, 2)).astype(np.uint8)
    planes = np.moveaxis(both, 2, 0)
    rows = tm.decode_pages(page({256: 4, 257: 3, 258: (8, 8), 259: 1, 273: (8, 20), 277: 2, 278: 3, 279: (12, 12), 284: 2}, planes.tobytes()))
    assert rows[0][6] is None and rows[0][4] == both.tobytes()
    assert "bits" in tm.decode_pages(page({256: 7, 257: 5, 258: 32, 273: 8, 279: 70}, wide.tobytes()))[0][6]
