import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rankloom.llm import orc_tokens, tier_packing, token_text

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n\t", "Hello, world! It's 42 (forty-two) o'clock...", "e\u0301\u00e9 \u00a0x\u2028y\u3000z", "don't can't 's 't ''s", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "a.b,c;d:e!f?g(h)\"i\" \u00c4.\u00d6",
    "\x00\x01 nul \x00", "İstanbul ΑΣ ΣΑΣ ſ K", "日本語。テキスト、です", "🙂🙂 ok", "word " * 5000, "e" + "\u0301" * 40, "a" * 3000, " ".join(f"t{i}" for i in range(3000)),
]


@pytest.fixture(scope="module")
def plain():
    t = tokenizers.Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in TEXTS]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def docs(spark, rows=None):
    rows = [(100 - i, t, 1) for i, t in enumerate(TEXTS)] if rows is None else rows
    return spark.createDataFrame(rows, "doc_id long, text string, ids int")


def test_words_in_turn_give_the_text(plain, monkeypatch):
    for most in (2_000_000, 1000):  # also with a pool that is emptied again and again
        monkeypatch.setattr(token_text, "POOL_WORDS", most)
        monkeypatch.setattr(token_text, "LATE_WORDS", most // 10)
        codec = token_text.WordCodec(PATH)
        for _ in range(2):
            ids, at = token_text.with_end(*codec.encode(pa.array(TEXTS)), 1)
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == plain


def test_orc(spark, plain, tmp_path):
    path = str(tmp_path / "tokens")
    orc_tokens.write_tokens(docs(spark), path, PATH, stride=1000)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in orc_tokens.token_index(spark, path).collect()}
    want, start = {}, 0
    for i in reversed(range(len(TEXTS))):
        want[100 - i] = (start, len(plain[i]), crc(plain[i]))
        start += len(plain[i])
    assert got == want
    one = orc_tokens.read_tokens(spark, path).where("doc_id = 97")
    assert [r["ids"] for r in one.collect()] == [plain[3]] and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,97)]" in one._jdf.queryExecution().toString()


def test_orc_edge_cases(spark, tmp_path):
    orc_tokens.write_tokens(docs(spark, []), str(tmp_path / "none"), PATH)
    assert orc_tokens.token_index(spark, str(tmp_path / "none")).count() == 0
    orc_tokens.write_tokens(docs(spark, [(None, "a", 1), (3, "b c", 1), (3, "b c", 1), (1, None, 1)]), str(tmp_path / "some"), PATH)
    rows = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in orc_tokens.token_index(spark, str(tmp_path / "some")).collect())
    assert rows == [(0, None, 2), (2, 1, 1), (3, 3, 3), (6, 3, 3)]


@pytest.mark.parametrize("tiers", [(256, 512, 1024, 2048), (8, 64), (16,)])
def test_packing(spark, plain, tiers):
    rows = tier_packing.pack(docs(spark).coalesce(2), PATH, tiers, step=4 * tiers[-1]).collect()
    of = {100 - i: x for i, x in enumerate(plain)}
    pieces, sequences, steps = defaultdict(list), defaultdict(list), defaultdict(dict)
    for r in rows:
        ids = of[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) and r["length"] > 0
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        steps[r["step_group"]][r["sequence_id"]] = r["tier"]
    for d, ids in of.items():
        at = 0
        for s, n in sorted(pieces[d]):
            assert s == at
            at += n
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at & (at - 1) == 0 and at <= tiers[-1]  # no padding
    assert sorted(sequences) == list(range(len(sequences)))
    filled = Counter()
    for r in rows:
        filled[r["step_group"]] += r["length"]
    assert sorted(filled) == list(range(len(filled)))
    assert all(abs(filled[k] - 4 * tiers[-1]) <= tiers[-1] for k in range(len(filled) - 1)) and filled[len(filled) - 1] <= 5 * tiers[-1]


def test_packer_fills_gaps_from_shorter_tiers():
    p = tier_packing.Packer((4, 8), 0)
    p.add(1, np.arange(6, dtype=np.uint32))
    p.add(2, np.arange(2, dtype=np.uint32))
    p.add(3, np.arange(7, dtype=np.uint32))  # does not fit after 1; 2 fills the gap
    assert [(r[1], r[3], r[7]) for r in p.rows] == [(1, 6, 0), (2, 2, 6)]
    p.finish()
    assert sum(r[3] for r in p.rows) == 15


def test_packing_edge_cases(spark):
    assert tier_packing.pack(docs(spark, []), PATH).count() == 0
    rows = tier_packing.pack(docs(spark, [(None, "a", 1), (1, "a", 1), (1, "a", 1)]), PATH).collect()
    assert sum(r["length"] for r in rows) == 6


PIECES = ["\u0130", "I", "i", "\u0307", "\u0301", "é", "e", "ß", "Σ", "ς", "K", "\u0958", "\ufb2a", "क", "\u093c", "\u1100", "\u1161", "가", "中", "。", "1", "½", ".", ",", ";", ":", "!", "?", "(", ")", '"', "'", "'s", "'ll", "-",
          "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "\n", "\t", "\u00a0", "\u0085", "\x1c", "\x00", "a", "b", "Z", "word", "🙂", "\u2260", "\u0338", "<", "GELİR VERGİSİ."]


def test_ids_are_those_of_the_tokenizer():
    """10,000 random texts of what normalisation joins, splits or lower-cases oddly, and words with equal power sums."""
    import random

    rng = random.Random(11)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(10_000)]
    texts += ["".join(ab[bin(i).count("1") % 2] for i in range(1 << bits)) for bits in (10, 11, 12) for ab in ("ab", "ba")]
    codec = token_text.WordCodec(PATH)
    assert codec.by_words
    for a in range(0, len(texts), 500):
        part = texts[a : a + 500]
        ids, at = codec.encode(pa.array(part))
        assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in codec.tokenizer.encode_batch(part, add_special_tokens=False)]


def test_words_of_one_hash_and_other_tokenizers(monkeypatch):
    codec, texts = token_text.WordCodec(PATH), ["one two one", "three", None]
    want = [codec.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    read = lambda c: (lambda ids, at: [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)])(*c.encode(pa.array(texts)))
    assert read(codec) == want
    monkeypatch.setattr(token_text, "word_hashes", lambda data, ws, we: np.zeros(len(ws), np.uint64))
    assert read(codec) == want  # all words share a hash
    other = token_text.WordCodec(public.path("byte_bpe_50k.json"))
    assert not other.by_words  # its ids depend on the space before a word
    assert read(other) == [other.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_start_follows_the_file(spark, tmp_path):
    """Rows of one doc_id are counted in the order they stand in the file, not by their lengths."""
    path = str(tmp_path / "tokens")
    orc_tokens.write_tokens(docs(spark, [(7, "one two three four", 1), (7, "one", 1), (7, "one two", 1), (9, "x", 1)]).coalesce(1), path, PATH)
    stored = [r for f in sorted(tmp_path.glob("tokens/*.orc")) for r in spark.read.orc(str(f)).orderBy("row").collect()]
    at, want = 0, []
    for r in stored:
        want.append((r["doc_id"], at, len(r["ids"])))
        at += len(r["ids"])
    assert sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in orc_tokens.token_index(spark, path).collect()) == sorted(want)
