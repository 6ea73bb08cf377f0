import random
import re

import numpy as np
import pyarrow as pa

from rankloom.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n):
    return [f"{rng.choice('abcdefghij')}{rng.randrange(10**6)}" for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def planted(seed=0, n=60, shared=51):
    """Texts of their own words; some hold one of three passages, at any place."""
    rng = random.Random(seed)
    passages = [words(rng, shared) for _ in range(3)]
    rows, holds = [], {}
    for i in range(n):
        t = words(rng, rng.randint(20, 200))
        if i % 4 == 0:
            k = rng.randrange(3)
            at = rng.randrange(len(t))
            t[at:at] = passages[k]
            holds[i] = k
        rows.append((i, rng.choice([" ", "\n", "  "]).join(t)))
    return rows, holds, passages


def brute(rows, shortest):
    """Words of each document that lie in a run of `shortest` words that another document holds, and of those the ones
    whose run an earlier document holds."""
    grams = {}
    texts = {i: WORD.findall(t) for i, t in rows}
    for i, t in texts.items():
        for k in range(len(t) - shortest + 1):
            grams.setdefault(tuple(t[k : k + shortest]), set()).add(i)
    every, later = {i: set() for i in texts}, {i: set() for i in texts}
    for i, t in texts.items():
        for k in range(len(t) - shortest + 1):
            holders = grams[tuple(t[k : k + shortest])]
            if len(holders) > 1:
                every[i] |= set(range(k, k + shortest))
                if min(holders) < i:
                    later[i] |= set(range(k, k + shortest))
    return every, later


def covered(rows, spans):
    """Numbers of the words in the spans of each document."""
    out = {i: set() for i, _ in rows}
    texts = dict(rows)
    for r in spans:
        raw = texts[r["doc_id"]].encode()
        before = len(WORD.findall(raw[: r["start"]].decode()))
        inside = len(WORD.findall(raw[r["start"] : r["end"]].decode()))
        assert inside == r["n_words"]
        out[r["doc_id"]] |= set(range(before, before + inside))
    return out


def test_planted_passages(spark):
    """Passages of 51 words, in other white space too, are found in every later holder; other words are left alone."""
    missed = total = 0
    for seed in range(3):
        rows, holds, passages = planted(seed)
        got = sd.repeated_spans(frame(spark, rows)).collect()
        every, later = brute(rows, 51)
        spans = covered(rows, [r for r in got if not r["kept"]])
        assert {i for i, w in spans.items() if w} == {i for i, w in later.items() if w}
        for i, w in spans.items():
            assert w <= later[i]
            missed, total = missed + len(later[i] - w), total + len(later[i])
        assert {r["doc_id"] for r in got} == {i for i, w in every.items() if w}
        assert all(r["n_words"] >= 32 for r in got)
    assert missed <= 0.005 * total


def test_against_all_repeated_word_runs(spark):
    """Long overlapping copies of parts of other texts, few distinct words: what is found against every repeated run."""
    rng = random.Random(9)
    vocabulary = words(rng, 300)
    rows = []
    for i in range(80):
        t = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            if rows:
                other = rng.choice(rows)[1].split()
                a = rng.randrange(len(other))
                t[rng.randrange(len(t)) :] = other[a : a + rng.randint(20, 120)]
        rows.append((i, " ".join(t)))
    spans = covered(rows, [r for r in sd.repeated_spans(frame(spark, rows)).collect() if not r["kept"]])
    wanted, allowed = brute(rows, 51)[1], brute(rows, 4)[1]
    found = sum(len(spans[i] & w) for i, w in wanted.items())
    assert found >= 0.99 * sum(map(len, wanted.values())) > 0
    assert all(w <= allowed[i] for i, w in spans.items())  # nothing that no earlier text holds


def test_cut_texts(spark):
    rows, holds, passages = planted(4)
    rows = [(i, " ".join(WORD.findall(t))) for i, t in rows]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "length(text) as n_chars", "'x' as digest")
    out = {r["doc_id"]: r for r in sd.without_repeats(docs).collect()}
    assert set(out) == set(range(60))
    seen = set()
    for i, t in rows:
        if i not in holds:
            assert out[i]["text"] == t
        else:
            left = [w for w in passages[holds[i]] if w in out[i]["text"].split()]
            assert len(left) == (0 if holds[i] in seen else len(passages[holds[i]]))
            seen.add(holds[i])
        assert out[i]["n_chars"] == len(out[i]["text"]) and out[i]["digest"] == "x"


def test_shifts_leave_chunks(spark):
    rng = random.Random(2)
    base = words(rng, 400)
    chunks = lambda t: set(sd.text_chunks(pa.array([" ".join(t)]), 3).digest[0].tolist())
    whole = chunks(base)
    assert len(whole & chunks([*words(rng, 3), *base])) >= len(whole) - 3
    assert len(whole & chunks([*base[:200], "new", *base[200:]])) >= len(whole) - 4


def test_chunks_cover_and_gear():
    texts = [None, "", "  ", "one", "é  b\tc " * 50, "x" * 1000]
    c = sd.text_chunks(pa.array(texts), 3)
    assert np.bincount(c.owner, weights=c.last - c.first + 1, minlength=6).tolist() == [0, 0, 0, 1, 150, 1]
    assert all(a < b for a, b in zip(c.starts[c.first], c.ends[c.last], strict=True))
    data = np.frombuffer(bytes(32) + b"some bytes to roll over, more than thirty-two of them", np.uint8)
    h = sd.gear(data)
    for i in (32, 50, len(data) - 1):
        want = sum(int(sd.GEAR[data[i - j]]) << j for j in range(32)) % 2**32
        assert h[i] == want


def test_edge_cases(spark):
    rng = random.Random(3)
    t = " ".join(words(rng, 80))
    none = sd.repeated_spans(frame(spark, []))
    assert none.count() == 0
    own = sd.repeated_spans(frame(spark, [(1, t + " " + t), (1, t + " " + t), (2, None), (3, "")]))
    assert own.count() == 0  # within one document
    null = sd.repeated_spans(frame(spark, [(None, t), (5, t), (None, t)])).collect()
    assert {(r["doc_id"], r["kept"], r["first_doc_id"]) for r in null} == {(5, True, 5), (None, False, 5)}
    assert sd.without_repeats(frame(spark, [(1, t), (2, t), (3, None), (4, "")])).count() == 3  # 2 loses all its words
    both = [(1, t), (1, t), (1, "quite " + " ".join(words(rng, 60))), (2, t), (None, t + " more"), (None, "x")]
    out = sd.without_repeats(frame(spark, both)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out if r["doc_id"]) == sorted(both[2:4])  # 1's plain rows comes after 2
    assert sorted(r["text"].strip() for r in out if r["doc_id"] is None) == ["more", "x"]
    long = " ".join(words(rng, 50_000))
    wide = sd.repeated_spans(frame(spark, [(1, "a " + long), (2, long + " b"), (3, "word " * 40_000), (4, "word " * 30_000)])).collect()
    assert max(r["n_words"] for r in wide) == 50_000
