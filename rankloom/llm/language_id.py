"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.llm.common import small_batches
from rankloom.llm.hashing import sized

FEATURE_BITS = 16
ORDERS = (1, 2, 3)
PER_LANGUAGE = 1500
MOST_LANGUAGES = 1000
SAMPLE_BYTES = 128_000_000
CHUNK_TEXT = 1_000_000
SPREAD = 1 << 36
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of the texts: features (n-grams x positions), bounds of the texts, letters of each text.

    Texts are lower-cased; everything but letters counts as a space, and a space stands before and after each text.
    """
    joined = "".join([" " + (t or "").lower() + "  " for t in texts])
    lens = np.fromiter((len((t or "").lower()) + 3 for t in texts), np.int64, len(texts))
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    known = letters()[points]
    points = np.where(known, points, 32).astype(np.uint32)
    bounds = np.concatenate([[0], np.cumsum(lens)])
    found = np.concatenate([[0], np.cumsum(known)])[bounds]
    out = np.zeros((len(ORDERS), len(points)), np.uint16 if FEATURE_BITS <= 16 else np.uint32)
    h = np.full(len(points), 0x811C9DC5, np.uint32)
    for k in range(max(ORDERS)):
        moved = points if not k else np.concatenate([points[k:], np.full(k, 32, np.uint32)])
        for j in range(1, k + 1):
            moved[bounds[1:] - j] = 32  # never a letter of the next text
        h = (h ^ moved) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if k + 1 in ORDERS:
            out[ORDERS.index(k + 1)] = (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - FEATURE_BITS)
    return out, bounds, np.diff(found)


@dataclass(frozen=True)
class Model:
    """weights: features x languages, already times the inverse document frequency; scores are divided by temperature."""

    languages: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the languages for each text, and how many letters it has."""
        found, bounds, n_letters = grams(texts)
        total = np.zeros((len(texts), len(self.languages)))
        for row in found:
            total += np.add.reduceat(self.weights[row], bounds[:-1], axis=0, dtype=np.float64)
        total /= (np.diff(bounds) * len(ORDERS))[:, None]
        return softmax((total + self.bias) / self.temperature), n_letters


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, scale: float = 30.0, idf: np.ndarray | None = None) -> Model:
    """Train with FTRL-Proximal (McMahan et al., 2013) under elastic-net penalties, then fit the temperature.

    The value of a feature is scale x its share of the text's n-grams x its inverse document frequency: `idf`,
    or that of the given texts. Every fifth text is kept out of training; the temperature is the one under which those
    have the least log loss.
    """
    languages = tuple(sorted(set(labels)))
    target = np.array([languages.index(x) for x in labels])
    size, k = 1 << FEATURE_BITS, len(languages)
    rows = []
    for text in texts:
        found, _, _ = grams([text])
        rows.append(np.unique(found, return_counts=True))
    if idf is None:
        df = np.bincount(np.concatenate([f for f, _ in rows]), minlength=size)
        idf = np.log((1 + len(rows)) / (1 + df)) + 1
    values = [scale * c / c.sum() * idf[f] for f, c in rows]
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 10 * k else np.zeros(len(rows), bool)
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in np.flatnonzero(~held).tolist():
            f, x = np.append(rows[i][0].astype(np.int64), size), np.append(values[i], 1.0)
            w = weights(z[f], n[f])
            p = softmax((x @ w)[None])[0]
            p[target[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - sigma * w
            n[f] += g * g
    w = weights(z, n)
    model = Model(languages, (w[:size] * idf[:, None] * scale).astype(np.float32), w[size], 1.0)
    best = 1.0
    if held.any():
        kept = np.flatnonzero(held)
        raw = np.array([values[i] @ w[rows[i][0].astype(np.int64)] + w[size] for i in kept])
        loss = lambda t: -np.log(softmax(raw / t)[np.arange(len(kept)), target[kept]] + 1e-300).mean()
        best = min(np.exp(np.linspace(np.log(0.05), np.log(20), 121)), key=loss)
    return Model(model.languages, model.weights, model.bias, float(best))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many of the texts hold each hashed n-gram, and how many texts there are; one column, every row counted.

    Each task adds up its texts; the sums, at most 2**FEATURE_BITS a task, are added by Spark, and so many reach the
    driver.
    """
    size = 1 << FEATURE_BITS
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(size, np.int64), 0
        for batch in sized(batches, 0, CHUNK_TEXT):
            for a in range(0, batch.num_rows, 128):
                part = batch.column(0).slice(a, 128).to_pylist()
                found, bounds, _ = grams(part)
                held = np.zeros((len(part), size), bool)
                owner = np.repeat(np.arange(len(part)), np.diff(bounds))
                for row in found:
                    held[owner, row] = True
                total += held.sum(axis=0)
                rows += len(part)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], names=["feature", "n"])

    sums = texts.mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(size), 0
    for r in sums:
        if r["feature"] < 0:
            n = r["n"]
        else:
            df[r["feature"]] = r["n"]
    return df, n


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample: of each language the `per_language` rows of least hash that are not held out.

    docs: doc_id, text, lang, of at most MOST_LANGUAGES languages (more are refused). Document frequencies are counted
    over all rows that may be learned from. One task trains, on whole texts: of each language as many of its sampled
    rows, in the order of the hash, as begin within its equal part of `sample_bytes`; the driver gets the weights,
    2**FEATURE_BITS x languages floats.
    """
    mine = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(SPREAD))
    counts = mine.groupBy("lang").agg(F.count("*").alias("rows"))
    languages = counts.count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not languages:
        return Model((), np.zeros((0, 0), np.float32), np.zeros(0), 1.0)
    df, n = document_frequencies(mine.select("text"))
    idf = docs.sparkSession.sparkContext.broadcast(np.log((1 + n) / (1 + df)) + 1)
    # Twice the share that is wanted surely holds the rows of least hash, and is all that is ranked.
    ranked = mine.select("doc_id", "lang", place.alias("h")).join(F.broadcast(counts), "lang").where(F.col("h").cast("double") * F.col("rows") < 2.0 * per_language * SPREAD)
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    picked = ranked.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("doc_id").distinct()
    sample = mine.join(F.broadcast(picked), "doc_id", "left_semi")  # at most per_language rows for each language
    sample = sample.select("doc_id", place.alias("h"), "text", "lang").where("text is not null")
    upto = Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("text")).over(upto), F.lit(0))
    sample = sample.withColumn("before", before).where(F.col("before") < sample_bytes // languages).drop("before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        rows = sorted((r for r in rows if r["text"]), key=lambda r: (r["h"], r["doc_id"] or 0, r["text"]))
        if rows:
            m = fit([r["text"] for r in rows], [r["lang"] for r in rows], idf=idf.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(m.languages)]), pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias.tolist()], pa.list_(pa.float64())), pa.array([m.temperature])],
                names=["languages", "weights", "bias", "temperature"],
            )

    schema = "languages array<string>, weights binary, bias array<double>, temperature double"
    got = sample.repartition(1).mapInArrow(run, schema).collect()
    if not got:
        return Model((), np.zeros((0, 0), np.float32), np.zeros(0), 1.0)
    m = got[0]
    return Model(tuple(m["languages"]), np.frombuffer(m["weights"], np.float32).reshape(1 << FEATURE_BITS, -1), np.array(m["bias"]), m["temperature"])


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The kept columns with lang_pred and score, from nothing but the whole text.

    score is the calibrated probability of lang_pred. Defined results: a text that is null or has no letter gets
    `und` and 0.0, as does every text under a model without languages; ties go to the language first by name;
    repeated rows are kept; an empty table gives no rows; kept columns named lang_pred or score are refused.
    """
    if {"lang_pred", "score"} & set(keep):
        raise ValueError("lang_pred and score are added")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spare = [c for c in keep if c != "text"]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema) + "lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in sized(batches, len(spare), CHUNK_TEXT):
            part = batch.column(len(spare)).to_pylist()
            if m.languages:
                p, n_letters = m.scores(part)
                known = pa.array(n_letters > 0)
                best = p.argmax(axis=1)
                lang = pc.if_else(known, pa.array(m.languages).take(pa.array(best)), UNKNOWN)
                score = pc.if_else(known, pa.array(p[np.arange(len(part)), best]), 0.0)
            else:
                lang, score = pa.array([UNKNOWN] * len(part)), pa.array([0.0] * len(part))
            cols = [batch.column(spare.index(c) if c in spare else len(spare)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, lang, score], names=[*keep, "lang_pred", "score"])

    return docs.select(*spare, "text").mapInArrow(run, schema)


def in_known_language(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The documents whose text is in one of the model's languages with at least `least_score`; all columns kept."""
    kept = docs.columns
    if {"lang_pred", "score"} & set(kept):
        docs = docs.withColumnsRenamed({"lang_pred": "__lang_pred", "score": "__score"})
    out = predict(docs, model, docs.columns).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).drop("lang_pred", "score")
    return out.withColumnsRenamed({"__lang_pred": "lang_pred", "__score": "score"}).select(*kept)
