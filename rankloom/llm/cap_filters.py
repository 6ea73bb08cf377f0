"""Embedding near-dedup by spherical-cap filters from random product codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import components, partitions, small_batches, stored

BLOCKS = 2
BUCKET = 8
HITS = 24
LEAST_HITS = 12
ROWS_OF_BLOCK = 2048
ROWS_AT_ONCE = 20_000
LARGE = 128
MOST_BROADCAST = 100_000
MARGIN = 1e-3
PAIR, LINK, COUNT = 0, 1, 2


def blocks_of(dim: int) -> int:
    """Blocks of four dimensions at least: code words of fewer would be few."""
    return max(1, min(BLOCKS, dim // 4))


@dataclass(frozen=True)
class CapFilters:
    """Filters are unit vectors: one of `codes` code words from each block of a randomly rotated space, put together.

    A vector is in the cap of every filter whose inner product with it is at least `least`. There are about
    HITS / BUCKET filters for each vector to be indexed, and `least` is the height that a random vector exceeds for
    HITS of them, so a cap holds about BUCKET random vectors however many there are, while vectors at the asked
    cosine share most of theirs. The height is lowered for a vector that exceeds it for fewer than LEAST_HITS
    filters, as one whose blocks are of uneven length does; without that its whole neighbourhood could be missed.
    """

    dim: int
    codes: int
    least: float
    seed: int = 7

    @staticmethod
    def for_rows(dim: int, rows: int) -> CapFilters:
        blocks = blocks_of(dim)
        codes = max(4, math.ceil((max(rows, 256) * HITS / BUCKET) ** (1 / blocks)))
        share = min(0.5, HITS / codes**blocks)
        return CapFilters(dim, codes, NormalDist().inv_cdf(1 - share) / math.sqrt(dim))

    def tables(self) -> tuple[np.ndarray, list[np.ndarray], list[slice]]:
        return code_tables(self)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the numbers of the filters whose caps hold it."""
        rows, found = self.decoded(unit)
        return np.split(found, np.searchsorted(rows, np.arange(1, len(unit))))

    def decoded(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same as pairs (row, filter), rows ascending."""
        enough = min(LEAST_HITS, self.codes ** blocks_of(self.dim))
        parts, left, least = [], np.arange(len(unit)), self.least
        while len(left):
            rows, found = self.above(unit[left], least)
            done = np.bincount(rows, minlength=len(left)) >= enough
            own = done[rows]
            parts.append((left[rows[own]], found[own]))
            left, least = left[~done], least - 0.25 / math.sqrt(self.dim)
        none = np.zeros(0, np.int64)
        rows, found = (np.concatenate([none, *x]) for x in (zip(*parts, strict=True) if parts else ((), ())))
        order = np.argsort(rows, kind="stable")
        return rows[order], found[order]

    def exceeding(self, unit: np.ndarray, least: float) -> list[np.ndarray]:
        rows, found = self.above(unit, least)
        order = np.argsort(rows, kind="stable")
        return np.split(found[order], np.searchsorted(rows[order], np.arange(1, len(unit))))

    def above(self, unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, filter) of inner product `least` or more, without looking at the others.

        Codes of the first block that no code of the second could lift over the bound are dropped; for the others the
        second block's codes are taken from the best down, all rows at once, until they fall short.
        """
        turn, words, parts = self.tables()
        moved = unit @ turn
        scores = [moved[:, p] @ w.T for w, p in zip(words, parts, strict=True)]
        if len(scores) == 1:
            return np.nonzero(scores[0] >= least)
        one, two = scores
        rows, first = np.nonzero(one >= least - two.max(axis=1)[:, None])
        need = least - one[rows, first]
        few = int((two >= least - one.max(axis=1)[:, None]).sum(axis=1).max(initial=0))
        if not few:
            return rows[:0], first[:0]
        best = np.argpartition(-two, few - 1, axis=1)[:, :few] if few < two.shape[1] else np.tile(np.arange(few), (len(unit), 1))
        values = np.take_along_axis(two, best, axis=1)
        order = np.argsort(-values, axis=1)
        best, values = np.take_along_axis(best, order, axis=1), np.take_along_axis(values, order, axis=1)
        out_rows, out, alive = [rows[:0]], [first[:0]], np.arange(len(rows))
        for k in range(few):
            alive = alive[values[rows[alive], k] >= need[alive]]
            if not len(alive):
                break
            out_rows.append(rows[alive])
            out.append(first[alive] * self.codes + best[rows[alive], k])
        return np.concatenate(out_rows), np.concatenate(out)


@lru_cache(maxsize=8)
def code_tables(filters: CapFilters) -> tuple[np.ndarray, list[np.ndarray], list[slice]]:
    """The rotation, the code words of each block and the blocks' coordinates; kept, as all rows use them."""
    rng = np.random.default_rng(filters.seed + filters.dim)
    turn = np.linalg.qr(rng.standard_normal((filters.dim, filters.dim)))[0]
    blocks = blocks_of(filters.dim)
    edges = [filters.dim * i // blocks for i in range(blocks + 1)]
    words = []
    for a, b in zip(edges, edges[1:], strict=False):
        w = rng.standard_normal((filters.codes, b - a))
        words.append(w / np.linalg.norm(w, axis=1, keepdims=True) * math.sqrt((b - a) / filters.dim))
    return turn, words, [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def unit_rows(flat: np.ndarray) -> np.ndarray:
    x = flat.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rows_of(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors in 8-bit steps, and the angle by which each was turned."""
    q = np.rint(unit / np.abs(unit).max(axis=1, keepdims=True) * 127).astype(np.int8)
    f = q.astype(np.float64)
    cos = (f * unit).sum(axis=1) / np.sqrt((f * f).sum(axis=1))
    return q, np.arccos(np.clip(cos, -1, 1)) + 1e-6


def directions(q: np.ndarray) -> np.ndarray:
    f = q.astype(np.float32)
    return f / np.sqrt((f * f).sum(axis=1, keepdims=True))


def near_pairs(starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, q: np.ndarray, off: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs within small runs that can be within the angle; runs of one size are taken together."""
    f = directions(q)
    loose = math.cos(min(math.pi, angle + 2 * float(off.max(initial=0)) + MARGIN))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in np.unique(sizes[sizes > 1]).tolist():
        upper = np.triu(np.ones((m, m), bool), 1)
        of_size = starts[sizes == m]
        step = max(1, (4 << 20) // (m * max(m, f.shape[1])))
        for a in range(0, len(of_size), step):
            at = of_size[a : a + step, None] + np.arange(m)
            part = f[at]
            cos = part @ part.transpose(0, 2, 1)
            r, i, j = np.nonzero((cos >= loose) & upper)
            x, y = at[r, i], at[r, j]
            good = np.arccos(np.clip(cos[r, i, j], -1, 1)) <= angle + off[x] + off[y] + MARGIN
            left.append(x[good])
            right.append(y[good])
    return np.concatenate(left), np.concatenate(right)


def joined_roots(sure: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Least place reachable from each row and column of a table of links; columns count after rows unless they are the rows."""
    rows, cols = sure.shape
    a = np.arange(rows)
    b = a if same else rows + np.arange(cols)
    far = rows + cols
    while True:
        na = np.minimum(a, np.where(sure, b[None, :], far).min(axis=1, initial=far))
        nb = na if same else np.minimum(b, np.where(sure, na[:, None], far).min(axis=0, initial=far))
        if np.array_equal(na, a) and np.array_equal(nb, b):
            return a, b
        a, b = na, nb


def large_block(cap: int, side: np.ndarray, ids: np.ndarray, q: np.ndarray, off: np.ndarray, copies: np.ndarray, large: list[np.ndarray], angle: float) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """One block, or two blocks against each other, of a large cap: (kind, a, b, n) arrays; see `compared`.

    A pair belongs to the least large cap that holds both. Pairs whose 8-bit angle is within the bound whatever the
    rounding are only counted and joined; those that rounding leaves open are listed.
    """
    same = side.max() < 0
    mine = np.arange(len(ids)) if same else np.flatnonzero(side == side.min())
    other = mine if same else np.flatnonzero(side != side.min())
    f = directions(q)
    cos = f[mine] @ f[other].T
    most = 2 * float(off.max())
    maybe = cos >= math.cos(min(math.pi, angle + most + MARGIN))
    sure = cos >= math.cos(max(0.0, angle - most - MARGIN)) if angle > most + MARGIN else np.zeros_like(maybe)
    if same:
        np.fill_diagonal(maybe, False)
        np.fill_diagonal(sure, False)
    earlier = np.unique(np.concatenate([x[x < cap] for x in large]))
    if len(earlier):
        holds = np.zeros((len(ids), len(earlier)), np.float32)
        for i, x in enumerate(large):
            holds[i, np.searchsorted(earlier, x[x < cap])] = 1
        here = (holds[mine] @ holds[other].T) == 0
        maybe &= here
        sure &= here
    none = np.zeros(0, np.int64)
    i, j = np.nonzero(maybe & ~sure)
    x, y = mine[i], other[j]
    keep = np.arccos(np.clip(cos[i, j], -1, 1)) <= angle + off[x] + off[y] + MARGIN
    if same:
        keep &= x < y
    x, y = ids[x[keep]], ids[y[keep]]
    out = [(PAIR, np.minimum(x, y), np.maximum(x, y), np.zeros(len(x), np.int64))]
    counted = [(mine, sure @ copies[other])] + ([] if same else [(other, copies[mine] @ sure)])
    for at, n in counted:
        some = n > 0
        out.append((COUNT, ids[at[some]], np.zeros(int(some.sum()), np.int64), n[some].astype(np.int64)))
    a, b = joined_roots(sure, same)
    names = ids[mine] if same else np.concatenate([ids[mine], ids[other]])
    for at, roots, own in [(mine, a, np.arange(len(mine)))] + ([] if same else [(other, b, len(mine) + np.arange(len(other)))]):
        moved = roots != own
        out.append((LINK, ids[at[moved]], names[roots[moved]], np.zeros(int(moved.sum()), np.int64)))
    return [x for x in out if len(x[1])] or [(PAIR, none, none, none)]


def large_batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least so many rows but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def capped(reps: DataFrame, filters: CapFilters) -> DataFrame:
    """A row for each vector and cap that holds it: cap, id, copies, q (8-bit steps), off (the angle they are off by)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in large_batches(batches, 1024):
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                unit = unit_rows(rows_of(part.column(1)))
                q, off = quantised(unit)
                at, found = filters.decoded(unit)
                at = pa.array(at)
                codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(q.shape[1]), len(q), [None, pa.py_buffer(np.ascontiguousarray(q))]).cast(pa.binary())
                cols = [pa.array(found), part.column(0).take(at), part.column(2).take(at), codes.take(at), pa.array(off).take(at)]
                yield pa.RecordBatch.from_arrays(cols, names=["cap", "id", "copies", "q", "off"])

    return stored(reps.select("id", "v", "copies").mapInArrow(emit, "cap long, id long, copies long, q binary, off double"), "caps")


def compared(reps: DataFrame, filters: CapFilters, cosine: float) -> DataFrame:
    """What vectors that share a cap have to do with each other: rows (kind, a, b, n).

    reps: id, v (lists of the filters' dimension), copies. PAIR: a and b pass the 8-bit comparison, which loses no true
    pair, and are to be verified; LINK: a and b surely reach the bound; COUNT: a surely reaches it with n vectors more,
    copies counted, which are not listed. Pairs that share no cap of more than LARGE rows are listed. Larger caps
    (broadcast where they are at most MOST_BROADCAST) are dealt as pairs of blocks of ROWS_OF_BLOCK rows, so no task
    holds a whole cap, and a cluster of m vectors gives about m rows and not all its pairs.
    """
    angle = math.acos(cosine)
    rows = capped(reps, filters)
    hot = rows.groupBy("cap").agg(F.count("*").alias("n")).where(F.col("n") > LARGE)
    hot = stored(hot, "large")
    n_hot = hot.count()
    none = F.array().cast("array<bigint>")
    if not n_hot:
        rows_in = rows.withColumns({"n": F.lit(1).cast("long"), "large": none})
    else:
        few = F.broadcast(hot) if n_hot <= MOST_BROADCAST else hot
        of = rows.select("cap", "id").join(few, "cap").groupBy("id").agg(F.collect_list("cap").alias("large"))
        rows_in = rows.join(few, "cap", "left").join(of, "id", "left").withColumns({"n": F.coalesce("n", F.lit(1)), "large": F.coalesce("large", none)})
    rows_in = rows_in.withColumn("blocks", F.ceil(F.col("n") / ROWS_OF_BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("id", "cap"), F.col("blocks")).cast("int")
    pairs_of = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("mine"), o).alias("i"), F.greatest(F.col("mine"), o).alias("j")))
    dealt = rows_in.withColumn("mine", mine).withColumn("p", F.explode(pairs_of))
    side = F.when(F.col("p.i") == F.col("p.j"), F.lit(-1)).otherwise(F.col("mine"))
    dealt = dealt.select(F.xxhash64("cap", "p.i", "p.j").alias("key"), side.alias("side"), "cap", (F.col("n") > LARGE).alias("is_large"), "id", "copies", "q", "off", "large")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in with_last(large_batches(batches, ROWS_AT_ONCE)):
            table = held if batch is None else pa.concat_batches([held, batch]) if held is not None else batch
            held = None
            if table is None or not table.num_rows:
                continue
            keys = np.asarray(table.column("key"))
            whole = len(keys)
            if batch is not None:  # the last run may go on in the next batch
                whole = int(np.searchsorted(keys, keys[-1]))
                held = table.slice(whole)
            if whole:
                yield from outcome(table.slice(0, whole), keys[:whole], angle)

    n = partitions(reps.sparkSession)
    return dealt.repartition(n, "key").sortWithinPartitions("key", "cap").mapInArrow(compare, "kind int, a long, b long, n long")


def outcome(part: pa.RecordBatch, keys: np.ndarray, angle: float) -> Iterator[pa.RecordBatch]:
    """The rows of `compared` for whole runs of equal keys."""
    q = np.frombuffer(b"".join(part.column("q").to_pylist()), np.int8).reshape(len(keys), -1)
    ids, off, copies = np.asarray(part.column("id")), np.asarray(part.column("off")), np.asarray(part.column("copies"))
    caps, side, big = np.asarray(part.column("cap")), np.asarray(part.column("side")), part.column("is_large").to_numpy(zero_copy_only=False)
    lists = part.column("large")
    starts = np.concatenate([[0], np.flatnonzero((np.diff(keys) != 0) | (np.diff(caps) != 0)) + 1])
    sizes = np.diff(np.append(starts, len(keys)))
    small = ~big[starts]
    i, j = near_pairs(starts[small], sizes[small], ids, q, off, angle)
    if len(i) and len(lists.flatten()):
        counts = np.diff(np.asarray(lists.offsets))
        apart = np.ones(len(i), bool)
        for k in np.flatnonzero((counts[i] > 0) & (counts[j] > 0)).tolist():  # pairs that a large cap has too are its own
            apart[k] = not set(lists[int(i[k])].as_py()) & set(lists[int(j[k])].as_py())
        i, j = i[apart], j[apart]
    yield as_batch(PAIR, np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), np.zeros(len(i), np.int64))
    for s, m in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
        run = slice(s, s + m)
        large = [np.array(x, np.int64) for x in lists.slice(s, m).to_pylist()]
        if m > 1 and (side[run].max() < 0 or len(np.unique(side[run])) == 2):
            for kind, a, b, n in large_block(int(caps[s]), side[run], ids[run], q[run], off[run], copies[run], large, angle):
                yield as_batch(kind, a, b, n)


def as_batch(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(n)], names=["kind", "a", "b", "n"])


def with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(pairs: DataFrame, reps: DataFrame, cosine: float) -> DataFrame:
    """The pairs whose cosine, in double precision, reaches the bound."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x, y = (rows_of(part.column(c)).astype(np.float64) for c in ("va", "vb"))
                x, y = (z / np.abs(z).max(axis=1, keepdims=True) for z in (x, y))
                cos = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                yield part.select(["a", "b"]).filter(pa.array(cos >= cosine))

    joined = pairs.join(reps.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(reps.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    return joined.select("a", "b", "va", "vb").mapInArrow(verify, "a long, b long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """Links between vectors of at least `cosine`: vec_id, n_links, component_id, kept.

    vectors: vec_id, embedding. Equal vectors are one representative, the smallest id, with a count, so copies are
    never paired; representatives are indexed all, by caps, and compared where they share one. No pair below the bound
    is linked; of those above, a small part shares no cap and is missed (recall is measured in the tests). Pairs whose
    8-bit codes cannot tell are verified in double precision; those of a large cap that surely link are counted where
    they are met, not listed.
    Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    vectors of different lengths are not compared; a repeated row is a vector of its own; rows with a null id are
    returned, each linked with nothing; an empty table gives no rows; other columns are ignored.
    """
    small_batches(vectors.sparkSession)
    v = F.col("embedding")
    clean = F.coalesce(
        (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False)
    )
    rows = vectors.select(F.col("vec_id").cast("long"), F.transform(v, lambda x: x.cast("double") + 0.0).alias("v"), clean.alias("clean"))
    key = [F.xxhash64(F.lit(s), "v", F.size("v")).alias(f"k{s}") for s in (1, 2)]
    rows = rows.select("vec_id", F.when(F.col("clean"), F.col("v")).alias("v"), "clean", *key)
    classes = rows.where("clean").groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = stored(classes, "classes")
    reps = rows.where("clean").join(classes, (rows["vec_id"] == classes["id"]) & (rows["k1"] == classes["k1"]) & (rows["k2"] == classes["k2"]))
    reps = stored(reps.select("id", "v", "copies").dropDuplicates(["id", "copies"]), "reps")
    found = None
    for dim, n in sorted((r["d"], r["n"]) for r in reps.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()):
        mine = reps.where(F.size("v") == dim)
        seen = stored(compared(mine, CapFilters.for_rows(dim, n), cosine), "compared")
        near = links(seen.where(F.col("kind") == PAIR).select("a", "b").distinct(), mine, cosine).withColumn("n", F.lit(0).cast("long"))
        part = near.withColumn("kind", F.lit(PAIR)).unionByName(seen.where(F.col("kind") != PAIR))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = reps.select(F.lit(PAIR).alias("kind"), F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).cast("long").alias("n")).limit(0)
    found = stored(found, "links")
    pairs = found.where(F.col("kind") == PAIR).select("a", "b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    listed = both.join(reps.select(F.col("id").alias("b"), "copies"), "b").select(F.col("a").alias("id"), F.col("copies").alias("n"))
    counted = found.where(F.col("kind") == COUNT).select(F.col("a").alias("id"), "n")
    degree = listed.unionByName(counted).groupBy("id").agg(F.sum("n").alias("others"))
    parts = components(found.where(F.col("kind") != COUNT).select("a", "b")).select(F.col("node").alias("id"), "component")
    about = classes.join(degree, "id", "left").join(parts, "id", "left")
    about = about.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c"))
    out = rows.select("vec_id", "k1", "k2", "clean").join(about.withColumn("clean", F.lit(True)), ["k1", "k2", "clean"], "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
