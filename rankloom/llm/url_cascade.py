"""URL filters: a cascade of Bloom filters that gives exact rule membership without joins."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import stored

NEXT_RATE = 0.01
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url column; both empty when it is null or holds no `://`."""
    url = F.coalesce(url, F.lit(""))
    rest = r"(?s)^.*?://"
    host = F.regexp_extract(url, rest + r"([^/?#]*)", 1)
    path = F.regexp_extract(url, rest + r"[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def keys_of(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """All keys a rule could have and fit this url: each label suffix of the host with each prefix of the path.

    Only prefixes as long as some rule's path matter. The longest key comes first.
    """
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(path_lengths), reverse=True)]
    prefixes = F.filter(F.array(*cuts), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: `words` are its bits in 64-bit words, `hashes` the number of probes, `seed` their salt."""

    words: tuple[int, ...]
    hashes: int
    seed: int

    def holds(self, key: Column) -> Column:
        bits = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")  # folded to one literal by the optimizer
        return F.forall(F.array(*places(key, len(self.words) * 64, self.hashes, self.seed)), lambda p: bit(bits, p))


def bit(words: Column, place: Column) -> Column:
    word = F.element_at(words, (F.shiftright(place, 6) + 1).cast("int"))
    return F.lit(1).cast("long").bitwiseAND(F.call_function("shiftrightunsigned", word, F.pmod(place, F.lit(64)).cast("int"))) != 0


def places(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed * 1000 + i), key), F.lit(bits).cast("long")) for i in range(hashes)]


def level(keys: DataFrame, n: int, fpp: float, seed: int) -> Level:
    """Bloom filter of a table with one string column `key` and about n keys; its size follows n and fpp alone."""
    bits = max(64, math.ceil(n * -math.log(fpp) / math.log(2) ** 2 / 64) * 64)
    hashes = max(1, min(16, round(bits / max(n, 1) * math.log(2))))
    place = F.explode(F.array(*places(F.col("key"), bits, hashes, seed)))
    words = (
        keys.select(place.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
    )
    held = dict(words.collect())  # at most bits / 64 rows
    return Level(tuple(held.get(i, 0) for i in range(bits // 64)), hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def holds(self, key: Column) -> Column:
        """True for listed keys; exact for every key of the universe that the cascade was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i, one in reversed(list(enumerate(self.levels))):
            out = F.when(~one.holds(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def cascade(listed: DataFrame, universe: DataFrame, n_listed: int, n_universe: int, max_levels: int = 40) -> Cascade:
    """Cascade for the keys of `listed` within `universe` (each one column `key`).

    Level 0 encodes the listed keys at a rate of n_listed / n_universe, so that about as many other keys of the
    universe pass as are listed; level 1 encodes those, level 2 the listed keys that level 1 wrongly holds, and so
    on until nothing passes. The universe is read once; sizes follow the number of listed keys. A level that holds
    wrongly even its whole input is built again with another salt. Keys stay in tables; the driver gets the finished
    filters, whose bits follow the number of keys of each level (about 1.44 log2(n_universe / n_listed) bits for each
    listed key in level 0, 1.44 log2(1 / NEXT_RATE) for each key after that).
    """
    if not n_listed:
        return Cascade([])
    fpp = min(0.5, max(n_listed, 1) * math.sqrt(0.5) / max(n_universe, 1))
    levels = [level(listed, n_listed, fpp, 1)]
    inside = listed.select("key").distinct()
    passed = universe.where(levels[0].holds(F.col("key"))).select("key").distinct()
    sides = [(inside, n_listed), kept_keys(passed.join(inside, "key", "left_anti"))]
    for i in range(1, max_levels):
        mine, n = sides[i % 2]
        if not n:
            break
        one = level(mine, n, NEXT_RATE, i + 1)
        levels.append(one)
        other = sides[1 - i % 2][0]
        sides[1 - i % 2] = kept_keys(other.where(one.holds(F.col("key"))))
    else:
        raise RuntimeError("the cascade did not end")
    return Cascade(levels)


def kept_keys(keys: DataFrame) -> tuple[DataFrame, int]:
    """The keys as a written table, and how many they are."""
    out = stored(keys, "keys")
    return out, out.count()


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Rules as (verdict, key, n): the key is host and path, n the length of the path."""
    if not isinstance(rules, DataFrame):
        kind = "array<struct<verdict:string,host:string,path:string>>"
        text = json.dumps([{"verdict": v, "host": h, "path": p} for v, h, p in rules])
        rules = spark.range(1).select(F.explode(F.from_json(F.lit(text), kind)).alias("r")).select("r.*")
    return rules.where("host is not null and path is not null").select("verdict", F.concat("host", "path").alias("key"), F.length("path").alias("n"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to a table of urls.

    rules: (verdict, host, path prefix), as a list or a table of these columns. A rule fits its host and all
    subdomains; of those that fit, the longest wins. One cascade over the corpus's complete key universe tells which
    keys are rules, a second which of the rules block; a url without a rule gets `default`. Defined results: a null
    url or one without `://` has an empty host and path; a path shorter than every rule's has no keys; with no rules
    or an empty table every verdict is `default`; a key that is listed with both verdicts blocks, repeated rules count
    once, rules with a null are left out; repeated urls are judged alike; other columns pass through, and columns
    named host, path, rule or verdict are replaced.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    listed = stored(rule_table(spark, rules).distinct(), "rules")
    lengths = sorted(r["n"] for r in listed.select("n").distinct().collect())  # one row for each length of a path
    plain = pages.drop("rule", "verdict").withColumns({"host": host, "path": path})
    if not lengths:
        return plain.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keyed = pages.select(F.explode(keys_of(host, path, lengths)).alias("key"))
    keys = listed.select("key").distinct()
    blocked = listed.where("verdict = 'block'").select("key").distinct()
    n = keys.count()
    fits = cascade(keys, keyed, n, max(1, keyed.count()))
    blocks = cascade(blocked, keys, blocked.count(), n)
    found = F.filter(keys_of(F.col("host"), F.col("path"), lengths), fits.holds)
    longest = F.array_max(F.transform(found, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))
    # One row for one row: a generated column is computed once, wherever later filters and columns refer to it.
    once = lambda c, name: F.explode(F.array(c)).alias(name)
    out = plain.select("*", once(longest["k"], "rule"))
    verdict = F.when(F.col("rule").isNull(), default).when(blocks.holds(F.col("rule")), "block").otherwise("allow")
    return out.select("*", once(verdict, "verdict"))
