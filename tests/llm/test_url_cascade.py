import random

import pytest
from pyspark.sql import functions as F

from rankloom.llm import url_cascade as uc
from rankloom.llm.queries import RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]


def plain(url, rules, default="allow"):
    host, path = split(url)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else default


URLS = [
    None, "", "no scheme/x", "http://www.EXAMPLE.com/en/1", "http://example.com/en/", "http://a.b.example.com/en/x?q#f", "http://example.com/de/", "http://x.net/es/1", "http://net/es/", "http://xnet/es/", "http://www.example.com/en",
    "ftp://y.org/fr/", "http://com/", "http://com", "http://É.com/ö", "http://h.com:80/", "http://u@h.com/", "a://b://c/d", "http:///en/", "http://x.net?/es/", "http://.com/", "http://example.com./en/", "http://line\nbreak.com/x", "http://x.net/fr/" + "y" * 50_000,
]


def test_rules(spark):
    frame = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS)] + [(3, URLS[3], "again")], "page_id long, url string, rule string")
    for r in uc.judge(frame, RULES).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(r["url"], RULES), r["url"]


def test_no_rules_and_no_pages(spark):
    frame = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert uc.judge(frame, []).first()["verdict"] == "allow"
    assert uc.judge(frame.limit(0), RULES).count() == 0
    assert uc.judge(frame, [("allow", "a.com", "/")], default="block").first()["verdict"] == "allow"


@pytest.mark.parametrize("n", [1, 40, 400])
def test_cascade_is_exact_over_its_universe(spark, n):
    keys = [f"k{i}" for i in range(4000)]
    listed = set(random.Random(n).sample(keys, n))
    frame = lambda x: spark.createDataFrame([(k,) for k in x], "key string")
    c = uc.cascade(frame(sorted(listed)), frame(keys), n, len(keys))
    got = {r["key"] for r in frame(keys).where(c.holds(F.col("key"))).collect()}
    assert got == listed
    assert sum(len(x.words) for x in c.levels) * 64 < 40 * n + 64 * 40  # follows the list, not the universe


def test_long_rule_lists(spark):
    """A million rules as a table, a third of the urls on one host; every verdict against a plain look-up."""
    n = 1_000_000
    rules = spark.range(n).select(F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("verdict"), F.concat(F.lit("h"), F.col("id"), F.lit(".com")).alias("host"), F.lit("/").alias("path"))
    number = F.when(F.col("id") % 3 == 0, F.lit(4)).otherwise(F.col("id") * 7)
    pages = spark.range(60_000).select(number.alias("page_id"), F.concat(F.lit("https://a.h"), number, F.lit(".com/x")).alias("url"))
    out = uc.judge(pages, rules)
    wrong = out.where(f"case when page_id < {n} then not (rule <=> concat('h', page_id, '.com/')) or (verdict = 'block') <> (page_id % 2 = 0) else rule is not null or verdict <> 'allow' end")
    assert out.count() == 60_000 and wrong.count() == 0


def test_rules_that_disagree(spark):
    frame = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.com/")], "page_id long, url string")
    rules = [("allow", "a.com", "/"), ("block", "a.com", "/"), ("block", "a.com", "/"), ("allow", "b.com", None), ("block", None, "/")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in uc.judge(frame, rules).collect()}
    assert got == {1: ("a.com/", "block"), 2: (None, "allow")}
