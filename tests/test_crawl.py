"""Url signals, robots.txt, heuristics."""

import math

import pytest
from pyspark.sql import functions as F

from rankloom.functions import robots, urls
from rankloom.operators import crawl
from rankloom.operators import experiments as ex

SIGNALS = {
    "https://arxiv.org/abs/1706.03762": (0.75, 1.00, math.exp(-0.35), 1.0, 0.50),
    "https://www.nytimes.com/section/technology": (0.45, 0.72, math.exp(-0.35), 1.0, 0.50),
    "https://en.wikipedia.org/wiki/PageRank": (0.75, 0.90, math.exp(-0.35), 1.0, 0.90),
    "https://oxford.ac.uk/": (0.95, 1.00, 1, 1.0, 0.50),
    "https://www.bbc.co.uk/news": (0.42, 0.30, 1, 1.0, 0.50),
    "http://ththre.example.com/fr/825?page=2&ref=x": (0.45, 0.30, math.exp(-0.35), 0.65, 0.50),
    "no url": (0.20, 0.30, 1, 1.0, 0.50),
}


def test_signals(spark):
    rows = urls.with_signals(spark.createDataFrame([(u,) for u in SIGNALS], "url string")).collect()
    for r in rows:
        assert (r["tld_score"], r["reputation"], r["depth"], r["cleanliness"], r["content_prior"]) == pytest.approx(SIGNALS[r["url"]]), r["url"]


ROBOTS = {
    "User-agent: GPTBot\nDisallow: /": False, "User-agent: *\nDisallow: /": False, "User-agent: GPTBot\nUser-agent: ClaudeBot\nDisallow: /": False, "User-agent: GPTBot\n\nDisallow: /": True,
    "User-agent: GPTBot\nDisallow: /private": True, "User-agent: Googlebot\nDisallow: /": True, "User-agent: GPTBot\nDisallow:": True,
    "User-agent: GPTBot\n# note\nUser-agent: Googlebot\nDisallow: /": True, "": True, "user-AGENT : xCCBOTx\r\ndisallow :  * ": False,
}


def test_robots(spark):
    rows = spark.createDataFrame([(str(i), c) for i, c in enumerate(ROBOTS)] + [("null", None)], "domain string, content string")
    got = {r["domain"]: r["permitted"] for r in robots.verdicts(rows).collect()}
    assert got == {str(i): v for i, v in enumerate(ROBOTS.values())} | {"null": True}


@pytest.fixture(scope="module")
def web(spark):
    pages = ["https://arxiv.org/", "https://a.com/x", "https://b.com/x/y", "https://spam.com/ad?utm_source=1"]
    links = [(pages[1], pages[0]), (pages[2], pages[0]), (pages[0], pages[1]), (pages[1], "https://out.org/")]
    ranks = list(zip(pages, [0.5, 0.2, 0.2, 0.01], strict=True))
    rules = [("https://b.com", "User-agent: *\nDisallow: /")]
    return crawl.Web(
        spark.createDataFrame([(p,) for p in pages], "url string"), spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame(ranks, "url string, score double"),
        spark.createDataFrame(rules, "domain string, content string"),
    )


def test_heuristics(web):
    for name, h in crawl.heuristics().items():
        rows = crawl.ranked(web, h).orderBy("rank").collect()
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert len(rows) == (3 if h.gated else 4), name
        if name != "H0_Random":
            assert rows[0]["url"] == "https://arxiv.org/" and rows[-1]["url"].startswith("https://spam"), name
        assert [r["url"] for r in crawl.ranked(web, h, 2).orderBy("rank").collect()] == [r["url"] for r in rows[:2]]


def test_prioritizer(web):
    rows = crawl.Prioritizer(web, check_robots=True).top_k(5).collect()
    assert len(rows) == 3 and rows[0]["reason"].startswith("robots.txt permits") and "very high" in rows[0]["reason"]
    assert crawl.Prioritizer(web).top_k(0).count() == 0 and "75%" in crawl.Prioritizer(web).policy()


def test_constant_signals(spark):
    from rankloom.functions.statistics import min_max

    rows = spark.range(3).withColumn("c", F.lit(2.0))
    assert min_max(rows, {"c": "n"}, 0.0).agg(F.sum("n")).first()[0] == 0.0
    assert min_max(rows, {"c": "n"}, 0.5).agg(F.sum("n")).first()[0] == 1.5


def test_experiments(web):
    assert ex.ablation(web, 3).count() == 5
    assert all(r["tau"] == pytest.approx(1.0) for r in ex.k_stability(web).collect())
    top = {r["heuristic"]: r for r in ex.head_to_head(web, 2).collect()}
    assert len(top) == 5 and top["H1_PurePageRank"]["precision"] == 0.5
    corr = {(r["a"], r["b"]): r["rho"] for r in ex.signal_correlation(web).collect()}
    assert len(corr) == 16 and corr["PageRank", "PageRank"] == pytest.approx(1.0)


def test_content_prior_reads_the_path_alone(spark):
    from rankloom.functions import urls

    want = {"https://research.example.com/": 0.5, "https://adobe.com/": 0.5, "https://x.com/research/a": 0.9, "https://x.com/ads/b": 0.05, "https://x.com/?u=/paper": 0.5, "https://x.com/a.pdf": 0.9}
    got = urls.with_signals(spark.createDataFrame([(u,) for u in want], "url string"))
    assert {r["url"]: r["content_prior"] for r in got.collect()} == want
