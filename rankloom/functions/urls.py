"""Quality signals of urls as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scores of top-level domains and of known hosts, defaults, and patterns.
TLD_SCORES = {
    "edu": 1.00, "gov": 1.00, "mil": 0.90, "ac.uk": 0.95, "ac.jp": 0.90, "org": 0.75, "int": 0.85, "com": 0.45,
    "net": 0.40, "co.uk": 0.42, "io": 0.35, "ai": 0.35, "info": 0.25, "biz": 0.15, "xyz": 0.10, "club": 0.08,
}
TLD_DEFAULT = 0.20
REPUTATION = {
    "arxiv.org": 1.00, "pubmed.ncbi.nlm.nih.gov": 1.00, "scholar.google.com": 0.95, "semanticscholar.org": 0.95,
    "researchgate.net": 0.85, "jstor.org": 0.90, "nature.com": 0.95, "sciencedirect.com": 0.90, "acm.org": 0.92,
    "ieee.org": 0.92, "mit.edu": 1.00, "stanford.edu": 1.00, "berkeley.edu": 1.00, "oxford.ac.uk": 1.00,
    "cambridge.org": 0.95, "en.wikipedia.org": 0.90, "britannica.com": 0.88, "nih.gov": 1.00, "cdc.gov": 0.98,
    "nasa.gov": 0.98, "who.int": 0.97, "openai.com": 0.80, "anthropic.com": 0.80, "deepmind.com": 0.80,
    "huggingface.co": 0.78, "reuters.com": 0.80, "bbc.co.uk": 0.80, "theguardian.com": 0.72, "medium.com": 0.45,
    "substack.com": 0.42, "github.com": 0.70, "stackoverflow.com": 0.72, "nytimes.com": 0.72, "cnn.com": 0.70,
    "washingtonpost.com": 0.78, "python.org": 0.85, "docs.python.org": 0.85, "news.ycombinator.com": 0.65,
}
REPUTATION_DEFAULT = 0.30
HIGH_TYPE = r"(?i)(/paper|/abstract|/article|/wiki/|/research|/publication|/journal|/preprint|/pdf|\.pdf$|/docs?/|/documentation|/report|/whitepaper)"
LOW_TYPE = r"(?i)(/ad|/ads/|/click|/redirect|/track|/affiliate|/promo|/coupon|/download-now|/sign-up|/subscribe\?|/checkout|/cart)"
DIRTY = r"(?i)(utm_|sessionid|PHPSESSID|ref=|fbclid|gclid|affiliate)"
COMPOSITE = {"reputation": 0.30, "tld_score": 0.25, "depth": 0.20, "cleanliness": 0.15, "content_prior": 0.10}
SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"


def host(url: Column) -> Column:
    """Lower-cased host without port and user; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), SCHEME + r"(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), SCHEME + r"[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def query(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)


def domain_key(url: Column) -> Column:
    """scheme://netloc, with the port, as robots.txt is looked up by."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)


def bare_domain(host_: Column) -> Column:
    """The last two labels of a host of three or more, else the host."""
    return F.when(F.size(F.split(host_, r"\.")) > 2, F.substring_index(host_, ".", -2)).otherwise(host_)


def lookup(table: dict[str, float], key: Column) -> Column:
    """A fixed table as a map literal: null for unknown keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def tld(host_: Column) -> Column:
    """The last two labels if the host has three or more and they are a known domain, else the last."""
    two = F.substring_index(host_, ".", -2)
    known = F.array_contains(F.lit(list(TLD_SCORES)), two)
    return F.when((F.size(F.split(host_, r"\.")) >= 3) & known, two).otherwise(F.substring_index(host_, ".", -1))


def tld_score(host_: Column) -> Column:
    return F.coalesce(lookup(TLD_SCORES, tld(host_)), F.lit(TLD_DEFAULT))


def reputation(host_: Column) -> Column:
    return F.coalesce(lookup(REPUTATION, host_), lookup(REPUTATION, bare_domain(host_)), F.lit(REPUTATION_DEFAULT))


def depth(path_: Column) -> Column:
    """exp(-0.35 x (non-empty segments - 1)), at most 1."""
    segments = F.size(F.filter(F.split(path_, "/"), lambda x: x != ""))
    return F.exp(-0.35 * F.greatest(F.lit(0), segments - 1))


def cleanliness(url: Column, query_: Column) -> Column:
    off = F.when(query_.rlike(DIRTY), 0.35).otherwise(0.0) + F.when(F.length(url) > 200, 0.25).otherwise(0.0) + F.when(F.length(query_) > 80, 0.20).otherwise(0.0)
    return F.greatest(F.lit(0.0), 1.0 - off)


def content_prior(path_: Column) -> Column:
    """By the kind of page the path speaks of; host and query do not count."""
    return F.when(path_.rlike(HIGH_TYPE), 0.90).when(path_.rlike(LOW_TYPE), 0.05).otherwise(0.50)


def with_signals(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path, query and the five signals with their weighted sum `composite`."""
    u = F.col(url)
    out = df.withColumns({"host": host(u), "path": path(u), "query": query(u)})
    out = out.withColumns(
        {"tld_score": tld_score(F.col("host")), "reputation": reputation(F.col("host")), "depth": depth(F.col("path")), "cleanliness": cleanliness(u, F.col("query")), "content_prior": content_prior(F.col("path"))}
    )
    parts = [w * F.col(c) for c, w in COMPOSITE.items()]
    total = parts[0]
    for x in parts[1:]:
        total = total + x
    return out.withColumn("composite", total)


def rounded_signals(rows: DataFrame, url: str = "url", digits: int = 4) -> DataFrame:
    """The signals of `with_signals` as they are reported: url, tld_score, domain_reputation, url_depth_score,
    path_cleanliness, content_type_prior and composite to four digits."""
    names = {"tld_score": "tld_score", "reputation": "domain_reputation", "depth": "url_depth_score", "cleanliness": "path_cleanliness", "content_prior": "content_type_prior", "composite": "composite"}
    return rows.select(F.col(url).alias("url"), *[F.round(c, digits).alias(n) for c, n in names.items()])
