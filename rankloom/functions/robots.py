"""robots.txt verdicts for crawlers that gather training data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.functions.urls import domain_key

# Names of such crawlers, and the two line patterns.
BOTS = ["GPTBot", "CCBot", "OAI-SearchBot", "anthropic-ai", "ClaudeBot"]
DISALLOW = r"(?i)^Disallow\s*:\s*(.+)$"
AGENT = r"(?i)^User-agent\s*:\s*(.+)$"


def verdicts(robots: DataFrame) -> DataFrame:
    """domain, permitted for (domain, content).

    Successive User-agent lines open a group, any other line ends the run, a blank line ends the group. A domain is
    not permitted if a group that names `*` or a name holding one of BOTS disallows `/` or `*`. Lines become rows,
    and groups the running count of their openings, so the parser is a window and two aggregates.
    """
    lines = robots.select("domain", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\r\n|\r|\n")).alias("pos", "raw"))
    line = F.regexp_replace("raw", r"^\s+|\s+$", "")
    lines = lines.select("domain", "pos", line.alias("line"))
    lines = lines.withColumns({"agent": F.regexp_extract("line", AGENT, 1), "rule": F.regexp_extract("line", DISALLOW, 1)})
    lines = lines.withColumns({"is_agent": F.col("agent") != "", "blank": F.col("line") == ""})
    order = Window.partitionBy("domain").orderBy("pos")
    opens = F.col("blank") | (F.col("is_agent") & ~F.coalesce(F.lag("is_agent").over(order), F.lit(False)))
    lines = lines.withColumn("grp", F.sum(opens.cast("int")).over(order))
    name = F.trim(F.lower("agent"))
    named = F.lit(False)
    for bot in BOTS:
        named = named | F.contains(name, F.lit(bot.lower()))
    hit = F.col("is_agent") & (named | (name == "*"))
    stops = F.trim("rule").isin("/", "*")
    groups = lines.groupBy("domain", "grp").agg((F.max(hit.cast("int")) * F.max(F.coalesce(stops, F.lit(False)).cast("int"))).alias("blocked"))
    return groups.groupBy("domain").agg((F.max("blocked") == 0).alias("permitted"))


def gate(urls: DataFrame, robots: DataFrame | None, url: str = "url") -> DataFrame:
    """The urls whose domain's robots.txt permits; domains without one are permitted."""
    if robots is None:
        return urls
    barred = verdicts(robots).where("not permitted").select(F.col("domain").alias("__domain"))
    return urls.withColumn("__domain", domain_key(F.col(url))).join(barred, "__domain", "left_anti").drop("__domain")


def fetch(domains: DataFrame, timeout: float = 5.0) -> DataFrame:
    """(domain) -> (domain, content): robots.txt over HTTP; content is null, hence permitting, after any error.

    Domains are distinct first, so each is asked once; meant to fill a stored table, not to stand in a query.
    """
    import pandas as pd

    def run(frames):
        from urllib.request import urlopen

        for frame in frames:
            texts = []
            for d in frame["domain"]:
                try:
                    with urlopen(f"{d}/robots.txt", timeout=timeout) as r:
                        texts.append(r.read().decode("utf-8", "replace"))
                except Exception:
                    texts.append(None)
            yield pd.DataFrame({"domain": frame["domain"], "content": texts})

    return domains.select("domain").distinct().mapInPandas(run, "domain string, content string")
