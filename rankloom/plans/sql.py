"""DuckDB SQL for iterated scores: each iteration is one more common table."""

from __future__ import annotations

from rankloom.functions import urls
from rankloom.functions.robots import BOTS
from rankloom.plans.tables import ROBOTS, WEB, quoted


def graph(edges: str, nodes: str | None = None) -> list[str]:
    """e, n (id), cnt (n), t (src, dst, w), d (dangling ids)."""
    nodes = nodes or "SELECT src AS id FROM e UNION SELECT dst FROM e"
    return [
        f"e AS MATERIALIZED ({edges})",
        f"n AS MATERIALIZED ({nodes})",
        "cnt AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM n)",
        "t AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE / (sum(count(*)) OVER (PARTITION BY src))::DOUBLE AS w FROM e GROUP BY src, dst)",
        "d AS MATERIALIZED (SELECT id FROM n WHERE id NOT IN (SELECT src FROM e))",
    ]


def iterate(name: str, k: int, p: float, v: str | None = None, t: str = "t", d: str = "d") -> list[str]:
    """Tables name0 .. name{k} of (id, s); v: a table (id, v) to restart at, its own start too."""
    out = [f"{name}0 AS MATERIALIZED (SELECT id, {'v' if v else '1.0::DOUBLE / (SELECT n FROM cnt)'} AS s FROM {v or 'n'})"]
    for i in range(k):
        back = f"{p}::DOUBLE * n.v" if v else f"{p}::DOUBLE / (SELECT n FROM cnt)"
        out.append(
            f"{name}{i + 1} AS MATERIALIZED (SELECT n.id, (1 - {p}::DOUBLE) * (coalesce(y.y, 0) + coalesce((SELECT sum(r.s) FROM {name}{i} r JOIN {d} x ON x.id = r.id), 0) / (SELECT n FROM cnt)) + {back} AS s "
            f"FROM {v or 'n'} n LEFT JOIN (SELECT t.dst AS id, sum(t.w * r.s) AS y FROM {t} t JOIN {name}{i} r ON r.id = t.src GROUP BY t.dst) y ON y.id = n.id)"
        )
    return out


def residuals(name: str, k: int) -> str:
    return "tr AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {i + 1} AS iter, (SELECT sum(abs(a.s - b.s)) FROM {name}{i} a JOIN {name}{i + 1} b USING (id)) AS residual" for i in range(k)) + ")"


def with_(tables: list[str], select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(tables) + "\n" + select


def values(table: dict[str, float]) -> str:
    return ", ".join(f"({quoted(k)}, {v}::DOUBLE)" for k, v in table.items())


def signals(source: str) -> list[str]:
    """Table sig: the rows of `source` (with url) and their signals."""
    return [
        f"tlds(t, ts) AS (VALUES {values(urls.TLD_SCORES)})",
        f"reps(h, rs) AS (VALUES {values(urls.REPUTATION)})",
        f"""parts AS (SELECT *, lower(regexp_extract(url, '{urls.SCHEME}(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    coalesce(nullif(regexp_extract(url, '{urls.SCHEME}[^/?#]*([^?#]*)', 1), ''), '/') AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query FROM {source})""",
        """labels_ AS (SELECT *, string_split(host, '.') AS l FROM parts)""",
        """two AS (SELECT *, CASE WHEN len(l) > 1 THEN l[-2] || '.' || l[-1] ELSE host END AS last2, l[-1] AS last1 FROM labels_)""",
        f"""sig AS MATERIALIZED (SELECT *, reputation * 0.30::DOUBLE + tld_score * 0.25::DOUBLE + depth * 0.20::DOUBLE + cleanliness * 0.15::DOUBLE + content_prior * 0.10::DOUBLE AS composite FROM (
    SELECT two.* EXCLUDE (l, last2, last1),
      coalesce(CASE WHEN len(l) >= 3 THEN a.ts END, b.ts, 0.20::DOUBLE) AS tld_score,
      coalesce(c.rs, CASE WHEN len(l) > 2 THEN f.rs END, 0.30::DOUBLE) AS reputation,
      exp(-0.35::DOUBLE * greatest(0, len(list_filter(string_split(path, '/'), lambda x: x <> '')) - 1)) AS depth,
      greatest(0.0::DOUBLE, 1.0::DOUBLE - (CASE WHEN regexp_matches(query, {quoted(urls.DIRTY)}) THEN 0.35::DOUBLE ELSE 0 END
        + CASE WHEN length(url) > 200 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN length(query) > 80 THEN 0.20::DOUBLE ELSE 0 END)) AS cleanliness,
      CASE WHEN regexp_matches(path, {quoted(urls.HIGH_TYPE)}) THEN 0.90::DOUBLE WHEN regexp_matches(path, {quoted(urls.LOW_TYPE)}) THEN 0.05::DOUBLE ELSE 0.50::DOUBLE END AS content_prior
    FROM two LEFT JOIN tlds a ON a.t = last2 LEFT JOIN tlds b ON b.t = last1 LEFT JOIN reps c ON c.h = host LEFT JOIN reps f ON f.h = last2))""",
    ]


def robots() -> list[str]:
    """Table rob (domain, permitted)."""
    rows = ", ".join(f"({quoted(d)}, {quoted(c)})" for d, c in ROBOTS).replace("\n", "\\n")
    rows = rows.replace("'" + "User", "E'User")
    bots = " OR ".join(f"contains(lower(agent), {quoted(b.lower())})" for b in BOTS)
    return [
        f"robots(domain, content) AS (VALUES {rows})",
        "lines AS (SELECT domain, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM robots)",
        "flags AS (SELECT *, regexp_extract(line, '(?i)^User-agent\\s*:\\s*(.+)$', 1) AS agent, regexp_extract(line, '(?i)^Disallow\\s*:\\s*(.+)$', 1) AS rule FROM lines)",
        "runs AS (SELECT *, sum(CASE WHEN line = '' OR (agent <> '' AND NOT coalesce(before, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY domain ORDER BY pos) AS grp FROM (SELECT *, lag(agent <> '') OVER (PARTITION BY domain ORDER BY pos) AS before FROM flags))",
        f"grps AS (SELECT domain, grp, max((agent <> '' AND (trim(agent) = '*' OR {bots}))::INT) * max((trim(rule) IN ('/', '*'))::INT) AS blocked FROM runs GROUP BY ALL)",
        "rob AS (SELECT domain, max(blocked) = 0 AS permitted FROM grps GROUP BY domain)",
    ]


def web(iterations: int = 10, p: float = 0.15) -> list[str]:
    """Tables web, links, n, t, d, w0.. (PageRank), and sig with pagerank, out_degree and the signals."""
    return [
        WEB,
        *graph("SELECT src, dst FROM links", "SELECT url AS id FROM web"),
        *iterate("w", iterations, p),
        f"outs AS (SELECT src, count(*) AS c FROM links GROUP BY src)",
        f"base AS MATERIALIZED (SELECT web.url, w{iterations}.s AS pagerank, (refs + coalesce(c, 0))::BIGINT AS out_degree FROM web JOIN w{iterations} ON id = web.url LEFT JOIN outs ON outs.src = web.url)",
        *signals("base"),
    ]


def scaled(columns: dict[str, str], source: str, constant: float) -> str:
    parts = [f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE {constant}::DOUBLE END AS {n}" for c, n in columns.items()]
    return f"SELECT *, {', '.join(parts)} FROM {source}"


NORMAL = {"pagerank": "pr_norm", "out_degree": "out_norm", "reputation": "rep_norm", "tld_score": "tld_norm", "depth": "dep_norm"}
SCORES = {
    "H0_Random": ("('0x' || substr(md5('42' || url), 1, 8))::BIGINT / 4294967296.0::DOUBLE", False),
    "H1_PurePageRank": ("pr_norm", False),
    "H2_HubAuthority": ("0.60::DOUBLE * pr_norm + 0.40::DOUBLE * out_norm", False),
    "H3_PR_Robots": ("pr_norm", True),
    "H4_QWA": ("0.45::DOUBLE * pr_norm + 0.30::DOUBLE * rep_norm + 0.15::DOUBLE * tld_norm + 0.10::DOUBLE * dep_norm", True),
}
PERMITTED = f"regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) NOT IN (SELECT domain FROM rob WHERE NOT permitted)"


def ranking(name: str, score: str, gated: bool, source: str = "nrm") -> str:
    where = f"WHERE {PERMITTED}" if gated else ""
    return f"SELECT '{name}' AS heuristic, url, score, host, composite, tld_score, pr_norm, rep_norm, tld_norm, dep_norm, row_number() OVER (ORDER BY round(score, 12) DESC, url)::INT AS rank FROM (SELECT *, {score} AS score FROM {source}) {where}"


def rankings(iterations: int = 10) -> list[str]:
    """All of `web`, plus nrm, rob, rk (all five rankings) and lab (url, quality)."""
    return [
        *web(iterations),
        f"nrm AS MATERIALIZED ({scaled(NORMAL, 'sig', 0.5)})",
        *robots(),
        "rk AS MATERIALIZED (" + " UNION ALL ".join(ranking(n, s, g) for n, (s, g) in SCORES.items()) + ")",
        "lab AS MATERIALIZED (SELECT url, CASE WHEN reputation >= 0.75 OR (pagerank >= (SELECT median(pagerank) FROM sig) AND tld_score >= 0.70) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS quality FROM sig)",
    ]


def ndcg(source: str, group: str) -> str:
    """SQL for (group, ndcg) of a table with group, rank, quality."""
    return (
        f"SELECT {group}, CASE WHEN max(quality) > 0 THEN sum(quality / log2(rank + 1.0::DOUBLE)) / sum(quality / log2(ideal + 1.0::DOUBLE)) ELSE 0.0::DOUBLE END AS ndcg "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY quality DESC, rank) AS ideal FROM {source}) GROUP BY {group}"
    )


def average_rank(column: str, name: str) -> str:
    return f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0::DOUBLE AS {name}"
