"""URL filter by trust and distrust over the host graph (operator 4).

Rules judge what they fit. What is left is judged by host: trust spreads from
the hosts of allowed pages along links, distrust from the hosts of blocked
pages against them, both by personalised PageRank over host edges. Beside each
runs the same walk from all pages, so that a host's score is the share of its
rank that comes from the seeds. A host is blocked if its distrust share
reaches the threshold and exceeds its trust share.

Host edges come from links in ``html`` that name a host, with a scheme or by
``//host``; they are counted by (from,
to) before any join, so a host with very many pages is a few rows. A node
without links out passes nothing on; walks run a fixed number of rounds, so
two engines can repeat them.

Edge cases: a null url, or one without ``://``, has empty host and path, is
fitted by no rule and has no node: it is allowed. A null html has no links.
Repeated pages count as often as they occur; ties between trust and distrust
allow; an empty table gives an empty result; only the three page columns are
read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stage

ALLOW, BLOCK = "allow", "block"
Rule = tuple[str, str]  # verdict, host followed by the path's beginning
_PARTS = r"(?s)://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, p = _split(rule)
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst, share)``: distinct pairs of hosts by their share of src's links."""
    links = pages.select(
        host_of(F.col(url_col)).alias("src"),
        F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(1))).alias("to"),
    )
    counted = (
        links.select("src", _lower(F.col("to")).alias("dst"))
        .filter("src != '' and src != dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )
    return _shares(counted)


def _shares(counted: DataFrame) -> DataFrame:
    out = counted.groupBy(F.col("src").alias("of")).agg(F.sum("n").alias("all"))
    return counted.join(out, F.col("src") == F.col("of")).select(
        "src", "dst", "n", (F.col("n") / F.col("all")).alias("share")
    )


def _turned(edges: DataFrame) -> DataFrame:
    return _shares(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))


def _walk(
    nodes: DataFrame, edges: DataFrame, seeds: list[str], rounds: int, damping: float, every: int
) -> DataFrame:
    """Personalised PageRank from each seed column at once: ``host, <seeds>``."""
    start = nodes.select("host", *seeds)
    rank = start
    for i in range(1, rounds + 1):
        arrived = (
            edges.join(rank, F.col("src") == F.col("host"))
            .groupBy("dst")
            .agg(*(F.sum(F.col(s) * F.col("share")).alias(f"{s}_in") for s in seeds))
        )
        rank = start.join(arrived, F.col("host") == F.col("dst"), "left").select(
            "host",
            *(
                ((1 - damping) * F.col(s) + damping * F.coalesce(f"{s}_in", F.lit(0.0))).alias(s)
                for s in seeds
            ),
        )
        if i % every == 0:
            rank = stage(rank, "rank")
    return rank


def host_scores(
    judged: DataFrame,
    edges: DataFrame,
    rounds: int = 20,
    damping: float = 0.85,
    stage_every: int = 5,
) -> DataFrame:
    """``(host, trust, distrust)`` of every host with a page or a link.

    ``judged`` has a host and a verdict (null: no rule) for each page. The two
    scores are shares, 0 to 1, of the rank that reaches the host.
    """
    edges = stage(edges, "host-edges")
    pages = judged.filter("host != ''").groupBy("host").agg(
        F.count("*").cast("double").alias("all"),
        F.sum(F.when(F.col("verdict") == ALLOW, 1.0).otherwise(0.0)).alias("good"),
        F.sum(F.when(F.col("verdict") == BLOCK, 1.0).otherwise(0.0)).alias("bad"),
    )
    ends = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    nodes = stage(
        ends.join(pages, "host", "full").select(
            "host", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("all", "good", "bad"))
        ),
        "hosts",
    )
    if edges.isEmpty():  # nothing spreads: every walk stays where it starts
        return nodes.select("host", *_parts("good", "bad", "all", "all"))
    forward = _walk(nodes, edges, ["good", "all"], rounds, damping, stage_every)
    back = _walk(nodes, stage(_turned(edges), "turned"), ["bad", "all"], rounds, damping, stage_every)
    back = back.select(F.col("host").alias("h"), "bad", F.col("all").alias("all_back"))
    return forward.join(back, F.col("host") == F.col("h")).select(
        "host", *_parts("good", "bad", "all", "all_back")
    )


def _parts(good: str, bad: str, all_good: str, all_bad: str) -> list[Column]:
    return [
        F.coalesce(F.try_divide(F.col(good), F.col(all_good)), F.lit(0.0)).alias("trust"),
        F.coalesce(F.try_divide(F.col(bad), F.col(all_bad)), F.lit(0.0)).alias("distrust"),
    ]


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    threshold: float = 0.5,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    **walk,
) -> DataFrame:
    """``(id, host, path, rule, verdict, trust, distrust)`` of every page.

    ``rules`` is a short list of (verdict, host and path beginning); it becomes
    one conditional expression.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    split = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = split.withColumns({"rule": rule, "verdict": verdict})
    scores = stage(
        host_scores(judged, host_edges(pages, url_col, html_col), **walk), "host-scores"
    ).withColumnRenamed("host", "scored")
    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return judged.join(scores, F.col("host") == F.col("scored"), "left").select(
        id_col,
        "host",
        "path",
        "rule",
        F.coalesce("verdict", F.when(bad, BLOCK).otherwise(ALLOW)).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def oracle_sql(rules: list[Rule], threshold: float = 0.5, rounds: int = 20, damping: float = 0.85) -> str:
    """DuckDB SQL for the verdicts of ``judge_urls`` over table ``pages``."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))

    def fit(rule: str) -> str:
        h, p = _split(rule)
        return f"((host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}'))"

    def case(column: int) -> str:
        whens = " ".join(f"WHEN {fit(r[1])} THEN '{r[column]}'" for r in ordered)
        return f"CASE {whens} END"

    def walk(name: str, edges: str, seed: str) -> str:
        steps = [f"{name}0 AS (SELECT host, s, a FROM (SELECT host, {seed} AS s, n AS a FROM nodes))"]
        for i in range(rounds):
            steps.append(
                f"{name}{i + 1} AS MATERIALIZED (SELECT z.host, {1 - damping} * z.s + {damping} * coalesce(x.s, 0) AS s,"
                f" {1 - damping} * z.a + {damping} * coalesce(x.a, 0) AS a FROM {name}0 z LEFT JOIN"
                f" (SELECT dst, sum(r.s * share) AS s, sum(r.a * share) AS a FROM {edges} JOIN {name}{i} r"
                f" ON src = r.host GROUP BY dst) x ON z.host = x.dst)"
            )
        return ",\n".join(steps)

    lower = "translate({}, '" + string.ascii_uppercase + "', '" + string.ascii_lowercase + "')"
    link = _LINK.replace("'", "''")
    return f"""WITH u AS (
  SELECT page_id, html, {lower.format("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), j AS (SELECT page_id, html, host, path, {case(1)} AS rule, {case(0)} AS by_rule FROM u),
links AS (
  SELECT host AS src, {lower.format("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst FROM j
), e AS (
  SELECT src, dst, count(*) AS n FROM links WHERE src != '' AND src != dst GROUP BY ALL
), ef AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM e),
eb AS (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY dst) AS share FROM e),
nodes AS (
  SELECT host, sum(n) AS n, sum(good) AS good, sum(bad) AS bad FROM (
    SELECT host, 1.0::DOUBLE AS n, (coalesce(by_rule, '') = 'allow')::INT::DOUBLE AS good,
           (coalesce(by_rule, '') = 'block')::INT::DOUBLE AS bad FROM j WHERE host != ''
    UNION ALL SELECT src, 0, 0, 0 FROM e UNION ALL SELECT dst, 0, 0, 0 FROM e) GROUP BY host
), {walk("f", "ef", "good")},
{walk("b", "eb", "bad")},
scores AS (
  SELECT f.host, CASE WHEN f.a = 0 THEN 0 ELSE f.s / f.a END AS trust,
         CASE WHEN b.a = 0 THEN 0 ELSE b.s / b.a END AS distrust
  FROM f{rounds} f JOIN b{rounds} b ON f.host = b.host
)
SELECT page_id, j.host, path, rule,
       coalesce(by_rule, CASE WHEN distrust >= {threshold} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN scores ON j.host = scores.host"""
