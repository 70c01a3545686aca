"""URL rules and host scores against a plain walk, and SQL against DuckDB."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from shelfwise.llm.queries import URL_RULES
from shelfwise.llm.url_graph import judge_urls, oracle_sql

PAGES = "page_id long, url string, html string"


def link(*urls):
    return "".join(f'<p><A class=x HREF="{u}">t</a>' for u in urls)


ROWS = [
    (1, "https://www.Example.com/en/1", link("http://good.org/a", "http://good.org/b", "/local")),
    (2, "http://x.example.com/en/2", ""),
    (3, "http://x.example.com/en", None),
    (4, "http://example.com", ""),
    (5, "http://farm.net/es/1", ""),
    (6, "http://farm.net/en/1", ""),
    (7, "http://promoter.org/1", link("http://farm.net/es/1", "https://FARM.net/fr/2")),
    (8, "http://good.org/1?u=http://y.net/es/", link("http://neutral.info/")),
    (9, "http://neutral.info#x", link("http://good.org/", "http://farm.net/")),
    (10, None, link("http://farm.net/")),
    (11, "no scheme/en/", ""),
    (12, "http://farm.net/es/1", ""),
    (None, "http://notcom/", ""),
    (13, "ftp://a.b.net/es/x", ""),
]


def walk(edges, seed, rounds=20, damping=0.85):
    out = {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    rank = dict(seed)
    for _ in range(rounds):
        into = dict.fromkeys(seed, 0.0)
        for (a, b), n in edges.items():
            into[b] += rank[a] * n / out[a]
        rank = {h: (1 - damping) * seed[h] + damping * into[h] for h in seed}
    return rank


def test_verdicts_and_scores(spark):
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(ROWS, PAGES), URL_RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == (
        "www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("example.com/en/", "block")
    assert (got[3].rule, got[3].verdict) == ("com/", "allow")
    assert (got[4].path, got[4].rule, got[4].verdict) == ("", None, "allow")
    assert (got[5].rule, got[5].verdict) == ("net/es/", "block")
    assert (got[6].rule, got[6].verdict) == (None, "block")  # two of its host's three pages are
    assert got[7].distrust > got[8].distrust > 0  # it links to a blocked host, the other to one that does
    assert (got[8].path, got[8].verdict) == ("/1", "allow")
    assert (got[9].host, got[9].path, got[9].verdict) == ("neutral.info", "", "allow")
    assert (got[10].host, got[10].path, got[10].rule, got[10].verdict) == ("", "", None, "allow")
    assert (got[11].host, got[11].verdict) == ("", "allow")
    assert (got[13].rule, got[13].verdict) == ("net/es/", "block")
    assert (got[None].host, got[None].rule) == ("notcom", None)

    edges = {
        ("www.example.com", "good.org"): 2, ("promoter.org", "farm.net"): 2, ("good.org", "neutral.info"): 1,
        ("neutral.info", "good.org"): 1, ("neutral.info", "farm.net"): 1,
    }
    hosts = {r.host for r in got.values()} - {""}
    pages = {h: sum(r.host == h for r in got.values()) for h in hosts}
    pages["farm.net"] = 3
    good = {h: sum(r.host == h and r.rule is not None and r.verdict == "allow" for r in got.values()) for h in hosts}
    bad = {h: sum(r.host == h and r.rule is not None and r.verdict == "block" for r in got.values()) for h in hosts}
    turned = {(b, a): n for (a, b), n in edges.items()}
    trust, reach = walk(edges, good), walk(edges, pages)
    distrust, back = walk(turned, bad), walk(turned, pages)
    for r in got.values():
        if r.host:
            assert r.trust == pytest.approx(trust[r.host] / reach[r.host])
            assert r.distrust == pytest.approx(distrust[r.host] / back[r.host])
            blocked = r.distrust >= 0.5 and r.distrust > r.trust
            assert r.rule is not None or r.verdict == ("block" if blocked else "allow")


def test_sql_agrees_on_a_linked_graph(spark):
    got = judge_urls(spark.createDataFrame(ROWS, PAGES), URL_RULES).drop("trust", "distrust").toPandas()
    pages = pd.DataFrame(ROWS, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})
    con = duckdb.connect()
    con.register("pages", pages)
    want = con.sql(oracle_sql(URL_RULES)).df()
    key = lambda df: sorted(map(str, df[list(got.columns)].astype(object).where(df.notna(), None).values.tolist()))
    norm = lambda rows: [x.replace(".0,", ",") for x in rows]
    assert norm(key(got)) == norm(key(want))


def test_no_links_and_empty(spark):
    rows = [(1, "http://a.net/es/", None), (2, "http://a.net/x", None), (3, "http://b.org/x", None)]
    got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(rows, PAGES), URL_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}
    clash = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as host", "2 as rule", "3 as n", "4 as src")
    assert judge_urls(clash, URL_RULES).count() == 3
    assert judge_urls(spark.createDataFrame([], PAGES), URL_RULES).count() == 0


def test_links_without_a_scheme_name_a_host_too(spark):
    from shelfwise.llm.url_graph import host_edges

    html = link("//Farm.net/es/1", "//good.org", "/a//b.org", "c//d.org", "https://x.org//y.org/", "#//z.org")
    edges = host_edges(spark.createDataFrame([(1, "http://p.org/", html)], PAGES)).collect()
    assert {(e.src, e.dst, e.n) for e in edges} == {
        ("p.org", "farm.net", 1), ("p.org", "good.org", 1), ("p.org", "x.org", 1),
    }


def test_sql_takes_links_without_a_scheme(spark, tmp_path):
    rows = [(r[0], r[1], None if r[2] is None else r[2].replace('"http://', '"//')) for r in ROWS]
    assert any(r[2] and '"//' in r[2] for r in rows)
    path = f"{tmp_path}/pages.parquet"
    spark.createDataFrame(rows, PAGES).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = {tuple(map(str, r)) for r in con.execute(oracle_sql(URL_RULES)).fetchall()}
    names = [d[0] for d in con.execute(oracle_sql(URL_RULES)).description]
    got = judge_urls(spark.read.parquet(path), URL_RULES).select(*names).collect()
    assert {tuple(map(str, r)) for r in got} == want
