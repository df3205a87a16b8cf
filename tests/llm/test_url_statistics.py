"""The URL filter: rules against brute force, trees against held-out rule-decided URLs, columns against numpy."""

import re

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import url_filter

DATA = "/root/testdata/sf0.01"


def by_hand(url):
    """Host, path, rule and the rule's verdict as the contract words them."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


ODD = [None, "", "none", "://", "http://A.Org/", "http://org/x", "http://xorg/", "http://example.org", "http://EXAMPLE.org/es/?a#b", "https://q.com?x=/de/", "http://q.com/de/" + "y" * 20_000, "http://q.com/fr/", "http://é.com/de/", "a://b://c.com/de/"]


def test_rules_against_brute_force(spark):
    real = [r["url"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    urls = [*real, *ODD, *ODD]  # repeated rows too
    df = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(urls)], "page_id long, url string, host string, score double")
    got = {r["page_id"]: r for r in url_filter.url_verdicts(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = by_hand(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["score"] > 0.5 else "allow"))


def test_trees_on_held_out_urls(spark):
    """Trees that never saw a host agree with the rules on its URLs far more often than the commonest verdict does."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    fold = F.pmod(F.xxhash64(url_filter.split_url(F.col("url"))[0]), F.lit(4)) == 0
    model = url_filter.train(pages.where(~fold))
    ruled = url_filter.judge(pages.where(fold), *model).where("rule is not null").select("verdict", "score").collect()
    right = np.mean([(r["score"] > 0.5) == (r["verdict"] == "block") for r in ruled])
    common = max(np.mean([r["verdict"] == v for r in ruled]) for v in ("allow", "block"))
    assert len(ruled) > 100 and right > 0.85 and right > common + 0.05, (right, common)


def test_column_equals_the_model(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    model, tables, prior = url_filter.train(pages)
    wide = url_filter._with_statistics(pages.select("page_id", "url", *[c.alias(n) for c, n in zip(url_filter.split_url(F.col("url")), ("host", "path"), strict=True)]), tables, 0)
    for name in tables:
        wide = wide.withColumn(name, (F.col(f"{name}_blocked") + 2 * prior) / (F.col(f"{name}_urls") + 2))
    rows = wide.select("page_id", *[c.cast("double").alias(k) for k, c in url_filter.lexical(F.col("url"), F.col("host"), F.col("path")).items()], *tables).toArrow()
    x = np.stack([rows[f].to_numpy() for f in url_filter.FEATURES], 1)
    want = dict(zip(rows["page_id"].to_pylist(), 1 / (1 + np.exp(-model.margin(x))), strict=True))
    got = {r["page_id"]: r["score"] for r in url_filter.judge(pages, model, tables, prior).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_statistics_cover_all_urls(spark):
    """Hosts outside the trees' sample are judged by the statistics of all labelled URLs, and a repeated URL counts once."""
    rules = tuple(("block" if i % 2 else "allow", f"a.site{i:03d}.net", "/p") for i in range(60))
    rows = [(i * 20 + j, f"http://a.site{i:03d}.net/{'p' if j < 10 else 'q'}{j}") for i in range(60) for j in range(20)]
    rows += [(5_000 + i, "http://a.site001.net/p0") for i in range(1_500)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, *url_filter.train(df, rules=rules, sample=150), rules=()).collect()}
    want = {i: "block" if int(u[len("http://a.site") :][:3]) % 2 else "allow" for i, u in rows}
    assert len(got) == len(rows) and np.mean([got[i] == want[i] for i in got]) > 0.95


def test_large_tables_and_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "http://a.b.com/de/x"), (2, "http://a.b.com/de/x"), (None, "http://x.b.com/fr/"), (4, None), (5, "none")], "page_id long, url string")
    model = url_filter.train(df)
    rows = lambda few: sorted(map(str, url_filter.judge(df, *model, few=few).collect()))
    assert rows(0) == rows(100) and len(rows(0)) == 5
    alone = spark.createDataFrame([(1, "http://x.net/de/")], "page_id long, url string")
    assert [(r["verdict"], r["score"]) for r in url_filter.url_verdicts(alone).collect()] == [("allow", 0.0)]
    assert url_filter.url_verdicts(df.where("false")).count() == 0
