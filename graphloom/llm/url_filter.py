"""URL filters: domain rules first, then gradient-boosted trees on lexical features.

The URLs that a rule decides are the labelled ones: the trees learn from them and judge the
others. The features are lengths, depth, digit ratio, entropy, parameter counts and
statistics of host suffixes and of the path's first part: how often labelled URLs with them
are blocked, smoothed. The trees are compiled into a Spark column, so judging a URL stays in
the JVM.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import FEW, lookup, settle
from .trees import BoostedTrees, boost

#: Rules as (verdict, host, path); a rule fits its host and all subdomains, and urls whose path begins with its path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Bound of the labelled URLs that the trees are fitted on, each URL counted once.
SAMPLE = 20_000
#: What statistics are kept of: the last two and three labels of a host, and the first part of a path.
STATISTICS = ("suffix_two", "suffix_three", "head")
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_depth", "digits", "host_digits", "hyphens", "entropy", "parameters", *STATISTICS)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    has = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lower).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written as host and path, and its verdict; nulls where none fits. The rules are one literal, however many."""
    table = F.array(*[F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("name"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    best = F.array_max(fits)
    return best["name"], best["verdict"]


def _entropy(text: Column) -> Column:
    """Bits per character over the characters a-z, 0-9 and the rest as one."""
    total = F.greatest(F.length(text), F.lit(1))
    left, out = F.lit(1.0), F.lit(0.0)
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        share = (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / total
        out = out - F.when(share > 0, share * F.log2(share)).otherwise(0.0)
        left = left - share
    return out - F.when(left > 1e-9, left * F.log2(left)).otherwise(0.0)


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that need no statistics."""
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "depth": _count(path, "/"), "host_depth": _count(host, r"\."),
        "digits": _count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)), "host_digits": _count(host, "[0-9]"), "hyphens": _count(host, "-"), "entropy": _entropy(host),
        "parameters": F.when(query == "", 0).otherwise(1 + _count(query, "&")),
    }


def statistic_keys(host: Column, path: Column) -> dict[str, Column]:
    return {"suffix_two": suffix(host, 2), "suffix_three": suffix(host, 3), "head": F.regexp_extract(path, r"^/?([^/]*)", 1)}


def _with_statistics(rows: DataFrame, tables: dict[str, tuple[DataFrame, int]], few: int) -> DataFrame:
    """Add blocked and all labelled URLs for each key of a row: <name>_blocked, <name>_urls; 0 where none was labelled."""
    keys = statistic_keys(F.col("host"), F.col("path"))
    for name, (table, n) in tables.items():
        table = table.select(F.col("key").alias("__key"), F.col("blocked").alias(f"{name}_blocked"), F.col("urls").alias(f"{name}_urls"))
        rows = lookup(rows.withColumn("__key", keys[name]), table, "__key", n, "left", few).drop("__key")
    return rows.na.fill(0.0, [f"{n}_{x}" for n in tables for x in ("blocked", "urls")])


def train(pages: DataFrame, url_col: str = "url", rules: tuple = RULES, sample: int = SAMPLE, few: int = FEW) -> tuple[BoostedTrees, dict[str, tuple[DataFrame, int]], float]:
    """Trees from at most about `sample` of the URLs that a rule decides, chosen by a hash, and statistics of all of them.

    A URL counts once, however many rows have it. The trees learn from no more than half of
    the labelled URLs, with statistics of the others, so that no label shows in its own
    features; judging takes the statistics of all. Without any labelled URL, the score is 0
    and the method allows.
    """
    host, path = split_url(F.col("url"))
    ruled = rule_of(F.col("host"), F.col("path"), rules)[1]
    urls = pages.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url")).select("url", host.alias("host"), path.alias("path"))
    urls = settle(urls.withColumn("y", (ruled == "block").cast("double")).where("y is not null").distinct(), "urls")
    n, blocked = urls.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    prior = float((blocked + 0.5) / (n + 1)) if n else 0.0
    share = min(0.5, sample / n) if n else 0.0
    urls = urls.withColumn("picked", F.pmod(F.xxhash64("url", F.lit("trees")), F.lit(1 << 20)) < share * (1 << 20))
    tables, others = {}, {}
    for name, key in statistic_keys(F.col("host"), F.col("path")).items():
        rest = F.when(F.col("picked"), 0.0).otherwise(1.0)
        table = settle(urls.groupBy(key.alias("key")).agg(F.sum("y").alias("blocked"), F.count("*").cast("double").alias("urls"), F.sum(rest * F.col("y")).alias("other_blocked"), F.sum(rest).alias("other_urls")), name)
        m = table.count()
        tables[name] = table.select("key", "blocked", "urls"), m
        others[name] = table.select("key", F.col("other_blocked").alias("blocked"), F.col("other_urls").alias("urls")), m
    features = lexical(F.col("url"), F.col("host"), F.col("path"))
    counts = [f"{name}_{x}" for name in others for x in ("blocked", "urls")]
    table = _with_statistics(urls.where("picked"), others, few).orderBy("url").select(*[c.cast("double").alias(k) for k, c in features.items()], *counts, "y").toArrow()
    y = table["y"].to_numpy().astype(np.float64)
    columns = [table[k].to_numpy() for k in features]
    columns += [(table[f"{name}_blocked"].to_numpy() + 2 * prior) / (table[f"{name}_urls"].to_numpy() + 2) for name in others]
    return boost(np.stack(columns, 1), y), tables, prior


def judge(pages: DataFrame, model: BoostedTrees, tables: dict[str, tuple[DataFrame, int]], prior: float, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, threshold: float = 0.5, few: int = FEW) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every URL; the score is the trees', rule or not.

    A null URL or one without `://` has empty host and path, fits no rule and is judged by
    the trees; repeated rows each get their result; URLs are read whole, however long; other
    columns are not read; an empty table gives no rows.
    """
    host, path = split_url(F.col(url_col))
    rows = _with_statistics(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path")), tables, few)
    for name in tables:
        rows = rows.withColumn(name, (F.col(f"{name}_blocked") + 2 * prior) / (F.col(f"{name}_urls") + 2))
    for k, c in lexical(F.col("url"), F.col("host"), F.col("path")).items():
        rows = rows.withColumn(k, c.cast("double"))
    score = model.column([F.col(f) for f in FEATURES]) if prior else F.lit(0.0)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("score", score)
    return rows.select(F.col("page_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > threshold, "block").otherwise("allow")).alias("verdict"), "score")


def url_verdicts(pages: DataFrame) -> DataFrame:
    return judge(pages, *train(pages))
