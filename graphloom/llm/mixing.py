"""Mixing sources to target weights by hierarchical budgets.

Weights go down a tree of levels (domain, language, source). A node's budget is shared
among its children by weight, but no child gets more than its leaves can give; what a
child cannot take goes to its siblings first, and only what a whole family cannot take
goes back to the ancestors' other children. A leaf gives its documents in seeded order,
epoch after epoch, until its budget is spent.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, lookup, settle

#: Fixed values of the example tree: domain of a source, and weights. What is not named weighs 1.
DOMAINS = {"web": ("src0", "src1", "src2", "src3", "src4", "src5"), "books": ("src6", "src7", "src8", "src9"), "forums": ("src10", "src11", "src12", "src13", "src14"), "reference": ("src15", "src16", "src17", "src18", "src19")}
WEIGHTS = {("web",): 4.0, ("books",): 3.0, ("forums",): 1.0, ("reference",): 2.0, ("web", "en"): 2.0, ("books", "en"): 2.0, ("web", "en", "src0"): 0.5, ("reference", "en", "src15"): 3.0}
#: A leaf's order is cut into COARSE * FINE buckets.
COARSE, FINE = 64, 64


def domain_of(source: Column, domains: Mapping[str, tuple] = DOMAINS) -> Column:
    out = F.lit("other")
    for name, sources in domains.items():
        out = F.when(source.isin(*sources), name).otherwise(out)
    return out


def share_out(budget: float, weights: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Budgets by weight within room: what one cannot take is shared among the others by their weights."""
    out = np.zeros(len(weights))
    open_ = (room > 0) & (weights > 0)
    left = min(budget, float(room[weights > 0].sum()))
    while left > 1e-9 and open_.any():
        want = left * weights * open_ / (weights * open_).sum()
        full = open_ & (out + want >= room)
        if not full.any():
            return out + want
        left -= float((room - out)[full].sum())
        out[full] = room[full]
        open_ &= ~full
    return out


def leaf_budgets(leaves: list[tuple[tuple, float]], total: float, weights: Mapping[tuple, float], epochs: float) -> dict[tuple, float]:
    """Budget of each leaf. leaves: (path, tokens); a leaf can give epochs * tokens, but nothing where a node on its path weighs 0."""
    out: dict[tuple, float] = {}
    gives = {path: epochs * tokens if all(weights.get(path[: k + 1], 1.0) > 0 for k in range(len(path))) else 0.0 for path, tokens in leaves}

    def descend(prefix: tuple, members: list[tuple[tuple, float]], budget: float) -> None:
        depth = len(prefix)
        if len(members) == 1 and len(members[0][0]) == depth:
            out[prefix] = budget
            return
        children: dict[tuple, list] = {}
        for path, tokens in members:
            children.setdefault(path[: depth + 1], []).append((path, tokens))
        names = sorted(children, key=str)
        room = np.array([sum(gives[path] for path, _ in children[c]) for c in names])
        for c, b in zip(names, share_out(budget, np.array([float(weights.get(c, 1.0)) for c in names]), room), strict=True):
            descend(c, children[c], float(b))

    if leaves:
        descend((), leaves, total)
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def mix(
    docs: DataFrame, levels: Mapping[str, Column], share: float = 0.5, epochs: float = 2.0, weights: Mapping[tuple, float] = WEIGHTS, seed: str = "mix",
    id_col: str = "doc_id", tokens: Column | None = None,
) -> DataFrame:
    """The documents' columns and `epoch`, `n_tokens`, `leaf_budget`: one row per document and epoch in which it is taken.

    The target is `share` of all tokens. Of each leaf's partial epoch, the longest prefix in
    seeded order (md5 of seed, epoch, id) whose tokens fit the budget is taken, so a budget is
    never exceeded. Nulls of a level are a leaf of their own. Documents without tokens cost
    nothing and come where their place in the order is within the prefix. Repeated rows of an
    id are each counted and taken together. Columns of the documents that are named like an
    added one give way to it. An empty table gives an empty result.

    The driver holds the tree, one row per leaf. A leaf's order is cut into hash buckets that
    are summed before they are moved, first 64 of them and then 64 in the one where the budget
    runs out; only the bucket in which it does is ordered, so no leaf is gathered in one task.
    """
    added = ("epoch", "n_tokens", "leaf_budget")
    own = [c for c in docs.columns if c not in added]
    return chosen_rows(docs, levels, share, epochs, weights, seed, id_col, tokens).select(*[F.col(f"row.`{c}`").alias(c) for c in own], *added)


def chosen_rows(
    docs: DataFrame, levels: Mapping[str, Column], share: float, epochs: float, weights: Mapping[tuple, float] = WEIGHTS, seed: str = "mix",
    id_col: str = "doc_id", tokens: Column | None = None,
) -> DataFrame:
    """As `mix`, with the document as one column `row`, whatever its columns are named."""
    names = [f"level{i}" for i in range(len(levels))]
    tokens = tokens if tokens is not None else word_count(F.col("text"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), *[c.cast("string").alias(n) for n, c in zip(names, levels.values(), strict=True)], tokens.alias("n"))
    # a leaf's key is one string, null-safe: lengths keep parts apart
    rows = rows.withColumn("leaf", F.concat_ws("/", *[F.concat(F.coalesce(F.length(n).cast("string"), F.lit("n")), F.lit(":"), F.coalesce(n, F.lit(""))) for n in names]))
    light = settle(rows.select("id", "leaf", *names, "n"), "mix")
    leaves = [(tuple(r[n] for n in names), r["leaf"], float(r["n"])) for r in light.groupBy("leaf", *names).agg(F.sum("n").alias("n")).collect()]
    budgets = leaf_budgets([(p, t) for p, _, t in leaves], share * sum(t for _, _, t in leaves), weights, epochs)
    plan = []
    for path, key, available in leaves:
        budget = int(budgets.get(path, 0.0) + 1e-6)
        whole = int(budget // available) if available else 0
        for e in range(whole + 1):
            plan.append((key, e, None if e < whole else int(budget - whole * available), budget))
    table = docs.sparkSession.createDataFrame(plan, "leaf string, epoch int, part long, leaf_budget long")
    # one row a leaf holds all its epochs, so a row of `light` finds one row
    by_leaf = table.groupBy("leaf").agg(F.collect_list(F.struct("epoch", "part", "leaf_budget")).alias("epochs"))
    planned = lookup(light.select("id", "leaf", "n"), by_leaf, "leaf", len(leaves), "inner").select("id", "leaf", "n", F.explode("epochs").alias("e")).select("id", "leaf", "n", "e.*")
    place = F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    partial = planned.where("part is not null").withColumn("place", place).withColumn("bucket", F.conv(F.substring("place", 1, 3), 16, 10).cast("int"))
    sums = settle(partial.groupBy("leaf", "part", "bucket").agg(F.sum("n").alias("n")), "buckets")
    upto = Window.partitionBy("leaf").orderBy("coarse")
    coarse = sums.groupBy("leaf", "part", F.floor(F.col("bucket") / FINE).cast("int").alias("coarse")).agg(F.sum("n").alias("n"))
    coarse = coarse.withColumn("before", F.sum("n").over(upto) - F.col("n")).where("before + n > part")
    coarse = coarse.groupBy("leaf").agg(F.min(F.struct("coarse", "before")).alias("first")).select("leaf", F.col("first.coarse").alias("coarse"), F.col("first.before").alias("before"))
    fine = lookup(sums, coarse, "leaf", len(leaves), "inner").where(F.floor(F.col("bucket") / FINE) == F.col("coarse"))
    fine = fine.withColumn("start", F.col("before") + F.sum("n").over(Window.partitionBy("leaf").orderBy("bucket")) - F.col("n")).where("start + n > part")
    # the first bucket that does not fit, if any
    edge = fine.groupBy("leaf").agg(F.min(F.struct("bucket", "start")).alias("first")).select("leaf", F.col("first.bucket").alias("edge"), F.col("first.start").alias("before"))
    edge = settle(edge, "edges")
    marked = lookup(partial, edge, "leaf", len(leaves))
    cut = marked.where("bucket = edge").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("leaf").orderBy("place"))).where("upto <= part").select("leaf", "id", "epoch", "leaf_budget")
    taken = marked.where("edge is null or bucket < edge").select("leaf", "id", "epoch", "leaf_budget").union(cut)
    whole = planned.where("part is null").select("leaf", "id", "epoch", "leaf_budget")
    # an id that stands in many rows of a leaf is chosen once an epoch; its epochs are one row
    chosen = whole.union(taken).distinct().groupBy("leaf", "id").agg(F.sort_array(F.collect_list(F.struct("epoch", "leaf_budget"))).alias("epochs"))
    chosen = settle(chosen.select(F.col("leaf").alias("of_leaf"), F.col("id").alias("of_id"), "epochs"), "chosen")
    discard(light, sums, edge)
    # merged at every size: the documents move once, whatever the planner thinks of the chosen ones
    out = rows.select("row", "id", "leaf", "n").join(chosen.hint("merge"), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("leaf") == F.col("of_leaf")))
    return out.select("row", F.col("n").alias("n_tokens"), F.explode("epochs").alias("e")).select("row", "e.epoch", "n_tokens", "e.leaf_budget")


def source_levels() -> dict[str, Column]:
    return {"domain": domain_of(F.col("source")), "language": F.col("lang"), "source": F.col("source")}
