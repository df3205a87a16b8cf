"""Quality classifier: a sparse ensemble of rules.

Boosted trees are grown on statistics of labelled texts; every path from a root is a
conjunctive rule; a logistic regression with a lasso penalty keeps few rules and weighs
them; the rules that remain become Spark column expressions over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language_id import held_out
from .text_stats import STATS, with_statistics
from .trees import boost, sigmoid

#: Bound of the labelled sample that the rules are fitted on, in documents.
SAMPLE = 20_000


@dataclass
class RuleEnsemble:
    bias: float
    rules: list[tuple[tuple, float]]  # (conditions (feature, is_low, cut), weight)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((w * _holds(r, x) for r, w in self.rules), np.zeros(len(x)))

    def column(self) -> Column:
        """The score, 0 to 1, as an expression over the columns named in STATS."""
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            holds = reduce(lambda a, b: a & b, [F.col(STATS[f]) <= F.lit(c) if low else F.col(STATS[f]) > F.lit(c) for f, low, c in rule])
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATS[f]} {'<=' if low else '>'} {c:.4g}" for f, low, c in r) for r, w in sorted(self.rules, key=lambda x: -abs(x[1]))]


def _holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, low, cut in rule:
        out &= (x[:, f] <= cut) if low else (x[:, f] > cut)
    return out.astype(np.float64)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Weights of a logistic regression with an L1 penalty (accelerated proximal gradient); the bias is free."""
    n, d = x.shape
    z = np.concatenate([np.ones((n, 1)), x], 1)
    lip = np.linalg.norm(z, 2) ** 2 / (4 * n) + 1e-9
    w = np.zeros(d + 1)
    mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    w[0] = np.log(mean / (1 - mean))
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        new = ahead - z.T @ (sigmoid(z @ ahead) - y) / n / lip
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - penalty / lip, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        if np.abs(new - w).max() < 1e-6:
            break
        w, t = new, t_new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 0.002) -> RuleEnsemble:
    """Rules of trees grown on all rows, thinned by the lasso. Without rows, a constant of one half; with one class, near it."""
    if not len(y):
        return RuleEnsemble(0.0, [])
    rules = list(dict.fromkeys(r for t in boost(x, y, trees, depth, least=max(3, len(y) // 1000)).trees for r in t.paths()))
    if not rules:
        mean = (y.sum() + 0.5) / (len(y) + 1)
        return RuleEnsemble(float(np.log(mean / (1 - mean))), [])
    held = np.stack([_holds(r, x) for r in rules], 1)
    bias, w = lasso_logistic(held, y, penalty)
    return RuleEnsemble(bias, [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-4])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> RuleEnsemble:
    """Fit on whole texts of at most about `sample` labelled rows, chosen by a hash of the id.

    Labels other than 0 and 1 and null ids are left out; an id labelled twice counts by its least label, one with
    several texts by the least of their statistics.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).alias("mark"))
    n = marks.count()
    if n > sample:
        marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < sample / n * (1 << 20))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if n > sample:  # the same bound on the documents' side, before their texts move
        texts = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < sample / n * (1 << 20))
    measured = with_statistics(texts, F.col("doc_id")).groupBy("id").agg(F.min(F.struct(*STATS)).alias("s")).select("id", "s.*")
    table = measured.join(marks, "id").orderBy("id").toArrow()
    x = np.stack([table[s].to_numpy() for s in STATS], 1) if table.num_rows else np.zeros((0, len(STATS)))
    return fit(x, table["mark"].to_numpy().astype(np.float64) if table.num_rows else np.zeros(0))


def score(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5) of every whole text.

    Null texts count as empty and are scored; repeated rows each get their result; other
    columns are not read; an empty table gives no rows.
    """
    scored = with_statistics(docs, F.col(id_col).cast("long"), text_col).select(F.col("id").alias("doc_id"), model.column().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def accepted(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold; nothing is shuffled."""
    scored = with_statistics(docs, F.struct("*"), text_col).where(model.column() >= threshold)
    return scored.select("id.*")


def quality_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from labelled documents outside fold 1 of 3."""
    model = train(docs.where(~held_out("doc_id", 3, 1)), labels.where(~held_out("doc_id", 3, 1)))
    return score(docs, model).withColumn("held_out", held_out("doc_id", 3, 1)).select("doc_id", "held_out", "score", "predicted")
