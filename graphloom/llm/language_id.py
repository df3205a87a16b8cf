"""Language ID by mixture inference.

A language is a distribution over hashed byte n-grams, learned by counting. A document is
a mixture of languages: expectation-maximisation estimates the proportions from the
likelihoods of its n-grams, and the set of languages is the one with the best penalised
likelihood, found by dropping the weakest language while that gains.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import release
from .textbytes import _BLANK, _LOWER, slices, text_buffers

ORDER, BUCKETS = 3, 1 << 15
#: Bound of the labelled sample that the n-gram counts are fitted on, in documents.
SAMPLE = 20_000
#: n-grams overlap, so `ORDER` of them count as one observation in the penalty.
PENALTY = 2.0
_LETTER = re.compile(r"[^\W\d_]")


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram that begins at each byte (-1: none, or it has no letter), and the document bounds.

    A-Z are lower-cased, white space is one symbol, and other ASCII signs and digits are one more, so
    decoration does not pass for language.
    """
    base, end = int(offsets[0]), int(offsets[-1])
    x = _LOWER[data[base:end]]
    kind = np.where(_BLANK[x], 32, np.where((x < 128) & ~((x >= 97) & (x <= 122)), 33, x)).astype(np.uint32)
    n = len(kind)
    h = np.zeros(n, np.uint32)
    letters = np.zeros(n, np.uint8)
    for i in range(ORDER):
        h[: n - i] = h[: n - i] * np.uint32(0x01000193) ^ kind[i:]
        letters[: n - i] += kind[i:] > 33
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)
    out = h.astype(np.int32)
    out[letters < 2] = -1
    bounds = offsets - base
    for i in range(1, ORDER):  # n-grams do not cross from one document to the next
        at = bounds[1:] - i
        out[at[at >= 0]] = -1
    return out, bounds


@dataclass
class LanguageModel:
    languages: list[str]
    likelihood: np.ndarray  # buckets x languages

    def mixture(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Proportions of the languages in a document with these n-grams."""
        p = self.likelihood[buckets]
        total = counts.sum()
        alive = np.arange(p.shape[1])
        share, fit = _fit(p, counts)
        if len(alive) > 1 and share.max() < 0.999:
            price = PENALTY * np.log(1 + total / ORDER)
            while len(alive) > 1:
                fewer = np.delete(alive, share[alive].argmin()) if len(alive) > 2 else alive[[int(share[alive].argmax())]]
                own, value = _fit(p[:, fewer], counts)
                if value / ORDER < fit / ORDER - price:
                    break
                alive, fit = fewer, value
                share = np.zeros(p.shape[1])
                share[alive] = own
        return share


def _fit(p: np.ndarray, counts: np.ndarray, steps: int = 25) -> tuple[np.ndarray, float]:
    share = np.full(p.shape[1], 1 / p.shape[1])
    weight = counts / counts.sum()
    for _ in range(steps):
        q = p @ share
        new = share * (p.T @ (weight / q))
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    share = share / share.sum()
    return share, float(counts @ np.log(p @ share))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        data, offsets = text_buffers(batch.column("text"))
        for lo, hi in slices(offsets):
            g, bounds = grams(data, offsets[lo : hi + 1])
            own = np.repeat(np.arange(lo, hi), np.diff(bounds))
            for lang in set(langs[lo:hi].tolist()):
                at = g[(langs[own] == lang) & (g >= 0)]
                sums[lang] = sums.get(lang, 0) + np.bincount(at, minlength=BUCKETS)
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> LanguageModel:
    """Fit on whole texts of at most about `sample` labelled rows, chosen by a hash of id and text; all of them where there are fewer."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = rows.groupBy(lang_col).count().collect()
    total = sum(r["count"] for r in labelled)
    if total > sample:
        # every language gets its share of the sample, but no fewer than it has where it is rare
        each = {r[lang_col]: min(1.0, max(sample / total, sample / (4 * len(labelled) * r["count"]))) for r in labelled}
        share = F.lit(0.0)
        for lang, f in each.items():
            share = F.when(F.col(lang_col) == lang, f).otherwise(share)
        rows = rows.where(F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col), F.lit("lang")), F.lit(1 << 20)) < share * (1 << 20))
    counted = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted({r[lang_col] for r in labelled})
    n = np.zeros((BUCKETS, len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    if counted.num_rows:
        n[counted["bucket"].to_numpy(), [place[x] for x in counted["lang"].to_pylist()]] = counted["n"].to_numpy()
    return LanguageModel(languages, (n + 0.1) / (n.sum(0) + 0.1 * BUCKETS) if languages else n)


def _predict(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = batch.column("text")
            data, offsets = text_buffers(texts)
            langs, scores, mixtures = [], [], []
            for lo, hi in slices(offsets):
                g, bounds = grams(data, offsets[lo : hi + 1])
                for i, a, b in zip(range(lo, hi), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    text = texts[i].as_py()
                    if not model.languages or not text or not _LETTER.search(text):
                        langs.append("und")
                        scores.append(0.0)
                        mixtures.append([])
                        continue
                    own = g[a:b]
                    own = own[own >= 0]
                    if len(own):
                        if len(own) > BUCKETS // 4:
                            counts = np.bincount(own, minlength=BUCKETS)
                            buckets = np.flatnonzero(counts)
                            counts = counts[buckets]
                        else:
                            buckets, counts = np.unique(own, return_counts=True)
                        share = model.mixture(buckets, counts.astype(np.float64))
                    else:
                        share = np.full(len(model.languages), 1 / len(model.languages))
                    best = int(share.argmax())
                    langs.append(model.languages[best])
                    scores.append(float(min(1.0, share[best])))
                    mixtures.append([(model.languages[j], float(share[j])) for j in np.flatnonzero(share > 0)] if share.max() < 1 else [(model.languages[best], 1.0)])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            mixed = pa.array([[{"lang": x, "share": y} for x, y in m] for m in mixtures], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), mixed], names=[*(c for c in batch.schema.names if c != "text"), "lang_pred", "score", "mixture"])

    return run


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the fold; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score (the first language's share, 0 to 1), mixture (languages with their shares).

    `und` with score 0 for null texts, texts without a letter, and where no language was learned. Texts are
    read whole; other columns are not read; repeated rows each get their result; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, mixture array<struct<lang: string, share: double>>")


def in_a_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that have a language: not `und`, and a first language of at least that share."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    found = rows.mapInArrow(_predict(model), f"row {kind}, lang_pred string, score double, mixture array<struct<lang: string, share: double>>")
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")


def language_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixture: learned from documents outside fold 0 of 5."""
    model = train(docs.where(~held_out("doc_id", 5, 0)))
    return predict(docs, model).withColumn("held_out", held_out("doc_id", 5, 0)).select("doc_id", "held_out", "lang_pred", "score", "mixture")
