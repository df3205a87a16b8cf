"""Document fingerprints by winnowing, in DataFrame expressions alone.

Words are hashed, a script without spaces by its signs and a very long word by pieces; a
k-gram's hash rolls over k word hashes; of each window of w k-grams the least hash is kept,
the rightmost on ties, with its position. w grows with the text from 1 to WINDOW, so a short
text keeps several marks. Any run of w + k - 1 words that two texts share, w the larger of
theirs, leaves a common hash in both fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shuffle_width

#: Words of a gram; grams of the longest window (a power of two); a window doubles while the text has SPREAD words for each of its grams.
GRAM, WINDOW, SPREAD = 3, 16, 8
#: A k-gram's hash has 31 bits and its position 30, enough for any text, so both fit one long and order by hash, then position from the right.
_BITS = 30
_POSITIONS = (1 << _BITS) - 1
_PRIME = (1 << 31) - 1
_ROLL = 1_000_003
#: Signs of scripts that put no space between words (kana, Han, Hangul syllables, Thai), and code points of a piece of a long word.
_UNSPACED = "\\u0E01-\\u0E5B\\u3041-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uAC00-\\uD7AF"
_PIECE = 16
WORD = f"[{_UNSPACED}]|[^\\x20\\x09-\\x0D{_UNSPACED}]{{1,{_PIECE}}}"


def _words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _roll(at) -> Column:
    """The rolled hash of GRAM values, newest last; sums stay below 2^62."""
    h = at(0)
    for i in range(1, GRAM):
        h = (h * F.lit(_ROLL) + at(i)) % F.lit(_PRIME)
    return h


def _doubled(minima: Column, half: int) -> Column:
    """Minima of windows of 2 * half grams, of those of half."""
    return F.transform(F.slice(minima, 1, F.greatest(F.size(minima) - half, F.lit(1))), lambda x, i: F.least(x, F.get(minima, i + half)))


def winnow(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Add `out`: array of longs, the distinct selected (hash, position) codes in order of position.

    A text of fewer than GRAM words is one gram; one without words, or null, has none.
    Each step is a column of its own, so no array is computed twice. Window minima double:
    those of 2w grams are the lesser of two neighbouring ones of w.
    """
    h, g, size = (f"__{out}_{x}" for x in "hgn")
    df = df.withColumn(h, F.transform(_words(text), lambda x: F.pmod(F.xxhash64(x), F.lit(_PRIME))))
    hashes = F.col(h)
    many = F.size(hashes) >= GRAM
    code = lambda value, i: F.shiftleft(value, _BITS) + (F.lit(_POSITIONS) - i.cast("long"))
    rolled = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (GRAM - 1), F.lit(0))), lambda x, i: code(_roll(lambda j: F.get(hashes, i + j)), i))
    whole = F.aggregate(hashes, F.lit(17).cast("long"), lambda a, x: (a * F.lit(_ROLL) + x) % F.lit(_PRIME))
    df = df.withColumn(g, F.when(many, rolled).when(F.size(hashes) > 0, F.array(code(whole, F.lit(0)))).otherwise(F.array().cast("array<long>")))
    df = df.withColumn(size, F.size(g))
    steps, half = [], 1
    while half < WINDOW:
        m, before = f"__{out}_m{half}", F.col(steps[-1] if steps else g)
        df = df.withColumn(m, F.when(F.col(size) >= 2 * half * SPREAD, _doubled(before, half)).otherwise(before))
        steps.append(m)
        half *= 2
    return df.withColumn(out, F.array_distinct(F.col(steps[-1] if steps else g))).drop(h, g, size, *steps)


def hashes_of(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda c: F.shiftright(c, _BITS)))


def written(fingerprint: Column) -> Column:
    """`hash@position` items, in order of position."""
    return F.array_join(F.transform(fingerprint, lambda c: F.concat(F.lower(F.hex(F.shiftright(c, _BITS))), F.lit("@"), (F.lit(_POSITIONS) - c.bitwiseAND(F.lit(_POSITIONS))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, F.lit(1.0)).otherwise(both / total)


def _even_keys(spark: SparkSession, parts: int) -> list[int]:
    """For each of `parts` hash partitions an integer that Spark deals into it, so that every task gets one range."""
    found = spark.range(64 * parts).select(F.col("id").cast("int").alias("key")).groupBy(F.pmod(F.hash("key"), F.lit(parts)).alias("part")).agg(F.min("key").alias("key")).collect()
    by = {r["part"]: r["key"] for r in found}
    return [by.get(p, p) for p in range(parts)]


def _range_of(key: Column, bounds: list[int], step: int = 32) -> Column:
    """How many bounds after the first are not above the key: looked for among every `step`-th, then among `step`."""
    table, coarse = F.array(*[F.lit(b).cast("long") for b in bounds]), F.array(*[F.lit(b).cast("long") for b in bounds[::step]])
    begin = F.greatest(F.size(F.filter(coarse, lambda b: b <= key)) - 1, F.lit(0)) * step
    return F.greatest(begin + F.size(F.filter(F.slice(table, begin + 1, step), lambda b: b <= key)) - 1, F.lit(0))


def with_next(docs: DataFrame, id_col: str, columns: dict[str, str], parts: int) -> DataFrame:
    """Each row with columns of the row that follows in ascending order of id (the last row's is the first).

    Ids are cut into ranges at ids that exist, so the first row of a range is known by its
    id: it is copied to the range before, and no range needs to see another. Equal ids are
    ordered by a hash of the text and lie in one range; null ids come first.
    """
    cuts = docs.agg(F.percentile_approx(id_col, [i / parts for i in range(parts)], 10_000).alias("q"), F.min(id_col).alias("m"), F.max(F.col(id_col).isNull()).alias("nulls")).first()
    bounds = sorted({cuts["m"], *(cuts["q"] or [])} - {None})
    table = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    key = F.col(id_col)
    own = F.when(key.isNull(), F.lit(0)).otherwise(_range_of(key, bounds)) if bounds else F.lit(0)
    n = max(1, len(bounds))
    opens = F.coalesce(F.array_contains(table, key), F.lit(False)) & (F.lit(not cuts["nulls"]) | (own > 0)) | key.isNull()
    before = F.when(own == 0, F.lit(n - 1)).otherwise(own - 1)
    # A copy of an opening row stands behind all rows of the range before.
    rows = docs.withColumn("__places", F.when(opens, F.array(F.struct(own.alias("r"), F.lit(0).alias("copy")), F.struct(before.alias("r"), F.lit(1).alias("copy")))).otherwise(F.array(F.struct(own.alias("r"), F.lit(0).alias("copy")))))
    keys = F.array(*[F.lit(k) for k in _even_keys(docs.sparkSession, parts)[:n]])
    rows = rows.withColumn("__place", F.explode("__places")).select(*docs.columns, F.element_at(keys, F.col("__place.r") + 1).alias("__range"), F.col("__place.copy").alias("__copy"))
    order = Window.partitionBy("__range").orderBy("__copy", F.col(id_col).asc_nulls_first(), F.col("__tie"))
    return rows.repartition(parts, "__range").withColumns({new: F.lead(old).over(order) for old, new in columns.items()}).where("__copy = 0").drop("__copy", "__range")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many
    (or all) of the next document. Null texts count as empty; two empty fingerprints are alike.
    A single document is its own next. Repeated rows are documents of their own; other columns
    are not read; an empty table gives no rows. Of fewer than GRAM words, a change of any one
    leaves no common mark.
    """
    parts = max(1, shuffle_width(docs.sparkSession))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("__tie", F.xxhash64("text"))
    # a document's own fingerprint is made before the rows move, and goes with it to the document before
    rows = with_next(winnow(rows, F.col("text"), "a"), "doc_id", {"text": "next_text", "a": "c"}, parts)
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("__q", F.floor(F.col("n_chars") / 4).cast("int"))
    rows = rows.withColumn("__edited", F.concat(F.expr("substring(text, 1, int(n_chars) - __q)"), F.expr("substring(next_text, 1, __q)")))
    rows = winnow(rows, F.col("__edited"), "b")
    rows = rows.withColumns({"ha": hashes_of(F.col("a")), "hb": hashes_of(F.col("b")), "hc": hashes_of(F.col("c"))})
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"), written(F.col("a")).alias("fingerprint"), written(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("ha"), F.col("hb")).alias("near_edited"), likeness(F.col("ha"), F.col("hc")).alias("near_next"),
    )
