"""Numbers, times, hashes, JSON, arrays and maps: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nonneg(v: Column) -> Column:
    """A whole number of JSON (a VARIANT) that is not negative, else 0: no text, no fraction, no true or false."""
    return F.when(F.schema_of_variant(v) == "BIGINT", F.greatest(F.try_variant_get(v, "$", "bigint"), F.lit(0))).otherwise(F.lit(0)).cast("long")


def rel_change(before: Column, after: Column) -> Column:
    """(after - before) / before; null where either is null or the base is 0."""
    return F.when(before != 0, (after - before) / before)


def tier(model: Column) -> Column:
    """The model family named in it, else the model itself."""
    out = model
    for name in ("fable", "haiku", "sonnet", "opus"):
        out = F.when(F.contains(F.lower(model), F.lit(name)), name).otherwise(out)
    return out


def tool_name(tool: Column, server: str) -> Column:
    """Tools of our own server, named in full or through a plugin, by a short name; other servers' tools as one."""
    own = rf"^mcp__(?:plugin_{server}_)?{server}__(\w+)$"
    return F.when(F.rlike(tool, F.lit(own)), F.concat(F.lit(server + ":"), F.regexp_extract(tool, own, 1))).when(F.startswith(tool, F.lit("mcp__")), "mcp").otherwise(tool)


#: Task categories and the words that stand for them, words for sizes, characters of a category.
CATEGORIES = {
    "explain": ("explain", "locate", "locate and explain", "question", "understand"),
    "bug_fix": ("bug fix", "bugfix", "bug", "fix"),
    "feature": ("feature", "small feature", "new feature"),
    "refactor": ("refactor", "refactoring", "cross module refactor"),
    "tests": ("tests", "test", "write tests", "testing"),
    "triage": ("triage", "failing tests", "logs", "triage failing tests or logs"),
}
SIZES = {"s": "S", "small": "S", "m": "M", "medium": "M", "l": "L", "large": "L"}
CATEGORY_CHARS = 30


def norm_category(c: Column) -> Column:
    """The category that the words name, else the words as a slug of at most CATEGORY_CHARS; null without words."""
    words = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    out = F.nullif(F.substring(F.replace(words, F.lit(" "), F.lit("_")), 1, CATEGORY_CHARS), F.lit(""))
    for name, spoken in CATEGORIES.items():
        out = F.when(words.isin(*spoken) | (F.replace(words, F.lit(" "), F.lit("_")) == name), name).otherwise(out)
    return out


def norm_size(c: Column) -> Column:
    """S, M or L by the first word; null for any other."""
    first = F.lower(F.regexp_extract(c, r"^\s*(\S+)", 1))
    return _by_word(first, SIZES)


def _by_word(word: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(word == k, v).otherwise(out)
    return out


def iso_to_epoch(c: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(c)) / 1e6


def epoch_to_day(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def since(at: Column, day: str | None) -> Column:
    return F.substring(at, 1, 10) >= day if day else F.lit(True)


def map_total(m: Column) -> Column:
    """Sum of a map's values."""
    return F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)).cast("long"))


def signed_percent(x: Column) -> Column:
    """`+12.3%`, with a true minus sign; a dash for null."""
    text = F.format_string("%.1f%%", F.abs(x) * 100)
    return F.when(x.isNull(), "–").when(x < 0, F.concat(F.lit("−"), text)).otherwise(F.concat(F.lit("+"), text))


def duration(seconds: Column) -> Column:
    """`2m 05s`."""
    s = F.round(seconds).cast("long")
    return F.when(s >= 60, F.format_string("%dm %02ds", F.floor(s / 60).cast("long"), s % 60)).otherwise(F.format_string("%ds", s))


def text_of_content(content: Column) -> Column:
    """Message content that is a string, or blocks of which the text ones count, as one text. `content` is a VARIANT."""
    blocks = F.try_variant_get(content, "$", "array<struct<type: string, text: string>>")
    return F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise(F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n"))
