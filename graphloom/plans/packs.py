"""Context packs for prompts made of the events table over the code map, with a DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extraction import manifests as mf
from ..operators import packs
from .code import DUCK, index
from .stacks import build_files

BUDGET = 60
#: What an event asks, by its id modulo 6; {k} is a Python part's key.
_K = "(event_id % 49) * 4 + 4"
PROMPTS = ("Please fix `price_{k}` for me", "Change ts/base.ts and gin too", "Add a cache to py/tests", "Rename `build_{k}x` now", "thanks", "See part_{k}.py and `Part{k}.price_{k}`")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) of an event's prompt."""
    key = F.expr(_K).cast("string")
    text = F.lit(None).cast("string")
    for n, template in enumerate(PROMPTS):
        text = F.when(F.expr(f"event_id % {len(PROMPTS)} = {n}"), F.replace(F.lit(template), F.lit("{k}"), key)).otherwise(text)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), text.alias("text"))


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.context_packs(prompts(spark, sf_dir), index(spark, sf_dir), BUDGET, versions=mf.go(mf.facts(build_files(spark, sf_dir).where(F.endswith("path", F.lit("go.mod")))))[1])


_HIT = "'py/b'||b||'/part_'||k||'.py:11-13  method Part'||k||'.price_'||k||'(self, n)'"
_FILE = "'py/b'||b||'/part_'||k||'.py'"
_TESTS = f"CASE WHEN k%5=0 THEN 'Tests: py/tests/test_part_'||k||'.py (for '||{_FILE}||')' END"
_LISTED = "(SELECT '- py/tests/: '||array_to_string(list_slice(names, 1, 12), ', ')||CASE WHEN len(names)>12 THEN ', … ('||len(names)||' in all)' ELSE '' END FROM (SELECT list(regexp_extract(path, '[^/]*$') ORDER BY path) AS names FROM files WHERE dir='py/tests'))"
QUERIES = {"context_pack": context_pack}
ORACLES = {
    "context_pack": f"WITH {DUCK}, e AS (SELECT event_id AS id, event_id%6 AS c, {_K} AS k FROM events), "
    f"l AS (SELECT id, CASE c WHEN 0 THEN '- `price_'||k||'`: '||{_HIT} WHEN 1 THEN '- ts/base.ts (typescript, 1 symbols)' WHEN 2 THEN {_LISTED} WHEN 3 THEN 'Not in the code map: `build_'||k||'x` (did you mean build_'||k||'?)' WHEN 5 THEN '- `Part'||k||'.price_'||k||'`: '||{_HIT} END AS l1, "
    f"CASE c WHEN 0 THEN {_TESTS} WHEN 1 THEN '  L1 class Base' WHEN 5 THEN '- `part_'||k||'.py` matches: '||{_FILE} END AS l2, CASE c WHEN 1 THEN 'Stack versions in use: github.com/gin-gonic/gin v1.9.1' WHEN 5 THEN {_TESTS} END AS l3 FROM e JOIN p USING (k) WHERE c<>4), "
    f"h AS (SELECT *, '{packs.HEADER}' AS l0, {BUDGET} - (length(l0)+2)//3 AS r0 FROM l), a AS (SELECT *, coalesce((length(l1)+2)//3+1<=r0, false) AS f1, r0 - CASE WHEN f1 THEN (length(l1)+2)//3+1 ELSE 0 END AS r1 FROM h), "
    "b AS (SELECT *, coalesce((length(l2)+2)//3+1<=r1, false) AS f2, r1 - CASE WHEN f2 THEN (length(l2)+2)//3+1 ELSE 0 END AS r2 FROM a), c AS (SELECT *, coalesce((length(l3)+2)//3+1<=r2, false) AS f3, r2 - CASE WHEN f3 THEN (length(l3)+2)//3+1 ELSE 0 END AS r3 FROM b) "
    f"SELECT id, l0||CASE WHEN f1 THEN chr(10)||l1 ELSE '' END||CASE WHEN f2 THEN chr(10)||l2 ELSE '' END||CASE WHEN f3 THEN chr(10)||l3 ELSE '' END AS pack, ({BUDGET}-r3)::BIGINT AS tokens, (count(l1) OVER w + count(l2) OVER w + count(l3) OVER w - f1::INT - f2::INT - f3::INT)::BIGINT AS left_out FROM c WINDOW w AS (PARTITION BY id)"
}
