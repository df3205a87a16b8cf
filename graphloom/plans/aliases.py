"""Imports by aliases, workspace packages and crates: a tree made of the part table, with DuckDB counterparts.

A part is a script below its brand's configuration, which takes an alias and the base URL from a
chain of two others that ends in a cycle; a package that names the one before; or a crate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extraction.tables import CodeMap
from .code import _filled, _sql

#: Path, language and text of a part's files by its key modulo 3; `{k3}` and `{b3}` are the key and the brand of the part three before.
KINDS = (
    (
        ("web/b{b}/src/p{k}.ts", "typescript", "import {{ a }} from '@/b{b3}/src/p{k3}'\nimport {{ b }} from 'b{b3}/src/p{k3}.js'\nimport {{ c }} from '@/b{b3}/src/p{k3}.gone'\nimport pad from 'left-pad'\nexport const a = 1\n"),
        ("web/b{b}/tsconfig.json", None, '{{\n  // all by inheritance\n  "extends": "../conf/mid",\n}}\n'),
    ),
    (
        ("kit/k{k}/package.json", None, '{{"author": {{"name": "@shop/other"}}, "name": "@shop/k{k}"}}'),
        ("kit/k{k}/src/index.ts", "typescript", "import {{ x }} from '@shop/k{k3}'\nimport {{ y }} from '@shop/k{k3}/use'\nimport {{ z }} from '@shop/other'\n"),
        ("kit/k{k}/use.ts", "typescript", "export const y = {k}\n"),
    ),
    (
        ("rs/c{k}/Cargo.toml", None, '[package]\nversion = "0.1.0"\nname = "shop-c{k}"\n'),
        ("rs/c{k}/src/lib.rs", "rust", "use shop_c{k3}::Item;\nuse serde::Serialize;\n"),
        ("rs/c{k}/src/net.rs", "rust", "use shop_c{k3}::net::open;\nuse crate::Item;\nuse super::VERSION;\n"),
    ),
)
FIXED = (
    ("web/conf/mid.json", None, '{"extends": ["./base.json"], "compilerOptions": {"paths": {"@/*": ["gone/*", "./*"], "*": 1}}}'),
    ("web/conf/base.json", None, '{"extends": "./mid.json", "compilerOptions": {"baseUrl": ".."}}'),
)
#: Importer, target and the file that it names, which is there only if the part three before is; `always` needs none.
IMPORTS = (
    (0, "web/b{b}/src/p{k}.ts", "@/b{b3}/src/p{k3}", "web/b{b3}/src/p{k3}.ts", "before"),
    (0, "web/b{b}/src/p{k}.ts", "b{b3}/src/p{k3}.js", "web/b{b3}/src/p{k3}.ts", "before"),
    (0, "web/b{b}/src/p{k}.ts", "@/b{b3}/src/p{k3}.gone", None, "always"),
    (0, "web/b{b}/src/p{k}.ts", "left-pad", None, "always"),
    (1, "kit/k{k}/src/index.ts", "@shop/k{k3}", "kit/k{k3}/src/index.ts", "before"),
    (1, "kit/k{k}/src/index.ts", "@shop/k{k3}/use", "kit/k{k3}/use.ts", "before"),
    (1, "kit/k{k}/src/index.ts", "@shop/other", None, "always"),
    (2, "rs/c{k}/src/lib.rs", "shop_c{k3}::Item", "rs/c{k3}/src/lib.rs", "before"),
    (2, "rs/c{k}/src/lib.rs", "serde::Serialize", None, "always"),
    (2, "rs/c{k}/src/net.rs", "shop_c{k3}::net::open", "rs/c{k3}/src/net.rs", "before"),
    (2, "rs/c{k}/src/net.rs", "crate::Item", "rs/c{k}/src/lib.rs", "always"),
    (2, "rs/c{k}/src/net.rs", "super::VERSION", "rs/c{k}/src/lib.rs", "always"),
)
_P = "p AS (SELECT a.p_partkey AS k, substr(a.p_brand, 7) AS b, greatest(a.p_partkey-3, 0) AS k3, coalesce(substr(c.p_brand, 7), 'none') AS b3, c.p_partkey IS NOT NULL AS before, true AS always FROM part a LEFT JOIN part c ON c.p_partkey = a.p_partkey-3)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, lang, text) of the tree."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.expr("substring(p_brand, 7, 10)").alias("b"))
    before = p.select((F.col("k") + 3).alias("k"), F.col("b").alias("b3"))
    p = p.join(before, "k", "left").select("k", "b", F.greatest(F.col("k") - 3, F.lit(0)).alias("k3"), F.coalesce("b3", F.lit("none")).alias("b3"))
    own = F.get(F.array(*[F.array(*[F.struct(_filled(path).alias("path"), F.lit(lang).cast("string").alias("lang"), _filled(text).alias("text")) for path, lang, text in kind]) for kind in KINDS]), (F.col("k") % 3).cast("int"))
    return p.select(F.explode(own).alias("f")).select("f.*").distinct().unionByName(spark.createDataFrame(list(FIXED), "path string, lang string, text string"))


_ROWS = " UNION ALL ".join(f"SELECT {_sql(path)} AS path, {_sql(target)} AS target, CASE WHEN {there} THEN {_sql(file)} END AS resolved FROM p WHERE k%3={m}" for m, path, target, file, there in IMPORTS)
QUERIES = {"ex_resolve_declared": lambda s, d: CodeMap.of(sources(s, d)).imports}
ORACLES = {"ex_resolve_declared": f"WITH {_P} {_ROWS}"}
