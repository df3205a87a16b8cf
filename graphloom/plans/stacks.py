"""Build files made of the part table, and their stack profile with DuckDB counterparts.

Each part is a module of one of four tools: a Maven module below the parent of its brand, which
lies below the root's; a crate of a workspace; a package with or without a lock; a Gradle build
that names entries of a catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extraction import manifests as mf
from ..session import settled
from .code import _filled, _sql

ROOT_POM = """<project xmlns="http://maven.apache.org/POM/4.0.0">
  <groupId>com.shop</groupId><artifactId>root</artifactId><version>9.0</version>
  <properties><lib.major>3</lib.major><lib.version>${lib.major}.1</lib.version></properties>
  <dependencyManagement><dependencies>
    <dependency><groupId>com.shop</groupId><artifactId>core</artifactId><version>${core.version}</version></dependency>
    <dependency><groupId>com.shop</groupId><artifactId>near</artifactId><version>1</version></dependency>
  </dependencies></dependencyManagement>
</project>
"""
BRAND_POM = """<project>
  <parent><groupId>com.shop</groupId><artifactId>root</artifactId><version>9.0</version></parent>
  <artifactId>brand-{b}</artifactId>
  <properties><core.version>2.{b}</core.version></properties>
  <dependencyManagement><dependencies>
    <dependency><groupId>com.shop</groupId><artifactId>near</artifactId><version>2</version></dependency>
  </dependencies></dependencyManagement>
</project>
"""
MODULE_POM = """<project>
  <parent><groupId>com.shop</groupId><artifactId>brand-{b}</artifactId><version>9.0</version></parent>
  <artifactId>m{k}</artifactId><version>1.{z}</version>
  <dependencies>
    <dependency><groupId>com.shop</groupId><artifactId>core</artifactId></dependency>
    <dependency><groupId>com.shop</groupId><artifactId>near</artifactId></dependency>
    <dependency><groupId>com.shop</groupId><artifactId>lib{z}</artifactId><version>${{lib.version}}</version></dependency>
    <dependency><groupId>${{project.groupId}}</groupId><artifactId>own</artifactId><version>7.{k}</version></dependency>
    <dependency><groupId>org.other</groupId><artifactId>unknown</artifactId></dependency>
  </dependencies>
</project>
"""
CRATE = """[package]
name = "c{k}"
version = "0.{z}.0"

[dependencies]
serde = {{ workspace = true }}
tokio = "1.{z}"
anyhow = "1"

[dependencies.before]
path = "../c{k4}"

[dev-dependencies]
tokio = "0.1"
rayon = {{ version = "1.{z}", features = ["web"] }}
"""
PACKAGE = """{{"name": "p{k}", "version": "{z}.0.0", "dependencies": {{"react": "^{z}.1.0", "left-pad": "1.x"}}, "devDependencies": {{"vite": "~{z}", "react": "0"}}}}
"""
LOCK = """{{"lockfileVersion": 3, "packages": {{"": {{"name": "p{k}"}}, "node_modules/react": {{"version": "{z}.1.7"}}, "node_modules/vite/node_modules/left-pad": {{"version": "0.0.1"}}}}}}
"""
BUILD = """plugins {{ id("java") }}
dependencies {{
    implementation(libs.okio.core)
    testImplementation(libs.junit)
    api("org.x:y{k}:1.{z}")
    implementation(libs.missing.entry)
}}
"""
FIXED = (
    ("java/pom.xml", ROOT_POM),
    ("rust/Cargo.toml", '[workspace]\nmembers = ["c*"]\n\n[workspace.dependencies]\nserde = "1.0.200"\n'),
    ("rust/Cargo.lock", 'version = 3\n\n[[package]]\nname = "anyhow"\nversion = "1.0.75"\n\n[[package]]\nname = "libc"\nversion = "0.2"\n'),
    ("jvm/gradle/libs.versions.toml", '[versions]\nokio = "3.9"\n\n[libraries]\nokio-core = { module = "com.squareup.okio:okio", version.ref = "okio" }\njunit = "junit:junit:4.13"\n'),
    ("broken/package.json", '{"name": '),
    ("tool/go.mod", "module example.com/tool\n\ngo 1.22\n\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.1\n\tgolang.org/x/sys v0.1.0 // indirect\n)\n\nrequire gorm.io/gorm v1.25.0\n"),
    ("tool/pyproject.toml", '[project]\nname = "tool"\nversion = "1.2"\ndependencies = ["Flask>=2 ; python_version > \'3\'", "numpy==1.26", "my_lib[fast]"]\n'),
    ("tool/uv.lock", 'version = 1\n\n[[package]]\nname = "flask"\nversion = "2.3.3"\n'),
)
#: Path and text of a part's build file by its key modulo 4.
KINDS = (("jvm/app{k}/build.gradle.kts", BUILD), ("rust/c{k}/Cargo.toml", CRATE), ("web/p{k}/package.json", PACKAGE), ("java/b{b}/m{k}/pom.xml", MODULE_POM))


def build_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of the tree."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.expr("substring(p_brand, 7, 10)").alias("b"), F.col("p_size").alias("z"), F.greatest(F.col("p_partkey") - 4, F.lit(0)).alias("k4"))
    kind = F.get(F.array(*[F.struct(_filled(path).alias("path"), _filled(text).alias("text")) for path, text in KINDS]), (F.col("k") % 4).cast("int"))
    own = p.select(kind.alias("f")).select("f.path", "f.text")
    locks = p.where("k % 4 = 2 and k % 3 = 0").select(_filled("web/p{k}/package-lock.json").alias("path"), _filled(LOCK).alias("text"))
    brands = p.where("k % 4 = 3").select("b").distinct().select(_filled("java/b{b}/pom.xml").alias("path"), _filled(BRAND_POM).alias("text"))
    return own.union(locks).union(brands).union(spark.createDataFrame(list(FIXED), "path string, text string"))


_P = "p AS (SELECT p_partkey AS k, substr(p_brand, 7) AS b, p_size AS z, greatest(p_partkey-4, 0) AS k4, p_partkey%4 AS m, p_partkey%3=0 AS locked FROM part)"
#: What a part's build file depends on by its key modulo 4: name, version, source.
LISTED = (
    (("com.squareup.okio:okio", "3.9", "catalog"), ("junit:junit", "4.13", "catalog"), ("org.x:y{k}", "1.{z}", "declared")),
    (("serde", "1.0.200", "workspace"), ("tokio", "1.{z}", "declared"), ("anyhow", "1.0.75", "lock"), ("before", "../c{k4}", "path"), ("rayon", "1.{z}", "declared")),
    (("left-pad", "1.x", "declared"), ("vite", "~{z}", "declared")),
    (("com.shop:core", "2.{b}", "inherited"), ("com.shop:near", "2", "inherited"), ("com.shop:lib{z}", "3.1", "property"), ("com.shop:own", "7.{k}", "declared"), ("org.other:unknown", "", "none")),
)
TOOL = ("gradle", "rust", "node", "maven")
OTHERS = (
    ("tool/go.mod", "go", "github.com/gin-gonic/gin", "v1.9.1", "declared"), ("tool/go.mod", "go", "gorm.io/gorm", "v1.25.0", "declared"),
    ("tool/pyproject.toml", "python", "flask", "2.3.3", "lock"), ("tool/pyproject.toml", "python", "numpy", "1.26", "declared"), ("tool/pyproject.toml", "python", "my-lib", "", "none"),
)
_DEPENDENCIES = (
    f"WITH {_P}, d AS ("
    + " UNION ALL ".join(f"SELECT {_sql(KINDS[m][0])} AS path, '{TOOL[m]}' AS tool, {_sql(name)} AS name, {_sql(version)} AS version, '{source}' AS source FROM p WHERE m={m}" for m in range(4) for name, version, source in LISTED[m])
    + f" UNION ALL SELECT {_sql(KINDS[2][0])}, 'node', 'react', CASE WHEN locked THEN z || '.1.7' ELSE '^' || z || '.1.0' END, CASE WHEN locked THEN 'lock' ELSE 'declared' END FROM p WHERE m=2"
    + "".join(f" UNION ALL SELECT {', '.join(repr(x) for x in row)}" for row in OTHERS)
    + ") "
)
_NAMES = (
    "CASE m WHEN 0 THEN NULL WHEN 1 THEN 'c' || k WHEN 2 THEN 'p' || k ELSE 'm' || k END AS name, CASE m WHEN 0 THEN NULL WHEN 1 THEN '0.' || z || '.0' WHEN 2 THEN z || '.0.0' ELSE '1.' || z END AS version, "
    "CASE m WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 3 ELSE 5 END AS dependencies, CASE m WHEN 1 THEN 'anyhow 1.0.75, rayon 1.' || z || ', serde 1.0.200, tokio 1.' || z WHEN 2 THEN 'react ' || CASE WHEN locked THEN z || '.1.7' ELSE '^' || z || '.1.0' END ELSE '' END AS frameworks"
)
_PROFILE = (
    f"WITH {_P}"
    + " SELECT path, tool, name, version, dependencies::BIGINT AS dependencies, frameworks FROM ("
    + " UNION ALL ".join(f"SELECT {_sql(KINDS[m][0])} AS path, '{TOOL[m]}' AS tool, {_NAMES} FROM p WHERE m={m}" for m in range(4))
    + " UNION ALL SELECT DISTINCT 'java/b' || b || '/pom.xml', 'maven', 'brand-' || b, '9.0', 0, '' FROM p WHERE m=3"
    + " UNION ALL SELECT 'java/pom.xml', 'maven', 'root', '9.0', 0, '' UNION ALL SELECT 'rust/Cargo.toml', 'rust', NULL, NULL, 0, '' UNION ALL SELECT 'broken/package.json', 'node', NULL, NULL, 0, ''"
    + " UNION ALL SELECT 'tool/go.mod', 'go', 'example.com/tool', '1.22', 2, 'github.com/gin-gonic/gin v1.9.1, gorm.io/gorm v1.25.0' UNION ALL SELECT 'tool/pyproject.toml', 'python', 'tool', '1.2', 3, 'flask 2.3.3, numpy 1.26')"
)
QUERIES = {
    "ex_stack_profile": lambda s, d: mf.dependencies(settled(mf.facts(build_files(s, d)), "facts")),
    "stack_profile": lambda s, d: mf.profile(settled(mf.facts(build_files(s, d)), "facts")),
}
ORACLES = {"ex_stack_profile": _DEPENDENCIES + "SELECT * FROM d", "stack_profile": _PROFILE}
