"""Build files: versions inherited over levels, cycles, odd files."""

from pyspark.sql import functions as F

from graphloom.extraction import manifests as mf


def found(spark, files):
    rows = mf.dependencies(mf.facts(spark.createDataFrame(files, "path string, text string"))).collect()
    return {(r["path"], r["name"]): (r["version"], r["source"]) for r in rows}


def pom(artifact, parent=None, body=""):
    above = f"<parent><groupId>g</groupId><artifactId>{parent}</artifactId><version>1</version></parent>" if parent else "<groupId>g</groupId>"
    return f"<project>{above}<artifactId>{artifact}</artifactId>{body}</project>"


DEP = "<dependencies><dependency><groupId>x</groupId><artifactId>y</artifactId>{}</dependency></dependencies>"


def test_versions_come_down_many_levels(spark):
    """Seven levels of parents; the nearest value of a property wins, and it may name another."""
    files = [("l0/pom.xml", pom("l0", None, "<properties><v>${w}.0</v><w>1</w></properties><dependencyManagement>" + DEP.format("<version>${v}</version>") + "</dependencyManagement>"))]
    files += [(f"l{i}/pom.xml", pom(f"l{i}", f"l{i - 1}", "<properties><w>5</w></properties>" if i == 3 else "") if i < 7 else pom("l7", "l6", DEP.format(""))) for i in range(1, 8)]
    assert found(spark, files) == {("l7/pom.xml", "x:y"): ("5.0", "inherited")}


def test_parents_in_a_circle_end(spark):
    files = [("a/pom.xml", pom("a", "b", DEP.format("<version>${v}</version>"))), ("b/pom.xml", pom("b", "a", "<properties><v>${v}x</v></properties>")), ("c/pom.xml", pom("c", "c", DEP.format("")))]
    got = found(spark, files)
    assert set(got) == {("a/pom.xml", "x:y"), ("c/pom.xml", "x:y")} and got["c/pom.xml", "x:y"] == ("", "none")


def test_closure_is_the_fixed_point(spark):
    links = [(str(i), str(i + 1)) for i in range(6)] + [("2", "0"), ("9", "9"), ("8", "3")]
    step = dict.fromkeys(links, 1)
    while True:
        more = {(a, d): step[a, b] + step[c, d] for a, b in step for c, d in step if b == c and a != d}
        new = {k: min(v, step.get(k, 99)) for k, v in more.items() if min(v, step.get(k, 99)) < step.get(k, 99) and v <= 8}
        if not new:
            break
        step |= new
    got = {(r["path"], r["above"]): r["depth"] for r in mf.closure(spark.createDataFrame(links, "path string, above string")).collect()}
    assert got == {k: v for k, v in step.items() if k[0] != k[1]}


def test_nearest_workspace_lock_and_catalog(spark):
    files = [
        ("Cargo.toml", '[workspace]\n[workspace.dependencies]\nserde = "1"\n'), ("deep/Cargo.toml", '[workspace]\n[workspace.dependencies]\nserde = { version = "2" }\n'),
        ("deep/a/Cargo.toml", '[package]\nname = "a"\n[dependencies]\nserde.workspace = true\ngone.workspace = true\n'), ("b/Cargo.toml", '[dependencies]\nserde = { workspace = true }\nl = { git = "https://x" }\n'),
        ("w/package-lock.json", '{"packages": {"node_modules/a": {"version": "1.0"}, "in/p/node_modules/a": {"version": "2.0"}, "node_modules/@s/b": {"version": "3"}}}'),
        ("w/in/p/package.json", '{"dependencies": {"a": "*", "@s/b": "*"}}'), ("w/in/q/package.json", '{"dependencies": {"a": "*", "c": "^1"}}'),
        ("gradle/libs.versions.toml", '[versions]\nv = { strictly = "7" }\n[libraries]\na_b-c = { group = "g", name = "n", version.ref = "v" }\n'), ("app/build.gradle", "dependencies {\n  implementation libs.a.b.c\n  api 'x:y'\n}"),
    ]
    assert found(spark, files) == {
        ("deep/a/Cargo.toml", "serde"): ("2", "workspace"), ("deep/a/Cargo.toml", "gone"): ("", "none"), ("b/Cargo.toml", "serde"): ("1", "workspace"), ("b/Cargo.toml", "l"): ("https://x", "git"),
        ("w/in/p/package.json", "a"): ("2.0", "lock"), ("w/in/p/package.json", "@s/b"): ("3", "lock"), ("w/in/q/package.json", "a"): ("1.0", "lock"), ("w/in/q/package.json", "c"): ("^1", "declared"),
        ("app/build.gradle", "g:n"): ("7", "catalog"), ("app/build.gradle", "x:y"): ("", "none"),
    }


def test_odd_files(spark):
    files = [("pom.xml", None), ("a/pom.xml", ""), ("package.json", "[1, {"), ("b/package.json", '["x"]'), ("Cargo.toml", "= broken"), ("notes.txt", "x")]
    rows = mf.facts(spark.createDataFrame(files, "path string, text string"))
    assert {r["path"] for r in rows.where("at = 'unreadable'").collect()} == {"a/pom.xml", "package.json", "Cargo.toml"}
    assert mf.dependencies(rows).count() == 0
    assert mf.profile(mf.facts(spark.createDataFrame([], "path string, text string"))).count() == 0
    assert mf.filled(F.lit("a"), F.lit(None).cast("map<string,string>")) is not None
