"""The languages of a source tree: how files are recognised, which are tests, how names and imports are read."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.globs import globs_regex


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    interpreters: tuple[str, ...] = ()
    index_files: tuple[str, ...] = ()
    tests: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    strategy: str | None = None  # how imports resolve: path, module, package, or not at all
    separator: str = "/"
    package_files: tuple[str, ...] = ()
    source_roots: tuple[str, ...] = ()
    tries: tuple[str, ...] = ()  # extensions that an import may leave out
    stand_ins: dict[str, tuple[str, ...]] = field(default_factory=dict, hash=False)
    same_package: bool = False


_WEB_TESTS = ("**/*.test.*", "**/*.spec.*", "**/__tests__/**", "**/test/**", "**/tests/**", "**/e2e/**")
#: Languages with their extensions, interpreters, test globs, affixes of test names and import rules.
LANGUAGES = (
    Language("python", (".py", ".pyi"), ("python", "python2", "python3", "pypy", "pypy3"), ("__init__.py",), ("**/test_*.py", "**/*_test.py", "**/tests/**/*.py", "**/test/**/*.py", "**/conftest.py"), ("test_",), ("_test",), "module", ".", ("__init__.py",), ("src",), (".py", ".pyi")),
    Language("typescript", (".ts", ".tsx", ".mts", ".cts"), ("ts-node", "tsx", "deno", "bun"), ("index.ts", "index.tsx"), _WEB_TESTS, (), (".test", ".spec"), "path", "/", ("index.ts", "index.tsx", "index.js", "index.jsx"), (), (".ts", ".tsx", ".d.ts", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"), {".js": (".ts", ".tsx"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}),
    Language("javascript", (".js", ".jsx", ".mjs", ".cjs"), ("node", "nodejs", "deno", "bun"), ("index.js", "index.jsx", "index.mjs", "index.cjs"), _WEB_TESTS, (), (".test", ".spec"), "path", "/", ("index.js", "index.jsx", "index.mjs", "index.cjs", "index.ts", "index.tsx"), (), (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx")),
    Language("go", (".go",), (), ("doc.go",), ("**/*_test.go",), (), ("_test",), "package", "/", same_package=True),
    Language("java", (".java",), (), ("package-info.java",), ("**/src/test/**", "**/src/testFixtures/**", "**/src/integrationTest/**", "**/*Test.java", "**/*Tests.java", "**/*IT.java"), (), ("Test", "Tests", "IT"), "module", ".", ("package-info.java",), (), (".java",)),
    Language("rust", (".rs",), (), ("lib.rs", "main.rs", "mod.rs"), ("**/tests/**/*.rs", "**/benches/**/*.rs"), (), ("_test", "_tests"), "module", "::", ("mod.rs",), (), (".rs",)),
    Language("c", (".c",), (), (), ("**/tests/**", "**/test/**", "**/*_test.*", "**/*_tests.*", "**/test_*.*"), ("test_",), ("_test", "_tests"), "path"),
    Language("cpp", (".cpp", ".cc", ".cxx", ".c++", ".hpp", ".hh", ".hxx", ".h++", ".h", ".ipp", ".tpp", ".inl"), (), (), ("**/tests/**", "**/test/**", "**/*_test.*", "**/*_tests.*", "**/*_unittest.*", "**/test_*.*"), ("test_",), ("_test", "_tests", "_unittest"), "path"),
    Language("csharp", (".cs",), (), (), ("**/*.Tests/**", "**/*.Test/**", "**/*.UnitTests/**", "**/*.IntegrationTests/**", "**/tests/**/*.cs", "**/test/**/*.cs", "**/*Tests.cs", "**/*Test.cs"), (), ("Tests", "Test"), None, "."),
    Language("kotlin", (".kt", ".kts"), ("kotlin", "kotlinc"), (), ("**/src/test/**", "**/src/androidTest/**", "**/src/commonTest/**", "**/src/jvmTest/**", "**/src/testFixtures/**", "**/*Test.kt", "**/*Tests.kt"), (), ("Test", "Tests", "IT"), "module", ".", tries=(".kt",)),
    Language("swift", (".swift",), ("swift",), (), ("**/Tests/**/*.swift", "**/*Tests.swift"), (), ("Tests", "Test"), "module", ".", tries=(".swift",)),
    Language("dart", (".dart",), (), (), ("**/*_test.dart", "**/test/**", "**/integration_test/**", "**/test_driver/**"), (), ("_test",), "path"),
)
BY_NAME = {x.name: x for x in LANGUAGES}


def language_of(path: str, first_line: str = "") -> str | None:
    """By extension; by the interpreter of a `#!` line where a file has none."""
    base = path.rsplit("/", 1)[-1]
    stem, dot, ext = base.rpartition(".")
    if dot and stem:
        return next((x.name for x in LANGUAGES if "." + ext.lower() in x.extensions), None)
    if not first_line.startswith("#!"):
        return None
    words = first_line[2:].split()
    if words and words[0].endswith("/env"):
        words = [w for w in words[1:] if not w.startswith("-") and "=" not in w]
    program = words[0].rsplit("/", 1)[-1].rstrip("0123456789.") if words else ""
    return next((x.name for x in LANGUAGES if program and program in {i.rstrip("0123456789.") for i in x.interpreters}), None)


def _by_language(lang: Column, of, default: Column) -> Column:
    return reduce(lambda out, x: F.when(lang == x.name, of(x)).otherwise(out), LANGUAGES, default)


def is_test(path: Column, lang: Column) -> Column:
    """Whether a path is a test by its language's globs; a path without a language is none."""
    return F.coalesce(_by_language(lang, lambda x: F.rlike(path, F.lit(globs_regex(list(x.tests)))), F.lit(False)), F.lit(False))


def test_stem(stem: Column, lang: Column) -> Column:
    """The stem of a test's name without the first prefix, else the first suffix, of its language that it has."""

    def strip(x: Language) -> Column:
        out = stem
        for s in reversed(x.suffixes):
            out = F.when(F.endswith(stem, F.lit(s)), F.substring(stem, F.lit(1), F.length(stem) - len(s))).otherwise(out)
        for p in reversed(x.prefixes):
            out = F.when(F.startswith(stem, F.lit(p)), F.substring(stem, F.lit(len(p) + 1), F.length(stem))).otherwise(out)
        return out

    return _by_language(lang, strip, stem)


def separator(lang: Column) -> Column:
    """How a language parts the names of a module; null where its imports don't resolve."""
    return _by_language(lang, lambda x: F.lit((x.separator if x.strategy == "module" else "/") if x.strategy else None).cast("string"), F.lit(None).cast("string"))


def imports_directories(lang: Column) -> Column:
    return F.coalesce(lang.isin(*[x.name for x in LANGUAGES if x.strategy == "package"]), F.lit(False))
