"""Schemas of the relations: files, symbols, imports, call sites, skipped files, telemetry rows."""

from __future__ import annotations

FILES = "path string, dir string, lang string, hash string, size bigint, mtime_ns bigint, doc string, is_test boolean"
SYMBOLS = "id bigint, path string, name string, kind string, parent string, signature string, start_line bigint, end_line bigint, visibility string, doc string, doc_source string"
IMPORTS = "path string, target string, resolved string"
REFS = "path string, name string, line bigint, kind string"
SKIPPED = "path string, size bigint, mtime_ns bigint"
_USAGE = "struct<input: bigint, output: bigint, cache_creation: bigint, cache_read: bigint>"
TELEMETRY = (
    f"v int, kind string, at string, session string, task string, category string, size string, large boolean, assisted boolean, modules array<string>, main map<string, {_USAGE}>, "
    f"delegated map<string, {_USAGE}>, tools map<string, bigint>, prompts bigint, active_s double, injected_chars bigint, host_version string, asked boolean, source string, bench string"
)
