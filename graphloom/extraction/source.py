"""Symbols, imports and call sites of one source file.

Python is read by its own parser; a line that it can't read is blanked, as often as that
helps. The languages with braces are read from their declarations: strings and comments are
masked, so that neither is taken for code, and a declaration reaches to the brace that closes
its body. What is declared inside a function stays local and isn't listed.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import astuple, dataclass, field
from itertools import accumulate

from .prose import clean_comment, header, trimmed

SIGNATURE = 160
CALLABLE = ("function", "method")
SCOPES = ("class", "interface", "struct", "enum", "trait", "impl", "namespace", "module", "record")


@dataclass
class Symbol:
    name: str
    kind: str
    parent: str | None
    signature: str | None
    start_line: int
    end_line: int
    visibility: str | None
    doc: str | None
    doc_source: str | None = None


@dataclass
class Parsed:
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    refs: list[tuple[int, str]] = field(default_factory=list)
    doc: str | None = None


_TIDY = tuple((re.compile(pattern), new) for pattern, new in ((r"([(\[{]) ", r"\1"), (r" ([)\]}])", r"\1"), (r", *([)\]}])", r"\1"), (r"(\s*(\{|:|=>|=|;|,))+$", "")))


def normal_signature(text: str) -> str:
    """One line, no blanks inside brackets, no trailing comma or opener, at most SIGNATURE characters."""
    text = " ".join(text.split())
    for pattern, new in _TIDY:
        text = pattern.sub(new, text)
    return text if len(text) <= SIGNATURE else text[: SIGNATURE - 1].rstrip() + "…"


def qualified_signature(signature: str | None, name: str, parent: str | None) -> str:
    """The signature with its parent before the name, unless it stands there already."""
    own = signature or name
    if not parent:
        return own
    if re.search(rf"(?:\.|::|#|\)\s*){re.escape(name)}(?!\w)", own.split("(")[0]):
        return own
    at = re.search(rf"(?<!\w){re.escape(name)}(?!\w)", own)
    return own[: at.start()] + parent + "." + own[at.start() :] if at else f"{parent}.{own}"


def lines_of(text: str) -> list[str]:
    """Lines cut at \\n alone, without one \\r at their ends and without an empty last one."""
    found = text.split("\n")
    if found[-1] == "":
        found.pop()
    return [line.removesuffix("\r") for line in found]


# Python


def _python_tree(text: str, tries: int = 20) -> tuple[ast.Module, str]:
    lines = text.split("\n")
    for _ in range(tries):
        try:
            return ast.parse("\n".join(lines)), "\n".join(lines)
        except SyntaxError as e:
            at = min(max((e.lineno or 1) - 1, 0), len(lines) - 1)
            while at >= 0 and not lines[at].strip():
                at -= 1
            if at < 0:
                break
            lines[at] = ""
        except ValueError:
            break
    return ast.Module([], []), ""


#: Nodes below which there are no others.
_LEAVES = (ast.Constant, ast.Name, ast.alias)
_HEAD, _EDGE = re.compile(r"\b(?:class|def)\s+"), re.compile(r"\b")
_QUOTED, _BRACKETS = re.compile(r"'[^'\n]*'|\"[^\"\n]*\"|#[^\n]*"), re.compile(r"[(\[{)\]}:]")
_NOTES = re.compile(r"(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|#[^\n]*")
_DUNDER, _CAPITALS = re.compile("__.*__"), re.compile("_?[A-Z][A-Z0-9_]*")


def _named_at(head: str, name: str) -> int:
    """Where the name stands behind the first class or def that it follows, else 0. No pattern is made of a name: each would be compiled anew."""
    return next((m.end() for m in _HEAD.finditer(head) if head.startswith(name, m.end()) and _EDGE.match(head, m.end() + len(name))), 0)


def _nodes(tree: ast.AST) -> Iterator[ast.AST]:
    """Every node but those that only say how a name is used, in no order."""
    open_ = [tree]
    while open_:
        node = open_.pop()
        yield node
        if type(node) in _LEAVES:
            continue
        for name in node._fields:
            value = getattr(node, name, None)
            if type(value) is list:
                open_ += [v for v in value if isinstance(v, ast.AST)]
            elif name != "ctx" and isinstance(value, ast.AST):
                open_.append(value)


def _no_comments(text: str) -> str:
    return _NOTES.sub(lambda m: m[1] or "", text) if "#" in text else text


def python(text: str) -> Parsed:
    tree, text = _python_tree(text)
    rows, out = text.split("\n"), Parsed()
    shown = lambda name: "public" if _DUNDER.fullmatch(name) else "private" if name.startswith("_") else "public"

    def above(line: int) -> str | None:
        """The run of comment lines that ends right above a line."""
        first = line
        while first > 1 and rows[first - 2].lstrip().startswith("#") and not rows[first - 2].startswith("#!"):
            first -= 1
        return clean_comment("\n".join(rows[first - 1 : line - 1])) or None if first < line else None

    def visit(body: list, parent: str | None, inside: str) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                a_class = isinstance(node, ast.ClassDef)
                if inside != "function":
                    head = "\n".join(rows[node.lineno - 1 : node.body[0].lineno])
                    begin = _named_at(head, node.name)
                    # the head ends at the colon that is outside of all brackets
                    depth, end, bare = 0, len(head), _QUOTED.sub(lambda m: " " * len(m[0]), head)
                    for m in _BRACKETS.finditer(bare[begin:]):
                        depth += (m[0] in "([{") - (m[0] in ")]}")
                        if m[0] == ":" and not depth:
                            end = begin + m.start()
                            break
                    kind = "class" if a_class else "method" if inside == "class" else "function"
                    doc = ast.get_docstring(node) or above(first)
                    out.symbols.append(Symbol(node.name, kind, parent, normal_signature(_no_comments(head[begin:end])), first, node.end_lineno, shown(node.name), trimmed(doc.split("\n")) if doc else None))
                if inside != "function":
                    visit(node.body, f"{parent}.{node.name}" if parent else node.name, "class" if a_class else "function")
            elif isinstance(node, ast.Assign | ast.AnnAssign) and inside == "module":
                for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(target, ast.Name) and _CAPITALS.fullmatch(target.id):
                        out.symbols.append(Symbol(target.id, "constant", None, normal_signature(_no_comments(rows[node.lineno - 1][node.col_offset :])), node.lineno, node.end_lineno, shown(target.id), above(node.lineno)))
            elif isinstance(node, ast.If | ast.Try | ast.With):
                for part in ("body", "orelse", "finalbody"):
                    visit(getattr(node, part, []), parent, inside if inside != "module" else "block")
                for handler in getattr(node, "handlers", []):
                    visit(handler.body, parent, inside)

    visit(tree.body, None, "module")
    for node in _nodes(tree):
        if isinstance(node, ast.Import):
            out.imports += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module != "__future__":
            base = "." * node.level + (node.module or "")
            out.imports += [base if a.name == "*" else base + ("" if base.endswith(".") else ".") + a.name for a in node.names]
        elif isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name):
                out.refs.append((node.func.lineno, node.func.id))
            elif isinstance(node.func, ast.Attribute):
                out.refs.append((node.func.end_lineno, node.func.attr))
    blocks, run = [], []
    for row in rows:
        if row.startswith("#") and not (row.startswith("#!") and not run):
            run.append(row)
        elif row.startswith("#!"):
            continue
        elif row.strip():
            break
        elif run:
            blocks.append(clean_comment("\n".join(run)))
            run = []
    out.doc = ast.get_docstring(tree) or header([*blocks, clean_comment("\n".join(run))] if run else blocks)
    return out


# languages with braces

_TOKENS = {
    "go": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`",
    "rust": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'",
    "": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`",
}
_TOKENS = {lang: re.compile(pattern, re.S) for lang, pattern in _TOKENS.items()}
_NOT_NEWLINE, _BRACES, _MARKS = re.compile(r"[^\n]"), re.compile(r"[{}]"), re.compile(r"[()\[\]{};\n]")
_LINE_END, _GOES_ON, _UNFINISHED = re.compile(r"[;\n]"), re.compile(r"\s*[{.?:|&=]"), re.compile(r"(=>|[=,|&(:])\s*$")
#: A word is tried once: neither its endings nor its beginnings can do what the whole of it can't.
_CALLED = re.compile(r"(?<![A-Za-z_$])([A-Za-z_$][\w$]*+)\s*(?:<[\w\s,.<>\[\]]*>)?(?=\()")
_ATTRIBUTE, _ANNOTATION, _ABOVE = re.compile(r"#!?\[\s*$"), re.compile(r"@\w*$"), re.compile(r"\s*(@\w|#\[)")
_MODIFIERS = r"(?:(?:public|protected|private|internal|static|final|abstract|sealed|override|readonly|async|default|synchronized|native|strictfp|virtual|partial|open|declare|export)\s+)*"
_JAVA_TYPE = r"[\w.$]+(?:\s*<[^;{}()=]*>)?(?:\s*\[\s*\])*"
#: Declarations of a language: kind, pattern over the masked text (`name`, and where it applies `sig`, `mods`, `parent`).
_SCRIPT = (
    ("class", r"^[ \t]*+(?P<mods>(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?)class\s+(?P<name>[\w$]+)"),
    ("interface", r"^[ \t]*+(?P<mods>(?:export\s+)?(?:default\s+)?(?:declare\s+)?)interface\s+(?P<name>[\w$]+)"),
    ("type", r"^[ \t]*+(?P<mods>(?:export\s+)?(?:declare\s+)?)type\s+(?P<name>[\w$]+)(?=[^\n=;]*=)"),
    ("enum", r"^[ \t]*+(?P<mods>(?:export\s+)?(?:declare\s+)?(?:const\s+)?)enum\s+(?P<name>[\w$]+)"),
    ("namespace", r"^[ \t]*+(?P<mods>(?:export\s+)?(?:declare\s+)?)namespace\s+(?P<name>[\w$.]+)"),
    ("function", r"^[ \t]*+(?P<mods>(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?)function\s*\*?\s*(?P<name>[\w$]+)"),
    ("function", r"^[ \t]*+(?P<mods>(?:export\s+)?)(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?=(?:<[^=\n]*>\s*)?(?P<arrow>\((?:[^()]|\([^()]*\))*\)|[\w$]+)\s*(?::[^=\n]+)?=>)"),
    ("constant", r"^(?P<mods>export\s+)(?:const|let)\s+(?P<name>[\w$]+)\s*(?=[:=])"),
    ("constant", r"^(?P<mods>)(?:const|let)\s+(?P<name>_?[A-Z][A-Z0-9_]*)\s*(?=[:=])"),
    ("member", r"^[ \t]++(?P<mods>(?:(?:public|private|protected|static|readonly|async|abstract|override|get|set)\s+)*)\*?(?P<name>#?[\w$]+)\s*(?=[<(])"),
    ("member", r"^[ \t]++(?P<mods>(?:(?:public|private|protected|static|readonly)\s+)*)(?P<name>#?[\w$]+)\s*=\s*(?:async\s+)?(?=(?P<arrow>\((?:[^()]|\([^()]*\))*\)|[\w$]+)\s*(?::[^=\n]+)?=>)"),
)
DECLARATIONS = {
    "typescript": _SCRIPT,
    "javascript": _SCRIPT,
    "go": (
        ("method", r"^func\s*\(\s*(?:\w+\s+)?\*?\s*(?P<parent>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<name>\w+)"),
        ("function", r"^func\s+(?P<name>\w+)"),
        ("struct", r"^(?:type\s+|\t)(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\s*(?=\{)"),
        ("interface", r"^(?:type\s+|\t)(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\s*(?=\{)"),
        ("type", r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?!struct\b|interface\b)=?\s*(?=\S)"),
        ("constant", r"^const\s+(?P<name>\w+)"),
        ("variable", r"^var\s+(?P<name>\w+)"),
        ("member", r"^[ \t]++(?P<name>[A-Za-z_]\w*)(?=\()"),
    ),
    "java": (
        ("class", rf"^[ \t]*+(?P<mods>{_MODIFIERS})(?:class|record)\s+(?P<name>\w+)"),
        ("interface", rf"^[ \t]*+(?P<mods>{_MODIFIERS})@?interface\s+(?P<name>\w+)"),
        ("enum", rf"^[ \t]*+(?P<mods>{_MODIFIERS})enum\s+(?P<name>\w+)"),
        ("member", rf"^[ \t]++(?P<mods>{_MODIFIERS})(?P<sig>(?:<[^;{{}}()]*>\s*)?(?!return\b|new\b|else\b|throw\b|case\b|public\b|protected\b|private\b|static\b){_JAVA_TYPE}\s+)(?P<name>\w+)\s*(?=\()"),
        ("member", rf"^[ \t]++(?P<mods>{_MODIFIERS})(?P<name>[A-Z]\w*)\s*(?=\([^;]*?\)\s*(?:throws [\w., ]+)?\{{)"),
        ("constant", rf"^[ \t]++(?P<mods>(?=[^=;\n]*\bstatic\b)(?=[^=;\n]*\bfinal\b){_MODIFIERS})(?P<sig>{_JAVA_TYPE}\s+)(?P<name>\w+)\s*(?==)"),
    ),
    "rust": (
        ("struct", r"^[ \t]*+(?P<mods>(?:pub(?:\s*\([^)]*\))?\s+)?)struct\s+(?P<name>\w+)"),
        ("enum", r"^[ \t]*+(?P<mods>(?:pub(?:\s*\([^)]*\))?\s+)?)enum\s+(?P<name>\w+)"),
        ("trait", r"^[ \t]*+(?P<mods>(?:pub(?:\s*\([^)]*\))?\s+)?)(?:unsafe\s+)?trait\s+(?P<name>\w+)"),
        ("impl", r"^[ \t]*+(?P<mods>)(?:unsafe\s+)?impl(?:\s*<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>\w+)"),
        ("module", r"^[ \t]*+(?P<mods>(?:pub(?:\s*\([^)]*\))?\s+)?)mod\s+(?P<name>\w+)\s*(?=\{)"),
        ("type", r"^(?P<mods>(?:pub(?:\s*\([^)]*\))?\s+)?)type\s+(?P<name>\w+)"),
        ("constant", r"^[ \t]*+(?P<mods>(?:pub(?:\s*\([^)]*\))?\s+)?)(?:const|static)\s+(?:mut\s+)?(?P<name>[A-Z_]\w*)\s*(?=:)"),
        ("function", r"^[ \t]*+(?P<mods>(?:pub(?:\s*\([^)]*\))?\s+)?)(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(?P<name>\w+)"),
    ),
}
_PATTERNS = {lang: [(kind, re.compile(pattern, re.M)) for kind, pattern in rows] for lang, rows in DECLARATIONS.items()}
#: Words without which a text has no declaration of a kind; of the kinds that aren't listed, none is certain.
_NEEDED = {k: k for k in ("class", "interface", "enum", "namespace", "struct", "trait", "impl", "type")}
_NEEDED_OF = {("java", "class"): ("class", "record"), ("rust", "function"): ("fn",), ("go", "function"): ("func",), ("go", "method"): ("func",), ("java", "constant"): ("static",), ("rust", "module"): ("mod",)}
#: Words before a bracket that are no calls.
NOT_CALLS = frozenset("if for while switch catch return function func fn typeof sizeof new await match loop else do super this case assert defer go select range when in is as not and or import constructor def class with const async pub var let type struct interface".split())
IMPORTS = {
    "go": r"^import\s+(?:\w+\s+|\.\s+|_\s+)?\"([^\"]+)\"|^import\s*\((?P<many>[^)]*)\)",
    "java": r"^import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;",
    "rust": r"^[ \t]*(?:pub(?:\s*\([^)]*\))?\s+)?use\s+([^;]+);",
    "typescript": r"^[ \t]*(?:import|export)\s+(?:type\s+)?(?:[^'\";]*?\s+from\s+)?['\"]([^'\"]+)['\"]|\b(?:require|import)\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
}
IMPORTS["javascript"] = IMPORTS["typescript"]
_IMPORTED = {lang: re.compile(pattern, re.M) for lang, pattern in IMPORTS.items()}


def _masked(text: str, lang: str) -> tuple[str, str, list[tuple[int, int]]]:
    """The text with strings and comments blanked, with comments blanked only, and where the comments are."""
    comments: list[tuple[int, int]] = []
    code, bare, done = [], [], 0
    for m in _TOKENS.get(lang, _TOKENS[""]).finditer(text):
        token, (a, b) = m[0], m.span()
        blank = _NOT_NEWLINE.sub(" ", token) if "\n" in token else " " * len(token)
        note = token.startswith(("//", "/*"))
        if note:
            comments.append((a, b))
        between = text[done:a]
        code += between, blank
        bare += between, blank if note else token
        done = b
    return "".join(code) + text[done:], "".join(bare) + text[done:], comments


def _closing(code: str, at: int) -> int:
    depth = 0
    for m in _BRACES.finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(code)


def _extent(code: str, at: int, lang: str, kind: str) -> tuple[int | None, int]:
    """Where the body of a declaration opens (None: it has none) and where the declaration ends."""
    depth = 0
    for m in _MARKS.finditer(code, at):
        c = m[0]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth > 0 and c != "{":
            continue
        elif c == "{":
            if depth > 0 or kind in ("type", "constant", "variable"):
                end = _closing(code, m.start())
                if depth > 0:
                    continue
                rest = _LINE_END.search(code, end)
                return None, rest.start() if rest else end
            return m.start(), _closing(code, m.start())
        elif c == ";":
            return None, m.end()
        elif c == "\n" and lang in ("go", "typescript", "javascript"):
            if lang != "go" and _GOES_ON.match(code, m.end()):
                continue
            if _UNFINISHED.search(code, at, m.start()):
                continue
            return None, m.start()
    return None, len(code)


def _shown(lang: str, name: str, mods: str, kind: str, parent_kind: str | None, parent_shown: str | None) -> str | None:
    words = mods.split()
    if kind in ("impl", "namespace", "module") and lang == "rust" and kind == "impl":
        return None
    if lang == "go":
        return "public" if name[:1].isupper() else "private"
    if lang == "java":
        given = next((v for v in ("private", "protected", "public") if v in words), None)
        return given or (parent_shown if parent_kind == "interface" and parent_shown else "internal")
    if lang == "rust":
        if mods.startswith("pub"):
            return "public" if words == ["pub"] else "private" if re.fullmatch(r"pub\s*\(\s*self\s*\)\s*", mods) else "internal"
        return parent_shown if parent_kind == "trait" and parent_shown else "public" if parent_kind == "impl for" else "private"
    given = next((v for v in ("private", "protected", "public") if v in words), None)
    if given or name.startswith("#"):
        return given or "private"
    if parent_kind in ("class", "interface"):
        return parent_shown if parent_kind == "interface" else "public"
    return "public" if "export" in words else "private"


def braces(text: str, lang: str) -> Parsed:
    code, bare, comments = _masked(text, lang)
    rows = text.split("\n")
    starts = [0, *accumulate(len(row) + 1 for row in rows[:-1])]
    line_at = lambda i: bisect_right(starts, i)
    out = Parsed()
    by_last = {line_at(b - 1): (a, b) for a, b in comments if not text[starts[line_at(a) - 1] : a].strip()}

    def above(line: int) -> str | None:
        parts: list[str] = []
        while span := by_last.get(line - 1):
            raw = text[slice(*span)]
            if raw.startswith(("//!", "/*!")) or (parts and raw.startswith("/*")):
                break
            parts.insert(0, raw)
            line = line_at(span[0])
            if raw.startswith("/*"):
                break
        return clean_comment("\n".join(parts)) or None if parts else None

    # blocks of const ( ... ) and var ( ... )
    found: list[tuple[int, int, str, re.Match, int, int]] = []
    for rank, (kind, pattern) in enumerate(_PATTERNS[lang]):
        needed = _NEEDED_OF.get((lang, kind)) or ((_NEEDED[kind],) if kind in _NEEDED else ("",))
        if not any(word in code for word in needed):
            continue
        for m in pattern.finditer(code):
            found.append((m.start("name"), m.end(), kind, m, m.start(), rank))
    if lang == "go":
        for m in re.finditer(r"^(const|var)\s*\(", code, re.M):
            end = code.find("\n)", m.end())
            for row in re.finditer(r"^[ \t]+(?P<name>\w+)(?=[ \t,=\n])", code[: end if end > 0 else len(code)][m.end() :], re.M):
                a = m.end() + row.start("name")
                if code[m.end() : a].count("{") == code[m.end() : a].count("}") and code[m.end() : a].count("(") == code[m.end() : a].count(")"):
                    found.append((a, m.end() + row.end(), "constant" if m[1] == "const" else "variable", row, a, 0))
    found.sort(key=lambda x: (x[0], x[5]))
    scopes: list[tuple[int, int, str, str, str | None]] = []  # body's start and end, qualified name, kind, visibility
    taken: set[int] = set()
    for at, after, kind, m, first, _ in found:
        if at in taken:
            continue
        while scopes and at >= scopes[-1][1]:
            scopes.pop()
        inner = scopes[-1] if scopes else None
        if inner and inner[3] in CALLABLE:
            continue
        name = m["name"]
        if kind == "member":
            if not inner or inner[3] not in ("class", "interface", "enum", "record") or name in NOT_CALLS - {"constructor"} or code[inner[0] : at].count("{") != code[inner[0] : at].count("}") + 1:
                continue
            kind = "method"
        elif kind in ("constant", "variable") and lang != "java" and inner and inner[3] not in ("impl", "impl for", "trait", "module", "namespace"):
            continue
        if lang == "go" and kind in ("struct", "interface") and code[first] == "\t" and not re.search(r"^type\s*\(", code, re.M):
            continue
        body, end = _extent(code, after, lang, kind)
        groups = m.groupdict()
        if groups.get("arrow") is None and kind == "method" and body is None and lang in ("typescript", "javascript") and inner[3] == "class" and "abstract" not in (groups.get("mods") or ""):
            if not re.match(r"\s*[;\n]", code[end - 1 : end + 1]) or "=" in code[after:end]:
                continue
        arrow = groups.get("arrow")
        if arrow is not None:
            body = code.find("=>", m.end("arrow")) + 2
            opens = re.match(r"\s*\{", code[body:])
            end = _closing(code, body + opens.end() - 1) if opens else _extent(code, body, lang, "constant")[1]
        taken.add(at)
        parent = groups.get("parent") or (inner[2] if inner else None)
        if kind == "function" and inner and inner[3] in ("class", "interface", "impl", "impl for", "trait", "struct"):
            kind = "method"
        sig_from = m.start("sig") if groups.get("sig") is not None else at
        if arrow is not None:
            params = bare[m.start("arrow") : body].rstrip().removesuffix("=>")
            signature = normal_signature(name + (params if params.lstrip().startswith(("(", "<")) else f"({params.strip()})"))
        else:
            stop = body if body is not None else end
            if kind in ("constant", "variable", "type") or body is None:
                newline = text.find("\n", sig_from)
                stop = min(stop, newline if newline >= 0 else len(text))
            signature = normal_signature(bare[sig_from:stop])
        if kind in SCOPES and kind != "namespace":
            signature = normal_signature(bare[at : body if body is not None else end])
            signature = re.sub(r"\s+(struct|interface)$", "", signature) if lang == "go" else signature
            if kind == "impl":
                signature = normal_signature(re.sub(r"^\s*(unsafe\s+)?impl(\s*<[^>]*>)?\s+", "", bare[first : body if body is not None else end]))
        begin = first + len(code[first:at]) - len(code[first:at].lstrip())
        line = line_at(begin)
        while line > 1 and lang != "go" and _ABOVE.match(rows[line - 2]):
            line -= 1
        shown = _shown(lang, name, groups.get("mods") or "", kind, inner[3] if inner else None, inner[4] if inner else None)
        out.symbols.append(Symbol(name, kind, parent, signature, line, max(line_at(max(end - 1, at)), line), shown, above(line)))
        if body is not None or kind in SCOPES:
            scope = "impl for" if kind == "impl" and " for " in signature else kind
            scopes.append((body if body is not None else end, end, f"{parent}.{name}" if parent and kind != "impl" else name, scope, shown))
    for m in _CALLED.finditer(code):
        at = m.start()
        if at in taken or m[1] in NOT_CALLS or _ATTRIBUTE.search(code[max(0, at - 8) : at]):
            continue
        if lang == "java" and _ANNOTATION.search(code[max(0, at - 1) : at]):
            continue
        out.refs.append((line_at(at), m[1]))
    for m in _IMPORTED[lang].finditer(bare):
        if lang == "go" and m["many"] is not None:
            out.imports += re.findall(r"\"([^\"]+)\"", m["many"])
        else:
            target = next(g for g in m.groups() if g)
            out.imports += _rust_paths(target) if lang == "rust" else [target]
    blocks: list[str] = []
    reach = 0
    used = {id(s.doc): s.doc for s in out.symbols if s.doc}
    for a, b in comments:
        if code[:a].strip() or text[:a].strip() and not blocks and reach == 0 and not text[:a].startswith("#!"):
            break
        raw = text[a:b]
        if blocks and line_at(a) == reach + 1 and not raw.startswith("/*"):
            blocks[-1] += "\n" + raw
        else:
            blocks.append(raw)
        reach = line_at(b - 1)
    out.doc = header([c for c in map(clean_comment, blocks) if c not in used.values()])
    return out


def _rust_paths(tree: str) -> list[str]:
    tree = re.sub(r"\s+as\s+\w+|\s+", lambda m: "" if m[0].isspace() else "", tree)
    group = re.search(r"\{(.*)\}$", tree)
    if not group:
        return [tree]
    parts, depth, word = [], 0, ""
    for c in group[1] + ",":
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            parts += [word] if word else []
            word = ""
        else:
            word += c
    head = tree[: group.start()]
    return [x for p in parts for x in _rust_paths(head.removesuffix("::") if p == "self" else head + p)]


def parse(text: str, lang: str | None) -> Parsed:
    """What a file of a language declares, imports and calls; nothing where the language isn't read."""
    found = python(text) if lang == "python" else braces(text, lang) if lang in DECLARATIONS else Parsed()
    found.symbols.sort(key=lambda s: (s.start_line, -s.end_line, s.kind, s.name, s.parent or ""))
    for s in found.symbols:
        s.doc_source = "author" if s.doc else None
    found.imports = sorted(set(found.imports))
    found.refs = sorted(set(found.refs))
    return found


def symbol_rows(text: str, lang: str | None) -> list[tuple]:
    return [astuple(s) for s in parse(text, lang).symbols]
