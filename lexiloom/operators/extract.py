"""Symbols and references of source files: Python through its own parser, other languages through a lexer.

One file is one unit of work (mapInArrow); files of more than ``MOST`` characters give nothing, Python that does not parse is read by lines.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from lexiloom.arrow import emitted, mapped, slices
from lexiloom.operators.structural import PART, brace_end, split_lines
from lexiloom.schema import REF_KINDS, SYMBOL_KINDS

MOST = 10_000_000
_NAME = r"[A-Za-z_$][\w$]*"

# For each language, lines that define something, and the kind of it; the group gives the name.
_SCRIPT = (
    (rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{_NAME})", "function"), (rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>{_NAME})", "class"),
    (rf"^\s*(?:export\s+)?interface\s+(?P<name>{_NAME})", "interface"), (rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+(?P<name>{_NAME})", "enum"), (rf"^\s*(?:export\s+)?type\s+(?P<name>{_NAME})\s*[=<]", "type"),
    (rf"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>{_NAME})", "variable"), (rf"^\s+(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*(?P<name>{_NAME})\s*\([^;]*\)\s*(?::[^{{;]+)?\{{", "method"),
)
_C = (
    (r"^\s*#\s*define\s+(?P<name>\w+)", "constant"), (r"^\s*(?:typedef\s+)?struct\s+(?P<name>\w+)\s*\{?$", "struct"), (r"^\s*(?:typedef\s+)?union\s+(?P<name>\w+)", "struct"), (r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?(?P<name>\w+)", "enum"),
    (r"^\s*typedef\s+.*\b(?P<name>\w+)\s*;", "type"), (r"^(?!\s*(?:return|else|if|for|while|switch)\b)[\w\s*&:<>,~]*?[\w*&>]\s+\**(?P<name>~?\w+)\s*\([^;]*\)\s*(?:const\s*)?\{?\s*$", "function"),
)
DEFINITIONS: dict[str, tuple[tuple[str, str], ...]] = {
    "go": ((r"^func\s+\(\s*\w*\s*(?P<of>\*?\w+)[^)]*\)\s*(?P<name>\w+)", "method"), (r"^func\s+(?P<name>\w+)", "function"), (r"^\s*type\s+(?P<name>\w+)(?:\[.*\])?\s+struct\b", "struct"), (r"^\s*type\s+(?P<name>\w+)(?:\[.*\])?\s+interface\b", "interface"), (r"^\s*type\s+(?P<name>\w+)", "type"), (r"^\s*var\s+(?P<name>\w+)", "variable"), (r"^\s*const\s+(?P<name>\w+)", "constant")),
    "javascript": _SCRIPT, "typescript": _SCRIPT, "tsx": _SCRIPT, "c": _C,
    "cpp": ((r"^\s*namespace\s+(?P<name>\w+)", "module"), (r"^\s*(?:template\s*<[^>]*>\s*)?class\s+(?P<name>\w+)", "class"), (r"^[\w\s*&:<>,]*?\b(?P<of>\w+)::(?P<name>~?\w+)\s*\([^;]*\)[^;]*\{?\s*$", "method"), *_C),
    "php": ((r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)+function\s+&?(?P<name>\w+)", "method"), (r"^\s*function\s+&?(?P<name>\w+)", "function"), (r"^\s*(?:abstract\s+|final\s+)?class\s+(?P<name>\w+)", "class"), (r"^\s*interface\s+(?P<name>\w+)", "interface"), (r"^\s*trait\s+(?P<name>\w+)", "class"), (r"^\s*enum\s+(?P<name>\w+)", "enum"), (r"^\s*const\s+(?P<name>\w+)", "constant"), (r"^\s*namespace\s+(?P<name>[\w\\]+)", "module")),
    "rust": ((r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(?P<name>\w+)", "function"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)", "struct"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)", "enum"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>\w+)", "interface"), (r"^\s*(?:pub\s+)?type\s+(?P<name>\w+)", "type"), (r"^\s*(?:pub\s+)?const\s+(?P<name>\w+)", "constant"), (r"^\s*(?:pub\s+)?static\s+(?:mut\s+)?(?P<name>\w+)", "variable"), (r"^\s*(?:pub\s+)?mod\s+(?P<name>\w+)", "module")),
    "zig": ((r"^\s*(?:pub\s+)?(?:export\s+|extern\s+|inline\s+)*fn\s+(?P<name>\w+)", "function"), (r"^\s*(?:pub\s+)?const\s+(?P<name>\w+)\s*=\s*(?:packed\s+|extern\s+)?(?:struct|union|opaque)\b", "struct"), (r"^\s*(?:pub\s+)?const\s+(?P<name>\w+)\s*=\s*enum\b", "enum"), (r'^\s*test\s+"(?P<name>[^"]*)"', "function")),
}
_COMPILED = {k: [(re.compile(p), kind) for p, kind in v] for k, v in DEFINITIONS.items()}
#: Words before a parenthesis that are no calls.
_NO_CALL = frozenset("if for while switch catch return func function fn def sizeof new class struct interface type elif else and or not in is lambda with assert except print_ typeof".split())
#: And what a pattern of definitions may take for a name.
_NO_NAME = frozenset("if for while switch catch return else".split())
_CALL = re.compile(rf"(?<![\w$])({_NAME})(!?)\s*\(")
_GO_IMPORT = re.compile(r'^\s*(?:import\s+)?(?:(?P<alias>[\w.]+)\s+)?"(?P<path>[^"]+)"\s*$')
_JS_IMPORT = re.compile(r"""^\s*import\s+(?:type\s+)?(?P<names>.+?)\s+from\s+['"](?P<path>[^'"]+)['"]""")
_JSX = re.compile(r"<([A-Z][\w.]*)[\s/>]")
# Names of types that a language brings along and that are no names of their own in it (Go's are).
_BUILT_IN = frozenset("void char short int long float double signed unsigned bool auto const static inline extern return else case goto typedef struct union enum class new delete using namespace template typename public private protected virtual operator if for while switch sizeof".split())
_UPPER = r"([A-Z]\w*)"
#: Where a name of a type stands, for languages whose types begin with a capital.
_TYPE_PLACES = {
    "typescript": re.compile(rf"(?::\s*|\b(?:as|extends|implements|class|interface|type|enum|keyof|is)\s+|[<|&,(]\s*(?=[A-Z]\w*\s*[\[\]<>|&,]+))(?:readonly\s+)?(?:\w+\.)*{_UPPER}"),
    "rust": re.compile(rf"(?:[:&<,(+=]\s*|->\s*|\b(?:impl|for|as|dyn|mut|struct|enum|trait|type|where)\s+)(?:'\w+\s+)?(?:mut\s+|dyn\s+)?(?:\w+::)*{_UPPER}(?!\s*(?:\(|::|!))"),
}
_TYPE_PLACES["tsx"] = _TYPE_PLACES["typescript"]
_C_TYPE = re.compile(r"\b(?:struct|union|enum|class)\s+(\w+)|(?<![\w.>\"])(?:\w+::)*([A-Za-z_]\w*)(?:\s*<[^<>;]*>)?(?:\s*[*&]+\s*|\s+)[A-Za-z_]\w*\s*(?=[;,)=({\[])")
_C_ARGUMENTS = re.compile(r"(?<=\w)<([^<>;()]*)>")
_GO_TYPE = r"(?:[\[\]*\w.]|\bchan\s|<-)+"
_GO_PLACES = re.compile(rf"\.\(({_GO_TYPE})\)|\b(?:make|new)\(({_GO_TYPE})|^\s*var\s+[\w, ]*?\w\s+({_GO_TYPE})|^\s*type\s+\w+(?:\[[^\]]*\])?\s+=?\s*((?!struct\b|interface\b|func\b){_GO_TYPE})|(\[\d*\]{_GO_TYPE}|\bmap\[{_GO_TYPE})")


def _go_names(type_text: str) -> list[str]:
    """The names in the text of a type, each behind its package."""
    return [m.rsplit(".", 1)[-1] for m in re.findall(r"[A-Za-z_][\w.]*", type_text) if m not in ("map", "chan", "func", "struct", "interface")]


def _go_parameters(text: str) -> list[str]:
    """Types of a list of parameters or results: what stands behind the names, if there are names."""
    parts = [p.strip() for p in text.split(",") if p.strip()]
    named = any(re.match(r"^\w+\s+\S", p) and not p.startswith(("chan ", "func")) for p in parts)
    return [n for p in parts for n in _go_names((p.split(None, 1)[1] if " " in p else "") if named else p)]


def _go_types(text: str, field: bool) -> list[str]:
    out = [n for m in _GO_PLACES.finditer(text) for g in m.groups() if g for n in _go_names(g)]
    if re.match(r"^\s*func\b|^\s*\w+\s*\(.*\)", text) and ("func" in text or field):
        groups = re.findall(r"\(([^()]*)\)", text.split("{", 1)[0])
        out += [n for g in groups for n in _go_parameters(g)]
        tail = re.search(r"\)\s*([^(){]+?)\s*(?:\{.*)?$", text.split("{", 1)[0])
        out += _go_names(tail[1]) if tail else []
    elif field and (m := re.match(rf"^\s*(?:\w+(?:\s*,\s*\w+)*\s+)?({_GO_TYPE})\s*$", re.sub(r'""|`.*`', "", text))):
        out += _go_names(m[1])
    return out


_MADE = re.compile(rf"\bnew\s+({_NAME})|(?<![\w.])&?([A-Z]\w*)\{{")


def _signature(lines: list[str], at: int) -> str:
    out = []
    for text in lines[at : at + 5]:
        out.append(text.strip())
        if any(c in text for c in "){:"):
            break
    return " ".join(out)


def _exported(language: str, name: str, line: str) -> bool:
    last = name.rsplit(".", 1)[-1]
    if language == "go":
        return last[:1].isupper()
    if language in ("python", "javascript", "typescript", "tsx"):
        return line.lstrip().startswith("export ") or not last.startswith("_")
    return True


def _bare(text: str) -> str:
    """A line without strings and comments to its end."""
    return re.sub(r"""(["'`])(?:\\.|(?!\1).)*\1|//.*|/\*.*?\*/""", lambda m: '""' if m[0][0] in "\"'`" else "", text)


class _Found:
    def __init__(self, language: str, path: str, digest: str, lines: list[str]):
        self.language, self.path, self.digest, self.lines = language, path, digest, lines
        self.symbols: dict[str, tuple] = {}
        self.refs: dict[str, tuple] = {}

    def symbol(self, bare: str, kind: str, first: int, last: int, shown: str | None = None) -> None:
        key, name = f"{self.digest}:{self.path}:{first}:{bare}", shown or bare
        line = self.lines[first - 1] if first <= len(self.lines) else ""
        self.symbols.setdefault(key, (key, name, SYMBOL_KINDS.index(kind), self.path, first, last, _signature(self.lines, first - 1), _exported(self.language, name, line)))

    def ref(self, target: str, kind: str, line: int, mark: str) -> None:
        if not target or len(target) >= 200:
            return
        source = f"{self.digest}:{self.path}:{line}:{mark}:{target}"
        key = f"{source}->{target}:{kind}:{line}"
        self.refs.setdefault(key, (key, source, target, REF_KINDS.index(kind), self.path, line, 1.0))


def _python(found: _Found, content: str) -> None:
    tree = ast.parse(content)
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            found.symbol(node.name, "function", node.lineno, node.end_lineno)
        elif isinstance(node, ast.ClassDef):
            found.symbol(node.name, "class", node.lineno, node.end_lineno)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            for a in node.names:
                module = getattr(node, "module", None)
                found.symbol(f"{module}.{a.name}" if module and isinstance(node, ast.ImportFrom) else a.name, "import", node.lineno, node.end_lineno)
                found.ref(a.name, "imports", node.lineno, "import")
        elif isinstance(node, ast.Call):
            f = node.func
            found.ref(f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else "", "calls", node.lineno, "call")


def _python_lines(found: _Found) -> None:
    """Python that does not parse, line by line."""
    for i, raw in enumerate(found.lines, 1):
        text = re.sub(r"#.*", "", _bare(raw.replace("//", "__")))
        own = None
        if m := re.match(r"^\s*(?:async\s+)?(def|class)\s+(\w+)", text):
            own, end = m[2], i
            for k in range(i, len(found.lines)):
                if found.lines[k].strip():
                    if len(found.lines[k]) - len(found.lines[k].lstrip()) <= len(raw) - len(raw.lstrip()):
                        break
                    end = k + 1
            found.symbol(own, "function" if m[1] == "def" else "class", i, end)
        elif m := re.match(r"^\s*(?:from\s+([\w.]+)\s+)?import\s+([\w.,\s]+?)\s*$", text):
            for part in m[2].split(","):
                if name := part.split(" as ")[0].strip():
                    found.symbol(f"{m[1]}.{name}" if m[1] else name, "import", i, i)
                    found.ref(name, "imports", i, "import")
            continue
        for m in _CALL.finditer(text):
            if m[1] != own and m[1] not in _NO_CALL:
                found.ref(m[1], "calls", i, "call")


def _lexed(found: _Found) -> None:
    lines, language, grouped, comment = found.lines, found.language, False, False
    patterns = _COMPILED[language]
    specs, inside, depth = "", "", 0  # of Go: the group of declarations, struct or interface that a line is in, and its open brackets
    for i, raw in enumerate(lines, 1):
        if comment or raw.lstrip().startswith("/*"):
            comment = "*/" not in raw
            continue
        if language == "go":
            if re.match(r"^\s*import\s*\(", raw):
                grouped = True
                continue
            if grouped and raw.strip() == ")":
                grouped = False
                continue
            m = _GO_IMPORT.match(raw) if grouped or raw.lstrip().startswith("import ") else None
            if m:
                found.symbol(m["path"], "import", i, i)
                continue
        if language in ("javascript", "typescript", "tsx") and (m := _JS_IMPORT.match(raw)):
            found.symbol(m["path"], "import", i, i)
            for name in re.findall(rf"({_NAME})(?:\s+as\s+{_NAME})?", m["names"]):
                if name not in ("as", "type"):
                    found.ref(name, "imports", i, "import")
            continue
        if language == "php" and (m := re.match(r"^\s*use\s+(?:function\s+|const\s+)?([\w\\]+)(?:\\\{([^}]*)\}|\s+as\s+\w+)?\s*;", raw)):
            for part in (m[2] or "").split(",") if m[2] else [""]:
                name = m[1] + ("\\" + part.split(" as ")[0].strip() if part else "")
                found.symbol(name, "import", i, i)
                found.ref(name.rsplit("\\", 1)[-1], "imports", i, "import")
            continue
        if language == "zig" and (m := re.match(r"^\s*(?:pub\s+)?const\s+(\w+)\s*=\s*@import\(", raw)):
            found.ref(m[1], "imports", i, "import")
            continue
        text, own = _bare(raw), None
        if language == "go":
            if specs:
                if text.strip() == ")" and not depth:
                    specs = ""
                    continue
                if not depth and (m := re.match(r"^\s*(\w+(?:\s*,\s*\w+)*)(?:\s+|\s*$|\s*=)(.*)", text)):
                    for name in re.split(r"\s*,\s*", m[1]):
                        kind = {"var": "variable", "const": "constant"}.get(specs) or next((k for k in ("struct", "interface") if m[2].startswith(k)), "type")
                        found.symbol(name, kind, i, brace_end(lines, i - 1) + 1 if kind in ("struct", "interface") else i)
                    own = m[1]
                    for name in _go_names(re.match(_GO_TYPE, m[2])[0]) if specs == "var" and re.match(_GO_TYPE, m[2]) else ():
                        found.ref(name, "accessed", i, "type")
                    if specs == "type" and (m := re.match(r"^(struct|interface)\s*\{\s*$", m[2])):
                        inside = m[1]
                depth += sum(map(text.count, "({[")) - sum(map(text.count, ")}]"))
            elif m := re.match(r"^\s*(var|const|type)\s*\(\s*$", text):
                specs, depth = m[1], 0
                continue
            elif m := re.match(r"^\s*(?:var|const)\s+(\w+(?:\s*,\s*\w+)+)", text):
                for name in re.split(r"\s*,\s*", m[1]):
                    found.symbol(name, "constant" if "const" in text else "variable", i, i)
                own = m[1]
            elif m := re.match(r"^\s*type\s+\w+(?:\[[^\]]*\])?\s+(struct|interface)\s*\{\s*$", text):
                inside = m[1] + " "
            if inside and not inside.endswith(" ") or inside and not re.match(r"^\s*type\b", text):
                if text.strip().startswith("}"):
                    inside = ""
                elif inside.strip() == "interface" and (m := re.match(r"^\s*(\w+)\s*\(", text)):
                    found.symbol(m[1], "method", i, i)
                    own = m[1]
            for name in dict.fromkeys(_go_types(text, bool(inside))):
                if name != own:
                    found.ref(name, "accessed", i, "type")
        elif language in _TYPE_PLACES:
            for m in _TYPE_PLACES[language].finditer(text):
                found.ref(m[1], "accessed", i, "type")
        elif language in ("c", "cpp") and not text.lstrip().startswith("#"):
            arguments = [n for m in _C_ARGUMENTS.finditer(text) for n in re.findall(r"(?<!\w)[A-Za-z_]\w*(?!\w|::)", m[1])]
            for name in [*(m[1] or m[2] for m in _C_TYPE.finditer(text)), *arguments]:
                if name not in _BUILT_IN:
                    found.ref(name, "accessed", i, "type")
        for pattern, kind in patterns if own is None else ():
            m = pattern.match(raw if kind == "function" and language == "zig" else text)
            if m and m["name"] not in _NO_NAME:
                own = m["name"]
                last = brace_end(lines, i - 1) + 1 if kind not in ("variable", "constant", "type") else i
                if last == i and "{" not in text and i < len(lines) and lines[i].strip().startswith("{"):
                    last = brace_end(lines, i) + 1
                of = m.groupdict().get("of")
                found.symbol(own, kind, i, last, f"({of}).{own}" if of else None)
                break
        for m in _CALL.finditer(text):
            made = re.search(r"\bnew\s+(?:[\w.]+\.)?$", text[: m.start(1)])
            if m[1] not in _NO_CALL and not made and not (m[1] == own and m.start(1) <= text.find(own)):
                found.ref(m[1], "calls", i, "call")
        for m in _MADE.finditer(text):
            name = m[1] or m[2]
            if name != own:
                found.ref(name, "instantiates", i, "type")
        if language in ("javascript", "tsx"):
            for m in _JSX.finditer(text):
                found.ref(m[1].rsplit(".", 1)[-1], "calls", i, "jsx")


def extract(language: str, path: str, digest: str, content: str | None) -> tuple[list[tuple], list[tuple]]:
    """Rows of symbols and of references."""
    if not content or len(content) > MOST or language not in (*DEFINITIONS, "python"):
        return [], []
    found = _Found(language, path, digest, split_lines(content))
    try:
        _python(found, content) if language == "python" else _lexed(found)
    except (SyntaxError, ValueError, RecursionError):  # such as Python 2
        _python_lines(found)
    return list(found.symbols.values()), list(found.refs.values())


_SYMBOL = [("id", pa.string()), ("name", pa.string()), ("kind", pa.int32()), ("rel_path", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("exported", pa.bool_())]
_REF = [("id", pa.string()), ("source_id", pa.string()), ("target_name", pa.string()), ("kind", pa.int32()), ("rel_path", pa.string()), ("line", pa.int32()), ("confidence", pa.float64())]


def _extracted(files: DataFrame, which: int, columns: list, schema: str) -> DataFrame:
    def run(batches):
        rows = (r for batch in batches for part in slices(batch, 3, PART) for path, lang, digest, text in zip(*(c.to_pylist() for c in part.columns)) for r in extract(lang or "", path, digest, text)[which])
        return emitted(rows, pa.schema(columns), PART)

    return mapped(files.select("rel_path", "language", "hash", "content"), run, schema)


def extract_symbols(files: DataFrame) -> DataFrame:
    return _extracted(files, 0, _SYMBOL, "id string, name string, kind int, rel_path string, start_line int, end_line int, signature string, exported boolean")


def extract_refs(files: DataFrame) -> DataFrame:
    return _extracted(files, 1, _REF, "id string, source_id string, target_name string, kind int, rel_path string, line int, confidence double")
