"""Languages, ignore rules, globs and regular expressions over paths and lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and the language each stands for.
EXTENSIONS = {
    ".go": "go", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".rs": "rust", ".java": "java",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".cu": "cpp", ".cuh": "cpp", ".cs": "csharp", ".rb": "ruby",
    ".php": "php", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".zig": "zig", ".sql": "sql", ".sh": "bash", ".bash": "bash",
    ".ps1": "powershell", ".md": "markdown", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml", ".html": "html", ".css": "css", ".scss": "css",
}
# Words that begin a definition line.
DEFINITION_WORDS = ("func", "type", "class", "struct", "interface", "enum", "trait", "impl", "def", "fn", "pub", "export", "async", "function", "const", "var", "let", "val")
# Paths that are ignored unless said otherwise.
IGNORED = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", ".env", ".next", ".nuxt", "build", "dist", "target", "vendor", ".idea", ".vscode",
    "*.exe", "*.dll", "*.so", "*.dylib", "*.bin", "*.class", "*.o", "*.obj", "*.lib", "*.wasm", "*.pyc", "*.pyo", "*.png", "*.jpg", "*.jpeg", "*.gif",
    "*.ico", "*.svg", "*.woff", "*.ttf", "*.eot", "*.zip", "*.tar.gz", "*.7z", "*.rar", "*.pdf", "*.min.js", "*.min.css", "*.lock",
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "Cargo.lock", "Pipfile.lock", "poetry.lock", ".gitkeep", ".gitmodules",
    ".DS_Store", "Thumbs.db", "*.log", ".tox", ".mypy_cache", ".pytest_cache", ".gradle", ".terraform", ".raggrep",
)
#: An expression with any of these characters is a regular expression.
REGEX_MARKS = frozenset(".*+?|()[]{}^$\\")

_WORD = "[0-9A-Za-z_]"
_BORDER = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
DEFINITION_LINE = r"(?i)^\s*(" + "|".join(DEFINITION_WORDS) + rf")(?!{_WORD})"


def language_of(path: Column) -> Column:
    """By the last extension, whatever its case; null for unknown ones."""
    pairs = [F.lit(x) for pair in EXTENSIONS.items() for x in pair]
    return F.create_map(*pairs)[F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))]


def is_regex(query: str) -> bool:
    return not REGEX_MARKS.isdisjoint(query)


# What POSIX calls classes, in Java.
_POSIX = {"alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}", "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\s", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}"}


def has_marks(query: Column) -> Column:
    """is_regex of a column."""
    return query.rlike("[" + "".join("\\" + c for c in sorted(REGEX_MARKS)) + "]")


def java_regex(pattern: str, case_sensitive: bool = False) -> str:
    """An RE2 expression as Java reads it: word borders of ASCII words, folding beyond ASCII, named groups, POSIX classes, scripts, and brackets inside classes, which are literal. What RE2 lacks (look-around, back references, atomic groups) is refused."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        rest = pattern[i:]
        if rest[0] == "\\":
            if m := re.match(r"\\Q(.*?)(?:\\E|$)", rest, re.S):
                out.append(quoted(m[1]))
                i += m.end()
                continue
            if re.match(r"\\[1-9kGZRXhHNV]", rest):
                raise ValueError(f"{rest[:2]} is not supported")
            m = re.match(r"\\[pP](?:\{(\^?)(\w+)\}|.)", rest)
            if m and m[2] and len(m[2]) > 2:
                out.append(("\\P" if (rest[1] == "P") != bool(m[1]) else "\\p") + "{Is" + m[2] + "}")
            else:
                out.append(_BORDER if rest[:2] == r"\b" and not inside else m[0] if m else rest[:2])
            i += m.end() if m else 2
            continue
        if inside:
            m = re.match(r"\[:(\^?)(\w+):\]", rest)
            if m and m[2] in _POSIX:
                own = _POSIX[m[2]]
                out.append("\\" + own[1].upper() + own[2:] if m[1] else own)
                i += m.end()
                continue
            inside = rest[0] != "]"
            out.append("\\" + rest[0] if rest[0] in "[&" else rest[0])
        elif rest[0] == "[":
            m = re.match(r"\[\^?\]?", rest)  # a bracket that comes first is a literal
            out.append(m[0].replace("]", r"\]"))
            i, inside = i + m.end(), True
            continue
        elif m := re.match(r"\(\?P?<\w+>", rest):
            out.append("(")
            i += m.end()
            continue
        elif re.match(r"\(\?(?![a-zA-Z-]*[:)])", rest) or re.match(r"\(\?[a-z-]*U", rest):
            raise ValueError("this kind of group is not supported")
        else:
            out.append(rest[0])
        i += 1
    return ("" if case_sensitive else "(?iu)") + "".join(out)


def quoted(text: str) -> str:
    """A literal inside a Java or RE2 expression."""
    return re.sub(r"([^0-9A-Za-z_\s])", r"\\\1", text) if text.isascii() else "".join("\\" + c if c.isascii() and not (c.isalnum() or c in "_ ") else c for c in text)


def has_glob(pattern: str) -> bool:
    return any(c in "*?[" for c in pattern)


def glob_regex(pattern: str) -> str:
    """Anchored: * and ? stay within a path segment, classes as they are."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2)
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and end > 0:
            out.append(pattern[i : end + 1])
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(quoted(pattern[i]))
        else:
            out.append(quoted(c))
        i += 1
    return "^" + "".join(out) + "$"


def path_regex(pattern: str) -> str | None:
    """One expression for a glob over relative paths: of the whole path, of the base name if it has no slash, of any tail behind a slash if it begins with **/; none for a plain prefix."""
    if not has_glob(pattern):
        return None
    body = glob_regex(pattern)[1:-1]
    forms = [body]
    if "/" not in pattern:
        forms.append(r"(?:.*/)?" + body)
    if pattern.startswith("**/"):
        forms.append(r"(?:.*/)?" + glob_regex(pattern[3:])[1:-1])
    return "^(?:" + "|".join(forms) + ")$"


def path_matches(path: Column, pattern: str) -> Column:
    """Globs, or else a prefix whatever its case; the empty pattern matches all."""
    if not pattern:
        return F.lit(True)
    expression = path_regex(pattern)
    return F.lower(path).startswith(pattern.lower()) if expression is None else path.rlike(expression)


def ignore_regex(patterns: tuple[str, ...] = IGNORED, compat: bool = False) -> str:
    """Paths that a list of ignore patterns hides: a name hides itself and all below it at any depth, a pattern with a slash from the
    root, a glob by its base name at any depth (compat: at the root only)."""
    forms = []
    for p in patterns:
        p = p.strip().rstrip("/")
        if not p or p.startswith("#"):
            continue
        body = glob_regex(p.lstrip("/"))[1:-1]
        deep = "/" not in p and not (compat and has_glob(p))
        forms.append((r"(?:.*/)?" if deep else "") + body + ("" if has_glob(p) and compat else r"(?:/.*)?"))
    return "^(?:" + "|".join(forms) + ")$"


def literal_factor(pattern: str) -> str | None:
    """A run of at least three word characters that every match of a regular expression must hold; none if that is not certain, as behind an escape of more than one character."""
    if "|" in pattern or "(?" in pattern or re.search(r"\\[^sSdDwWbBnrtfva\W]|\\$", pattern):
        return None
    text = re.sub(r"\[[^\]]*\]|\([^()]*\)|\{[^}]*\}|\\.|[a-zA-Z0-9_](?=[*?{])|[.^$*+?]", "\0", pattern)
    runs = sorted(re.findall(r"[0-9A-Za-z_]{3,}", text), key=len)
    return runs[-1] if runs and not re.search(r"[()\[\]]", text) else None
