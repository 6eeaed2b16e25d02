"""Tables, enumerations and identifiers of the index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNKS = "branch string, id string, file_path string, rel_path string, language string, start_line int, end_line int, content string, file_hash string"
VECTORS = "branch string, chunk_id string, vector array<float>"
SYMBOLS = "branch string, id string, name string, kind int, file_path string, rel_path string, start_line int, end_line int, signature string, exported boolean"
REFS = "branch string, id string, source_id string, target_name string, target_id string, kind int, file_path string, line int, confidence double"
META = "branch string, key string, value string"

# The order gives the stored numbers.
SYMBOL_KINDS = ("function", "method", "class", "struct", "interface", "enum", "type", "variable", "constant", "import", "module")
REF_KINDS = ("calls", "imports", "extends", "implements", "instantiates", "assigned", "accessed", "contains", "decorates")
METHOD, IMPORT = SYMBOL_KINDS.index("method"), SYMBOL_KINDS.index("import")
CALLS, IMPORTS = REF_KINDS.index("calls"), REF_KINDS.index("imports")
FORMAT_VERSION = "2"


def ref_kind_name(kind: Column) -> Column:
    """unknown for numbers without a name."""
    names = F.array(*[F.lit(k) for k in REF_KINDS])
    return F.when((kind >= 0) & (kind < len(REF_KINDS)), F.element_at(names, kind + 1)).otherwise("unknown")


def file_hash(content: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def chunk_id(digest: Column, rel_path: Column, start: Column, end: Column) -> Column:
    return F.concat(digest, F.lit(":"), F.replace(rel_path, F.lit("\\"), F.lit("/")), F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def symbol_id(digest: Column, rel_path: Column, line: Column, name: Column) -> Column:
    return F.concat_ws(":", digest, rel_path, line.cast("string"), name)


def ref_id(source: Column, target: Column, kind: Column, line: Column) -> Column:
    return F.concat(source, F.lit("->"), target, F.lit(":"), ref_kind_name(kind), F.lit(":"), line.cast("string"))


def branch_suffix(worktree: str, branch: str) -> str:
    """Empty for main; else both names with path characters made harmless."""
    if branch in ("", "main", "master"):
        return ""
    clean = lambda s: s.replace("/", "-").replace("\\", "-").replace(":", "-").replace("..", "-")
    return f"-{clean(worktree)}-{clean(branch)}"
