"""Source trees as tables: the walk, what it skips, and what git knows."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.patterns import IGNORED, ignore_regex, language_of
from lexiloom.schema import file_hash


def walk(spark: SparkSession, root: str, submodules: list[str] = (), ignored: tuple[str, ...] = IGNORED, branch: str = "main") -> DataFrame:
    """Files of known languages below a folder of any file system: branch, file_path, rel_path, language, hash, size, content. Text that is no UTF-8 is read with replacements."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    plain = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.\-]*:/*(?=/)", "")
    tail = F.substr(plain, F.lit(len(base.split(":", 1)[-1].replace("///", "/")) + 2))
    rows = raw.select(F.lit(branch).alias("branch"), plain.alias("file_path"), tail.alias("rel_path"), F.col("length").alias("size"), "content")
    return kept(rows, submodules, ignored).withColumns({"hash": file_hash(F.col("content")), "content": F.decode("content", "UTF-8")})


def kept(rows: DataFrame, submodules: list[str] = (), ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """What a walk keeps of a listing (rel_path): known languages, nothing ignored, no submodule; with the language."""
    rows = rows.withColumn("language", language_of(F.col("rel_path"))).filter(F.col("language").isNotNull() & ~F.col("rel_path").rlike(ignore_regex(tuple(ignored))))
    return without_submodules(rows, submodules)


def without_submodules(files: DataFrame, folders: list[str]) -> DataFrame:
    for f in folders:
        files = files.filter(~F.col("rel_path").startswith(f.rstrip("/") + "/"))
    return files


def submodule_paths(gitmodules: str) -> list[str]:
    return [line.split("=", 1)[1].strip() for line in gitmodules.splitlines() if line.strip().startswith("path = ")]


def gitignore_patterns(text: str) -> tuple[str, ...]:
    return tuple(p for p in (line.strip() for line in text.splitlines()) if p and p[0] not in "#!")


def _git(root: str, *args: str) -> str:
    out = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60)
    return out.stdout.strip() if out.returncode == 0 else ""


def head_sha(root: str) -> str:
    return _git(root, "rev-parse", "HEAD")


def branch_name(root: str) -> str:
    return _git(root, "rev-parse", "--abbrev-ref", "HEAD")


def branch_exists(root: str, name: str) -> bool:
    return bool(_git(root, "rev-parse", "--verify", "--quiet", f"refs/heads/{name}"))


def local_branches(root: str) -> list[str]:
    return [b for b in _git(root, "for-each-ref", "--format=%(refname:short)", "refs/heads").splitlines() if b]


def merge_base(root: str, a: str, b: str) -> str:
    return _git(root, "merge-base", a, b)


def worktree_name(root: str) -> str:
    return _git(root, "rev-parse", "--show-toplevel").rsplit("/", 1)[-1]


def changed_files(root: str, sha: str = "HEAD") -> list[str]:
    """Files that differ from a commit, and untracked ones that are not among them."""
    changed = [p for p in _git(root, "diff", "--name-only", sha or "HEAD").splitlines() if p]
    untracked = [p for p in _git(root, "ls-files", "--others", "--exclude-standard", "-z").split("\0") if p]
    return list(dict.fromkeys(changed + untracked))
