"""Reading git working trees (S1, S5-S10): subprocesses on the driver give lines, DataFrame plans read them."""

from __future__ import annotations

import hashlib
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.code_text import status_changes
from ..operators.maintenance import DELETED


def _git(root: str | Path, *arguments: str) -> str:
    done = subprocess.run(["git", "-C", str(root), *arguments], capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git {arguments[0]} failed: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode("utf-8")


def head(root: str | Path) -> str:
    """S8."""
    return _git(root, "rev-parse", "HEAD").strip()


def find_root(path: str | Path, directory_only: bool = False) -> Path | None:
    """The nearest parent that holds ``.git``, a file or a directory."""
    here = Path(path).resolve()
    for p in [here, *here.parents]:
        mark = p / ".git"
        if mark.is_dir() or not directory_only and mark.exists():
            return p
    return None


def tracked(spark: SparkSession, root: str | Path) -> DataFrame:
    """Every tracked file as added: ``path, change``."""
    paths = [x for x in _git(root, "ls-files", "-z").split("\0") if x]
    return spark.createDataFrame([(x, "added") for x in paths], "path string, change string")


def committed(spark: SparkSession, root: str | Path, since: str | None) -> DataFrame:
    """What commits since ``since`` changed, or all tracked files without one: ``path, change``."""
    if since is None:
        return tracked(spark, root)
    lines = [(x,) for x in _git(root, "-c", "core.quotePath=false", "diff", "--name-status", since, "HEAD").splitlines()]
    return spark.createDataFrame(lines, "line string").select(F.inline(status_changes(F.col("line"))))


def dirty(spark: SparkSession, root: str | Path) -> DataFrame:
    """Changed files of the working tree with content hashes, zeros for deleted ones: ``path, sha256``.

    Untracked directories are listed file by file and names are taken as they
    are, which the line format of plain status output can't do.
    """
    fields = iter(_git(root, "status", "--porcelain", "-z", "-uall").split("\0"))
    rows: dict[str, str] = {}
    for field in fields:
        if len(field) < 4:
            continue
        status, path = field[:2], field[3:]
        names = [path]
        if status[0] in "RC":
            old = next(fields)
            names += [old] if status[0] == "R" else []
        for name in names:
            file = Path(root) / name
            if file.is_file():
                rows[name] = hashlib.sha256(file.read_bytes()).hexdigest()
            elif not file.exists():
                rows[name] = DELETED
    return spark.createDataFrame(sorted(rows.items()), "path string, sha256 string")
