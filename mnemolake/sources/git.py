"""Changed paths of a working copy."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession

# Folders whose changes are not the project's.
IGNORED = ("terminals/", "agent-tools/", "mcps/", ".tmp_")


def normalise_path(path: str) -> str:
    """A path in forward slashes, without steps that lead nowhere; empty for no path."""
    plain = PurePosixPath(path.strip().replace("\\", "/")).as_posix()
    return "" if plain == "." else plain


def _fields(repo: str | Path, seconds: float, *ask: str) -> Iterator[str]:
    """What a git command lists, its fields ended by zero bytes, so that no name is quoted."""
    try:
        done = subprocess.run(["git", "-c", "safe.directory=*", *ask, "-z"], cwd=repo, capture_output=True, timeout=seconds, check=True)
    except subprocess.CalledProcessError as e:
        raise RuntimeError(f"no list of changes in {repo}: {e.stderr.decode(errors='replace').strip()}") from e
    return filter(None, done.stdout.decode(errors="surrogateescape").split("\0"))


def changed_paths(repo: str | Path, base: str | None = None, most: int | None = None, seconds: float = 15.0) -> list[str]:
    """Changes of the working tree and the index, new files, and commits since `base`: all of them, each once, by name.

    Ignored folders are left out. More than `most` paths (None: any number) raise an error: none is dropped in silence.
    """
    found = {x[3:] for x in _fields(repo, seconds, "status", "--porcelain", "--untracked-files=all", "--no-renames")}
    if base:
        found.update(_fields(repo, seconds, "diff", "--name-only", "--no-renames", f"{base}...HEAD"))
    out = sorted({p for p in map(normalise_path, found) if p and not p.startswith(IGNORED)})
    if most is not None and len(out) > most:
        raise ValueError(f"{len(out)} changed paths, more than {most}")
    return out


def changed(spark: SparkSession, repo: str | Path, base: str | None = None) -> DataFrame:
    return spark.createDataFrame([(p,) for p in changed_paths(repo, base)], "path string")
