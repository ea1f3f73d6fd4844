"""A source tree as tables: files, directories, root entries; git's changed files; project configuration.

The driver lists names (they are needed to prune directories); contents are read by tasks, where the executors can
see the tree, and each file is read once.
"""

from __future__ import annotations

import os
import re
import subprocess
import tomllib
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import text as X

#: Directories that an analysis never enters, besides hidden ones.
SKIPPED = {"node_modules", "venv", ".venv"}
EXTENSIONS = (".py", ".md", ".js", ".jsx", ".ts", ".tsx", ".json", ".yaml", ".yml", ".toml")
#: The table of ``pyproject.toml`` that holds a project's settings; callers may name another.
CONFIG_TABLE = "skarn"

FILES = "rel_path string, dir string, name string, ext string, size long, path string"


def analyzable(name: str) -> bool:
    return name.endswith(EXTENSIONS) or name == "Dockerfile" or name.startswith("Dockerfile.")


def walk(root: str, prune: Callable[[str], bool]) -> Iterator[tuple[str, list[str], list[str]]]:
    """``os.walk`` without the directories whose names ``prune`` takes out."""
    for d, dirs, names in os.walk(root):
        dirs[:] = [x for x in dirs if not prune(x)]
        yield d, dirs, names


def hidden_or_skipped(name: str) -> bool:
    return name.startswith(".") or name in SKIPPED


def hidden_or_cache(name: str) -> bool:
    return name.startswith(".") or name == "__pycache__"


def never(name: str) -> bool:
    return False


def listing(root: str, keep: Callable[[str], bool] = analyzable, prune: Callable[[str], bool] = hidden_or_skipped) -> list[tuple]:
    """``(rel_path, dir, name, ext, size, path)`` of the files below ``root``, or of ``root`` itself if it is a file."""
    if os.path.isfile(root):
        found, base = [root] if keep(os.path.basename(root)) else [], os.path.dirname(os.path.abspath(root))
    else:
        found, base = [os.path.join(d, n) for d, _, names in walk(root, prune) for n in names if keep(n)], root
    rows = []
    for p in sorted(found):
        rel = os.path.relpath(p, base)
        rows.append((rel, os.path.dirname(rel), os.path.basename(p), os.path.splitext(p)[1], os.path.getsize(p), os.path.abspath(p)))
    return rows


def read_files(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The ``files`` table: listing columns, ``language``, ``content`` (null unless strict UTF-8) and ``content_lossy``.

    Line ends of ``content`` are those of text files: all become line feeds.
    """
    listed = spark.createDataFrame(rows, FILES).repartition(max(1, min(len(rows) // 64 + 1, 10_000)))

    def run(batches):
        for pdf in batches:
            strict, lossy = [], []
            for p in pdf["path"]:
                with open(p, "rb") as f:
                    raw = f.read()
                lossy.append(_universal(raw.decode("utf-8", "ignore")))
                try:
                    strict.append(_universal(raw.decode("utf-8")))
                except UnicodeDecodeError:
                    strict.append(None)
            yield pdf.assign(content=strict, content_lossy=lossy)

    read = listed.mapInPandas(run, f"{FILES}, content string, content_lossy string")
    return read.withColumn("language", X.language(F.col("name"))).drop("path")


def _universal(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def files(spark: SparkSession, root: str, names: Iterable[str] = ()) -> DataFrame:
    """All analyzable files, and those whose names match one of some regular expressions."""
    more = [re.compile(n) for n in names]
    return read_files(spark, listing(root, lambda n: analyzable(n) or any(p.search(n) for p in more)))


def python_files(spark: SparkSession, root: str, prune: Callable[[str], bool] = never) -> DataFrame:
    """Every ``.py`` file below ``root``; pruning differs by use: none for fixes, hidden and caches for signatures."""
    return read_files(spark, listing(root, lambda n: n.endswith(".py"), prune))


def directories(spark: SparkSession, root: str) -> DataFrame:
    """``path, parent, hidden, files``: every directory, empty ones and the root (``.``) included, with all its files.

    ``hidden`` says whether a directory lies in, or is, one that is hidden or a cache.
    """
    rows = []
    for d, _, names in walk(root, never) if os.path.isdir(root) else ():
        rel = os.path.relpath(d, root)
        parts = [] if rel == "." else rel.split(os.sep)
        rows.append((rel, os.path.dirname(rel), any(map(hidden_or_cache, parts)), any(p.startswith(".") for p in parts), len(names)))
    return spark.createDataFrame(rows, "path string, parent string, hidden boolean, dotted boolean, files long")


def root_entries(spark: SparkSession, root: str) -> DataFrame:
    """``name, is_dir`` of the root's entries; those of its directory if it is a file."""
    base = root if os.path.isdir(root) else os.path.dirname(os.path.abspath(root))
    rows = [(e.name, e.is_dir()) for e in os.scandir(base)] if os.path.isdir(base) else []
    return spark.createDataFrame(rows, "name string, is_dir boolean")


def changed_files(root: str, base: str = "origin/main", target: str | None = None) -> list[str]:
    """Existing Python files that git reports as changed against ``base``; none if git fails."""
    command = ["git", "diff", "--name-only", "--diff-filter=d", base, *([target] if target else [])]
    try:
        out = subprocess.run(command, cwd=root, capture_output=True, text=True, check=True).stdout
    except (OSError, subprocess.CalledProcessError):
        return []
    return [p for p in out.splitlines() if p.endswith(".py") and os.path.exists(os.path.join(root, p))]


def merged(base: dict, over: dict) -> dict:
    """Nested dictionaries merged key by key; ``over`` wins."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(path: str, defaults: dict, table: str = CONFIG_TABLE) -> dict:
    """``defaults`` with the project's own table of ``pyproject.toml`` laid over; on any error the defaults."""
    base = path if os.path.isdir(path) else os.path.dirname(os.path.abspath(path))
    try:
        with open(os.path.join(base, "pyproject.toml"), "rb") as f:
            return merged(defaults, tomllib.load(f).get("tool", {}).get(table, {}))
    except (OSError, ValueError):
        return dict(defaults)


def valid_pyproject(root: str) -> bool:
    """Whether ``pyproject.toml`` is absent or parses."""
    base = root if os.path.isdir(root) else os.path.dirname(os.path.abspath(root))
    try:
        with open(os.path.join(base, "pyproject.toml"), "rb") as f:
            tomllib.load(f)
    except FileNotFoundError:
        return True
    except (OSError, ValueError):
        return False
    return True
