"""Measures of single Python files, for scripts; ``python -m skarn.metrics FILE...`` lists heavy units.

Whole trees go through :mod:`skarn.plans.analysis`, which measures all files at once.
"""

from __future__ import annotations

import ast
import sys

from skarn.functions import pycode
from skarn.operators.scoring import THRESHOLDS


def _read(path: str, errors: str = "strict") -> str:
    with open(path, encoding="utf-8", errors=errors) as f:
        return f.read()


def _tree(path: str) -> ast.Module | None:
    try:
        return pycode.parse(_read(path))
    except (OSError, UnicodeDecodeError):
        return None


def max_depth(source: str) -> int:
    """Deepest nesting; 0 for source that doesn't parse."""
    tree = pycode.parse(source)
    return 0 if tree is None else pycode.nesting_depth(tree)


def loc(path: str) -> int:
    """Lines that are neither blank nor comments."""
    return sum(1 for line in _read(path, "ignore").splitlines() if line.strip() and not line.strip().startswith("#"))


def complexity(path: str) -> float:
    """Mean cyclomatic complexity of all graphs; 0 without any."""
    tree = _tree(path)
    found = [c for _, c in pycode.graphs(tree).values()] if tree else []
    return sum(found) / len(found) if found else 0.0


def type_coverage(path: str) -> float:
    """Percentage of functions with types; 100 without functions, 0 for source that doesn't parse."""
    tree = _tree(path)
    units = pycode.functions(tree) if tree else []
    return 100.0 * sum(u["is_typed"] for u in units) / len(units) if units else 100.0 if tree else 0.0


def load(complexity: float, loc: int, depth: int) -> float:
    """Cognitive load of a unit."""
    return (depth * 2.0) + (complexity * 1.5) + (loc / 50.0)


def tokens(path: str) -> int:
    return len(_read(path, "ignore")) // 4


def units(path: str) -> list[dict]:
    tree = _tree(path)
    return pycode.functions(tree) if tree else []


def dump(path: str, yellow: float = THRESHOLDS["acl_yellow"], red: float = THRESHOLDS["acl_red"]) -> str:
    """A file's figures and its units above the thresholds."""
    tree = _tree(path)
    lines = [f"--- {path} ---", f"complexity {complexity(path):.2f}, types {type_coverage(path):.0f}%, depth {pycode.nesting_depth(tree) if tree else 0}"]
    for name, low, high in (("Red", red, float("inf")), ("Yellow", yellow, red)):
        lines += [f"{name}: {u['name']} {u['acl']:.2f} (line {u['lineno']})" for u in units(path) if low < u["acl"] <= high]
    return "\n".join(lines)


if __name__ == "__main__":
    print("\n".join(map(dump, sys.argv[1:])))
