"""Facts of Python source that need its syntax tree, all from one parse a file.

The trees are walked inside one ``mapInArrow`` pass; what comes out are rows that the rest of the engine treats
relationally.
"""

from __future__ import annotations

import ast
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DEEPER = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp, ast.Lambda)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)

UNIT = "struct<name:string,lineno:int,complexity:double,loc:int,acl:double,is_typed:boolean,nesting_depth:int>"


def parse(source: str | None) -> ast.Module | None:
    if source is None:
        return None
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None


def nesting_depth(root: ast.AST) -> int:
    """Deepest nesting of control blocks, comprehensions and lambdas below ``root``; nested functions included."""
    most, todo = 0, [(root, 0)]
    while todo:
        node, depth = todo.pop()
        depth += isinstance(node, _DEEPER)
        most = max(most, depth)
        todo += [(child, depth) for child in ast.iter_child_nodes(node)]
    return most


def decisions(body: list[ast.stmt]) -> int:
    """Extra paths through statements: edges less nodes of their control-flow graph.

    ``match``, ``try*`` and expressions are simple statements; ``finally`` isn't followed. A nested function is one
    more path besides its own decisions.
    """
    n, todo = 0, list(body)
    while todo:
        s = todo.pop()
        if isinstance(s, (ast.If, ast.For, ast.AsyncFor, ast.While)):
            n += 1
            todo += s.body + s.orelse
        elif isinstance(s, ast.Try):
            n += len(s.handlers) + 1
            todo += s.body + s.orelse + [x for h in s.handlers for x in h.body]
        elif isinstance(s, (ast.With, ast.AsyncWith, ast.ClassDef)):
            todo += s.body
        elif isinstance(s, _FUNCTIONS):
            n += 1
            todo += s.body
    return n


def graphs(tree: ast.Module) -> dict[str, tuple[int, int]]:
    """``name: (line, complexity)`` of top-level functions, methods and module-level control blocks.

    Names are qualified by class only, so a later definition replaces an earlier one of the same name. Functions
    below a control block or another function have no graph of their own.
    """
    out: dict[str, tuple[int, int]] = {}
    todo: list[tuple[str, ast.stmt]] = [("", s) for s in reversed(tree.body)]
    while todo:
        prefix, s = todo.pop()
        if isinstance(s, _FUNCTIONS):
            out[prefix + s.name] = s.lineno, 1 + decisions(s.body)
        elif isinstance(s, ast.ClassDef):
            todo += [(f"{prefix}{s.name}.", x) for x in reversed(s.body)]
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            todo += [(prefix, x) for x in reversed(s.body)]
        elif isinstance(s, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try)):
            kind = "If" if isinstance(s, ast.If) else "TryExcept" if isinstance(s, ast.Try) else "Loop"
            out[f"{prefix}{kind} {s.lineno}"] = s.lineno, 1 + decisions([s])
    return out


def is_typed(node: ast.FunctionDef | ast.AsyncFunctionDef) -> bool:
    """A return annotation, or one on any ordinary argument."""
    return node.returns is not None or any(a.annotation is not None for a in node.args.args)


def functions(tree: ast.Module) -> list[dict]:
    """A unit for each function, breadth first."""
    complexity = {line: c for line, c in graphs(tree).values()}
    out = []
    for node in ast.walk(tree):
        if isinstance(node, _FUNCTIONS):
            cc, depth = float(complexity.get(node.lineno, 1.0)), nesting_depth(node)
            loc = (node.end_lineno or node.lineno) - node.lineno + 1
            acl = (depth * 2.0) + (cc * 1.5) + (loc / 50.0)
            out.append({"name": node.name, "lineno": node.lineno, "complexity": cc, "loc": loc, "acl": acl, "is_typed": is_typed(node), "nesting_depth": depth})
    return out


def signatures(tree: ast.Module) -> list[str]:
    """Heads of all functions and classes, breadth first, decorators included."""
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            body, node.body = node.body, [ast.Pass()]
            head = ast.unparse(node).splitlines()
            node.body = body
            text = "\n".join(head[:-1]).strip() or head[0]
            out.append(text)
    return out


def imports(tree: ast.Module) -> list[dict]:
    """``module, level`` of every import, breadth first, repeats kept; ``module`` is null for ``from . import x``."""
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [{"module": a.name, "level": 0} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append({"module": node.module, "level": node.level})
    return out


def facts(files: DataFrame, key: str = "rel_path", content: str = "content") -> DataFrame:
    """One row a file: ``key, parsed, units, imports, signatures, mean_complexity, type_coverage, max_depth``.

    A file that is null or doesn't parse has empty lists, a mean complexity and a coverage of 0.
    """
    unit = "array<struct<name:string,lineno:int,complexity:double,loc:int,acl:double,is_typed:boolean,nesting_depth:int>>"
    schema = f"{key} string, parsed boolean, units {unit}, imports array<struct<module:string,level:int>>, signatures array<string>, mean_complexity double, type_coverage double, max_depth int"

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for k, source in zip(pdf[key], pdf["content"]):
                tree = parse(source if isinstance(source, str) else None)
                if tree is None:
                    rows.append((k, False, [], [], [], 0.0, 0.0, 0))
                    continue
                units = functions(tree)
                cc = [c for _, c in graphs(tree).values()]
                typed = 100.0 * sum(u["is_typed"] for u in units) / len(units) if units else 100.0
                rows.append((k, True, units, imports(tree), signatures(tree), sum(cc) / len(cc) if cc else 0.0, typed, nesting_depth(tree)))
            yield pd.DataFrame(rows, columns=[key, "parsed", "units", "imports", "signatures", "mean_complexity", "type_coverage", "max_depth"])

    return files.select(F.col(key), F.col(content).alias("content")).mapInPandas(run, schema)


def module_names(found: DataFrame, key: str = "rel_path") -> DataFrame:
    """``key, module`` distinct from :func:`facts`: what a file imports by name, levels left out."""
    return found.select(key, F.explode("imports").alias("i")).select(key, F.col("i.module").alias("module")).where("module is not null").distinct()
