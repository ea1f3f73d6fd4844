"""Depth of JSON, YAML and TOML documents."""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_depth(text: Column) -> Column:
    """Nesting of containers below the root of well-formed JSON text, as a column expression; empty ones don't count.

    Strings and white space are cut out, then empty containers, and the running sum of brackets is followed.
    """
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "0")
    bare = F.regexp_replace(bare, r"\s+", "")
    bare = F.regexp_replace(bare, r"\{\}|\[\]", "0")
    brackets = F.filter(F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.greatest(F.lit(0), F.aggregate(brackets, start, step)["most"] - 1)


def depth(root: object) -> int:
    """Deepest container below the root; scalars and empty containers are 0."""
    most, todo = 0, [(root, 0)]
    while todo:
        node, d = todo.pop()
        children = list(node.values()) if isinstance(node, dict) else node if isinstance(node, list) else []
        if children:
            most = max(most, d)
        todo += [(c, d + 1) for c in children]
    return most


def parse(text: str, ext: str) -> object:
    """Parsed by lower-case extension; raises ``ValueError`` for malformed text."""
    try:
        if ext == ".json":
            return json.loads(text)
        if ext == ".toml":
            return tomllib.loads(text)
        import yaml

        return yaml.safe_load(text)
    except ImportError:
        raise
    except Exception as e:
        raise ValueError(str(e)) from e


def facts(files: DataFrame, key: str = "rel_path", content: str = "content", ext: str = "ext") -> DataFrame:
    """One row a file: ``key, valid, depth``; null content is malformed."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            valid, deep = [], []
            for text, e in zip(pdf["content"], pdf["ext"]):
                try:
                    if not isinstance(text, str):
                        raise ValueError("no text")
                    deep.append(depth(parse(text, str(e).lower())))
                    valid.append(True)
                except ValueError:
                    deep.append(0)
                    valid.append(False)
            yield pd.DataFrame({key: pdf[key], "valid": valid, "depth": deep})

    return files.select(F.col(key), F.col(content).alias("content"), F.col(ext).alias("ext")).mapInPandas(run, f"{key} string, valid boolean, depth int")
