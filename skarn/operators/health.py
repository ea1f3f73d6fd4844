"""Checks of a project's surroundings: documents, linters, lock files, agent frameworks, directory entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions import text as X

#: Names that count.
LINTERS = ["ruff.toml", ".flake8", ".eslintrc", "pyproject.toml"]
LOCKS = ["package-lock.json", "poetry.lock", "uv.lock", "requirements.txt"]
STEERING = [".cursorrules", ".windsurfrules", "cline_docs", ".github/copilot-instructions.md"]
FRAMEWORKS = ["baml", "instructor", "outlines", "pydantic-ai", "crewai", "langfuse"]
DEPENDENCY_FILES = ["pyproject.toml", "requirements.txt"]

CROWDED, CROWDED_AVERAGE = 50, 15


def missing_docs(required: DataFrame, present: DataFrame) -> DataFrame:
    """``ord, name`` of required documents that are not present in any case: a left anti join on lower-case names."""
    have = present.select(F.lower("name").alias("low")).distinct()
    return required.withColumn("low", F.lower("name")).join(have, "low", "left_anti").select("ord", "name")


def environment(entries: DataFrame, project: str | None = None) -> DataFrame:
    """One row of booleans from root entries ``name, is_dir``: ``agents_md, linter_config, lock_file, baml_detected``.

    With ``project``, a column, a row for each of many projects.
    """
    some = lambda c: F.coalesce(F.max(c), F.lit(False))
    baml = ((F.col("name") == "baml_src") & F.col("is_dir")) | (F.col("name") == "generators.baml")
    return (entries if project is None else entries.groupBy(project)).agg(
        some(F.lower("name") == "agents.md").alias("agents_md"),
        some(F.col("name").isin(LINTERS)).alias("linter_config"),
        some(F.col("name").isin(LOCKS)).alias("lock_file"),
        some(baml).alias("baml_detected"),
    )


def frameworks(texts: DataFrame, content: str, terms: list[str] = FRAMEWORKS) -> DataFrame:
    """One row: ``found array<string>``, the sorted terms that any of the texts contains."""
    found = texts.select(F.explode(X.contained_terms(F.col(content), terms)).alias("term"))
    return found.agg(F.array_sort(F.collect_set("term")).alias("found"))


def entropy(counts: DataFrame, files: str = "files", path: str = "path", crowded: int = CROWDED, average: int = CROWDED_AVERAGE) -> DataFrame:
    """One row from files a directory: ``avg_files, max_files, warning, crowded_dirs``; no directory gives zeros."""
    mean = F.coalesce(F.sum(files) / F.count("*"), F.lit(0.0))
    most = F.coalesce(F.max(files), F.lit(0))
    return counts.agg(
        mean.alias("avg_files"),
        most.alias("max_files"),
        ((mean > average) | (most > crowded)).alias("warning"),
        F.array_sort(F.collect_list(F.when(F.col(files) > crowded, F.col(path)))).alias("crowded_dirs"),
    )


def crowded_directories(dirs: DataFrame, threshold: int = CROWDED) -> DataFrame:
    """``path, file_count`` of directories with more files than the threshold, hidden ones left out."""
    return dirs.where(~X.hidden_path(F.when(F.col("path") == ".", "").otherwise(F.col("path"))) & (F.col("files") > threshold)).select("path", F.col("files").alias("file_count"))


def critical_context(readme: Column, agents: Column, signatures: Column) -> Column:
    """The text that every agent reads first."""
    return F.concat_ws("", F.concat(readme, F.lit("\n")), F.concat(agents, F.lit("\n")), signatures)


def joined_length(length: Column) -> Column:
    """An aggregate: characters of all texts with a line feed between each two."""
    return F.sum(length) + F.count(length) - 1


def critical_length(readme: Column, agents: Column, signatures: Column) -> Column:
    """Characters of :func:`critical_context`, from those of its parts."""
    return readme + agents + 2 + F.coalesce(signatures, F.lit(0))
