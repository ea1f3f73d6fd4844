"""Changelogs: one-line commits as rows, categorised by column expressions."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Headings in order, and the prefixes that lead to them.
FEATURES, FIXES, MAINTENANCE = "🚀 Features", "🐛 Bug Fixes", "⚙️ Maintenance"
FEATURE = r"^(feat|feature|add|implement)(\(.*\))?:"
FIX = r"^(fix|bugfix|resolve|patch)(\(.*\))?:"


def commits(spark: SparkSession, root: str) -> tuple[str, DataFrame]:
    """The newest tag's name and ``ord, line`` of the commits since the tag before it; no commits if git fails."""

    def git(*args: str) -> list[str]:
        got = subprocess.run(["git", *args], cwd=root, capture_output=True, text=True)
        return got.stdout.splitlines() if got.returncode == 0 else []

    tags = git("tag", "--sort=-v:refname")
    span = "HEAD" if not tags else tags[0] if len(tags) == 1 else f"{tags[1]}..{tags[0]}"
    rows = list(enumerate(git("log", span, "--oneline")))
    return (tags[0] if tags else "v0.1.0"), spark.createDataFrame(rows, "ord int, line string")


def categorised(lines: DataFrame) -> DataFrame:
    """``ord, category, entry`` of ``ord, line``; merges count by the branch that they name, or not at all."""
    line = F.col("line")
    merge = line.contains("Merge pull request") | line.contains("Merge branch")
    branch = F.regexp_extract(line, r"Merge pull request #\d+ from .*?/(.*)", 1)
    words = F.replace(branch, F.lit("-"), F.lit(" "))
    named = F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.expr("substring(replace(regexp_extract(line, 'Merge pull request #[0-9]+ from .*?/(.*)', 1), '-', ' '), 2)")))
    parts = F.split(line, " ", 2)
    message, commit = F.get(parts, F.lit(1)), F.get(parts, F.lit(0))
    low = F.lower(message)
    category = F.when(merge, MAINTENANCE).when(low.rlike(FEATURE), FEATURES).when(low.rlike(FIX), FIXES).otherwise(MAINTENANCE)
    entry = F.when(merge, F.when(branch != "", F.concat(F.lit("- "), named))).otherwise(F.concat(F.lit("- "), message, F.lit(" ("), commit, F.lit(")")))
    return lines.select("ord", category.alias("category"), entry.alias("entry")).where("entry is not null")


def changelog(version: str, rows: list, heading: str = "Release", lead: str = "") -> str:
    """Markdown of categorised rows in order. What a project says of itself, ``heading`` and ``lead``, is the caller's."""
    if not rows:
        return f"## {version}\n\nNo changes identified in this release."
    out = [f"## {heading} {version}\n", *[f"{lead}\n"] * bool(lead)]
    for name in (FEATURES, FIXES, MAINTENANCE):
        entries = [r["entry"] for r in rows if r["category"] == name]
        if entries:
            out += [f"### {name}", *entries, ""]
    return "\n".join(out)
