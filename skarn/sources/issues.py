"""An issue tracker as a source of open titles and a sink for new issues."""

from __future__ import annotations

import json
import subprocess
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import text as X
from skarn.operators import fix

#: The title of an issue, and its labels.
TITLE = "Refactor: %s (%s)"
LABELS = ("tech-debt", "ai-ready")


class Tracker(Protocol):
    def open_titles(self) -> list[str]:
        """Titles of all open issues."""

    def create(self, title: str, body: str) -> str:
        """The address of the new issue."""


@dataclass
class GithubTracker:
    """The issues of the repository that ``folder`` belongs to, through GitHub's command line."""

    folder: str = "."
    most: int = 1_000_000
    labels: tuple[str, ...] = LABELS
    failed_labels: list[str] = field(default_factory=list)

    def _gh(self, *args: str) -> str:
        return subprocess.run(["gh", "issue", *args], cwd=self.folder, capture_output=True, text=True, check=True).stdout

    def open_titles(self) -> list[str]:
        return [x["title"] for x in json.loads(self._gh("list", "--state", "open", "--limit", str(self.most), "--json", "title"))]

    def create(self, title: str, body: str) -> str:
        """Labels come after, one by one: one that the repository lacks costs only itself."""
        url = self._gh("create", "--title", title, "--body", body).strip()
        for label in self.labels:
            try:
                self._gh("edit", url, "--add-label", label)
            except subprocess.CalledProcessError:
                self.failed_labels.append(label)
        return url


def wanted(parsed: DataFrame) -> DataFrame:
    """Issues ``title, body`` beside the columns of :func:`skarn.operators.fix.parsed_issues`, for heavy files only."""
    return parsed.where(F.col("kind") == "High Cognitive Load").withColumns({"title": F.format_string(TITLE, F.col("file"), F.col("kind")), "body": X.strip(F.col("prompt"))})


def open_issues(spark: SparkSession, tracker: Tracker) -> DataFrame:
    return spark.createDataFrame([(t,) for t in tracker.open_titles()], "title string")


def publish(parsed: DataFrame, tracker: Tracker) -> list[str]:
    """Create what isn't open yet, one issue a title; the addresses. If the tracker can't be asked, nothing is created."""
    new = fix.new_issues(wanted(parsed), open_issues(parsed.sparkSession, tracker)).groupBy("title").agg(F.min("body").alias("body"))
    return [tracker.create(r["title"], r["body"]) for r in new.orderBy("title").toLocalIterator()]
