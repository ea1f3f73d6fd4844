"""Penalties and scores as aggregations over units, driven by a table of rules a language."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions import text as X

#: Default thresholds.
THRESHOLDS = {"acl_yellow": 10, "acl_red": 15, "complexity": 10, "type_safety": 90, "token_limit": 32000}

#: Documents that each profile requires.
PROFILES = {"generic": ["README.md"], "jules": ["agents.md", "instructions.md"], "copilot": []}

PASS_MARK = 70


@dataclass(frozen=True)
class Rules:
    """How a language's units turn into penalties; the texts are part of the results."""

    bloat_limit: int | None
    bloat_step: int
    bloat_text: str
    red_text: str
    yellow_text: str
    type_text: str | None  # null: units are never held to types
    type_limit: int | None = None  # null: the threshold applies


#: Limits, steps and message texts by language.
RULES = {
    "Python": Rules(200, 10, "Bloated File: %s lines (-%s)", "%s Red ACL functions (-%s)", "%s Yellow ACL functions (-%s)", "Type Safety Index %s%% < %s%% (-20)"),
    "JavaScript": Rules(200, 10, "Bloated File: %s lines (-%s)", "%s Red ACL functions (-%s)", "%s Yellow ACL functions (-%s)", "Type Safety Index %s%% < %s%% (-20)"),
    "Markdown": Rules(
        500, 25, "Bloated Documentation: %s lines (-%s)",
        "%s Red ACL sections detected. Ensure headers group content logically (-%s)",
        "%s Yellow ACL sections detected. Consider breaking down large documentation chunks (-%s)", None,
    ),
    "Docker": Rules(
        100, 10, "Bloated Dockerfile: %s lines (-%s)", "%s Red ACL instructions detected (-%s)", "%s Yellow ACL instructions detected (-%s)",
        "Best Practices Compliance %s%% < %s%% (-20)", 90,
    ),
}
TOKEN_TEXT = "Cumulative Token Budget Exceeded: %s > %s (-15)"
CONFIG_RED, CONFIG_YELLOW = "Red ACL detected: %s > %s (-15)", "Yellow ACL detected: %s > %s (-5)"
MALFORMED = "Malformed Configuration File (-20)"


def bloat(loc: Column, limit: int | Column, step: int | Column) -> Column:
    """Points lost for lines beyond the limit."""
    return F.greatest(F.lit(0), F.floor((loc - limit) / step)).cast("int")


def unit_stats(units: DataFrame, key: str, red: Column, yellow: Column) -> DataFrame:
    """Per file: ``n_units, complexity, type_index, n_red, n_yellow, max_acl``."""
    return units.groupBy(key).agg(
        F.count("*").alias("n_units"),
        F.avg("complexity").alias("complexity"),
        (F.sum(F.col("is_typed").cast("int")) / F.count("*") * 100.0).alias("type_index"),
        F.count_if(X.is_red(F.col("acl"), red)).alias("n_red"),
        F.count_if(X.is_yellow(F.col("acl"), yellow, red)).alias("n_yellow"),
        F.max("acl").alias("max_acl"),
    )


def penalised(language: str, typed: Column | None = None, rules: Rules | None = None) -> dict[str, Column]:
    """``score, issues, complexity, type_coverage`` for a file with ``loc, cumulative`` and unit statistics beside it.

    Also needs ``token_limit`` and ``type_safety``. Without units only bloat counts. ``typed`` says whether the
    file is held to types at all.
    """
    r = rules or RULES[language]
    some = F.coalesce("n_units", F.lit(0)) > 0
    lost_bloat = bloat(F.col("loc"), r.bloat_limit, r.bloat_step) if r.bloat_limit is not None else F.lit(0)
    lost_tokens = F.when(some & (F.col("cumulative") > F.col("token_limit")), 15).otherwise(0)
    lost_red = F.when(some, F.col("n_red") * 15).otherwise(0)
    lost_yellow = F.when(some, F.col("n_yellow") * 5).otherwise(0)
    held = F.lit(r.type_text is not None) if typed is None else typed
    limit = F.lit(r.type_limit) if r.type_limit is not None else F.col("type_safety")
    lost_type = F.when(some & held & (F.col("type_index") < limit), 20).otherwise(0)

    def said(lost: Column, text: str, *args: Column) -> Column:
        return F.when(lost > 0, F.format_string(text, *[a.cast("string") for a in args]))

    parts = [
        said(lost_bloat, r.bloat_text, F.col("loc"), lost_bloat),
        said(lost_tokens, TOKEN_TEXT, X.thousands(F.col("cumulative")), X.thousands(F.col("token_limit"))),
        said(lost_red, r.red_text, F.col("n_red"), lost_red),
        said(lost_yellow, r.yellow_text, F.col("n_yellow"), lost_yellow),
    ]
    if r.type_text:
        parts.append(said(lost_type, r.type_text, X.percent(F.col("type_index")), limit))
    score = F.lit(100) - lost_bloat - lost_tokens - lost_red - lost_yellow - lost_type
    return {
        "score": F.greatest(F.lit(0), score).cast("int"),
        "issues": F.concat_ws(", ", *parts),
        "complexity": F.coalesce(F.col("complexity"), F.lit(0.0)),
        "type_coverage": F.when(some & held, F.col("type_index")).otherwise(F.lit(100.0)),
    }


def config_penalised() -> dict[str, Column]:
    """As :func:`penalised` for configuration files: ``valid, acl, cumulative, token_limit, acl_red, acl_yellow``."""
    lost_tokens = F.when(F.col("cumulative") > F.col("token_limit"), 15).otherwise(0)
    red = X.is_red(F.col("acl"), F.col("acl_red"))
    yellow = X.is_yellow(F.col("acl"), F.col("acl_yellow"), F.col("acl_red"))
    lost_acl = F.when(red, 15).when(yellow, 5).otherwise(0)
    tokens = F.when(lost_tokens > 0, F.format_string(TOKEN_TEXT, X.thousands(F.col("cumulative")), X.thousands(F.col("token_limit"))))
    load = F.when(red, F.format_string(CONFIG_RED, X.one_decimal(F.col("acl")), F.col("acl_red").cast("string"))).when(
        yellow, F.format_string(CONFIG_YELLOW, X.one_decimal(F.col("acl")), F.col("acl_yellow").cast("string"))
    )
    return {
        "score": F.when(F.col("valid"), F.greatest(F.lit(0), 100 - lost_tokens - lost_acl)).otherwise(80).cast("int"),
        "issues": F.when(F.col("valid"), F.concat_ws(", ", tokens, load)).otherwise(MALFORMED),
    }


def project_penalty(missing: Column, malformed: Column, gods: Column, crowded: Column, cycles: Column) -> Column:
    """Points a project loses for missing documents, a broken pyproject, god modules, crowded directories and cycles."""
    return missing * 15 + malformed.cast("int") * 20 + gods * 10 + crowded * 5 + cycles * 5


def final_score(average: Column, penalty: Column, steering: Column, frameworks: Column) -> Column:
    """Four fifths file average, one fifth project score, bonuses for steering files and frameworks, 100 at most."""
    project = F.greatest(F.lit(0), 100 - penalty)
    bonus = F.when(steering, 5.0).otherwise(0.0) + F.when(frameworks, 10.0).otherwise(0.0)
    return F.least(F.lit(100.0), average * 0.8 + project * 0.2 + bonus)
