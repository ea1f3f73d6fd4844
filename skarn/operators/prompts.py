"""Prompt lint: structural heuristics over any text column, without user-defined functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions import text as X

#: The heuristics' patterns, weights and advice.
ROLE = r"(?i)(you are|act as|your role)"
SCAFFOLD = r"(?i)(step by step|reasoning|think|plan|step \d+|phase \d+)"
DELIMITER = r"""(?id)(<[^>]+>|'''|\"\"\"|```|\{\{.*?\}\})"""
FEW_SHOT = r"(?is)(example:|input:.*?output:)"
EXAMPLE_HEADER = r"(?imd)^#+.*(Example|Examples)"
NEGATIVE = r"(?i)(not|don't|do not|never)"
WEIGHT, PENALTY = 25, 10
ADVICE = {
    "role_definition": "Add a clear persona (e.g., 'You are a Python Expert') to ground the model's latent space.",
    "cognitive_scaffolding": "Add Chain-of-Thought instructions ('Think step by step') to improve complex reasoning.",
    "delimiter_hygiene": "Use delimiters (like XML tags or triple quotes) to separate instructions from input data.",
    "few_shot": "Include 1-3 examples (Few-Shot) to guide the model on format and style.",
    "negative_constraints": "Refactor negative constraints ('Don't do X') into positive instructions ('Do Y instead') for better adherence.",
}
EMPTY = "Prompt is empty."
#: Score from which a prompt passes.
PROMPT_PASS = 80

_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def few_shot(text: Column) -> Column:
    """Labelled examples, an example header, or a code fence within two lines after a line about an example."""
    rows = F.split(text, _LINE_ENDS, -1)
    at = F.sequence(F.lit(1), F.size(rows))

    def fence(k: Column) -> Column:
        return F.coalesce(X.strip(F.get(rows, k)).startswith("```"), F.lit(False))

    after = F.exists(at, lambda k: F.get(rows, k - 1).rlike(r"(?i)(example|sample)") & (fence(k) | fence(k + 1)))
    return text.rlike(FEW_SHOT) | text.rlike(EXAMPLE_HEADER) | after


def negative_constraint(text: Column) -> Column:
    """Whether a list line beyond the first fifth forbids something.

    A match never spans lines, so the text is cut once, at the line that holds the first fifth's end; of that line only
    matches from there on count, of later ones all.
    """
    first = F.ceil(F.length(text) * 0.2).cast("int")
    upto = F.length(F.element_at(F.split(F.substring(text, F.lit(1), first), "\n", -1), -1))  # of the cut line
    rows = F.split(F.substring(text, first - upto + 1, F.length(text)), "\n", -1)
    cut = F.get(rows, F.lit(0))

    def listed(line: Column) -> Column:
        line = X.strip(line)
        return ~line.rlike("(?id)currently.*not") & line.rlike(r"^(\*|-|\d+\.)")

    # The three characters before tell whether a "not" belongs to a "do not" that began too early.
    seen = F.least(upto, F.lit(3))
    rest = F.substring(cut, upto - seen + 1, F.length(cut))
    late = F.lit(False)
    for n in range(4):
        late = F.when(seen == n, rest.rlike(rf"(?is)^.{{{n}}}.*?((?<!do )not|don't|do not|never)")).otherwise(late)
    later = F.exists(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda line: line.rlike(NEGATIVE) & listed(line))
    return F.coalesce(late & listed(cut), F.lit(False)) | later


def checks(text: Column) -> dict[str, Column]:
    """Each heuristic's result; ``negative_constraints`` is true if there is no issue."""
    return {
        "role_definition": text.rlike(ROLE),
        "cognitive_scaffolding": text.rlike(SCAFFOLD),
        "delimiter_hygiene": text.rlike(DELIMITER),
        "few_shot": few_shot(text),
        "negative_constraints": ~negative_constraint(text),
    }


def lint(df: DataFrame, key: str, content: str) -> DataFrame:
    """``key, score, results map<string,boolean>, improvements array<string>`` of each row; null and blank text is empty."""
    text = F.coalesce(F.col(content).cast("string"), F.lit(""))
    found = df.select(F.col(key), text.alias("text")).withColumns({f"r_{k}": c for k, c in checks(F.col("text")).items()})
    empty = X.strip(F.col("text")) == ""
    names = list(ADVICE)
    score = sum((F.when(F.col(f"r_{k}"), WEIGHT).otherwise(0) for k in names[:4]), F.lit(0)) - F.when(F.col("r_negative_constraints"), 0).otherwise(PENALTY)
    results = F.create_map(*[x for k in names for x in (F.lit(k), F.col(f"r_{k}"))])
    advice = F.array_compact(F.array(*[F.when(~F.col(f"r_{k}"), ADVICE[k]) for k in names]))
    return found.select(
        key,
        F.when(empty, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score))).cast("int").alias("score"),
        F.when(empty, F.create_map().cast("map<string,boolean>")).otherwise(results).alias("results"),
        F.when(empty, F.array(F.lit(EMPTY))).otherwise(advice).alias("improvements"),
    )


def lint_report(name: str, row: dict) -> str:
    """A lint row as text."""
    lines = [f"Prompt Analysis: {name}", f"Score: {row['score']}/100"]
    lines += [f"{k.replace('_', ' ').title()}: {'PASS' if ok else 'FAIL'}" for k, ok in (row["results"] or {}).items()]
    if row["improvements"]:
        lines += ["Refactored Suggestions:", *[f"- {x}" for x in row["improvements"]]]
    lines.append("PASSED" if row["score"] >= PROMPT_PASS else "FAILED")
    return "\n".join(lines)
