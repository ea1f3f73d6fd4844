"""Metrics of text as column expressions: lines of code, tokens, cognitive load, Dockerfile practices, formats.

All of them take columns and return columns, so they fuse into the scan's stage. Regular expressions follow the
Unicode rules of Python's ``str`` methods where those decide a result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ``str.strip`` sees it, for Java expressions.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def lines(text: Column) -> Column:
    """Lines between line feeds."""
    return F.split(text, "\n", -1)


def code_loc(text: Column) -> Column:
    """Lines that are neither blank nor comments starting with ``#``; null text has none."""
    kept = F.filter(F.transform(lines(text), strip), lambda x: (x != "") & ~x.startswith("#"))
    return F.when(text.isNull(), 0).otherwise(F.size(kept))


def filled_loc(text: Column) -> Column:
    """Lines that are not blank."""
    return F.when(text.isNull(), 0).otherwise(F.size(F.filter(F.transform(lines(text), strip), lambda x: x != "")))


def docker_loc(text: Column) -> Column:
    """As :func:`code_loc`, over every kind of line end."""
    kept = F.filter(F.transform(F.split(text, r"\R|[\x1c-\x1e]", -1), strip), lambda x: (x != "") & ~x.startswith("#"))
    return F.when(text.isNull(), 0).otherwise(F.size(kept))


def tokens_of_length(length: Column) -> Column:
    """A quarter of the code points, rounded down."""
    return F.coalesce(F.floor(length / 4), F.lit(0)).cast("int")


def token_estimate(text: Column) -> Column:
    """That of a text."""
    return tokens_of_length(F.length(text))


# --- agent cognitive load ---


def acl_code(complexity: Column, loc: Column, depth: Column) -> Column:
    return (depth * 2.0) + (complexity * 1.5) + (loc / 50.0)


def acl_markdown(tokens: Column, depth: Column) -> Column:
    return (depth * 1.5) + (tokens / 100.0)


def acl_docker(complexity: Column, loc: Column) -> Column:
    return F.greatest(F.lit(0.0), complexity - 1.0) * 1.5 + loc * 0.5


def acl_config(depth: Column, loc: Column) -> Column:
    return (depth * 2.0) + (loc / 50.0)


def is_red(acl: Column, red: Column) -> Column:
    return acl > red


def is_yellow(acl: Column, yellow: Column, red: Column) -> Column:
    return (acl > yellow) & (acl <= red)


# --- Markdown and Dockerfiles ---


def header_depth(header: Column) -> Column:
    """Number of leading hash signs."""
    return F.length(F.regexp_extract(header, r"^(#+)", 1))


def instruction_name(text: Column) -> Column:
    return F.upper(F.regexp_extract(text, r"(?U)^\s*(\S+)", 1))


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def chained_commands(text: Column) -> Column:
    """One more than the ``&&`` and ``;`` in an instruction."""
    return occurrences(text, "&&") + occurrences(text, ";") + 1


def from_ok(text: Column) -> Column:
    """A base image names a tag other than ``latest``, or is ``scratch``; options before it are skipped."""
    words = F.split(strip(text), r"(?U)\s+")
    second = F.get(words, F.lit(1))
    image = F.when(second.startswith("--") & (F.size(words) > 2), F.get(words, F.lit(2))).otherwise(second)
    return F.when(F.size(words) <= 1, True).when(F.lower(image) == "scratch", True).otherwise(image.contains(":") & ~image.endswith(":latest"))


def practice_ok(name: Column, text: Column) -> Column:
    """Best practices of a Dockerfile instruction."""
    return (
        F.when(name == "FROM", from_ok(text))
        .when(name == "ADD", False)
        .when(name == "RUN", ~text.contains("sudo ") & ~text.contains("apt-get upgrade"))
        .otherwise(True)
    )


# --- formats and predicates ---


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def percent(c: Column) -> Column:
    """Whole percent, halves to even."""
    return F.bround(c, 0).cast("long").cast("string")


def one_decimal(c: Column) -> Column:
    return F.format_string("%.1f", F.bround(c, 1))


def hidden_path(path: Column) -> Column:
    """Whether any component starts with a dot."""
    return F.exists(F.split(path, "/"), lambda x: x.startswith("."))


def language(name: Column) -> Column:
    """The analyzer of a file name, in order of precedence; null if there is none."""

    def ends(*exts: str) -> Column:
        return name.rlike("(" + "|".join(e.replace(".", r"\.") for e in exts) + ")$")

    return (
        F.when(ends(".py"), "Python")
        .when(ends(".md"), "Markdown")
        .when((name == "Dockerfile") | name.startswith("Dockerfile."), "Docker")
        .when(ends(".js", ".jsx", ".ts", ".tsx"), "JavaScript")
        .when(ends(".json", ".yaml", ".yml", ".toml"), "Config")
    )


def contained_terms(text: Column, terms: list[str]) -> Column:
    """The sorted terms that a text contains, in any case."""
    low = F.lower(text)
    return F.array_sort(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, F.lower(t))))


def badge_color(score: Column) -> Column:
    return F.when(score >= 90, "#4c1").when(score >= 70, "#97ca00").when(score >= 50, "#dfb317").otherwise("#e05d44")


def fenced_code(text: Column) -> Column:
    """The content of the first code fence, or the whole text; stripped."""
    inner = F.regexp_extract(text, r"(?s)```(?:python)?\s*\n?(.*?)```", 1)
    return strip(F.when(F.regexp_like(text, F.lit(r"(?s)```(?:python)?\s*\n?(.*?)```")), inner).otherwise(text))
