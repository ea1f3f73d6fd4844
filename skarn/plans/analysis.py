"""The whole analysis of a source tree: files, units, graph, context, penalties, project score.

Every file is read and parsed once; all that follows is joins and aggregations over the parsed rows.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import configs, jscode, pycode, tokens
from skarn.functions import text as X
from skarn.operators import fix, graph, health, report, scoring, segment
from skarn.sources import repo
from skarn.sources.tables import durable

UNIT_COLUMNS = ["rel_path", "ord", "name", "lineno", "complexity", "loc", "acl", "is_typed", "nesting_depth"]


@dataclass(frozen=True)
class Analyzer:
    """How files of a language are measured and scored; :func:`register` adds one.

    ``units(files, tokens)`` gives ``UNIT_COLUMNS`` of the language's files, ``loc`` counts lines of a text, ``score()``
    gives columns ``score, issues`` (and ``complexity, type_coverage``) over unit statistics. ``names`` is a regular
    expression of file names, for languages that the engine doesn't know by itself.
    """

    language: str
    units: Callable[[DataFrame, Callable[[Column], Column]], DataFrame]
    loc: Callable[[Column], Column] = X.filled_loc
    score: Callable[[], dict[str, Column]] | None = None
    names: str | None = None

    def scored(self) -> dict[str, Column]:
        made = self.score() if self.score else scoring.penalised(self.language)
        return {"complexity": F.lit(0.0), "type_coverage": F.lit(100.0)} | made


ANALYZERS: dict[str, Analyzer] = {}


def register(analyzer: Analyzer) -> None:
    """Add a language, or replace one."""
    ANALYZERS[analyzer.language] = analyzer


@dataclass
class Analysis:
    """The tables of an analysis, and its small results."""

    results: DataFrame
    units: DataFrame
    edges: DataFrame
    inbound: DataFrame
    cycles: DataFrame
    final_score: float
    penalty: int
    project_issues: list[str]
    missing_docs: list[str]
    health: dict
    god_modules: dict[str, int]
    directory_stats: list[dict]
    report_style: str = "full"
    token_context: dict = field(default_factory=dict)

    def file_rows(self) -> list[dict]:
        """File results in order of path, units nested."""
        return [r.asDict(recursive=True) for r in self.results.orderBy("file").toLocalIterator()]


def token_counter(name: str = "chars4") -> Callable[[Column], Column]:
    """Token counts as an expression: a quarter of the characters, or a BPE vocabulary by file or name."""
    return X.token_estimate if name == "chars4" else tokens.counter(name)


def threshold_table(spark: SparkSession, config: dict, thresholds: dict | None) -> DataFrame:
    """``language`` and its thresholds: defaults, the project's, the caller's, the language's own, in that order."""
    rows = []
    for lang in ANALYZERS:
        t = scoring.THRESHOLDS | config.get("thresholds", {}) | (thresholds or {}) | config.get(lang.lower(), {}).get("thresholds", {})
        rows.append((lang, *[float(t[k]) if k.startswith("acl") else int(t[k]) for k in ("acl_yellow", "acl_red", "type_safety", "token_limit")]))
    return spark.createDataFrame(rows, "language string, acl_yellow double, acl_red double, type_safety int, token_limit int")


def inline(facts: DataFrame) -> DataFrame:
    return facts.select("rel_path", F.posexplode("units").alias("ord", "u")).select("rel_path", "ord", "u.*")


def docker_units(files: DataFrame, tokens) -> DataFrame:
    body = files.where("content is not null")
    return segment.instructions(segment.numbered_lines(body, "rel_path", "content", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), "rel_path")


def config_units(files: DataFrame, tokens) -> DataFrame:
    conf = configs.facts(files).where("valid").join(files.select("rel_path", "name", "content"), "rel_path")
    loc = X.code_loc(F.col("content"))
    given = {"ord": F.lit(0), "lineno": F.lit(1), "complexity": F.lit(0.0), "loc": loc, "acl": X.acl_config(F.col("depth"), loc), "is_typed": F.lit(True), "nesting_depth": F.col("depth")}
    return conf.withColumns(given)


register(Analyzer("Python", lambda files, tokens: inline(pycode.facts(files.where("content is not null"))), X.code_loc))
register(Analyzer("JavaScript", lambda files, tokens: inline(jscode.facts(files.where("content is not null"))), score=lambda: scoring.penalised("JavaScript", F.col("ext").isin(".ts", ".tsx"))))
register(Analyzer("Markdown", lambda files, tokens: segment.sections(segment.numbered_lines(files.where("content <> ''"), "rel_path", "content"), "rel_path", tokens(F.col("content")))))
register(Analyzer("Docker", docker_units, X.docker_loc))
register(Analyzer("Config", config_units, X.code_loc, scoring.config_penalised))


def recognised(files: DataFrame) -> DataFrame:
    """Files with the languages of analyzers that have name patterns of their own."""
    own = [a for a in ANALYZERS.values() if a.names]
    language = F.col("language")
    for a in own:
        language = F.when(F.col("name").rlike(a.names), a.language).otherwise(language)
    return files.withColumn("language", language) if own else files


def units_of(files: DataFrame, tokens=X.token_estimate, javascript: bool = True) -> tuple[DataFrame, DataFrame]:
    """All units, and the facts of Python files (imports, signatures)."""
    py = durable(pycode.facts(files.where("content is not null")), "python")
    units = None
    for lang, a in ANALYZERS.items():
        of = files.where(F.col("language") == lang)
        if lang == "JavaScript" and not javascript:
            continue
        # Python's facts are at hand: they hold the units too.
        part = inline(py.join(of.select("rel_path"), "rel_path", "left_semi")) if lang == "Python" else a.units(of, tokens)
        part = part.select(UNIT_COLUMNS)
        units = part if units is None else units.unionByName(part)
    return durable(units, "units"), py


def loc_of() -> Column:
    loc = X.filled_loc(F.col("content"))
    for lang, a in ANALYZERS.items():
        loc = F.when(F.col("language") == lang, a.loc(F.col("content"))).otherwise(loc)
    return loc


def file_results(files: DataFrame, units: DataFrame, context: DataFrame, limits: DataFrame, javascript: bool = True) -> DataFrame:
    """A row a file with score, issues and nested units; ``context (rel_path, tokens, cumulative)``."""
    base = files.withColumn("loc", loc_of()).select("rel_path", "ext", "language", "loc", "content")
    base = base.withColumn("valid", F.col("content").isNotNull()).drop("content")
    base = fix.with_thresholds(base, F.broadcast(limits), "language").join(context, "rel_path", "left")  # a row a language
    base = base.withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "cumulative": F.coalesce("cumulative", F.lit(0))})
    # Thresholds differ by language, so they come to the units before they are counted.
    rated = units.join(base.select("rel_path", "acl_red", "acl_yellow"), "rel_path")
    stats = scoring.unit_stats(rated, "rel_path", F.col("acl_red"), F.col("acl_yellow"))
    nested = units.groupBy("rel_path").agg(F.array_sort(F.collect_list(F.struct("ord", *UNIT_COLUMNS[2:]))).alias("function_metrics"))
    rows = base.join(stats, "rel_path", "left").join(nested, "rel_path", "left")
    rows = rows.withColumn("acl", F.coalesce("max_acl", F.lit(0.0))).withColumn("valid", F.coalesce("n_units", F.lit(0)) > 0)
    whole = {lang: a.scored() for lang, a in ANALYZERS.items()}
    if not javascript:
        whole["JavaScript"] = {"score": F.lit(0), "issues": F.lit("JavaScript/TypeScript parsing is switched off."), "complexity": F.lit(0.0), "type_coverage": F.lit(0.0)}
    out: dict[str, Column] = {}
    for name in ("score", "issues", "complexity", "type_coverage"):
        c = F.lit(None)
        for lang, made in whole.items():
            c = F.when(F.col("language") == lang, made[name]).otherwise(c)
        out[name] = c
    return rows.select(F.col("rel_path").alias("file"), "language", *[v.alias(k) for k, v in out.items()], "loc", "function_metrics", F.col("tokens").cast("int").alias("tokens"), F.col("cumulative").cast("long").alias("cumulative_tokens"), "acl")


def environment_health(spark: SparkSession, root: str, entries: DataFrame, files: DataFrame) -> dict:
    base = root if os.path.isdir(root) else os.path.dirname(os.path.abspath(root))
    found = health.environment(entries).first().asDict()
    deps = files.where(F.col("rel_path").isin(health.DEPENDENCY_FILES))
    rows = [(n, os.path.join(base, n)) for n in health.DEPENDENCY_FILES if os.path.isfile(os.path.join(base, n))]
    if rows:  # requirements.txt is no analyzable file, so both are read here
        texts = spark.createDataFrame([(open(p, encoding="utf-8", errors="ignore").read(),) for _, p in rows], "content string")
    else:
        texts = deps.select(F.col("content_lossy").alias("content")).limit(0)
    tools = list(health.frameworks(texts, "content").first()["found"] or [])
    steering = [n for n in health.STEERING if os.path.exists(os.path.join(base, n))]
    eco = {"has_context_files": bool(steering), "found_files": steering, "has_agent_frameworks": bool(tools), "found_frameworks": tools}
    return found | {"pyproject_valid": repo.valid_pyproject(root), "agentic_ecosystem": eco}


def critical_context(spark: SparkSession, root: str, tokens=X.token_estimate) -> dict:
    """Tokens of README, AGENTS.md and all signatures, and whether they exceed the budget.

    The estimate needs lengths alone, which are summed; a BPE vocabulary needs the whole text in one row.
    """
    py = pycode.facts(repo.python_files(spark, root, repo.hidden_or_cache))
    own = F.array_join("signatures", "\n")
    docs = {}
    for name in ("README.md", "AGENTS.md"):
        path = os.path.join(root, name)
        docs[name] = open(path, encoding="utf-8", errors="ignore").read() if os.path.isfile(path) else ""
    if tokens is X.token_estimate:
        length = health.critical_length(F.lit(len(docs["README.md"])), F.lit(len(docs["AGENTS.md"])), health.joined_length(F.length(own)))
        n = py.agg(X.tokens_of_length(length).alias("n")).first()["n"]
    else:
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rel_path", own.alias("s")))), lambda x: x["s"]), "\n")
        whole = health.critical_context(F.lit(docs["README.md"]), F.lit(docs["AGENTS.md"]), F.col("s"))
        n = py.agg(text.alias("s")).select(tokens(whole).alias("n")).first()["n"]
    return {"token_count": n, "alert": n > scoring.THRESHOLDS["token_limit"]}


def directory_entropy(spark: SparkSession, root: str) -> dict:
    """Files a directory, hidden directories and caches left out, and whether they are too many."""
    return health.entropy(repo.directories(spark, root).where(~F.col("hidden"))).first().asDict()


def perform_analysis(
    spark: SparkSession, path: str, agent: str = "generic", limit_to_files: list[str] | None = None, thresholds: dict | None = None,
    config: dict | None = None, report_style: str = "full", tokens: str = "chars4", javascript: bool = True,
) -> Analysis:
    """Analyse a directory or a file. ``limit_to_files`` narrows what is scored, never the graph."""
    root = path if os.path.isdir(path) else os.path.dirname(os.path.abspath(path))
    config = config if config is not None else repo.load_config(path, {"thresholds": {}})
    count = token_counter(tokens)
    names = [a.names for a in ANALYZERS.values() if a.names]
    files = durable(recognised(repo.files(spark, path, names)), "files")
    units, py = units_of(files, count, javascript)
    nodes = files.select("rel_path")
    edges = durable(graph.module_edges(pycode.module_names(py), nodes), "edges")
    own = files.select(F.col("rel_path").alias("node"), count(F.col("content_lossy")).alias("tokens"))
    own = durable(own, "tokens")
    context = own.join(graph.context_tokens(own, edges), "node", "left").select(F.col("node").alias("rel_path"), "tokens", "cumulative")
    scored = files if limit_to_files is None else fix.limited(files, "rel_path", limit_to_files)
    results = durable(file_results(scored, units, context, threshold_table(spark, config, thresholds), javascript), "results")

    names = nodes.select(F.col("rel_path").alias("node"))
    degree = durable(graph.inbound(names, edges), "inbound")
    gods = {r["node"]: r["inbound"] for r in degree.where("inbound > 50").orderBy("node").toLocalIterator()}
    cycles = durable(graph.cycles(names, edges), "cycles")
    n_cycles = cycles.select("comp", "nth").distinct().count()
    entries = repo.root_entries(spark, root)
    required = spark.createDataFrame(list(enumerate(scoring.PROFILES.get(agent, scoring.PROFILES["generic"]))), "ord int, name string")
    missing = [r["name"] for r in health.missing_docs(required, entries).orderBy("ord").toLocalIterator()]
    crowded = [r.asDict() for r in health.crowded_directories(repo.directories(spark, root)).orderBy("path").toLocalIterator()]
    crowded = [d | {"path": os.path.basename(os.path.abspath(root)) if d["path"] == "." else d["path"]} for d in crowded]
    env = environment_health(spark, root, entries, files)

    issues = []
    if missing:
        issues.append(f"Missing Critical Agent Docs: {', '.join(missing)}")
    if not env["pyproject_valid"]:
        issues.append("Malformed pyproject.toml detected")
    if gods:
        issues.append(f"God Modules Detected (Inbound > 50): {', '.join(gods)}")
    if crowded:
        issues.append(f"High Directory Entropy (>50 files): {', '.join(d['path'] for d in crowded)}")
    if n_cycles:
        issues.append(f"Circular Dependencies Detected: {n_cycles}")
    eco = env["agentic_ecosystem"]
    penalty = scoring.project_penalty(F.lit(len(missing)), F.lit(not env["pyproject_valid"]), F.lit(len(gods)), F.lit(len(crowded)), F.lit(n_cycles))
    mean = results.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean"))
    row = mean.select(penalty.alias("penalty"), scoring.final_score(F.col("mean"), penalty, F.lit(eco["has_context_files"]), F.lit(eco["has_agent_frameworks"])).alias("final")).first()
    return Analysis(results, units, edges, degree, cycles, row["final"], row["penalty"], issues, missing, env, gods, crowded, report_style)


def cycle_lists(a: Analysis) -> list[list[str]]:
    rows = a.cycles.groupBy("comp", "nth").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "file"))), lambda x: x["file"]).alias("files"))
    return [r["files"] for r in rows.orderBy("comp", "nth").toLocalIterator()]


def full_report(a: Analysis, path: str, agent: str = "generic", style: str = "full") -> str:
    return report.markdown_report(a.file_rows(), a.final_score, path, {"description": agent}, a.project_issues, style, a.health)
