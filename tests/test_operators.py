"""Operators over small tables with known results."""

import random
import subprocess
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from skarn import metrics
from skarn.operators import fix, graph, health, prompts, report, scoring, segment
from skarn.sources import issues, models


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def pairs(df):
    return {tuple(r) for r in df.collect()}


def edges_of(spark, text):
    rows = [tuple(e.split(">")) for e in text.split()]
    nodes = sorted({n for r in rows for n in r})
    return frame(spark, [(n,) for n in nodes], "node string"), frame(spark, rows, "src string, dst string")


def found_cycles(spark, text):
    nodes, edges = edges_of(spark, text)
    rows = graph.cycles(nodes, edges).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["comp"], r["nth"], r["pos"])):
        out.setdefault((r["comp"], r["nth"]), []).append(r["file"])
    return sorted(out.values())


def test_sections(spark):
    text = "# One\nbody\n\n## Two\na\nb\nc\n### Three ###\n"
    lines = segment.numbered_lines(frame(spark, [("f", text), ("g", "intro\n# H")], "k string, t string"), "k", "t")
    got = [(r["k"], r["name"], r["lineno"], r["nesting_depth"], r["loc"]) for r in segment.sections(lines, "k").orderBy("k", "ord").collect()]
    assert got == [("f", "# One", 1, 1, 3), ("f", "## Two", 4, 2, 4), ("f", "### Three ###", 8, 3, 1), ("g", "# Introduction", 1, 1, 1), ("g", "# H", 2, 1, 1)]


def test_instructions(spark):
    text = "FROM python:3.12\n# note\nRUN a && \\\n\n# inside\n  b; \\\n  c\nCOPY . .\nrun x \\\n"
    lines = segment.numbered_lines(frame(spark, [("f", text)], "k string, t string"), "k", "t")
    got = [(r["name"], r["lineno"], r["loc"], r["complexity"], r["acl"], r["is_typed"]) for r in segment.instructions(lines, "k").orderBy("ord").collect()]
    assert got == [("FROM", 1, 1, 1.0, 0.5, True), ("RUN", 3, 5, 3.0, 5.5, True), ("COPY", 8, 1, 1.0, 0.5, True)]


def test_follows_within(spark):
    lines = segment.numbered_lines(frame(spark, [("f", "example\nx\n```\nexample\nx\ny\n```")], "k string, t string"), "k", "t")
    got = segment.follows_within(lines, "k", F.col("line").contains("example"), F.col("line").startswith("```"), 2)
    assert [r["lineno"] for r in got.collect()] == [1]


def test_module_edges(spark):
    files = frame(spark, [(p,) for p in ("a.py", "pkg/b.py", "pkg/config.json", "x/pkg/b.py", "pkg/__init__.py", "bb.py")], "rel_path string")
    imports = frame(spark, [("a.py", "pkg.b"), ("a.py", "config"), ("a.py", "pkg"), ("pkg/b.py", "b"), ("bb.py", "b"), ("a.py", "")], "rel_path string, module string")
    assert pairs(graph.module_edges(imports, files)) == {("a.py", "pkg/b.py"), ("a.py", "x/pkg/b.py"), ("a.py", "pkg/config.json"), ("pkg/b.py", "x/pkg/b.py"), ("bb.py", "pkg/b.py"), ("bb.py", "x/pkg/b.py")}


def test_package_edges(spark):
    files = frame(spark, [(p,) for p in ("main.py", "p/__init__.py", "p/a.py", "p/q/b.py", "ab.py")], "rel_path string")
    rows = [("main.py", "p.a", 0), ("main.py", "b", 0), ("p/a.py", None, 1), ("p/q/b.py", "a", 2), ("p/q/b.py", "zz", 1)]
    got = pairs(graph.package_edges(frame(spark, rows, "rel_path string, module string, level int"), files))
    assert got == {("main.py", "p/a.py"), ("main.py", "ab.py"), ("p/a.py", "p/__init__.py"), ("p/q/b.py", "p/a.py")}


def test_inbound(spark):
    nodes, edges = edges_of(spark, "main>utils utils>shared main>utils")
    assert pairs(graph.inbound(nodes, edges.distinct())) == {("main", 0), ("utils", 1), ("shared", 1)}


def test_closure_and_context(spark):
    nodes, edges = edges_of(spark, "a>b a>c b>d c>d d>e")
    assert ("a", "e") in pairs(graph.closure(edges))
    tokens = nodes.withColumn("tokens", F.lit(10))
    assert pairs(graph.context_tokens(tokens, edges)) == {("a", 50), ("b", 30), ("c", 30), ("d", 20), ("e", 10)}
    nodes, edges = edges_of(spark, "a>b b>a")
    tokens = nodes.withColumn("tokens", F.when(F.col("node") == "a", 10).otherwise(20))
    assert pairs(graph.context_tokens(tokens, edges)) == {("a", 30), ("b", 30)}


def test_cycles(spark):
    assert found_cycles(spark, "a.py>b.py b.py>c.py c.py>a.py d.py>b.py") == [["a.py", "b.py", "c.py"]]
    assert found_cycles(spark, "a>a a>b x>y y>x") == [["x", "y"]]


def test_cycles_depend_on_one_search_only():
    rng = random.Random(3)
    for _ in range(50):
        names = [f"n{i}" for i in range(8)]
        g = {n: [m for m in names if rng.random() < 0.2] for n in names}
        every = set(graph.elementary_cycles(g))
        assert set(graph.back_edge_cycles(g)) <= {graph.canonical(list(c)) for c in every}


def test_elementary_cycles(spark):
    g = {"a": ["b", "c"], "b": ["c", "a"], "c": ["a", "c"]}
    assert sorted(graph.elementary_cycles(g)) == [("a", "b"), ("a", "b", "c"), ("a", "c"), ("c",)]


def test_entropy(spark):
    counts = lambda *ns: frame(spark, [(f"d{i}", n) for i, n in enumerate(ns)], "path string, files long")
    got = [health.entropy(counts(*ns)).first().asDict() for ns in ((0, 10, 5), (20,), (60, *[0] * 11))]
    assert [(g["avg_files"], g["warning"], g["max_files"]) for g in got] == [(5.0, False, 10), (20.0, True, 20), (5.0, True, 60)]
    assert health.entropy(counts().limit(0)).first().asDict() == {"avg_files": 0.0, "max_files": 0, "warning": False, "crowded_dirs": []}


def test_missing_docs(spark):
    required = frame(spark, [(0, "README.md"), (1, "Agents.md")], "ord int, name string")
    assert [r["name"] for r in health.missing_docs(required, frame(spark, [("readme.MD",)], "name string")).collect()] == ["Agents.md"]


def lint(spark, text):
    return prompts.lint(frame(spark, [(1, text)], "id int, t string"), "id", "t").first()


def test_prompts(spark):
    perfect = "You are an expert.\nThink step by step.\n<input>x</input>\nExample: a"
    assert lint(spark, perfect)["score"] == 100 and lint(spark, perfect)["improvements"] == []
    bad = lint(spark, "x" * 100 + "\n* Don't fail.")
    assert bad["score"] == 0 and len(bad["improvements"]) == 5
    for empty in (" \n", "", None):
        assert (lint(spark, empty)["score"], lint(spark, empty)["improvements"]) == (0, ["Prompt is empty."])
    text = "x" * 50 + "\n{}"
    flagged = lambda line: not lint(spark, text.format(line))["results"]["negative_constraints"]
    assert flagged("* never do that") and flagged("1. do not") and not flagged("it does not work") and not flagged("- currently it does not work")
    assert not lint(spark, "* never\n" + "y" * 100)["results"]["negative_constraints"] is False
    assert lint(spark, "a sample\n\n ```x")["results"]["few_shot"] and not lint(spark, "a sample\n\n\n```x")["results"]["few_shot"]
    assert lint(spark, "## My Examples")["results"]["few_shot"] and lint(spark, "INPUT: a\nb OUTPUT: c")["results"]["few_shot"]


def test_negative_constraints_as_python_sees_them(spark):
    """The native expression against a restatement of the rule, on random texts."""
    import re

    rng = random.Random(5)
    bits = ["not", "Never", "do not", "don't", "* ", "- ", "12. ", "\n", " ", "currently ", "é", "𝒳", "\r", "word", "knot "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)]

    def rule(t):
        for m in re.finditer(r"(?i)(not|don't|do not|never)", t):
            start, end = t.rfind("\n", 0, m.start()) + 1, t.find("\n", m.end())
            line = t[start : len(t) if end < 0 else end].strip()
            if m.start() >= len(t) * 0.2 and not re.search(r"(?i)currently.*not", line) and re.match(r"^(\*|\-|\d+\.)", line):
                return True
        return False

    df = frame(spark, list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r["v"] for r in df.select("id", prompts.negative_constraint(F.col("t")).alias("v")).collect()}
    assert [t for i, t in enumerate(texts) if got[i] != rule(t)] == []


def test_penalties(spark):
    cols = "loc int, cumulative int, token_limit int, type_safety int, n_units int, n_red int, n_yellow int, type_index double, complexity double"
    rows = [(310, 0, 32000, 90, 0, None, None, None, None), (330, 40000, 32000, 90, 2, 1, 1, 50.0, 3.0), (10, 0, 32000, 90, 1, 0, 0, 0.0, 1.0)]
    c = scoring.penalised("Python")
    got = frame(spark, rows, cols).select(*[v.alias(k) for k, v in c.items()]).collect()
    assert (got[0]["score"], got[0]["issues"], got[0]["type_coverage"]) == (89, "Bloated File: 310 lines (-11)", 100.0)
    assert got[1]["score"] == 100 - 13 - 15 - 15 - 5 - 20
    assert got[1]["issues"] == "Bloated File: 330 lines (-13), Cumulative Token Budget Exceeded: 40,000 > 32,000 (-15), 1 Red ACL functions (-15), 1 Yellow ACL functions (-5), Type Safety Index 50% < 90% (-20)"
    assert (got[2]["score"], got[2]["issues"]) == (80, "Type Safety Index 0% < 90% (-20)")


def test_config_penalties(spark):
    rows = [(True, 12.02), (True, 16.02), (False, 0.0)]
    df = frame(spark, rows, "valid boolean, acl double").withColumns({k: F.lit(v) for k, v in {"cumulative": 0, "token_limit": 32000, "acl_red": 15, "acl_yellow": 10}.items()})
    c = scoring.config_penalised()
    got = df.select(c["score"].alias("s"), c["issues"].alias("i")).collect()
    assert [tuple(r) for r in got] == [(95, "Yellow ACL detected: 12.0 > 10 (-5)"), (85, "Red ACL detected: 16.0 > 15 (-15)"), (80, "Malformed Configuration File (-20)")]


def test_recommendations(spark):
    rows = [("a.py", 25.0, "Circular dependency found", 80.0), ("b.py", None, None, None)]
    missing = frame(spark, [("agents.md",)], "name string")
    got = report.recommendations(frame(spark, rows, "file string, complexity double, issues string, type_coverage double"), missing).orderBy("file", "ord").collect()
    assert [r["finding"] for r in got] == ["High Complexity: a.py", "Circular Dependency: a.py", "Low Type Safety: a.py", "Missing AGENTS.md"]
    assert "| Missing AGENTS.md |" in report.recommendations_report(got) and "Agent-Ready" in report.recommendations_report([])


def test_ranked(spark):
    df = frame(spark, [("fn1", 15.0, 10, 2.0), ("fn2", 12.0, 50, 5.0), ("fn3", 11.0, 5, 10.0)], "name string, acl double, loc int, complexity double")
    names = lambda *a: [r["name"] for r in report.ranked(df, *a).orderBy("rank").collect()]
    assert names("acl") == ["fn1", "fn2", "fn3"] and names("acl", 2) == ["fn1", "fn2"] and names("loc") == ["fn2", "fn1", "fn3"] and names("complexity") == ["fn3", "fn2", "fn1"]


def test_rendered():
    unit = {"name": "fn1", "acl": 18.0, "loc": 3, "complexity": 2.0}
    rows = [{"file": "a.py", "score": 60, "issues": "1 Red", "type_coverage": 50.0, "function_metrics": [unit]}, {"file": "good.py", "score": 100, "issues": "", "type_coverage": 100.0, "function_metrics": []}]
    full = report.markdown_report(rows, 70.0, ".", {"description": "x"}, ["God Modules Detected (Inbound > 50): m.py"])
    assert "# Report v1" in full and "Overall Score: 70.0/100" in full and "PASSED" in full and "🔴 Red" in full and "God Module `m.py`" in full and "good.py" in full
    assert "good.py" not in report.markdown_report(rows, 50, ".", {}, style="actionable") and "File Analysis" not in report.markdown_report(rows, 50, ".", {}, style="collapsed")
    assert "✅ All functions meet the Agent Cognitive Load (ACL) target of <= 10." in report.acl_section([])
    assert "95/100" in report.badge(95.9) and "#4c1" in report.badge(95)
    text = report.advisor_report(rows, {"m": 51}, {"d": 60}, [["a", "b"]])
    assert all(s in text for s in ("Hallucination Zones", "God Modules", "Circular Dependencies", "Directory Entropy", "a -> b -> a"))
    health_ = {"agents_md": True, "lock_file": False, "baml_detected": True, "agentic_ecosystem": {"has_context_files": True, "found_files": [".cursorrules"], "found_frameworks": []}}
    assert "(baml) (+10)" in report.environment_section(health_) and ".cursorrules" in report.environment_section(health_) and report.environment_section({}) == ""


def test_fix(spark, tmp_path):
    assert fix.clean("x\n```python\na = 1\n```\ny") == "a = 1" and fix.clean(" b ") == "b"
    assert fix.usable("a=1", "```\na=2\n```") == "a=2" and fix.usable("a=1", "a=1") is None and fix.usable("a", "def (") is None
    files = frame(spark, [("a.py", "x = 1"), ("b.py", "y = 1")], "rel_path string, content string")
    units = frame(spark, [("a.py", 20.0, True), ("b.py", 1.0, True)], "rel_path string, acl double, is_typed boolean")
    assert [tuple(r) for r in fix.rewrites(files, units, lambda system, user: "```python\nx = 2\n```").collect()] == [("a.py", "x = 1", "x = 2")]
    assert fix.create_missing(str(tmp_path), "jules") == ["agents.md", "instructions.md"] and fix.create_missing(str(tmp_path), "jules") == []
    have = frame(spark, [("t1",)], "title string")
    assert [r["title"] for r in fix.new_issues(frame(spark, [("t1",), ("t2",)], "title string"), have).collect()] == ["t2"]
    parsed = fix.parsed_issues(frame(spark, [("### File: `a.py` - Low Type Safety\nfix a\n\n### File: `b.py` - High Cognitive Load\nfix b\n",)], "t string"), "t")
    assert [r["file"] for r in parsed.collect()] == ["a.py", "b.py"] and '"a.py"' in fix.typing_tasks(parsed).first()["json"]
    limited = fix.limited(frame(spark, [("ba.py",), ("c.py",)], "p string"), "p", ["a.py"])
    assert [r["p"] for r in limited.collect()] == ["ba.py"] and fix.limited(limited, "p", []).count() == 0


def test_changed_and_limited(spark):
    rows = frame(spark, [("a.py",), ("a.py",), ("b.py",)], "p string")
    assert sorted(r["p"] for r in fix.changed(rows, "p").collect()) == ["a.py", "b.py"]
    assert [r["p"] for r in fix.changed(rows, "p", ["a.py"]).collect()] == ["a.py"] and fix.changed(rows, "p", []).count() == 0


class Memory:
    """A tracker that remembers."""

    def __init__(self, *titles):
        self.titles, self.bodies = list(titles), {}

    def open_titles(self):
        return self.titles

    def create(self, title, body):
        self.titles.append(title)
        self.bodies[title] = body
        return f"#{len(self.titles)}"


def test_issues(spark):
    text = "".join(f"### File: `{f}` - {k}\nfix {f}\n\n" for f, k in (("a.py", "High Cognitive Load"), ("b.py", "High Cognitive Load"), ("c.py", "Low Type Safety"), ("b.py", "High Cognitive Load")))
    parsed = fix.parsed_issues(frame(spark, [(text,)], "t string"), "t")
    tracker = Memory("Refactor: a.py (High Cognitive Load)")
    assert issues.publish(parsed, tracker) == ["#2"] and tracker.bodies == {"Refactor: b.py (High Cognitive Load)": "fix b.py"}
    assert issues.publish(parsed, tracker) == [] and issues.publish(parsed.limit(0), tracker) == []


def test_github_tracker(monkeypatch):
    calls = []

    def run(command, **_):
        calls.append(command)
        if "edit" in command and command[-1] == "ai-ready":
            raise subprocess.CalledProcessError(1, command)
        return subprocess.CompletedProcess(command, 0, stdout='[{"title": "x"}]' if "list" in command else "https://example.org/1\n")

    monkeypatch.setattr(subprocess, "run", run)
    tracker = issues.GithubTracker()
    assert tracker.open_titles() == ["x"] and tracker.create("t", "b") == "https://example.org/1"
    assert tracker.failed_labels == ["ai-ready"] and calls[1] == ["gh", "issue", "create", "--title", "t", "--body", "b"]


def test_model(capsys):
    seen = []

    def complete(**given):
        seen.append(given)
        return SimpleNamespace(choices=[SimpleNamespace(message=SimpleNamespace(content="code"))])

    assert models.Model.from_config({"model": "m", "api_key": "k"}, complete)("s", "u") == "code"
    assert seen == [{"model": "m", "api_key": "k", "temperature": 0.0, "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}]
    assert models.Model.from_config(None).name == models.DEFAULT_MODEL

    def broken(**_):
        raise RuntimeError("no answer")

    assert models.Model(complete=broken)("s", "u") == "" and "no answer" in capsys.readouterr().err
    try:
        import litellm  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="litellm is required"):
            models.Model()("s", "u")


def test_single_file_measures(tmp_path):
    p = tmp_path / "a.py"
    p.write_text("import x\n# note\n\ndef f(a: int):\n    if a:\n        return 1\n\nasync def g(b):\n    return 2\n")
    path = str(p)
    assert (metrics.loc(path), metrics.complexity(path), metrics.type_coverage(path), metrics.tokens(path)) == (6, 1.5, 50.0, len(p.read_text()) // 4)
    assert [u["name"] for u in metrics.units(path)] == ["f", "g"] and metrics.max_depth(p.read_text()) == 1 and metrics.max_depth("def (") == 0
    assert metrics.load(4, 50, 2) == 11.0 and "types 50%" in metrics.dump(path) and "Yellow: f" in metrics.dump(path, yellow=1)
    p.write_text("def (")
    assert (metrics.complexity(path), metrics.type_coverage(path), metrics.units(path)) == (0.0, 0.0, [])


def test_environment_table():
    health_ = {"agents_md": False, "lock_file": True, "baml_detected": True, "agentic_ecosystem": {"has_context_files": False, "found_files": [], "found_frameworks": ["baml"]}}
    text = report.environment_table(health_, {"avg_files": 3.25, "warning": True}, {"token_count": 12345, "alert": False})
    assert [line[24:] for line in text.splitlines()[1:]] == ["FAIL", "PASS", "PASS (baml)", "None", "3.2 files/dir (warning)", "12,345 tokens"]
