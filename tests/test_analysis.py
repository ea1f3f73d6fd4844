"""Whole analyses of small trees, the command line, configuration and streaming."""

import pytest
from pyspark.sql import functions as F

from skarn import cli
from skarn.plans import analysis
from skarn.sources import repo
from skarn.streaming import incremental


def test_listing(tree):
    root = tree({"good.py": "", "node_modules/bad.py": "", ".venv/bad2.py": "", "__init__.py": "", ".hidden.py": "", "sub/Dockerfile.dev": "", "x.txt": ""})
    assert [r[0] for r in repo.listing(root)] == [".hidden.py", "__init__.py", "good.py", "sub/Dockerfile.dev"]
    assert [r[0] for r in repo.listing(f"{root}/good.py")] == ["good.py"] and repo.listing(f"{root}/x.txt") == []


def test_strict_and_lossy_text(spark, tree):
    root = tree({"a.py": "x\r\ny"})
    with open(f"{root}/b.py", "wb") as f:
        f.write(b"z\xff")
    got = {r["rel_path"]: (r["content"], r["content_lossy"]) for r in repo.files(spark, root).collect()}
    assert got == {"a.py": ("x\ny", "x\ny"), "b.py": (None, "z")}


def test_malformed_pyproject(spark, tree):
    a = analysis.perform_analysis(spark, tree({"README.md": "# Hi\n", "m.py": "def f(): pass\n", "pyproject.toml": "[[["}))
    scores = {r["file"]: r["score"] for r in a.file_rows()}
    assert scores == {"README.md": 100, "m.py": 80, "pyproject.toml": 80}
    assert "Malformed pyproject.toml detected" in a.project_issues and round(a.final_score, 2) == 85.33


def test_nested_and_long(spark, tree):
    deep = "def f(a):\n" + "".join("    " * (k + 1) + f"if a > {k}:\n" for k in range(5)) + "    " * 6 + "return 1\n"
    a = analysis.perform_analysis(spark, tree({"a.py": deep + "x = 1\n" * 320, "b.py": "x = 1\n" * 310, "README.md": "# R"}))
    rows = {r["file"]: r for r in a.file_rows()}
    assert rows["a.py"]["score"] == 53
    assert (rows["b.py"]["score"], rows["b.py"]["loc"], rows["b.py"]["issues"]) == (89, 310, "Bloated File: 310 lines (-11)")


def test_red_unit(spark, tree):
    body = "def f(a: int):\n    if a:\n        if a:\n            if a:\n                pass\n" + "    a = 1\n" * 195
    row = analysis.perform_analysis(spark, tree({"a.py": body})).file_rows()[0]
    assert row["function_metrics"][0]["acl"] == 16.0 and row["function_metrics"][0]["loc"] == 200
    assert "1 Red ACL functions (-15)" in row["issues"]


def test_context_economics(spark, tree):
    big = "".join(f"def function_number_{i}(value):\n    return value + {i}\n" for i in range(3000))
    a = analysis.perform_analysis(spark, tree({"big.py": big, "main.py": "import big\ndef f(x: int): pass\n"}))
    row = {r["file"]: r for r in a.file_rows()}["main.py"]
    assert row["cumulative_tokens"] > 32000 and "Cumulative Token Budget Exceeded" in row["issues"]


def test_graph_bonus_and_limit(spark, tree):
    files = {f"u{i}.py": "import hub\nimport loop_a\n" for i in range(51)}
    files |= {"hub.py": "", "loop_a.py": "import loop_b", "loop_b.py": "import loop_a", ".cursorrules": "x", "requirements.txt": "Pydantic-AI\nlangfuse"}
    a = analysis.perform_analysis(spark, tree(files), limit_to_files=["hub.py"])
    assert a.god_modules == {"hub.py": 51, "loop_a.py": 52} and [r["file"] for r in a.file_rows()] == ["hub.py"]
    assert analysis.cycle_lists(a) == [["loop_a.py", "loop_b.py"]]
    assert a.health["agentic_ecosystem"]["found_frameworks"] == ["langfuse", "pydantic-ai"] and a.health["lock_file"]
    # a missing README, two god modules, a crowded root and a cycle
    assert a.penalty == 15 + 20 + 5 + 5 and a.final_score == min(100, 80 + 0.2 * 55 + 15)
    assert a.directory_stats == [{"path": "repo", "file_count": 56}]


def test_other_languages(spark, tree):
    docker = "FROM python:latest\nADD a b\nRUN sudo ls\nRUN apt-get upgrade\n"
    a = analysis.perform_analysis(spark, tree({"Dockerfile": docker, "a.ts": "function f(a) { return a }", "b.js": "function f(a) { return a }", "d.md": "Word \n" * 600, "e.json": "{"}))
    rows = {r["file"]: r for r in a.file_rows()}
    assert rows["Dockerfile"]["issues"] == "Best Practices Compliance 0% < 90% (-20)"
    assert (rows["a.ts"]["score"], rows["a.ts"]["type_coverage"]) == (80, 0.0) and rows["b.js"]["score"] == 100
    assert "Bloated Documentation: 600 lines (-4)" in rows["d.md"]["issues"]
    assert (rows["e.json"]["score"], rows["e.json"]["issues"]) == (80, "Malformed Configuration File (-20)")
    off = analysis.perform_analysis(spark, tree({"a.ts": ""}), javascript=False)
    assert {r["file"]: r["score"] for r in off.file_rows()}["a.ts"] == 0


def test_config(spark, tree):
    root = tree({"pyproject.toml": f"[tool.{repo.CONFIG_TABLE}.python.thresholds]\nacl_red = 1\n", "a.py": "def f(a: int):\n    return 1\n"})
    row = {r["file"]: r for r in analysis.perform_analysis(spark, root).file_rows()}["a.py"]
    assert "1 Red ACL functions (-15)" in row["issues"]
    assert repo.load_config("/nowhere", {"a": 1}) == {"a": 1} and repo.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_empty_tree(spark, tree):
    a = analysis.perform_analysis(spark, tree({}))
    assert a.file_rows() == [] and a.final_score == 0.2 * 85


def test_critical_context(spark, tree):
    got = analysis.critical_context(spark, tree({"README.md": "r" * 40, "a.py": "def f(): pass\n"}))
    assert got == {"token_count": (41 + 1 + len("def f():")) // 4, "alert": False}


def test_command_line(spark, tree, capsys, tmp_path):
    root = tree({"README.md": "# R\n", "a.py": "def f(a: int) -> int:\n    return a\n", "p.txt": "You are x. Think. <a> Example: b"})
    assert cli.main([root, "--report", str(tmp_path / "r.md"), "--badge", str(tmp_path / "b.svg")]) == 0
    assert "Final Agent Score: 100.0/100" in capsys.readouterr().out and "Overall Score" in (tmp_path / "r.md").read_text()
    assert cli.main(["score", root, "--verbosity", "quiet", "--fail-under", "101"]) == 1
    assert capsys.readouterr().out.strip() == "Final Agent Score: 100.0/100"
    assert cli.main(["check-prompts", f"{root}/p.txt"]) == 0 and "PASSED" in capsys.readouterr().out
    assert cli.main(["advise", root]) == 0 and "Hallucination" in capsys.readouterr().out
    assert cli.main(["fix", root, "--agent", "jules"]) == 0 and "created agents.md" in capsys.readouterr().out


def test_score_prints_and_fixes(spark, tree, capsys):
    root = tree({f"m{i}.py": "import hub\n" for i in range(51)} | {"hub.py": ""})
    cli.main(["score", root, "--agent", "jules"])
    out = capsys.readouterr().out
    assert "Environment Health" in out and "Critical Token Count" in out and "God Modules Detected (Inbound > 50): hub.py" in out and "Missing Critical Agent Docs" in out
    assert cli.main(["score", root, "--agent", "jules", "--fix", "--fail-under", "0"]) == 0
    assert "Missing Critical Agent Docs" not in capsys.readouterr().out
    with open(f"{root}/agents.md") as f:
        assert "Agent Context" in f.read()


def test_repair_writes_what_parses(spark, tree):
    root = tree({"a.py": "def f(x):\n    return x\n", "b.py": "def g(x: int):\n    return x\n", "c.py": "def h(x):\n    return x\n"})
    answer = lambda system, user: "def broken(" if "def h" in user else "```python\ndef f(x: int):\n    return x\n```"
    assert sorted(cli.repair(spark, root, "generic", None, answer)) == ["README.md", "a.py"]
    with open(f"{root}/a.py") as f:
        assert f.read() == "def f(x: int):\n    return x"


def test_registered_language(spark, tree):
    def units(files, tokens):
        given = {"ord": F.lit(0), "name": F.lit("all"), "lineno": F.lit(1), "complexity": F.lit(1.0), "loc": F.lit(1), "acl": F.lit(20.0), "is_typed": F.lit(True), "nesting_depth": F.lit(0)}
        return files.select("rel_path").withColumns(given)

    score = lambda: {"score": F.lit(100) - F.col("n_red") * 15, "issues": F.lit("heavy")}
    analysis.register(analysis.Analyzer("Ruby", units, score=score, names=r"\.rb$"))
    try:
        a = analysis.perform_analysis(spark, tree({"a.rb": "x = 1\n\ny = 2\n", "b.py": "x = 1\n"}))
        row = {r["file"]: r for r in a.file_rows()}["a.rb"]
        assert (row["language"], row["score"], row["issues"], row["loc"], row["type_coverage"]) == ("Ruby", 85, "heavy", 2, 100.0)
    finally:
        del analysis.ANALYZERS["Ruby"]


def test_changed_files_without_git(tmp_path):
    assert repo.changed_files(str(tmp_path)) == []


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "You are x", "2024-01-01 00:00:00"), (2, "", "2024-01-01 00:20:00")], "id int, t string, at string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(str(tmp_path / "in"))
    got = []
    stream = incremental.arrivals(spark, str(tmp_path / "in"), rows.schema)
    incremental.each_batch(incremental.linted(stream, "id", "t"), lambda df, n: got.extend(df.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert {r["id"]: r["score"] for r in got} == {1: 25, 2: 0}
    q = incremental.sizes(stream, "at", "id", "t").writeStream.format("memory").queryName("sizes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("sizes").count() == 2


def test_catalogue(spark):
    from skarn.plans.catalog import ORACLE_SQL, QUERIES
    from tests.compare import difference, duck

    pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duck(sf)
    bad = {n: d for n in ORACLE_SQL if (d := difference(QUERIES[n](spark, sf), con, ORACLE_SQL[n]))}
    assert bad == {}


def test_cycles_come_from_every_row(spark):
    """The cycle list against brute force over all rows of lineitem."""
    from skarn.operators import graph
    from skarn.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*cols).collect()]
    order, customer, supplier = dict(rows("orders", "o_orderkey", "o_custkey")), dict(rows("customer", "c_custkey", "c_nationkey")), dict(rows("supplier", "s_suppkey", "s_nationkey"))
    near = {f"{n:02}": set() for (n,) in rows("nation", "n_nationkey")}
    for o, s in rows("lineitem", "l_orderkey", "l_suppkey"):
        a, b = customer[order[o]], supplier[s]
        if a != b:
            near[f"{a:02}"].add(f"{b:02}")
    got = {}
    for r in sorted(QUERIES["q18b_cycles"](spark, sf).collect(), key=lambda r: (r["nth"], r["pos"])):
        got.setdefault((r["comp"], r["nth"]), []).append(r["file"])
    want = graph.back_edge_cycles({a: sorted(bs) for a, bs in near.items()})
    assert len(want) > 0 and sorted(map(tuple, got.values())) == sorted(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1 and set(entry.oracle_sql()) <= set(entry.queries())
