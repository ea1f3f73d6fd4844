"""Column functions and parsers against small cases with known results."""

import json

import pytest
from pyspark.sql import functions as F

from skarn.functions import configs, jscode, pycode, tokens
from skarn.functions import text as X


def value(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())] if cols else [(1,)], list(cols) or ["one"]).select(expr.alias("v")).first()["v"]


def test_acl_formulas(spark):
    lit = F.lit
    assert value(spark, X.acl_code(lit(10.0), lit(100), lit(5))) == 27.0
    assert value(spark, X.acl_code(lit(0.0), lit(0), lit(0))) == 0
    assert value(spark, X.acl_docker(lit(3.0), lit(3))) == 4.5
    assert value(spark, X.acl_config(lit(3), lit(10))) == 6 + 10 / 50
    assert value(spark, X.acl_markdown(lit(200.0), lit(2))) == 5.0


def test_lines_of_code(spark):
    text = "# comment\n\n" + "import os\n" * 10
    assert value(spark, X.code_loc(F.col("t")), t=text) == 10
    assert value(spark, X.filled_loc(F.col("t")), t=text) == 11
    assert value(spark, X.docker_loc(F.col("t")), t="FROM a\r\n\x0b# c\x85RUN b\n") == 2
    assert spark.createDataFrame([(None,)], "t string").select(X.code_loc(F.col("t"))).first()[0] == 0


@pytest.mark.parametrize(
    "text,ok",
    [("FROM python:latest", False), ("FROM python:3.12", True), ("FROM python", False), ("FROM scratch", True), ("FROM", True), ("FROM --platform=x python:3", True), ("FROM --platform=x", False)],
)
def test_from(spark, text, ok):
    assert value(spark, X.from_ok(F.col("t")), t=text) is ok


def test_practices(spark):
    for text, ok in (("ADD a b", False), ("RUN sudo ls", False), ("RUN apt-get upgrade -y", False), ("COPY a b", True), ("RUN ls", True)):
        assert value(spark, X.practice_ok(X.instruction_name(F.col("t")), F.col("t")), t=text) is ok


def test_formats(spark):
    assert [value(spark, X.percent(F.lit(x))) for x in (2.5, 3.5, 66.7)] == ["2", "4", "67"]
    assert value(spark, X.thousands(F.lit(1234567))) == "1,234,567"
    assert [value(spark, X.badge_color(F.lit(x))) for x in (95, 85, 60, 40)] == ["#4c1", "#97ca00", "#dfb317", "#e05d44"]


@pytest.mark.parametrize("name,lang", [("a.py", "Python"), ("Dockerfile.py", "Python"), ("Dockerfile.js", "Docker"), ("Dockerfile", "Docker"), ("x.tsx", "JavaScript"), ("y.toml", "Config"), ("z.md", "Markdown"), ("q.txt", None)])
def test_language(spark, name, lang):
    assert value(spark, X.language(F.col("n")), n=name) == lang


def units(source):
    return {u["name"]: u for u in pycode.functions(pycode.parse(source))}


def test_python_units():
    u = units("def simple_func(a: int):\n    return a\n\ndef complex_func(a):\n    if a:\n        if a > 1:\n            return 1\n    return 2\n")
    assert (u["simple_func"]["complexity"], u["simple_func"]["acl"], u["simple_func"]["is_typed"]) == (1, 1.54, True)
    assert (u["complex_func"]["complexity"], u["complex_func"]["loc"], u["complex_func"]["acl"]) == (3, 5, 8.6)


@pytest.mark.parametrize(
    "source,depth",
    [
        ("x = 1", 0),
        ("if a:\n for b in c:\n  if d:\n   pass", 3),
        ("try:\n try:\n  pass\n finally:\n  pass\nfinally:\n pass", 2),
        ("x = [(lambda: [b for b in c]) for a in b]", 3),
        ("async def f():\n async for a in b:\n  async with c:\n   pass", 2),
    ],
)
def test_depth(source, depth):
    assert pycode.nesting_depth(pycode.parse(source)) == depth


@pytest.mark.parametrize(
    "body,cc",
    [
        ("pass", 1),
        ("if a: pass", 2),
        ("if a: pass\n    elif b: pass\n    else: pass", 3),
        ("for x in y: pass\n    else: pass", 2),
        ("try: pass\n    except A: pass\n    except B: pass\n    finally: pass", 4),
        ("with a:\n        if b: pass", 2),
        ("return a and b or c if d else e", 1),
        ("def g():\n        if a: pass\n    return g", 3),
        ("match a:\n        case 1:\n            if b: pass", 1),
    ],
)
def test_complexity(body, cc):
    assert units(f"def f():\n    {body}\n")["f"]["complexity"] == cc


def test_complexity_of_redefinitions_and_closures():
    tree = pycode.parse("def f():\n    if a: pass\ndef f():\n    for x in y: pass\n    if b: pass\n")
    assert [u["complexity"] for u in pycode.functions(tree)] == [1.0, 3.0]
    assert units("def f():\n    def g():\n        if a: pass\n")["g"]["complexity"] == 1.0
    assert [c for _, c in pycode.graphs(pycode.parse("if a:\n    pass\nclass A:\n    def m(self):\n        while x: pass\n")).values()] == [2, 2]


def test_signatures_and_imports():
    tree = pycode.parse("import a.b, c\nfrom . import x\nfrom ..p import y\n@deco\nasync def f(a: int,\n  b=1) -> str:\n    return 1\nclass K(Base):\n    def m(self): pass\n")
    assert pycode.signatures(tree) == ["@deco\nasync def f(a: int, b=1) -> str:", "class K(Base):", "def m(self):"]
    assert pycode.imports(tree) == [{"module": "a.b", "level": 0}, {"module": "c", "level": 0}, {"module": None, "level": 1}, {"module": "p", "level": 2}]
    assert pycode.parse("def (") is None and pycode.parse(None) is None and pycode.parse("\0") is None


def test_javascript_units():
    u = jscode.functions("function f(a, b) {\n  if (a && b) {\n    while (a) {\n      if (b) { go(); }\n    }\n  } else { stop(); }\n}\n")
    assert [(x["name"], x["complexity"], x["nesting_depth"], x["loc"]) for x in u] == [("f", 5.0, 3, 7)]
    assert [x["is_typed"] for x in jscode.functions("function f(a: number): string { return '' }")] == [True]
    assert [x["is_typed"] for x in jscode.functions("function f(a) { return `${a ? {} : 1}` }")] == [False]


def test_javascript_kinds():
    u = jscode.functions("class A { run(x) { return /[/]}/.test(x) || y } }\nconst g = (a) => { for (;;) {} };\nconst h = async x => x && 1;\nvar k = function named() { switch (a) { case 1: break; case 2: } };\n")
    assert [(x["name"], x["complexity"]) for x in u] == [("run", 2.0), ("anonymous", 2.0), ("anonymous", 2.0), ("anonymous", 3.0)]
    assert jscode.functions(None) == [] and jscode.functions("") == []


def test_nested_functions_count_apart():
    u = jscode.functions("function f() { if (a) { return () => { while (b) {} } } }")
    assert [(x["name"], x["complexity"], x["nesting_depth"]) for x in u] == [("f", 2.0, 1), ("anonymous", 2.0, 1)]


@pytest.mark.parametrize("data,depth", [({"a": 1}, 0), ({"a": {"b": 1}}, 1), ({"server": {"database": {"credentials": {"u": 1}}}}, 3), ([], 0), ({"a": {}, "b": [[]]}, 1), ([[[1]]], 2), (3, 0), ({"]}": [{"[": "{"}]}, 2)])
def test_config_depth(spark, data, depth):
    assert configs.depth(data) == depth
    assert value(spark, configs.json_depth(F.col("t")), t=json.dumps(data)) == depth


def test_config_parsers(spark):
    rows = [("a", ".json", '{"a": NaN}'), ("b", ".json", "{"), ("c", ".TOML", "[a.b]\nx = 1"), ("d", ".yaml", "a:\n  b: [1]"), ("e", ".yml", "a: ["), ("f", ".json", None)]
    got = configs.facts(spark.createDataFrame(rows, "rel_path string, ext string, content string")).collect()
    assert {r["rel_path"]: (r["valid"], r["depth"]) for r in got} == {"a": (True, 0), "b": (False, 0), "c": (True, 2), "d": (True, 2), "e": (False, 0), "f": (False, 0)}


def test_tokens_of_a_vocabulary(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens.read_ranks(path), special_tokens={})
    texts = ["", None, "def f(x):\n    return x\n", "it's I'll  <|endoftext|>\n\n é 日本 123", "a" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = [r["n"] for r in df.select("k", tokens.counter(path)(F.col("t")).alias("n")).orderBy("k").collect()]
    assert got == [len(lib.encode_ordinary(t)) if t else 0 for t in texts]


def test_analysis_by_a_vocabulary(spark, tree):
    P = pytest.importorskip("public_tokenizers")
    pytest.importorskip("tiktoken")
    from skarn.plans import analysis

    a = analysis.perform_analysis(spark, tree({"a.py": "x = 1\n" * 40, "README.md": "# R\n"}), tokens=P.path("byte_bpe_50k.tiktoken"))
    assert {r["file"]: r["tokens"] for r in a.file_rows()}["a.py"] == 40 * 4
