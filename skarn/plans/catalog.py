"""The query catalogue over the sf tables: each operator applied to real columns, with DuckDB SQL beside it.

Columns that the tables lack (headers, continuations, source code) are derived from those they have, in the same
way on both sides. Results are flat; whole numbers are longs, other ones are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import configs, jscode, pycode
from skarn.functions import text as X
from skarn.operators import changelog, fix, graph, health, prompts, report, scoring, segment
from skarn.sources import issues
from skarn.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: flat(f(lambda name: table(spark, sf_dir, name)))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def flat(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    cast = {c: F.col(c).cast("long") for c, k in kinds.items() if k in ("int", "smallint", "tinyint")}
    return df.withColumns(cast | {c: F.round(c, 6) for c, k in kinds.items() if k in ("double", "float")})


# --- derived inputs ---

NL = "chr(10)"
WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"
UNITS_SQL = f"""u AS (SELECT doc_id, source, lang, n_chars, CAST(n_chars % 6 AS DOUBLE) AS depth, CAST(1 + n_chars % 11 AS DOUBLE) AS cc,
  CAST(len(string_split(text, {NL})) AS DOUBLE) AS loc, length(text) // 4 AS tokens, n_chars % 3 <> 0 AS typed FROM documents)"""
LINES_SQL = f"""l0 AS (SELECT doc_id, unnest(string_split(text, {NL})) AS line, generate_subscripts(string_split(text, {NL}), 1) AS lineno, len(string_split(text, {NL})) AS n FROM documents),
l AS (SELECT doc_id, line, lineno FROM l0 WHERE NOT (line = '' AND lineno = n))"""


def units(t) -> DataFrame:
    """A unit for each document."""
    d = t("documents")
    return d.select(
        "doc_id", "source", "lang", "n_chars",
        (F.col("n_chars") % 6).cast("double").alias("depth"),
        (1 + F.col("n_chars") % 11).cast("double").alias("complexity"),
        F.size(X.lines(F.col("text"))).cast("double").alias("loc"),
        X.token_estimate(F.col("text")).alias("tokens"),
        (F.col("n_chars") % 3 != 0).alias("is_typed"),
    ).withColumn("acl", X.acl_code(F.col("complexity"), F.col("loc"), F.col("depth")))


def lines(t) -> DataFrame:
    return segment.numbered_lines(t("documents"), "doc_id", "text")


def markdown_lines(t) -> DataFrame:
    mark = F.expr("repeat('#', 1 + length(line) % 4)")
    return lines(t).withColumn("line", F.when(F.length("line") % 7 == 0, F.concat(mark, F.lit(" "), "line")).otherwise(F.col("line")))


MARKDOWN_SQL = f"""{LINES_SQL},
m AS (SELECT doc_id, lineno, CASE WHEN length(line) % 7 = 0 THEN repeat('#', CAST(1 + length(line) % 4 AS INTEGER)) || ' ' || line ELSE line END AS line FROM l),
g AS (SELECT *, sum(CASE WHEN starts_with(line, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY lineno) AS ord FROM m),
s AS (SELECT doc_id, CAST(ord AS BIGINT) AS ord, CASE WHEN ord = 0 THEN 1 ELSE min(lineno) END AS lineno, count(*) AS loc,
  CASE WHEN ord = 0 THEN '# Introduction' ELSE trim(arg_min(line, lineno), {WS}) END AS name, length(string_agg(line, {NL} ORDER BY lineno)) // 4 AS tokens
  FROM g GROUP BY doc_id, ord),
md AS (SELECT *, length(regexp_extract(name, '^(#+)', 1)) AS depth FROM s),
mu AS (SELECT *, CAST(depth AS DOUBLE) * 1.5::DOUBLE + CAST(tokens AS DOUBLE) / 100 AS acl FROM md)"""


def docker_lines(t) -> DataFrame:
    return lines(t).withColumn("line", F.replace("line", F.lit(","), F.lit(" &&")))


DOCKER_SQL = f"""{LINES_SQL},
k AS (SELECT doc_id, lineno, replace(line, ',', ' &&') AS line FROM l),
k2 AS (SELECT *, length(line) % 3 = 0 AS more FROM k WHERE trim(line, {WS}) <> '' AND NOT starts_with(trim(line, {WS}), '#')),
k3 AS (SELECT *, CASE WHEN coalesce(lag(more) OVER (PARTITION BY doc_id ORDER BY lineno), FALSE) THEN 0 ELSE 1 END AS opens FROM k2),
k4 AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY lineno) AS ord FROM k3),
k5 AS (SELECT doc_id, CAST(ord AS BIGINT) AS ord, min(lineno) AS lineno, max(lineno) - min(lineno) + 1 AS loc, string_agg(line, {NL} ORDER BY lineno) AS content, arg_max(more, lineno) AS open
  FROM k4 GROUP BY doc_id, ord),
k6 AS (SELECT *, upper(replace(regexp_extract(content, '^\\s*(\\S+)', 1), 'ß', 'ss')) AS name, regexp_split_to_array(trim(content, {WS}), '\\s+') AS w,
  CAST((length(content) - length(replace(content, '&&', ''))) // 2 + length(content) - length(replace(content, ';', '')) + 1 AS DOUBLE) AS cc FROM k5 WHERE NOT open),
ku AS (SELECT *, greatest(0, cc - 1) * 1.5::DOUBLE + CAST(loc AS DOUBLE) * 0.5::DOUBLE AS acl,
  CASE WHEN name = 'FROM' THEN len(w) <= 1 OR lower(w[2]) = 'scratch' OR (contains(w[2], ':') AND NOT ends_with(w[2], ':latest')) WHEN name = 'ADD' THEN FALSE WHEN name = 'RUN' THEN NOT contains(content, 'sudo ') AND NOT contains(content, 'apt-get upgrade') ELSE TRUE END AS ok FROM k6)"""


# --- text metrics ---


@query(f"""SELECT doc_id, CAST(len(list_filter(string_split(text, {NL}), lambda x: trim(x, {WS}) <> '' AND NOT starts_with(trim(x, {WS}), '#'))) AS BIGINT) AS code_loc,
CAST(len(list_filter(string_split(text, {NL}), lambda x: trim(x, {WS}) <> '')) AS BIGINT) AS filled_loc FROM documents""")
def q01_loc(t):
    c = F.col("text")
    return t("documents").select("doc_id", X.code_loc(c).alias("code_loc"), X.filled_loc(c).alias("filled_loc"))


@query("SELECT lang, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, max(length(text) // 4) AS longest, count(*) AS n FROM documents GROUP BY lang")
def q02_token_estimate(t):
    tokens = X.token_estimate(F.col("text"))
    return t("documents").groupBy("lang").agg(F.sum(tokens).alias("tokens"), F.max(tokens).alias("longest"), F.count("*").alias("n"))


@query(f"""WITH {UNITS_SQL} SELECT doc_id, round(depth * 2 + cc * 1.5::DOUBLE + loc / 50, 6) AS code, round(depth * 1.5::DOUBLE + tokens / 100::DOUBLE, 6) AS markdown,
round(greatest(0, cc - 1) * 1.5::DOUBLE + loc * 0.5::DOUBLE, 6) AS docker, round(depth * 2 + loc / 50, 6) AS config FROM u""")
def q03_acl_formulas(t):
    cc, loc, depth = F.col("complexity"), F.col("loc"), F.col("depth")
    return units(t).select(
        "doc_id", F.col("acl").alias("code"), X.acl_markdown(F.col("tokens"), depth).alias("markdown"), X.acl_docker(cc, loc).alias("docker"), X.acl_config(depth, loc).alias("config")
    )


@query(f"""WITH {UNITS_SQL}, a AS (SELECT source, depth * 2 + cc * 1.5::DOUBLE + loc / 50 AS acl FROM u)
SELECT source, count(*) AS n_units, count(*) FILTER (acl > 15) AS n_red, count(*) FILTER (acl > 10 AND acl <= 15) AS n_yellow,
15 * count(*) FILTER (acl > 15) AS lost_red, 5 * count(*) FILTER (acl > 10 AND acl <= 15) AS lost_yellow, round(max(acl), 6) AS max_acl FROM a GROUP BY source""")
def q04_acl_tiers(t):
    s = scoring.unit_stats(units(t), "source", F.lit(15), F.lit(10))
    return s.select("source", "n_units", "n_red", "n_yellow", (F.col("n_red") * 15).alias("lost_red"), (F.col("n_yellow") * 5).alias("lost_yellow"), "max_acl")


SMALL = replace(scoring.RULES["Python"], bloat_limit=20, bloat_step=5)


@query(f"""WITH {UNITS_SQL}, b AS (SELECT doc_id, CAST(loc AS BIGINT) AS loc, tokens, greatest(0, (CAST(loc AS BIGINT) - 20) // 5) AS lost FROM u)
SELECT doc_id, greatest(0, 100 - lost - CASE WHEN tokens > 500 THEN 15 ELSE 0 END) AS score,
concat_ws(', ', CASE WHEN lost > 0 THEN 'Bloated File: ' || loc || ' lines (-' || lost || ')' END,
  CASE WHEN tokens > 500 THEN 'Cumulative Token Budget Exceeded: ' || format('{{:,}}', tokens) || ' > 500 (-15)' END) AS issues FROM b""")
def q05_bloat_token_penalty(t):
    one = units(t).select("doc_id", F.col("loc").cast("int").alias("loc"), F.col("tokens").alias("cumulative"), F.col("complexity"))
    given = {"token_limit": 500, "type_safety": 90, "n_units": 1, "n_red": 0, "n_yellow": 0, "type_index": 100.0}
    c = scoring.penalised("Python", rules=SMALL)
    return one.withColumns({k: F.lit(v) for k, v in given.items()}).select("doc_id", c["score"].alias("score"), c["issues"].alias("issues"))


@query("""WITH a AS (SELECT d.source, count(*) AS n, sum(l.quality) * 100.0::DOUBLE / count(*) AS type_index FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source)
SELECT source, n, round(type_index, 6) AS type_index, CASE WHEN type_index < 90 THEN 'Type Safety Index ' || printf('%.0f', type_index) || '% < 90% (-20)' ELSE '' END AS issue FROM a""")
def q06_type_coverage(t):
    rows = t("labels").join(t("documents").select("doc_id", "source"), "doc_id")
    units = rows.select("source", F.lit(0.0).alias("acl"), F.lit(1.0).alias("complexity"), (F.col("quality") == 1).alias("is_typed"))
    s = scoring.unit_stats(units, "source", F.lit(15), F.lit(10))
    given = {"loc": 1, "cumulative": 0, "token_limit": 32000, "type_safety": 90}
    c = scoring.penalised("Python")
    return s.withColumns({k: F.lit(v) for k, v in given.items()}).select("source", F.col("n_units").alias("n"), c["type_coverage"].alias("type_index"), c["issues"].alias("issue"))


@query(f"WITH {MARKDOWN_SQL} SELECT doc_id, ord, name, lineno, loc, tokens, depth AS nesting_depth, round(acl, 6) AS acl FROM mu")
def q07_md_sections(t):
    return segment.sections(markdown_lines(t), "doc_id").select("doc_id", "ord", "name", "lineno", "loc", "tokens", "nesting_depth", "acl")


MD_SCORE_SQL = f"""{MARKDOWN_SQL},
mt AS (SELECT doc_id, count(*) AS n, count(*) FILTER (acl > 6) AS red, count(*) FILTER (acl > 4 AND acl <= 6) AS yellow, sum(tokens) AS tokens, sum(loc) AS loc, avg(CAST(tokens AS DOUBLE) / 100) AS complexity FROM mu GROUP BY doc_id),
mb AS (SELECT *, greatest(0, (loc - 20) // 25) AS lost FROM mt),
mf AS (SELECT doc_id, greatest(0, 100 - lost - CASE WHEN tokens > 500 THEN 15 ELSE 0 END - 15 * red - 5 * yellow) AS score, complexity,
  concat_ws(', ', CASE WHEN lost > 0 THEN 'Bloated Documentation: ' || loc || ' lines (-' || lost || ')' END,
    CASE WHEN tokens > 500 THEN 'Cumulative Token Budget Exceeded: ' || format('{{:,}}', CAST(tokens AS BIGINT)) || ' > 500 (-15)' END,
    CASE WHEN red > 0 THEN red || ' Red ACL sections detected. Ensure headers group content logically (-' || red * 15 || ')' END,
    CASE WHEN yellow > 0 THEN yellow || ' Yellow ACL sections detected. Consider breaking down large documentation chunks (-' || yellow * 5 || ')' END) AS issues FROM mb)"""


def markdown_results(t) -> DataFrame:
    u = segment.sections(markdown_lines(t), "doc_id")
    s = scoring.unit_stats(u, "doc_id", F.lit(6), F.lit(4))
    sizes = u.groupBy("doc_id").agg(F.sum("tokens").alias("cumulative"), F.sum("loc").alias("loc"))
    rows = s.join(sizes, "doc_id").withColumns({"token_limit": F.lit(500), "type_safety": F.lit(90)})
    c = scoring.penalised("Markdown", rules=replace(scoring.RULES["Markdown"], bloat_limit=20))
    return rows.select("doc_id", *[v.alias(k) for k, v in c.items()])


@query(f"WITH {MD_SCORE_SQL} SELECT doc_id, CAST(score AS BIGINT) AS score, issues, round(complexity, 6) AS complexity, 100.0::DOUBLE AS type_coverage FROM mf")
def q08_md_file_score(t):
    return markdown_results(t)


@query(f"WITH {DOCKER_SQL} SELECT doc_id, ord, name, lineno, loc, cc AS complexity, round(acl, 6) AS acl FROM ku")
def q09_docker_instructions(t):
    u = segment.instructions(docker_lines(t), "doc_id", F.length("line") % 3 == 0)
    return u.select("doc_id", "ord", "name", "lineno", "loc", "complexity", "acl")


PRACTICE_SQL = """p AS (SELECT p_partkey, CASE p_partkey % 5
  WHEN 0 THEN 'FROM ' || split_part(p_name, ' ', 1) || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN ':latest' ELSE ':' || p_size END
  WHEN 1 THEN 'FROM --platform=linux ' || CASE WHEN p_size % 2 = 0 THEN 'Scratch' ELSE p_type END
  WHEN 2 THEN 'ADD ' || p_name WHEN 3 THEN 'RUN ' || CASE WHEN p_size % 3 = 0 THEN 'sudo ' ELSE '' END || p_name ELSE 'COPY ' || p_name END AS content FROM part)"""


@query(f"""WITH {PRACTICE_SQL}, w AS (SELECT *, string_split(content, ' ') AS w FROM p), i AS (SELECT *, CASE WHEN starts_with(w[2], '--') AND len(w) > 2 THEN w[3] ELSE w[2] END AS image FROM w)
SELECT p_partkey, w[1] AS name, CASE w[1] WHEN 'FROM' THEN lower(image) = 'scratch' OR (contains(image, ':') AND NOT ends_with(image, ':latest'))
WHEN 'ADD' THEN FALSE WHEN 'RUN' THEN NOT contains(content, 'sudo ') ELSE TRUE END AS ok FROM i""")
def q10_docker_practices(t):
    sql = PRACTICE_SQL.split("SELECT p_partkey, ", 1)[1].rsplit(" AS content FROM part)", 1)[0]
    p = t("part").select("p_partkey", F.expr(sql).alias("content"))
    name = X.instruction_name(F.col("content"))
    return p.select("p_partkey", name.alias("name"), X.practice_ok(name, F.col("content")).alias("ok"))


@query(f"""WITH {DOCKER_SQL}, a AS (SELECT doc_id, count(*) AS n, sum(loc) AS loc, count(*) FILTER (acl > 15) AS red, count(*) FILTER (acl > 10 AND acl <= 15) AS yellow, sum(CAST(ok AS INTEGER)) * 100.0::DOUBLE / count(*) AS idx FROM ku GROUP BY doc_id),
b AS (SELECT *, greatest(0, (loc - 10) // 10) AS lost FROM a)
SELECT doc_id, CAST(greatest(0, 100 - lost - 15 * red - 5 * yellow - CASE WHEN idx < 90 THEN 20 ELSE 0 END) AS BIGINT) AS score, concat_ws(', ', CASE WHEN lost > 0 THEN 'Bloated Dockerfile: ' || loc || ' lines (-' || lost || ')' END,
CASE WHEN red > 0 THEN red || ' Red ACL instructions detected (-' || 15 * red || ')' END, CASE WHEN yellow > 0 THEN yellow || ' Yellow ACL instructions detected (-' || 5 * yellow || ')' END,
CASE WHEN idx < 90 THEN 'Best Practices Compliance ' || printf('%.0f', idx) || '% < 90% (-20)' END) AS issues FROM b""")
def q11_docker_file_score(t):
    u = segment.instructions(docker_lines(t), "doc_id", F.length("line") % 3 == 0)
    s = scoring.unit_stats(u, "doc_id", F.lit(15), F.lit(10)).join(u.groupBy("doc_id").agg(F.sum("loc").alias("loc")), "doc_id")
    rows = s.withColumns({"cumulative": F.lit(0), "token_limit": F.lit(32000), "type_safety": F.lit(90)})
    c = scoring.penalised("Docker", rules=replace(scoring.RULES["Docker"], bloat_limit=10))
    return rows.select("doc_id", c["score"].alias("score"), c["issues"].alias("issues"))


# --- configuration files ---


def customer_json(t) -> DataFrame:
    """JSON whose depth follows the key; every tenth text is cut off."""
    n = (1 + F.col("c_custkey") % 9).cast("int")
    text = F.concat(F.expr("repeat('{\"k[\": [', cast(1 + c_custkey % 9 as int))"), F.lit('{"e": {}, "s": "}]"}'), F.expr("repeat(']}', cast(1 + c_custkey % 9 as int))"))
    return t("customer").select("c_custkey", n.alias("n"), text.alias("text"))


@query("SELECT c_custkey, 2 * (1 + c_custkey % 9) AS depth, round(4 * CAST(1 + c_custkey % 9 AS DOUBLE) + 1 / 50::DOUBLE, 6) AS acl FROM customer")
def q12_config_depth(t):
    depth = configs.json_depth(F.col("text"))
    return customer_json(t).select("c_custkey", depth.alias("depth"), X.acl_config(depth, F.lit(1)).alias("acl"))


@query("""WITH a AS (SELECT c_custkey, c_custkey % 10 <> 0 AS valid, round(4 * CAST(1 + c_custkey % 9 AS DOUBLE) + 1 / 50::DOUBLE, 6) AS acl FROM customer)
SELECT c_custkey, CAST(CASE WHEN NOT valid THEN 80 WHEN acl > 15 THEN 85 WHEN acl > 10 THEN 95 ELSE 100 END AS BIGINT) AS score,
CASE WHEN NOT valid THEN 'Malformed Configuration File (-20)' WHEN acl > 15 THEN 'Red ACL detected: ' || printf('%.1f', acl) || ' > 15 (-15)'
WHEN acl > 10 THEN 'Yellow ACL detected: ' || printf('%.1f', acl) || ' > 10 (-5)' ELSE '' END AS issues FROM a""")
def q13_config_score(t):
    cut = F.when(F.col("c_custkey") % 10 == 0, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    rows = customer_json(t).withColumn("text", cut)
    rows = rows.withColumn("valid", F.try_parse_json("text").isNotNull()).withColumn("acl", X.acl_config(configs.json_depth(F.col("text")), F.lit(1)))
    given = {"cumulative": 0, "token_limit": 32000, "acl_red": 15, "acl_yellow": 10}
    c = scoring.config_penalised()
    return rows.withColumns({k: F.lit(v) for k, v in given.items()}).select("c_custkey", c["score"].alias("score"), c["issues"].alias("issues"))


# --- graphs ---


@query("""WITH f AS (SELECT DISTINCT source || '/' || lang || '/m' || doc_id % 50 AS stem FROM documents),
i AS (SELECT DISTINCT source || '/' || lang || '/m' || doc_id % 50 || '.py' AS src, CASE doc_id % 3 WHEN 0 THEN 'm' || (doc_id * 7) % 50 WHEN 1 THEN lang || '/m' || (doc_id * 7) % 50 ELSE 'src1/' || lang || '/m' || (doc_id * 7) % 50 END AS s FROM documents)
SELECT DISTINCT i.src, f.stem || '.py' AS dst FROM i JOIN f ON f.stem = i.s OR ends_with(f.stem, '/' || i.s) WHERE i.src <> f.stem || '.py'""")
def q14_import_match(t):
    d, k = t("documents"), F.concat(F.lit("m"), ((F.col("doc_id") * 7) % 50).cast("string"))
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("m"), (F.col("doc_id") % 50).cast("string"), F.lit(".py")))
    module = F.when(F.col("doc_id") % 3 == 0, k).when(F.col("doc_id") % 3 == 1, F.concat_ws(".", "lang", k)).otherwise(F.concat_ws(".", F.lit("src1"), "lang", k))
    rows = d.select(path.alias("rel_path"), module.alias("module"))
    return graph.module_edges(rows, rows.select("rel_path").distinct())


@query("""WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), g AS (SELECT l_partkey, count(*) AS n FROM e GROUP BY 1)
SELECT CAST(p_partkey AS VARCHAR) AS node, coalesce(n, 0) AS inbound, coalesce(n, 0) > 30 AS god FROM part LEFT JOIN g ON l_partkey = p_partkey""")
def q15_inbound_god_modules(t):
    nodes = t("part").select(F.col("p_partkey").cast("string").alias("node"))
    edges = t("lineitem").select(F.col("l_suppkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst")).distinct()
    return graph.inbound(nodes, edges).withColumn("god", F.col("inbound") > 30)


NATION_SQL = """e AS (SELECT DISTINCT c.c_nationkey AS src, s.s_nationkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer c ON c_custkey = o_custkey
  JOIN supplier s ON s_suppkey = l_suppkey WHERE c.c_nationkey <> s.s_nationkey),
r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)"""


def nation_edges(t) -> DataFrame:
    """Edges between nations of customers and suppliers that trade, over every order line."""
    rows = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return rows.where("c_nationkey <> s_nationkey").select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()


@query(f"WITH RECURSIVE {NATION_SQL} SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM r")
def q16_transitive_closure(t):
    return graph.closure(nation_edges(t))


@query(f"""WITH RECURSIVE {NATION_SQL}, x AS (SELECT a, b FROM r UNION SELECT n_nationkey, n_nationkey FROM nation)
SELECT CAST(a AS BIGINT) AS node, CAST(sum(length(n_name)) AS BIGINT) AS cumulative FROM x JOIN nation ON n_nationkey = b GROUP BY a""")
def q17_context_tokens(t):
    return graph.context_tokens(t("nation").select(F.col("n_nationkey").alias("node"), F.length("n_name").alias("tokens")), nation_edges(t))


@query(f"WITH RECURSIVE {NATION_SQL} SELECT CAST(a AS BIGINT) AS node FROM r WHERE a = b")
def q18_cycle_members(t):
    return graph.closure(nation_edges(t)).where("a = b").select(F.col("a").alias("node"))


#: One depth-first search, a row a step: the path, the nodes entered, how many neighbours each node on the path has tried.
DFS_SQL = """adj AS (SELECT src, list(dst ORDER BY dst) AS out FROM g GROUP BY src),
names AS (SELECT list(node ORDER BY node) AS every FROM nodes),
dfs AS (SELECT 0 AS step, CAST([] AS VARCHAR[]) AS path, CAST([] AS VARCHAR[]) AS entered, CAST([] AS BIGINT[]) AS tried, CAST(NULL AS VARCHAR[]) AS cycle
  UNION ALL
  SELECT step + 1,
    CASE WHEN len(path) = 0 THEN [root] WHEN nb IS NULL THEN path[:-2] WHEN list_contains(entered, nb) THEN path ELSE list_append(path, nb) END,
    CASE WHEN len(path) = 0 THEN list_append(entered, root) WHEN nb IS NOT NULL AND NOT list_contains(entered, nb) THEN list_append(entered, nb) ELSE entered END,
    CASE WHEN len(path) = 0 THEN [CAST(0 AS BIGINT)] WHEN nb IS NULL THEN tried[:-2]
      WHEN list_contains(entered, nb) THEN list_append(tried[:-2], tried[-1] + 1) ELSE list_concat(tried[:-2], [tried[-1] + 1, 0]) END,
    CASE WHEN len(path) > 1 AND list_contains(path, nb) AND list_position(path, nb) < len(path) THEN path[list_position(path, nb):] END
  FROM (SELECT dfs.*, out[tried[-1] + 1] AS nb, CASE WHEN len(path) = 0 THEN list_filter(every, lambda x: NOT list_contains(entered, x))[1] END AS root
    FROM dfs CROSS JOIN names LEFT JOIN adj ON adj.src = path[-1]) WHERE len(path) > 0 OR root IS NOT NULL),
found AS (SELECT min(step) AS step, list_concat(cycle[list_position(cycle, list_min(cycle)):], cycle[:list_position(cycle, list_min(cycle)) - 1]) AS cycle FROM dfs WHERE cycle IS NOT NULL GROUP BY 2),
ties AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g),
near AS (SELECT node AS a, node AS b FROM nodes UNION SELECT near.a, ties.dst FROM near JOIN ties ON ties.src = near.b),
comps AS (SELECT a AS node, min(b) AS comp FROM near GROUP BY a),
told AS (SELECT comp, row_number() OVER (PARTITION BY comp ORDER BY step) - 1 AS nth, cycle FROM found JOIN comps ON comps.node = cycle[1])
SELECT comp, CAST(nth AS BIGINT) AS nth, CAST(unnest(range(len(cycle))) AS BIGINT) AS pos, unnest(cycle) AS file FROM told"""


@query(f"""WITH RECURSIVE {NATION_SQL}, g AS (SELECT lpad(CAST(src AS VARCHAR), 2, '0') AS src, lpad(CAST(dst AS VARCHAR), 2, '0') AS dst FROM e),
nodes AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS node FROM nation), {DFS_SQL}""")
def q18b_cycles(t):
    name = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    edges = nation_edges(t).select(name("src").alias("src"), name("dst").alias("dst"))
    return graph.cycles(t("nation").select(name("n_nationkey").alias("node")), edges)


#: Sources of one language call their neighbours, and the first source calls the second in every language.
CALLS_SQL = """nodes AS (SELECT DISTINCT source || '/' || lang AS node, CAST(substr(source, 4) AS INTEGER) AS n, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
g AS (SELECT a.node AS src, b.node AS dst FROM nodes a JOIN nodes b ON abs(a.n - b.n) = 1 AND (a.lang = b.lang OR a.n = 0 AND b.n = 1))"""


@query(f"""WITH RECURSIVE {CALLS_SQL}, p AS (SELECT src AS root, [src] AS path, dst AS tip FROM g
  UNION ALL SELECT root, list_append(path, tip), dst FROM p JOIN g ON g.src = p.tip WHERE tip > root AND NOT list_contains(path, tip) AND len(path) < 40),
c AS (SELECT path FROM p WHERE tip = root)
SELECT array_to_string(path, ' ') AS cycle, CAST(len(path) AS BIGINT) AS size FROM c""")
def q18c_simple_cycles(t):
    d = t("documents").where("source is not null and lang is not null")
    rows = d.select(F.concat("source", F.lit("/"), "lang").alias("node"), F.substring("source", 4, 9).cast("int").alias("n"), "lang").distinct()
    a, b = rows.alias("a"), rows.alias("b")
    called = (F.abs(F.col("a.n") - F.col("b.n")) == 1) & ((F.col("a.lang") == F.col("b.lang")) | (F.col("a.n") == 0) & (F.col("b.n") == 1))
    edges = a.join(b, called).select(F.col("a.node").alias("src"), F.col("b.node").alias("dst"))
    nodes = rows.select("node")
    found = graph.simple_cycles(nodes, edges)
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "file"))), lambda x: x["file"]), " ")
    return found.groupBy("comp", "nth").agg(path.alias("cycle"), F.count("*").alias("size")).select("cycle", "size")


# --- project health ---

HOST_SQL = "h AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1)"


def hosts(t) -> DataFrame:
    return t("pages").groupBy(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("path")).agg(F.count("*").alias("files"))


@query(f"""WITH {HOST_SQL} SELECT round(sum(n) / count(*)::DOUBLE, 6) AS avg_files, max(n) AS max_files, sum(n) / count(*)::DOUBLE > 15 OR max(n) > 10 AS warning,
coalesce(string_agg(host, ',' ORDER BY host) FILTER (n > 10), '') AS crowded_dirs FROM h""")
def q19_directory_entropy(t):
    return health.entropy(hosts(t), crowded=10).withColumn("crowded_dirs", F.array_join("crowded_dirs", ","))


SUFFIXES = ["7", "25", "x", "#top"]


@query("SELECT page_id, url FROM pages WHERE ends_with(url, '7') OR ends_with(url, '25') OR ends_with(url, 'x') OR ends_with(url, '#top')")
def q20_limit_to(t):
    return fix.limited(t("pages").select("page_id", "url"), "url", SUFFIXES)


REQUIRED = ["EN", "fr", "Klingon", "README.md", "De", "src1"]


@query("""SELECT CAST(ord AS BIGINT) AS ord, name FROM (VALUES (0, 'EN'), (1, 'fr'), (2, 'Klingon'), (3, 'README.md'), (4, 'De'), (5, 'src1')) v(ord, name)
WHERE NOT EXISTS (SELECT 1 FROM documents WHERE lower(lang) = lower(name))""")
def q21_missing_docs(t):
    d = t("documents")
    required = d.sparkSession.createDataFrame(list(enumerate(REQUIRED)), "ord int, name string")
    return health.missing_docs(required, d.select(F.col("lang").alias("name")))


@query(f"""WITH {UNITS_SQL}, v AS (SELECT * FROM (VALUES ('en', 8, 12), ('de', NULL, 20), ('xx', 1, 2)) v(lang, yellow, red)),
a AS (SELECT u.lang, depth * 2 + cc * 1.5::DOUBLE + loc / 50 AS acl, coalesce(yellow, 10) AS yellow, coalesce(red, 15) AS red FROM u LEFT JOIN v USING (lang))
SELECT lang, CAST(yellow AS BIGINT) AS acl_yellow, CAST(red AS BIGINT) AS acl_red, count(*) FILTER (acl > red) AS n_red, count(*) FILTER (acl > yellow AND acl <= red) AS n_yellow FROM a GROUP BY ALL""")
def q22_threshold_overlay(t):
    u = units(t)
    over = u.sparkSession.createDataFrame([("en", 8, 12), ("de", None, 20), ("xx", 1, 2)], "lang string, acl_yellow int, acl_red int")
    rows = fix.with_thresholds(u, over, "lang")
    return rows.groupBy("lang", "acl_yellow", "acl_red").agg(
        F.count_if(X.is_red(F.col("acl"), F.col("acl_red"))).alias("n_red"), F.count_if(X.is_yellow(F.col("acl"), F.col("acl_yellow"), F.col("acl_red"))).alias("n_yellow")
    )


TERMS = ["License", "token", "baml", "THE", "stupid"]


@query("""WITH x AS (SELECT source, unnest(['License', 'token', 'baml', 'THE', 'stupid']) AS term, text FROM documents)
SELECT source, string_agg(DISTINCT term, ',' ORDER BY term) AS found FROM x WHERE contains(lower(text), lower(term)) GROUP BY source""")
def q23_framework_scan(t):
    d = t("documents").select("source", F.explode(X.contained_terms(F.col("text"), TERMS)).alias("term"))
    return d.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("found"))


# --- prompts ---


def all_texts(t) -> DataFrame:
    parts = [("d", "documents", "doc_id", "text"), ("p", "pages", "page_id", "html")]
    rows = [t(name).select(F.lit(k).alias("kind"), F.col(i).alias("id"), F.col(c).alias("text")) for k, name, i, c in parts]
    turns = t("conversations").select(F.lit("c"), F.col("conv_id") * 1000 + F.col("turn"), "text")
    return rows[0].union(rows[1]).union(turns)


TEXTS_SQL = "x AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'p', page_id, html FROM pages UNION ALL SELECT 'c', conv_id * 1000 + turn, text FROM conversations)"
ROLE_SQL = "regexp_matches({0}, '(?i)(you are|act as|your role)')"
SCAFFOLD_SQL = "regexp_matches({0}, '(?i)(step by step|reasoning|think|plan|step \\d+|phase \\d+)')"
DELIMITER_SQL = "regexp_matches({0}, '(?i)(<[^>]+>|''''''|\"\"\"|```|\\{{\\{{.*?\\}}\\}})')"


@query(f"WITH {TEXTS_SQL} SELECT kind, id, {ROLE_SQL.format('text')} AS role, {SCAFFOLD_SQL.format('text')} AS scaffold, {DELIMITER_SQL.format('text')} AS delimiter FROM x")
def q24_prompt_standard(t):
    c = prompts.checks(F.col("text"))
    return all_texts(t).select("kind", "id", c["role_definition"].alias("role"), c["cognitive_scaffolding"].alias("scaffold"), c["delimiter_hygiene"].alias("delimiter"))


def prompt_texts(t) -> DataFrame:
    """Documents with list marks, labels, fences and negations put in by line length."""
    n = F.length("line")
    line = F.when(n % 11 == 0, F.concat(F.lit("* Never "), "line")).when(n % 11 == 1, F.concat(F.lit("2. currently it does NOT "), "line"))
    line = line.when(n % 11 == 2, F.concat(F.lit("Sample of "), "line")).when(n % 11 == 3, F.concat(F.lit("  ```"), "line"))
    line = line.when(n % 97 == 4, F.concat(F.lit("Example: "), "line")).otherwise(F.col("line"))
    rows = lines(t).select("doc_id", "lineno", line.alias("line"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lineno", "line"))), lambda x: x["line"]), "\n").alias("text"))


PROMPT_SQL = f"""{LINES_SQL},
pl AS (SELECT doc_id, lineno, CASE WHEN length(line) % 11 = 0 THEN '* Never ' || line WHEN length(line) % 11 = 1 THEN '2. currently it does NOT ' || line WHEN length(line) % 11 = 2 THEN 'Sample of ' || line
  WHEN length(line) % 11 = 3 THEN '  ```' || line WHEN length(line) % 97 = 4 THEN 'Example: ' || line ELSE line END AS line FROM l),
po AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY lineno) - length(line) - 1 AS before, sum(length(line) + 1) OVER (PARTITION BY doc_id) - 1 AS total,
  regexp_matches(line, '(?i)(example|sample)') AS names, starts_with(trim(line, {WS}), '```') AS fence FROM pl),
pf AS (SELECT *, names AND (coalesce(lead(fence, 1) OVER (PARTITION BY doc_id ORDER BY lineno), FALSE) OR coalesce(lead(fence, 2) OVER (PARTITION BY doc_id ORDER BY lineno), FALSE)) AS shown,
  length(line) - length(regexp_replace(line, '(?is)^.*(not|don''t|do not|never)', '', '')) AS last_end, regexp_extract(line, '(?is)^.*(do not|don''t|not|never)', 1) AS last_hit FROM po),
pd AS (SELECT doc_id, string_agg(line, {NL} ORDER BY lineno) AS text, bool_or(shown) AS after,
  bool_or(last_hit <> '' AND before + last_end - length(CASE WHEN lower(last_hit) = 'do not' THEN 'do not' ELSE last_hit END) >= 0.2::DOUBLE * total
    AND NOT regexp_matches(line, '(?i)currently.*not') AND regexp_matches(trim(line, {WS}), '^(\\*|-|\\d+\\.)')) AS negative FROM pf GROUP BY doc_id),
pr AS (SELECT *, {ROLE_SQL.format("text")} AS role, {SCAFFOLD_SQL.format("text")} AS scaffold, {DELIMITER_SQL.format("text")} AS delimiter,
  regexp_matches(text, '(?is)(example:|input:.*?output:)') OR regexp_matches(text, '(?im)^#+.*(Example|Examples)') OR after AS few_shot FROM pd)"""


@query(f"WITH {PROMPT_SQL} SELECT doc_id, few_shot FROM pr")
def q25_prompt_few_shot(t):
    return prompt_texts(t).select("doc_id", prompts.few_shot(F.col("text")).alias("few_shot"))


@query(f"WITH {PROMPT_SQL} SELECT doc_id, negative FROM pr")
def q26_prompt_negative(t):
    return prompt_texts(t).select("doc_id", prompts.negative_constraint(F.col("text")).alias("negative"))


@query(f"""WITH {PROMPT_SQL} SELECT doc_id, CAST(greatest(0, least(100, 25 * (CAST(role AS INTEGER) + CAST(scaffold AS INTEGER) + CAST(delimiter AS INTEGER) + CAST(few_shot AS INTEGER)) - 10 * CAST(negative AS INTEGER))) AS BIGINT) AS score,
CAST(4 - (CAST(role AS INTEGER) + CAST(scaffold AS INTEGER) + CAST(delimiter AS INTEGER) + CAST(few_shot AS INTEGER)) + CAST(negative AS INTEGER) AS BIGINT) AS n_improvements FROM pr""")
def q27_prompt_score(t):
    rows = prompts.lint(prompt_texts(t), "doc_id", "text")
    return rows.select("doc_id", "score", F.size("improvements").alias("n_improvements"))


# --- project score and reports ---


@query(f"""WITH RECURSIVE {NATION_SQL}, {MD_SCORE_SQL}, {HOST_SQL},
god AS (SELECT count(*) AS n FROM (SELECT l_partkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY 1 HAVING count(*) > 30)),
miss AS (SELECT count(*) AS n FROM (VALUES ('EN'), ('README.md')) v(name) WHERE NOT EXISTS (SELECT 1 FROM documents WHERE lower(lang) = lower(name))),
pen AS (SELECT (SELECT n FROM miss) * 15 + (SELECT n FROM god) * 10 + (SELECT count(*) FROM h WHERE n > 25) * 5 + (SELECT count(*) FROM r WHERE a = b) * 5 AS p)
SELECT round(avg(score), 6) AS file_score, CAST((SELECT p FROM pen) AS BIGINT) AS penalty,
round(least(100, avg(score) * 0.8::DOUBLE + greatest(0, 100 - (SELECT p FROM pen)) * 0.2::DOUBLE + 5), 6) AS final_score FROM mf""")
def q28_project_score(t):
    files = markdown_results(t).agg(F.avg("score").alias("file_score"))
    edges = t("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    gods = graph.inbound(t("part").select(F.col("p_partkey").alias("node")), edges).agg(F.count_if(F.col("inbound") > 30).alias("gods"))
    crowded = hosts(t).where("files > 25").agg(F.count("*").alias("crowded"))
    cyclic = graph.closure(nation_edges(t)).where("a = b").agg(F.count("*").alias("cycles"))
    d = t("documents")
    required = d.sparkSession.createDataFrame([(0, "EN"), (1, "README.md")], "ord int, name string")
    missing = health.missing_docs(required, d.select(F.col("lang").alias("name"))).agg(F.count("*").alias("missing"))
    rows = files.crossJoin(gods).crossJoin(crowded).crossJoin(cyclic).crossJoin(missing)  # one row each
    penalty = scoring.project_penalty(F.col("missing"), F.lit(False), F.col("gods"), F.col("crowded"), F.col("cycles"))
    return rows.select("file_score", penalty.alias("penalty"), scoring.final_score(F.col("file_score"), penalty, F.lit(True), F.lit(False)).alias("final_score"))


@query("""WITH f AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS file, CAST(n_chars % 30 AS DOUBLE) AS complexity, CASE WHEN n_chars % 7 = 0 THEN 'Circular dependency' ELSE '' END AS issues, CAST(n_chars % 101 AS DOUBLE) AS coverage FROM documents)
SELECT CAST(0 AS BIGINT) AS ord, file, 'High Complexity: ' || file AS finding, 'Refactor units.' AS recommendation FROM f WHERE complexity > 20
UNION ALL SELECT 1, file, 'Circular Dependency: ' || file, 'Use DI.' FROM f WHERE contains(issues, 'Circular dependency') UNION ALL SELECT 2, file, 'Low Type Safety: ' || file, 'Add PEP 484 hints.' FROM f WHERE coverage < 90""")
def q29_recommendations(t):
    n = F.col("n_chars")
    f = t("documents").select(F.col("doc_id").cast("string").alias("file"), (n % 30).cast("double").alias("complexity"), F.when(n % 7 == 0, "Circular dependency").otherwise("").alias("issues"), (n % 101).cast("double").alias("type_coverage"))
    return report.recommendations(f).select("ord", "file", "finding", "recommendation")


@query("""WITH s AS (SELECT source, avg(CAST(n_chars % 101 AS DOUBLE)) + 40 * (count(*) % 2) - 10 * (count(*) % 3) AS score FROM documents GROUP BY source)
SELECT source, CASE WHEN score >= 90 THEN '#4c1' WHEN score >= 70 THEN '#97ca00' WHEN score >= 50 THEN '#dfb317' ELSE '#e05d44' END AS color, CAST(trunc(score) AS BIGINT) || '/100' AS label FROM s""")
def q30_badge(t):
    n = F.count("*")
    s = t("documents").groupBy("source").agg((F.avg((F.col("n_chars") % 101).cast("double")) + 40 * (n % 2) - 10 * (n % 3)).alias("score"))
    return s.select("source", X.badge_color(F.col("score")).alias("color"), F.concat(F.col("score").cast("long").cast("string"), F.lit("/100")).alias("label"))


@query(f"""WITH {UNITS_SQL}, a AS (SELECT source, doc_id, depth * 2 + cc * 1.5::DOUBLE + loc / 50 AS acl FROM u)
SELECT source, doc_id, round(acl, 6) AS acl, row_number() OVER (PARTITION BY source ORDER BY acl DESC, doc_id) AS rank FROM a QUALIFY rank <= 3""")
def q31_topn(t):
    return report.ranked(units(t).select("source", "doc_id", "acl"), "acl", 3, "source", ("doc_id",))


@query(f"WITH {UNITS_SQL}, a AS (SELECT doc_id, typed, depth * 2 + cc * 1.5::DOUBLE + loc / 50 AS acl FROM u) SELECT doc_id, round(acl, 6) AS acl, typed AS is_typed FROM a WHERE acl > 15 OR NOT typed")
def q32_fix_violations(t):
    return fix.violations(units(t)).select("doc_id", "acl", "is_typed")


@query(f"""WITH r AS (SELECT source, string_agg('### File: `' || lang || '/' || doc_id || '` - ' || CASE WHEN doc_id % 2 = 0 THEN 'High Cognitive Load' ELSE 'Low Type Safety' END || {NL} || 'Fix ' || doc_id, {NL} ORDER BY doc_id) AS text FROM documents GROUP BY source)
SELECT lang || '/' || doc_id AS file, CASE WHEN doc_id % 2 = 0 THEN 'High Cognitive Load' ELSE 'Low Type Safety' END AS kind, 'Fix ' || doc_id AS prompt FROM documents""")
def q33_issue_parse(t):
    d = t("documents")
    entry = F.concat(F.lit("### File: `"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("` - "), F.when(F.col("doc_id") % 2 == 0, "High Cognitive Load").otherwise("Low Type Safety"), F.lit("\nFix "), F.col("doc_id").cast("string"))
    rows = d.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", entry.alias("e")))), lambda x: x["e"]), "\n").alias("text"))
    return fix.parsed_issues(rows, "text").select("file", "kind", "prompt")


@query("""SELECT DISTINCT url FROM pages WHERE length(html) % 3 = 0 AND (ends_with(url, '7') OR ends_with(url, '25') OR ends_with(url, 'x') OR ends_with(url, '#top'))""")
def q34_diff_intersection(t):
    return fix.changed(t("pages").where(F.length("html") % 3 == 0).select("url"), "url", SUFFIXES)


def source_rows(t) -> DataFrame:
    """Python source whose facts follow from the key: nested ifs, a return type for even keys."""
    n = (F.col("p_partkey") % 5).cast("int")
    ifs = F.array_join(F.transform(F.sequence(F.lit(1), n + 1), lambda k: F.concat(F.expr("repeat(' ', 4)"), F.repeat(F.lit("    "), k - 1), F.lit("if x > "), k.cast("string"), F.lit(":\n"))), "")
    tail = F.concat(F.repeat(F.lit("    "), n + 2), F.lit("return x\n"))
    head = F.concat(F.lit("import os.path\nfrom .pkg import y\n\ndef f"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "(x) -> int:\n").otherwise("(x):\n"))
    return t("part").select(F.col("p_partkey").cast("string").alias("rel_path"), F.concat(head, ifs, tail).alias("content"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS rel_path, 'f' || p_partkey AS name, CAST(4 AS BIGINT) AS lineno, CAST(p_partkey % 5 + 2 AS DOUBLE) AS complexity, p_partkey % 5 + 3 AS loc,
round(2 * CAST(p_partkey % 5 + 1 AS DOUBLE) + 1.5::DOUBLE * (p_partkey % 5 + 2) + (p_partkey % 5 + 3) / 50::DOUBLE, 6) AS acl, p_partkey % 2 = 0 AS is_typed, p_partkey % 5 + 1 AS nesting_depth FROM part""")
def q35_python_units(t):
    return pycode.facts(source_rows(t)).select("rel_path", F.inline("units"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS rel_path, 'def f' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '(x) -> int:' ELSE '(x):' END AS signatures, 'os.path:0,pkg:1' AS imports FROM part""")
def q36_signatures_imports(t):
    f = pycode.facts(source_rows(t))
    names = F.array_join(F.transform("imports", lambda i: F.concat_ws(":", i["module"], i["level"].cast("string"))), ",")
    return f.select("rel_path", F.array_join("signatures", "\n").alias("signatures"), names.alias("imports"))


@query(f"""WITH f AS (SELECT lang, arg_min(text, doc_id) AS readme, arg_max(text, doc_id) AS agents, string_agg(source, {NL} ORDER BY doc_id) AS sigs FROM documents GROUP BY lang)
SELECT lang, length(readme || {NL} || agents || {NL} || sigs) // 4 AS token_count, length(readme || {NL} || agents || {NL} || sigs) // 4 > 800 AS alert FROM f""")
def q37_critical_context(t):
    f = t("documents").groupBy("lang").agg(
        F.length(F.min_by("text", "doc_id")).alias("readme"), F.length(F.max_by("text", "doc_id")).alias("agents"), health.joined_length(F.length("source")).alias("signatures")
    )
    tokens = X.tokens_of_length(health.critical_length(F.col("readme"), F.col("agents"), F.col("signatures")))
    return f.select("lang", tokens.alias("token_count"), (tokens > 800).alias("alert"))


@query(f"""WITH {UNITS_SQL}, a AS (SELECT doc_id, n_chars % 101 AS score, depth * 2 + cc * 1.5::DOUBLE + loc / 50 AS acl FROM u)
SELECT doc_id, score, CASE WHEN acl > 15 THEN '🔴 Red' ELSE '🟡 Yellow' END AS status FROM a WHERE acl > 10 AND score < 100""")
def q38_verbosity_filter(t):
    rows = units(t).withColumn("score", F.col("n_chars") % 101)
    return report.visible(report.over_target(rows)).select("doc_id", "score", "status")


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS href FROM pages), p AS (SELECT DISTINCT page_id, href FROM a)
SELECT href AS node, count(*) AS inbound FROM p GROUP BY href""")
def q39_pages_link_graph(t):
    edges = t("pages").select(F.col("page_id").cast("string").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("dst")).distinct()
    return graph.inbound(edges.select(F.col("dst").alias("node")).distinct(), edges)



@query("""WITH p AS (SELECT p_partkey, 'c' || p_partkey || ' ' || CASE p_size % 4 WHEN 0 THEN 'feat: ' WHEN 1 THEN 'Fix(ui): ' WHEN 2 THEN 'chore: ' ELSE 'feature ' END || p_name AS line, p_size FROM part)
SELECT p_partkey AS ord, CASE p_size % 4 WHEN 0 THEN '🚀 Features' WHEN 1 THEN '🐛 Bug Fixes' ELSE '⚙️ Maintenance' END AS category,
'- ' || substr(line, strpos(line, ' ') + 1) || ' (c' || p_partkey || ')' AS entry FROM p""")
def q40_commit_categories(t):
    kind = F.col("p_size") % 4
    prefix = F.when(kind == 0, "feat: ").when(kind == 1, "Fix(ui): ").when(kind == 2, "chore: ").otherwise("feature ")
    line = F.concat(F.lit("c"), F.col("p_partkey").cast("string"), F.lit(" "), prefix, "p_name")
    return changelog.categorised(t("part").select(F.col("p_partkey").alias("ord"), line.alias("line")))


@query("""WITH f AS (SELECT lang || '/' || source || '.py' AS rel_path, count(*) AS n FROM documents GROUP BY 1),
t AS (SELECT rel_path, CASE WHEN n % 3 = 0 THEN '# h' || n ELSE 'x = ' || n END AS content FROM f)
SELECT rel_path, CASE WHEN starts_with(content, '#') THEN 0 ELSE 1 END::BIGINT AS loc, (length(content) // 4)::BIGINT AS tokens, 'Python' AS language FROM t""")
def q41_file_metrics(t):
    f = t("documents").groupBy(F.concat("lang", F.lit("/"), "source", F.lit(".py")).alias("rel_path")).agg(F.count("*").alias("n"))
    n = F.col("n").cast("string")
    c = f.select("rel_path", F.when(F.col("n") % 3 == 0, F.concat(F.lit("# h"), n)).otherwise(F.concat(F.lit("x = "), n)).alias("content"))
    return c.select("rel_path", X.code_loc(F.col("content")).alias("loc"), X.token_estimate(F.col("content")).alias("tokens"), X.language(F.col("rel_path")).alias("language"))


@query("""SELECT c_custkey, '/' || c_mktsegment || CASE WHEN c_custkey % 4 = 0 THEN '/.git/' ELSE '/src/' END || c_custkey AS path, c_custkey % 4 = 0 AS hidden FROM customer""")
def q42_hidden_paths(t):
    path = F.concat(F.lit("/"), "c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, "/.git/").otherwise("/src/"), F.col("c_custkey").cast("string"))
    return t("customer").select("c_custkey", path.alias("path"), X.hidden_path(path).alias("hidden"))


ENTRY_SQL = """CASE (c_custkey * 7 + c_nationkey) % 160 WHEN 0 THEN 'Agents.MD' WHEN 1 THEN 'ruff.toml' WHEN 2 THEN 'uv.lock' WHEN 3 THEN 'baml_src'
  WHEN 4 THEN 'generators.baml' WHEN 5 THEN 'AGENTS.md' WHEN 6 THEN 'poetry.lock' WHEN 7 THEN 'Ruff.toml' ELSE c_name END"""


@query(f"""WITH n AS (SELECT c_nationkey AS project, {ENTRY_SQL} AS name, c_custkey % 3 = 0 AS is_dir FROM customer)
SELECT project, bool_or(lower(name) = 'agents.md') AS agents_md, bool_or(name IN ('ruff.toml', '.flake8', '.eslintrc', 'pyproject.toml')) AS linter_config,
bool_or(name IN ('package-lock.json', 'poetry.lock', 'uv.lock', 'requirements.txt')) AS lock_file, bool_or(name = 'baml_src' AND is_dir OR name = 'generators.baml') AS baml_detected FROM n GROUP BY project""")
def q43_environment(t):
    entries = t("customer").select(F.col("c_nationkey").alias("project"), F.expr(ENTRY_SQL).alias("name"), (F.col("c_custkey") % 3 == 0).alias("is_dir"))
    return health.environment(entries, "project")


@query("""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '```python' || chr(10) || lang || chr(10) || '```' WHEN 1 THEN 'a ```' || chr(10) || source || '``` b' ELSE '  ' || lang || ' ' END AS answer, lang, source FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN source ELSE lang END AS code FROM d""")
def q44_fenced_code(t):
    k = F.col("doc_id") % 3
    answer = F.when(k == 0, F.concat(F.lit("```python\n"), "lang", F.lit("\n```"))).when(k == 1, F.concat(F.lit("a ```\n"), "source", F.lit("``` b"))).otherwise(F.concat(F.lit("  "), "lang", F.lit(" ")))
    return fix.fenced(t("documents").select("doc_id", answer.alias("answer")), "answer").select("doc_id", "code")


#: A module for each document, and what it imports: a neighbour, one of the package above, or one by its absolute name.
MODULES_SQL = """d AS (SELECT source || '/' || lang || '/m' || doc_id // 20 % 9 || CASE WHEN doc_id // 20 % 9 = 0 THEN '/__init__.py' ELSE '.py' END AS src, source, lang,
  doc_id // 20 % 9 AS k, doc_id // 7 % 10 AS j, doc_id // 180 % 5 AS kind FROM documents),
f AS (SELECT DISTINCT src AS path, regexp_replace(src, '/__init__\\.py$|\\.py$', '') AS stem FROM d),
i AS (SELECT DISTINCT src, string_split(src, '/') AS parts,
  CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS level,
  CASE kind WHEN 0 THEN 'm' || j WHEN 1 THEN lang || '/m' || j WHEN 2 THEN '' WHEN 3 THEN lang || '/m' || j ELSE 'm' || j END AS part FROM d),
r AS (SELECT src, array_to_string(list_filter(list_append(parts[1:len(parts) - level], part), lambda x: x <> ''), '/') AS base FROM i WHERE level > 0),
a AS (SELECT part, min(path) AS dst FROM (SELECT DISTINCT part FROM i WHERE level = 0) w JOIN f ON ends_with(f.stem, w.part) GROUP BY part)"""


@query(f"""WITH {MODULES_SQL} SELECT src, path AS dst FROM r JOIN f ON f.stem = r.base WHERE src <> path UNION SELECT src, dst FROM i JOIN a USING (part) WHERE level = 0 AND src <> dst""")
def q45_relative_imports(t):
    d = t("documents")
    step = lambda n, m: (F.floor(F.col("doc_id") / n) % m).cast("int")
    k, j, kind = step(20, 9), F.concat(F.lit("m"), step(7, 10).cast("string")), step(180, 5)
    path = F.concat("source", F.lit("/"), "lang", F.lit("/m"), k.cast("string"), F.when(k == 0, "/__init__.py").otherwise(".py"))
    module = F.when(kind.isin(1, 3), F.concat("lang", F.lit("."), j)).when(kind != 2, j)  # null: from . import name
    rows = d.select(path.alias("rel_path"), module.alias("module"), F.when(kind == 1, 2).when(kind.isin(0, 2), 1).otherwise(0).alias("level"))
    return graph.package_edges(rows, rows.select("rel_path").distinct())


# --- more programs: each shape's facts, by hand ---

PROGRAMS = [
    "def f{k}(x):\n    for i in x:\n        pass\n    else:\n        x = 1\n    return x\n",
    "def f{k}(x):\n    while x:\n        if x > 1:\n            x = 2\n    return x\n",
    "def f{k}(x) -> int:\n    try:\n        x = 1\n    except ValueError:\n        x = 2\n    except KeyError:\n        x = 3\n    finally:\n        x = 4\n    return x\n",
    "def f{k}(x):\n    with open(x) as g:\n        for i in g:\n            x = i\n    return x\n",
    "def f{k}(x):\n    match x:\n        case 1:\n            x = 2\n        case _:\n            x = 3\n    return x\n",
    "def f{k}(x):\n    def g(y: int):\n        if y:\n            y = 1\n        return y\n    return g\n",
    "def f{k}(x):\n    h = lambda y: [z for z in y]\n    return h(x)\n",
    "class C:\n    async def f{k}(self, x) -> None:\n        async for i in x:\n            pass\n",
    "x = 1\nif x:\n    def f{k}(a: int, *b):\n        return a and b\n",
    "def f{k}(:\n    return\n",
]
#: Shape, unit, line, complexity, lines, whether typed, nesting depth.
PROGRAM_UNITS = """(0, 'f', 1, 2, 6, FALSE, 1), (1, 'f', 1, 3, 5, FALSE, 2), (2, 'f', 1, 4, 10, TRUE, 1), (3, 'f', 1, 2, 5, FALSE, 2), (4, 'f', 1, 1, 7, FALSE, 0),
  (5, 'f', 1, 3, 6, FALSE, 1), (5, 'g', 2, 1, 4, TRUE, 1), (6, 'f', 1, 1, 3, FALSE, 2), (7, 'f', 2, 2, 3, TRUE, 1), (8, 'f', 3, 1, 2, TRUE, 0)"""
#: Shape, mean complexity of all graphs, type coverage, depth, signatures.
PROGRAM_FILES = """(0, 2, 0, 1, 'def f#(x):'), (1, 3, 0, 2, 'def f#(x):'), (2, 4, 100, 1, 'def f#(x) -> int:'), (3, 2, 0, 2, 'def f#(x):'), (4, 1, 0, 0, 'def f#(x):'),
  (5, 3, 50, 1, 'def f#(x):|def g(y: int):'), (6, 1, 0, 2, 'def f#(x):'), (7, 2, 100, 1, 'class C:|async def f#(self, x) -> None:'), (8, 3, 100, 1, 'def f#(a: int, *b):'), (9, 0, 0, 0, '')"""


def shaped(t, programs: list[str], n: int) -> DataFrame:
    """A program for each part, its shape by the key."""
    shape = (F.col("p_partkey") % n).cast("int")
    text = F.get(F.array(*map(F.lit, programs)), shape)
    return t("part").select(F.col("p_partkey").cast("string").alias("rel_path"), F.replace(text, F.lit("{k}"), F.col("p_partkey").cast("string")).alias("content"))


@query(f"""WITH s(shape, u, lineno, cc, loc, typed, depth) AS (VALUES {PROGRAM_UNITS})
SELECT CAST(p_partkey AS VARCHAR) AS rel_path, CASE u WHEN 'f' THEN 'f' || p_partkey ELSE u END AS name, CAST(lineno AS BIGINT) AS lineno, CAST(cc AS DOUBLE) AS complexity, CAST(loc AS BIGINT) AS loc,
round(depth * 2.0::DOUBLE + cc * 1.5::DOUBLE + loc / 50.0::DOUBLE, 6) AS acl, typed AS is_typed, CAST(depth AS BIGINT) AS nesting_depth FROM part JOIN s ON shape = p_partkey % 10""")
def q46_python_shapes(t):
    return pycode.facts(shaped(t, PROGRAMS, 10)).select("rel_path", F.inline("units"))


@query(f"""WITH s(shape, cc, coverage, depth, heads) AS (VALUES {PROGRAM_FILES})
SELECT CAST(p_partkey AS VARCHAR) AS rel_path, shape <> 9 AS parsed, CAST(cc AS DOUBLE) AS mean_complexity, CAST(coverage AS DOUBLE) AS type_coverage, CAST(depth AS BIGINT) AS max_depth,
replace(replace(heads, '#', CAST(p_partkey AS VARCHAR)), '|', {NL}) AS signatures FROM part JOIN s ON shape = p_partkey % 10""")
def q47_python_files(t):
    f = pycode.facts(shaped(t, PROGRAMS, 10))
    return f.select("rel_path", "parsed", "mean_complexity", "type_coverage", "max_depth", F.array_join("signatures", "\n").alias("signatures"))


SCRIPTS = [
    "function f{k}(a) {\n  if (a && a.b || a.c) {\n    return 1;\n  }\n  return 2;\n}\n",
    "function f{k}(a: number): number {\n  for (let i = 0; i < a; i++) {\n    while (i) {\n      i--;\n    }\n  }\n  return a;\n}\n",
    "const f{k} = (a) => {\n  switch (a) {\n    case 1:\n      return 1;\n    case 2:\n      return 2;\n    default:\n      return 3;\n  }\n};\n",
    "class C {\n  f{k}(a) {\n    try {\n      a();\n    } catch (e) {\n      a(e);\n    }\n  }\n}\n",
    "const s = `if (${1}) { while (x) }`;\n// if (a) {}\nconst r = /if (x)/g;\nfunction f{k}() { return a ? b : c; }\n",
    "export async function f{k}(a) {\n  do {\n    a--;\n  } while (a);\n  return [1].map((x) => x + 1);\n}\n",
]
#: Shape, unit, line, complexity, lines, whether typed, nesting depth.
SCRIPT_UNITS = """(0, 'f', 1, 4, 6, FALSE, 1), (1, 'f', 1, 3, 8, TRUE, 2), (2, 'anonymous', 1, 3, 10, FALSE, 1), (3, 'f', 2, 2, 7, FALSE, 2), (4, 'f', 4, 1, 1, FALSE, 0),
  (5, 'f', 1, 2, 6, FALSE, 1), (5, 'anonymous', 5, 1, 1, FALSE, 0)"""


def scripts(t) -> DataFrame:
    return jscode.facts(shaped(t, SCRIPTS, 6)).select("rel_path", F.inline("units"))


@query(f"""WITH s(shape, u, lineno, cc, loc, typed, depth) AS (VALUES {SCRIPT_UNITS})
SELECT CAST(p_partkey AS VARCHAR) AS rel_path, CASE u WHEN 'f' THEN 'f' || p_partkey ELSE u END AS name, CAST(lineno AS BIGINT) AS lineno, CAST(cc AS DOUBLE) AS complexity, CAST(loc AS BIGINT) AS loc,
round(depth * 2.0::DOUBLE + cc * 1.5::DOUBLE + loc / 50.0::DOUBLE, 6) AS acl, typed AS is_typed, CAST(depth AS BIGINT) AS nesting_depth FROM part JOIN s ON shape = p_partkey % 6""")
def q48_javascript_units(t):
    return scripts(t)


@query(f"""WITH s(shape, u, lineno, cc, loc, typed, depth) AS (VALUES {SCRIPT_UNITS}), l AS (SELECT shape, count(*) AS n, avg(cc) AS cc, sum(CAST(typed AS INTEGER)) * 100.0::DOUBLE / count(*) AS idx,
count(*) FILTER (depth * 2 + cc * 1.5 + loc / 50.0 > 8) AS red, count(*) FILTER (depth * 2 + cc * 1.5 + loc / 50.0 > 6 AND depth * 2 + cc * 1.5 + loc / 50.0 <= 8) AS yellow FROM s GROUP BY shape),
p AS (SELECT p_partkey, l.*, p_partkey % 2 = 0 AND idx < 90 AS held FROM part JOIN l ON shape = p_partkey % 6)
SELECT CAST(p_partkey AS VARCHAR) AS rel_path, CAST(100 - 15 * red - 5 * yellow - CASE WHEN held THEN 20 ELSE 0 END AS BIGINT) AS score, round(cc, 6) AS complexity,
concat_ws(', ', CASE WHEN red > 0 THEN red || ' Red ACL functions (-' || 15 * red || ')' END, CASE WHEN yellow > 0 THEN yellow || ' Yellow ACL functions (-' || 5 * yellow || ')' END,
  CASE WHEN held THEN 'Type Safety Index ' || printf('%.0f', idx) || '% < 90% (-20)' END) AS issues FROM p""")
def q49_javascript_score(t):
    """Every second file is held to types, as TypeScript is."""
    s = scoring.unit_stats(scripts(t), "rel_path", F.lit(8), F.lit(6))
    given = {"loc": 10, "cumulative": 0, "token_limit": 32000, "type_safety": 90}
    c = scoring.penalised("JavaScript", F.col("rel_path").cast("long") % 2 == 0)
    return s.withColumns({k: F.lit(v) for k, v in given.items()}).select("rel_path", *[c[k].alias(k) for k in ("score", "complexity", "issues")])


@query("""SELECT CAST(c_custkey AS VARCHAR) AS rel_path, c_custkey % 7 <> 0 AS valid, CAST(CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 1 + c_custkey % 4 END AS BIGINT) AS depth FROM customer""")
def q50_yaml_toml_depth(t):
    """Nested tables in TOML and nested lists of mappings in YAML; every seventh text is malformed."""
    n = (1 + F.col("c_custkey") % 4).cast("int")
    keys = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("k"), k.cast("string")))
    toml = F.concat(F.lit("a = 1 # {{\n["), F.array_join(keys, "."), F.lit("]\nv = '[[{'\ne = []\n"))
    levels = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.repeat(F.lit("  "), k), F.lit("k:\n")))
    yaml = F.concat(F.array_join(levels, ""), F.repeat(F.lit("  "), n), F.lit("v: \"[{\"\n"), F.repeat(F.lit("  "), n), F.lit("e: {}\n"))
    is_toml = F.col("c_custkey") % 2 == 0
    broken = F.when(is_toml, F.lit("a = = 1\n")).otherwise("a: [1\nb: }\n")
    text = F.when(F.col("c_custkey") % 7 == 0, broken).when(is_toml, toml).otherwise(yaml)
    ext = F.when(is_toml, ".toml").when(F.col("c_custkey") % 3 == 0, ".YAML").otherwise(".yml")
    return configs.facts(t("customer").select(F.col("c_custkey").cast("string").alias("rel_path"), text.alias("content"), ext.alias("ext")))


@query("""SELECT c_custkey, 'src' || c_custkey % 3 || '.py' AS file, CASE WHEN c_custkey % 2 = 0 THEN 'High Cognitive Load' ELSE 'Low Type Safety' END AS kind,
'Refactor: src' || c_custkey % 3 || '.py (' || CASE WHEN c_custkey % 2 = 0 THEN 'High Cognitive Load' ELSE 'Low Type Safety' END || ')' AS title
FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment <> 'BUILDING'""")
def q51_new_issues(t):
    """Issues of heavy files that are not open yet; those of one market segment are."""
    kind = F.when(F.col("c_custkey") % 2 == 0, "High Cognitive Load").otherwise("Low Type Safety")
    found = t("customer").select("c_custkey", "c_mktsegment", F.concat(F.lit("src"), (F.col("c_custkey") % 3).cast("string"), F.lit(".py")).alias("file"), kind.alias("kind"), F.lit("Do it.").alias("prompt"))
    wanted = issues.wanted(found).withColumn("key", F.concat("title", F.lit(" "), "c_custkey"))
    open_ = wanted.where("c_mktsegment = 'BUILDING'").select("key")
    return fix.new_issues(wanted, open_, "key").select("c_custkey", "file", "kind", "title")
