"""The import graph: edges by hash joins, inbound degrees, transitive closure, context tokens, cycles."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.sources.tables import durable


def path_suffixes(no_ext: Column) -> Column:
    """All suffixes of a path that begin at a component."""
    parts = F.split(no_ext, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), "/"))


def without_ext(path: Column) -> Column:
    """The path without the last extension of its last component; leading dots are no extension."""
    return F.regexp_replace(path, r"(?<=[^/.])\.[^./]*$", "")


def module_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``src, dst`` distinct: files whose path without extension ends, at a component, in an imported module's path.

    ``imports (rel_path, module)``, ``files (rel_path)``. The suffixes of all paths are spread out, which makes the match
    an equi-join; a file never imports itself.
    """
    have = files.select(F.col("rel_path").alias("dst"), F.explode(path_suffixes(without_ext(F.col("rel_path")))).alias("suffix"))
    want = imports.select(F.col("rel_path").alias("src"), F.replace(F.col("module"), F.lit("."), F.lit("/")).alias("suffix")).where("suffix <> ''").distinct()
    return want.join(have, "suffix").where("src <> dst").select("src", "dst").distinct()


def package_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``src, dst`` by the directed-graph rules, over Python files.

    Relative imports (``level`` above 0) go up ``level - 1`` directories and take the module's file before its package.
    Absolute ones take the smallest path that ends in the module's file or package, with no regard to component borders.
    """
    paths = files.where(F.col("rel_path").endswith(".py")).select("rel_path")
    imp = imports.withColumn("part", F.replace(F.coalesce("module", F.lit("")), F.lit("."), F.lit("/")))
    dirs = F.slice(F.split("rel_path", "/"), 1, F.greatest(F.lit(0), F.size(F.split("rel_path", "/")) - F.col("level")))
    base = F.array_join(F.filter(F.concat(dirs, F.array("part")), lambda x: x != ""), "/")
    rel = imp.where("level > 0").select(F.col("rel_path").alias("src"), base.alias("base")).distinct()
    exact = paths.select(F.col("rel_path").alias("dst"), F.regexp_replace("rel_path", r"(^|/)__init__\.py$|\.py$", "").alias("base"), (~F.col("rel_path").rlike(r"(^|/)__init__\.py$")).alias("is_file"))
    found = rel.join(exact, "base").groupBy("src", "base").agg(F.max_by("dst", "is_file").alias("dst")).select("src", "dst")
    want = imp.where("level = 0 and part <> ''").select("part").distinct()
    # Ends of paths are matched by equality here as well: those of a length that some module has, and a path's length bounds.
    stem = F.regexp_replace("rel_path", r"/__init__\.py$|\.py$", "")
    lengths = F.array(*[F.lit(r[0]) for r in want.select(F.length("part")).distinct().collect()]).cast("array<int>")
    ends = paths.select("rel_path", F.explode(F.transform(F.filter(lengths, lambda n: n <= F.length(stem)), lambda n: F.right(stem, n))).alias("part"))
    first = want.join(ends, "part").groupBy("part").agg(F.min("rel_path").alias("dst"))
    absolute = imp.where("level = 0").select(F.col("rel_path").alias("src"), "part").distinct().join(first, "part").select("src", "dst")
    return found.union(absolute).where("src <> dst").distinct()


def inbound(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, inbound`` of every node of ``nodes (node)``: how many others point to it."""
    degree = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("inbound"))
    return nodes.join(degree, "node", "left").select("node", F.coalesce("inbound", F.lit(0)).alias("inbound"))


def closure(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """``a, b``: every node that can be reached from ``a`` in one step or more; ``start (a)`` limits where to start.

    Semi-naive: each round joins only the pairs that the last one found. Rounds are written tables, and what was found
    becomes one table again every eighth round, so the plan stays short. A round costs two shuffles of the frontier. The
    result itself can be as large as the square of the nodes.
    """
    steps = durable(edges.select("src", "dst").distinct(), "edges")
    found = steps.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    if start is not None:
        found = found.join(start, "a", "left_semi")
    found = frontier = durable(found, "closure")
    rounds = 0
    while not frontier.isEmpty():
        rounds += 1
        reach = frontier.join(steps, frontier["b"] == steps["src"]).select("a", F.col("dst").alias("b")).distinct()
        frontier = durable(reach.join(found, ["a", "b"], "left_anti"), "frontier")
        found = found.unionByName(frontier)
        if rounds % 8 == 0:
            found = durable(found, "closure")
    return found


def context_tokens(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, cumulative`` for ``nodes (node, tokens)``: its own tokens and those of all it reaches, each once."""
    reach = closure(edges).where("a <> b").union(nodes.select("node", F.col("node").alias("b"))).toDF("a", "b")
    tokens = nodes.select(F.col("node").alias("b"), "tokens")
    return reach.join(tokens, "b", "left").groupBy(F.col("a").alias("node")).agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("cumulative"))


def canonical(cycle: list[str]) -> tuple[str, ...]:
    """Rotated so that the smallest member comes first."""
    k = cycle.index(min(cycle))
    return tuple(cycle[k:] + cycle[:k])


def back_edge_cycles(graph: dict[str, list[str]]) -> list[tuple[str, ...]]:
    """The cycles that the back edges of one depth-first search close, roots and neighbours in sorted order.

    A node is entered once only, so these need not be all cycles. Loops of one node don't count.
    """
    entered: set[str] = set()
    found: dict[tuple[str, ...], None] = {}
    for root in sorted(graph):
        if root in entered:
            continue
        entered.add(root)
        path, place = [root], {root: 0}
        todo = [iter(sorted(graph.get(root, ())))]
        while todo:
            for node in todo[-1]:
                if node in place:
                    if len(path) - place[node] > 1:
                        found.setdefault(canonical(path[place[node] :]))
                elif node not in entered:
                    entered.add(node)
                    place[node] = len(path)
                    path.append(node)
                    todo.append(iter(sorted(graph.get(node, ()))))
                    break
            else:
                todo.pop()
                del place[path.pop()]
    return list(found)


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, comp``: the smallest node of its weakly connected component, by label propagation to a fixed point."""
    both = durable(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "both")
    label = nodes.select("node", F.col("node").alias("comp"))
    while True:
        near = both.join(label, both["dst"] == label["node"]).groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("near"))
        lower = label.join(near, "node", "left").select("node", "comp", F.least("comp", F.coalesce("near", "comp")).alias("low"))
        hop = label.select(F.col("node").alias("low"), F.col("comp").alias("far"))
        new = durable(lower.join(hop, "low", "left").select("node", "comp", F.least("low", F.coalesce("far", "low")).alias("new")), "labels")
        same = new.where("new <> comp").isEmpty()
        label = new.select("node", F.col("new").alias("comp"))
        if same:
            return label


def _per_component(nodes: DataFrame, edges: DataFrame, search) -> DataFrame:
    """Cycles that ``search`` yields for each weakly connected component, which one task holds; rows leave in batches."""
    comp = weak_components(nodes, edges)
    # Only components with an edge can hold a cycle.
    rows = comp.join(edges, comp["node"] == edges["src"]).groupBy("comp").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))

    def run(batches):
        import pandas as pd

        names = ["comp", "nth", "pos", "file"]
        for pdf in batches:
            for comp, edges in zip(pdf["comp"], pdf["edges"]):
                graph: dict[str, list[str]] = {}
                for e in edges:
                    graph.setdefault(e["src"], []).append(e["dst"])
                    graph.setdefault(e["dst"], [])
                out = []
                for i, cycle in enumerate(search(graph)):
                    out += [(comp, i, k, f) for k, f in enumerate(cycle)]
                    if len(out) > 10_000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, "comp string, nth long, pos int, file string")


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``comp, nth, pos, file``: the cycles of :func:`back_edge_cycles`, component by component.

    The search never crosses weakly connected components, so each of them is searched on its own.
    """
    return _per_component(nodes, edges, back_edge_cycles)


def elementary_cycles(graph: dict[str, list[str]]) -> Iterator[tuple[str, ...]]:
    """Every elementary cycle, each from its smallest member on (a search bounded by the smallest node of each cycle).

    There can be exponentially many, so they are yielded one by one.
    """
    back: dict[str, set[str]] = {}
    for a, bs in graph.items():
        for b in bs:
            back.setdefault(b, set()).add(a)
    for root in sorted(graph):
        # Nodes not below the root that lead back to it, through such nodes only.
        lead, todo = {root}, [root]
        while todo:
            for a in back.get(todo.pop(), ()):
                if a >= root and a not in lead:
                    lead.add(a)
                    todo.append(a)
        path, on = [root], {root}
        stack = [iter(sorted(graph.get(root, ())))]
        while stack:
            for node in stack[-1]:
                if node == root:
                    yield tuple(path)
                elif node in lead and node not in on:
                    path.append(node)
                    on.add(node)
                    stack.append(iter(sorted(graph.get(node, ()))))
                    break
            else:
                stack.pop()
                on.discard(path.pop())


def simple_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``comp, nth, pos, file``: every elementary cycle, loops included. However many there are, none is held or dropped."""
    return _per_component(nodes, edges, elementary_cycles)
