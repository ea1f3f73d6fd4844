"""Connected components of a distributed edge list by union-find within partitions and alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import durable


class UnionFind:
    """Union by smallest member, with path halving."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p] = up.setdefault(p, p)
            x = up[x]
        return x

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def forest(self) -> list[tuple]:
        """``(member, smallest member)`` of all but the smallest ones."""
        return [(x, r) for x in list(self.up) if (r := self.find(x)) != x]


def _forest(edges: DataFrame) -> DataFrame:
    """A star forest for each partition's edges; as many rows as its nodes at most."""

    kind = dict(edges.dtypes)["hi"]

    def run(batches):
        import pyarrow as pa

        sets = UnionFind()
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sets.join(x, y)
        rows = sets.forest()
        for i in range(0, len(rows), 10_000):
            hi, lo = zip(*rows[i : i + 10_000])
            yield pa.RecordBatch.from_pydict({"hi": hi, "lo": lo}, schema=pa.schema([(c, pa.binary() if kind == "binary" else pa.int64()) for c in ("hi", "lo")]))

    return edges.mapInArrow(run, f"hi {kind}, lo {kind}")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node that has an edge to another one.

    Large and small stars alternate (Kiveris et al., 2014) until nothing changes; each round is a written
    table, so lineage stays short. Nodes are longs or binary strings; no null ends; loops are dropped. Stars meet their
    centre's smallest neighbour in a join between two exchanges, so adaptive execution can split a large star.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo")
    e = durable(_forest(e), "forest")
    mark = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(durable(least, "least").hint("merge"), "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        e = durable(small.select("e.*").where("hi <> lo").distinct(), "stars")
    roots = e.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
