"""Near-duplicate grouping with SuperMinHash (operator 8).

1. Each text's set of distinct word shingles gets a digest and a SuperMinHash signature. Texts with equal sets are
   one class; a node of its smallest id and the digest stands for it from here on.
2. Signatures are cut into bands. Classes that share a band value are joined to the smallest of them, and the
   connected classes form a family: all candidate pairs lie within families.
3. Families are verified on their full sets. A family is cut into blocks of bounded size, and each pair of blocks is a
   task that counts all intersections at once by a product of incidence matrices over the shingles that occur twice.
   A task reports a spanning forest of its links, never its pairs.
4. Union-find over the links gives the components.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import durable
from skarn.llm.components import UnionFind, components
from skarn.llm.superminhash import band_keys, set_digest, shingle_sets, signatures

#: Most classes, and most shingles, in a block of a family.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 1_000_000


def text_key(text: Column) -> Column:
    """Tells the texts of rows that share an id apart."""
    return F.xxhash64(F.octet_length(text), text)


def sketch(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, key, n, digest, sig`` of every row; null texts and texts without words have ``n = 0`` and no signature."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, keys = b.column(0), b.column(2)
            pend: list[np.ndarray] = []
            first = 0

            def out(first, pend):
                sig = signatures(pend)
                keep = [len(s) > 0 for s in pend]
                return pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(pend)),
                        keys.slice(first, len(pend)),
                        pa.array(map(len, pend), pa.int64()),
                        pa.array([set_digest(s) if ok else None for s, ok in zip(pend, keep)], pa.binary()),
                        pa.array([x.tobytes() if ok else None for x, ok in zip(sig, keep)], pa.binary()),
                    ],
                    ["id", "key", "n", "digest", "sig"],
                )

            size = 0
            for row, s in shingle_sets(b.column(1), k):
                pend.append(s)
                size += len(s)
                if size > 200_000 or len(pend) >= 2000:
                    yield out(first, pend)
                    first, pend, size = row + 1, [], 0
            if pend:
                yield out(first, pend)

    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), text_key(text).alias("key"))
    return src.mapInArrow(run, "id long, key long, n long, digest binary, sig binary")


def node_of(rep: Column, digest: Column) -> Column:
    """16 bytes for a class: in the order of its smallest id, and told apart by the digest where classes share that id."""
    biased = F.lpad(F.hex(rep.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.unhex(F.concat(biased, F.substring(F.hex(digest), 1, 16)))


def id_of(node: Column) -> Column:
    """The smallest id of a class."""
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63)))


def _bands(sigs: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 4096):
                p = b.slice(i, 4096)
                sig = np.array([np.frombuffer(x, np.uint32) for x in p.column(1).to_pylist()])
                keys = band_keys(sig)
                nodes = p.column(0).take(pa.array(np.repeat(np.arange(p.num_rows), keys.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), nodes], ["key", "node"])

    return sigs.select("node", "sig").mapInArrow(run, "key long, node binary")


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Index pairs of linked sets: within ``left``, or between ``left`` and ``right`` if given.

    Exact: intersections are counted over all shingles that at least two sets have, in column slices.
    """
    sets = left + (right or [])
    n, m = len(left), len(right or [])
    lens = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), lens)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    col = np.cumsum(new) - 1
    often = np.bincount(col) > 1
    keep = often[col]
    renumber = np.cumsum(often) - 1
    col, who = renumber[col[keep]], who[keep]
    rows, cols = (n, m) if m else (n, n)
    common = np.zeros((rows, cols), np.float32)  # exact below 2**24
    width = 4096
    for i in range(0, int(often.sum()), width):
        a, b = np.searchsorted(col, [i, i + width])
        x = np.zeros((len(sets), width), np.float32)
        x[who[a:b], col[a:b] - i] = 1
        common += x[:n] @ (x[n:] if m else x).T
    common = common.astype(np.int64)
    other = lens[n:] if m else lens
    hit = (common > 0) & (100 * common >= percent * (lens[:n, None] + other[None, :] - common))
    i, j = np.nonzero(hit)
    if m:
        return list(zip(i.tolist(), (j + n).tolist()))
    return [(x, y) for x, y in zip(i.tolist(), j.tolist()) if x < y]


def _verify(tasks: DataFrame, k: int, percent: int) -> DataFrame:
    """Links of tasks; rows ``family, i, j, block, node, text`` that lie together by task. Rows of a node are equal."""

    def run(batches):
        import pyarrow as pa

        def links(task, rows):
            sides = [list({r[1]: r for r in rows if r[0] == b}.values()) for b in sorted({task[1], task[2]})]
            nodes = [r[1] for s in sides for r in s]
            sets = [[x for _, x in shingle_sets(pa.array([r[2] for r in s], pa.large_string()), k)] for s in sides if s]
            found = block_links(sets[0], sets[1], percent) if len(sets) > 1 else block_links(sets[0], None, percent) if task[1] == task[2] else []
            tree = UnionFind()
            for x, y in found:
                tree.join(nodes[x], nodes[y])
            out = tree.forest()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], ["a", "b"])

        task, rows = None, []
        for b in batches:
            for f, x, y, z, r, t in zip(*(c.to_pylist() for c in b.columns)):
                if (f, x, y) != task:
                    if rows:
                        yield links(task, rows)
                    task, rows = (f, x, y), []
                rows.append((z, r, t))
        if rows:
            yield links(task, rows)

    return tasks.mapInArrow(run, "a binary, b binary")


def group(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key, root, n_shingles, class_id, component_id, kept`` of every row.

    Two texts are linked if ``100 * intersection >= percent * union`` of their sets of distinct ``k``-word shingles.
    Words are runs of anything but ASCII white space, with A-Z in lower case. Texts with fewer words have one
    shingle; null texts and texts without words have none and are linked with nothing. ``component_id`` is the
    smallest id reachable. Every row is a document by itself: to share an id links nothing, and ``key`` (of the text)
    tells such rows apart, as ``root`` tells components of one smallest id apart; equal rows get equal results. Rows with a null id stand alone, with a null component, and are
    kept. Other columns are ignored. Texts of any length are hashed in parts; the sets of a family's block are held
    in one task, so a single set must fit there (8 bytes a shingle).
    """
    spark = docs.sparkSession
    sketches = durable(sketch(docs, k, id_col, text_col), "sketches")
    some = sketches.where("n > 0 and id is not null")
    # The row with the smallest id stands for a class.
    classes = some.groupBy("digest").agg(F.min(F.struct("id", "key")).alias("first"))
    classes = classes.select("digest", F.col("first.id").alias("rep"), F.col("first.key").alias("rep_key"), node_of(F.col("first.id"), F.col("digest")).alias("node"))
    reps = some.join(classes, "digest").where("id = rep and key = rep_key").select("node", "rep", "rep_key", "n", "sig").dropDuplicates(["node"])
    reps = durable(reps, "classes")
    bands = _bands(reps)
    shared = bands.groupBy("key").agg(F.min("node").alias("m"), F.max("node").alias("x")).where("m < x").select("key", "m")
    candidates = bands.join(shared, "key").where("node <> m").select("node", "m").distinct()
    family = components(candidates, "node", "m").select("node", F.col("component").alias("family"))
    family = durable(family.join(reps.select("node", "rep", "rep_key", "n"), "node"), "families")
    size = family.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    member = family.join(size, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    task = member.select("family", "block", "node", "rep", "rep_key", other.alias("o"))
    task = task.select("family", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node", "rep", "rep_key")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), text_key(text).alias("rep_key"), text.alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = task.join(texts.hint("merge"), ["rep", "rep_key"]).select("family", "i", "j", "block", "node", "text")
    tasks = tasks.repartition(n, "family", "i", "j").sortWithinPartitions("family", "i", "j", "block", "node")
    links = _verify(tasks, k, percent)
    linked = components(links, "a", "b").select("node", F.col("component").alias("root"))
    found = classes.join(linked, "node", "left").select("digest", "rep", F.coalesce("root", "node").alias("root"))
    out = sketches.select("id", "key", "n", "digest").join(found, "digest", "left")
    known = F.col("id").isNotNull()
    component = F.when(known, F.coalesce(id_of(F.col("root")), "id"))
    return out.select(
        F.col("id").alias("doc_id"),
        "key",
        F.when(known, F.col("root")).alias("root"),
        F.col("n").alias("n_shingles"),
        F.when(known, F.coalesce("rep", "id")).alias("class_id"),
        component.alias("component_id"),
        (~known | (F.col("id") == component)).alias("kept"),
    )
