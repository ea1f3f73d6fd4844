"""Token ids in compressed files: an adaptive context-mixing range coder (operator 3).

Format. A row of the table is a frame: whole documents in ascending id order, with their lengths. The ids of
a frame are cut into blocks of ``BLOCK`` ids. Each block is coded on its own from a fresh model and carries the
CRC-32 of its ids, so any block can be read without the others and damage is found where it is.

Model. Order 2 and order 1 predict from counts of the ids that followed the last two ids and the last one in the block (of
the 3 and the 6 followers that lead), order 0 from counts of all ids so far, renewed with every id. The three
distributions are mixed; the weights are learned within the block, for each state of confidence. A range coder
codes each id within its share of the mix; what the candidates leave stands for all other ids, which order 0 codes alone,
and ids that are new to the block follow as plain bits. Any id below 2**32 - 1 can be coded. All arithmetic is on integers, so
coder and decoder agree on any machine. They step from id to id and run in the JVM (``IdCoder.java``).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.llm import jvm
from skarn.llm.bpe import Bpe, ByteLevelEncoder, text_buffer
from skarn.llm.common import durable

BLOCK = 8192
#: Ids after which a frame ends, at the next document.
FRAME = 128 * BLOCK
_SOURCE = Path(__file__).with_name("IdCoder.java")


def encoder(spark: SparkSession, block: int = BLOCK) -> Callable[[Column], Column]:
    """A column function: ids as little-endian unsigned 32-bit integers to their blocks, one after another.

    ``block``, the most ids of one, is a power of two up to 32768.
    """
    return jvm.function(spark, _SOURCE, "IdCoder", reads=False, block=block)


def decoder(spark: SparkSession, block: int = BLOCK) -> Callable[[Column], Column]:
    """The way back; a block whose checksum does not hold raises an error that names it."""
    return jvm.function(spark, _SOURCE, "IdCoder", reads=True, block=block)


def write_ids(docs: DataFrame, model: Bpe, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", frame_ids: int = FRAME, path: str | None = None) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write the file in ascending id order; returns the table read back.

    It lasts if ``path`` names a folder for it, else as long as the driver.
    A row is a frame: ``part`` and ``frame`` give its place in the file, ``at`` the ids of its part before it, ``doc_ids`` and
    ``lens`` its documents, ``coded`` its blocks. Null text counts as empty; a null id sorts first; rows with equal ids stay
    next to one another and, as order asks for it, in one part. A document is never split: a long one makes a long frame,
    which takes four bytes an id in the JVM.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc = ByteLevelEncoder(shared.value)
        part, frame, at, size = TaskContext.get().partitionId(), 0, 0, 0
        schema = pa.schema([("part", pa.int32()), ("frame", pa.int32()), ("at", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("raw", pa.binary())])
        tail = np.array([] if end_id is None else [end_id], "<u4")
        doc_ids: list = []
        held: list[np.ndarray] = []

        def close():
            rows = {"part": [part], "frame": [frame], "at": [at], "doc_ids": [doc_ids], "lens": [list(map(len, held))], "raw": [np.concatenate(held).tobytes()]}
            return pa.RecordBatch.from_pydict(rows, schema)

        for b in batches:
            ids, ends = enc.encode(*text_buffer(b.column(1)))
            start = 0
            for doc, end in zip(b.column(0).to_pylist(), ends.tolist()):
                doc_ids.append(doc)
                held.append(np.concatenate([ids[start:end], tail]).astype("<u4"))
                start = end
                size += len(held[-1])
                if size >= frame_ids:
                    yield close()
                    doc_ids, held, at, size, frame = [], [], at + size, 0, frame + 1
        if doc_ids:
            yield close()

    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = max(src.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = src.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    frames = ordered.mapInArrow(run, "part int, frame int, at long, doc_ids array<long>, lens array<long>, raw binary")
    coded = frames.select("part", "frame", "at", "doc_ids", "lens", encoder(spark)(F.col("raw")).alias("coded"))
    if path is None:
        return durable(coded, "token-ids", codec="none")
    coded.write.option("compression", "none").parquet(path)
    return spark.read.parquet(path)


def read_ids(frames: DataFrame, digest: bool = False) -> DataFrame:
    """Read a file that :func:`write_ids` wrote: ``doc_id, start, n_tokens`` and the ``ids``, or their CRC-32 if ``digest``.

    ``start`` counts the ids of all documents before: those of the parts before, which one row a part adds up, and
    those of the part itself. A damaged block raises an error that names it.
    """
    what = "ids_crc32 long" if digest else "ids array<int>"
    size = F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = frames.select("part", size.alias("size")).groupBy("part").agg(F.sum("size").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for doc_ids, lens, base, raw in zip(*(b.column(k).to_pylist() for k in ("doc_ids", "lens", "base", "raw"))):
                ends = np.cumsum([0, *lens])
                starts = pa.array(ends[:-1] + base, pa.int64())
                if digest:
                    view = memoryview(raw)
                    last = pa.array([zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(ends.tolist(), ends[1:].tolist())], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(raw, "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), starts, pa.array(lens, pa.int64()), last], ["doc_id", "start", "n_tokens", what.split()[0]])

    based = frames.join(F.broadcast(parts), "part")  # one row a partition of the writer
    rows = based.select("doc_ids", "lens", (F.col("at") + F.col("base")).alias("base"), decoder(frames.sparkSession)(F.col("coded")).alias("raw"))
    return rows.mapInArrow(run, f"doc_id long, start long, n_tokens long, {what}")
