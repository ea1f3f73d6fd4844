"""Shared plumbing: table access, durable intermediate tables, vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary one in local mode; elsewhere executors would each write to a disk of their own, so
    that is refused.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master or "").startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skarn-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def durable(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage: a later failure re-reads the committed files instead of replaying Python work,
    and losing an executor loses nothing. The table goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(nullable(df.schema)).parquet(path)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def give_back() -> None:
    """Free memory of a Python worker goes back to the system; workers live on after their tasks and would hold it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


# --- words of a UTF-8 buffer, hashed without creating Python strings -------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (digits, lower-case letters, everything beyond ASCII).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
CHUNK_BYTES = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    size = 1 << (n - 1).bit_length()
    out = []
    for base in (_BASE, _INVERSE):
        p = np.ones(1, np.uint64)
        while len(p) < size:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
        out.append(p)
    if size <= 2 * CHUNK_BYTES:  # tables for one huge text are not kept
        _POWERS[:] = out
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (Steele et al., 2014)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(buf: np.ndarray, doc_ends: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie one after another in ``buf`` (UTF-8, any case).

    ``doc_ends`` are end offsets. Returns the 64-bit word hashes in order, and for each text the
    number of words up to its end. The hash is polynomial over lower-cased bytes, finalised with the length.
    A long buffer is hashed in parts that end between words, so beside the hashes (8 bytes a word) memory is that of
    a part, or of the longest word.
    """
    if len(buf) <= 2 * CHUNK_BYTES:
        return _hash_part(buf, doc_ends, word_byte)
    hashes, upto = [], np.zeros(len(doc_ends), np.int64)
    at = n = 0
    while at < len(buf):
        stop = at + CHUNK_BYTES
        while stop < len(buf):
            gap = np.flatnonzero(~word_byte[LOWER[buf[stop : stop + 4096]]])
            stop += int(gap[0]) if len(gap) else 4096
            if len(gap):
                break
        stop = min(stop, len(buf))
        i, j = np.searchsorted(doc_ends, [at, stop], side="right")
        part, before = _hash_part(buf[at:stop], doc_ends[i:j] - at, word_byte)
        hashes.append(part)
        upto[i:j] = before + n
        n += len(part)
        at = stop
    return np.concatenate(hashes), upto


def _hash_part(buf: np.ndarray, doc_ends: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(doc_ends), np.int64)
    low = LOWER[buf]
    inside = word_byte[low]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cut = doc_ends[(doc_ends > 0) & (doc_ends < len(buf))]
    begin[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = _powers(len(buf) + 1)
    c = np.empty(len(buf) + 1, np.uint64)
    c[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=c[1:])
    h = (c[e] - c[s]) * down[s]
    h = mix(h ^ ((e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return h, np.searchsorted(s, doc_ends, side="left")


def text_chunks(column, limit: int = CHUNK_BYTES):
    """Yield ``(first row, buf, doc_ends)`` for runs of rows of an Arrow string column; null is empty text.

    A run holds at most ``limit`` bytes, or one longer text.
    """
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, data[offsets[row] : offsets[stop]], (offsets[row + 1 : stop + 1] - offsets[row])
        row = stop
