"""Benchmark decontamination with a positional inverted index (operator 10).

The training texts are cut into shards of whole documents. Of each shard the index stores, for every term, the
positions where it stands; positions of different documents are kept apart by a gap. Windows of benchmark items
are looked up shard by shard: their terms are ordered by how often they occur in the whole corpus, and the
lists, shifted by the terms' offsets, are intersected from the rarest term on. All lists of a document lie in one
shard, so intersections need no shuffle, and a very frequent term only makes its own lists longer.

Terms are 64-bit hashes of words; a phrase match needs all hashes of its window in place.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import ALNUM, durable, hash_words, text_chunks

WINDOW = 10
#: How far each word of a proximity match may be from its place.
SLOP = 3
#: Positions between documents of a shard; above SLOP.
GAP = 16
#: Benchmark windows that a pass holds in memory, at some 70 bytes each; a larger benchmark takes more passes over the index.
PASS_WINDOWS = 200_000
#: Windows of a piece of an item; items are dealt to passes by pieces.
PIECE = 4096


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """(n, min(size, len(words))) runs of consecutive words."""
    if not len(words):
        return np.zeros((0, size), np.uint64)
    return np.lib.stride_tricks.sliding_window_view(words, min(size, len(words)))


def item_pieces(benchmark: DataFrame, size: int) -> DataFrame:
    """``item, piece, n, words``: the word hashes of all items in pieces of at most ``PIECE`` windows (``n``), as a table.

    Pieces overlap by a window less a word, so that each window lies in one.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for row, buf, ends in text_chunks(b.column(1)):
                words, upto = hash_words(buf, ends, ALNUM)
                for i, w in enumerate(np.split(words, upto[:-1])):
                    n = max(len(w) - size + 1, 1) if len(w) else 0
                    cuts = range(0, n, PIECE)
                    columns = [[k // PIECE for k in cuts], [min(PIECE, n - k) for k in cuts], [w[k : k + min(PIECE, n - k) + size - 1].tobytes() for k in cuts]]
                    item = b.column(0).take(pa.array([row + i] * len(cuts), pa.int64()))
                    yield pa.RecordBatch.from_arrays([item, *[pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()))]], ["item", "piece", "n", "words"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    return durable(rows.mapInArrow(run, "item string, piece int, n long, words binary"), "benchmark")


class Query:
    """The distinct windows of some pieces of items, their terms ordered by corpus frequency; compact, as it is broadcast."""

    def __init__(self, pieces: list[tuple[str | None, bytes]], size: int):
        found: dict[bytes, set[int]] = {}
        names = sorted({item for item, _ in pieces if item is not None})
        number = {item: k for k, item in enumerate(names)}
        for item, words in pieces:
            for w in windows(np.frombuffer(words, np.uint64), size):
                found.setdefault(w.tobytes(), set()).update([] if item is None else [number[item]])
        self.size = size
        self.names = names
        self.item_ends = np.cumsum([0, *map(len, found.values())])
        self.item_numbers = np.fromiter((k for s in found.values() for k in sorted(s)), np.int32)
        self.lens = np.array([len(k) // 8 for k in found], np.int16)
        flat = np.frombuffer(b"".join(found), np.uint64)
        self.terms = np.unique(flat)
        # Shorter windows repeat their first term, which asks nothing more of a match.
        starts = np.cumsum(self.lens, dtype=np.int64) - self.lens
        place = np.minimum(np.arange(size)[None, :], self.lens[:, None] - 1) if len(found) else np.zeros((0, size), np.int64)
        self.offset = place.astype(np.int16)
        self.term = np.searchsorted(self.terms, flat[starts[:, None] + place]).astype(np.int32) if len(found) else place.astype(np.int32)

    def items(self, w: int) -> list[str]:
        return [self.names[k] for k in self.item_numbers[self.item_ends[w] : self.item_ends[w + 1]]]

    def order(self, frequency: np.ndarray) -> None:
        """Rarest terms first."""
        by = np.argsort(frequency[self.term], axis=1, kind="stable")
        self.term = np.take_along_axis(self.term, by, 1)
        self.offset = np.take_along_axis(self.offset, by, 1)

    def match(self, terms: np.ndarray, starts: np.ndarray, positions: np.ndarray, slop: int):
        """Yield ``(window, start positions, whether each is an exact phrase)`` of a shard's lists."""
        at = np.searchsorted(terms, self.terms)
        at = np.minimum(at, max(len(terms) - 1, 0))
        here = terms[at] == self.terms if len(terms) else np.zeros(len(self.terms), bool)
        for w in np.flatnonzero(here[self.term].all(1)).tolist():
            first = True
            for t, o in zip(at[self.term[w]].tolist(), self.offset[w].tolist()):
                p = positions[starts[t] : starts[t + 1]]
                if first:
                    begin, off, first = p - o, np.zeros(len(p), np.int64), False
                    continue
                want = begin + o
                k = np.searchsorted(p, want)
                right = p[np.minimum(k, len(p) - 1)]
                left = p[np.maximum(k - 1, 0)]
                miss = np.minimum(np.abs(right - want), np.abs(left - want))
                near = miss <= slop
                begin, off = begin[near], np.maximum(off[near], miss[near])
                if not len(begin):
                    break
            if len(begin):
                yield w, begin, off == 0


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, one row a shard, as a written table.

    ``doc_ids``, ``first`` (position of each document's first word) and ``n_words`` describe the documents; ``terms``
    (sorted), ``counts`` and ``positions`` the lists. With a ``vocabulary`` (sorted term hashes) only its terms
    get lists. Null and empty texts are documents without words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # terms of at most PASS_WINDOWS windows

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        vocab = shared.value
        shard = TaskContext.get().partitionId() << 33
        for b in batches:
            for row, buf, ends in text_chunks(b.column(1)):
                words, upto = hash_words(buf, ends, ALNUM)
                n = np.diff(np.concatenate([[0], upto]))
                first = np.concatenate([[0], upto[:-1]]) + GAP * np.arange(len(n))
                pos = np.arange(len(words)) + GAP * np.repeat(np.arange(len(n)), n)
                if vocab is not None:
                    at = np.minimum(np.searchsorted(vocab, words), max(len(vocab) - 1, 0))
                    keep = np.flatnonzero(vocab[at] == words) if len(vocab) else np.zeros(0, np.int64)
                    at, pos = at[keep], pos[keep]
                    order = np.argsort(at, kind="stable")
                    words = vocab[at[order]] if len(vocab) else words[:0]
                else:
                    order = np.argsort(words, kind="stable")
                    words = words[order]
                pos = pos[order].astype(np.uint32)
                cut = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, np.int64)
                counts = np.diff(np.concatenate([cut, [len(words)]])).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard], pa.int64()),
                        pa.array([b.column(0).slice(row, len(n)).to_pylist()], pa.list_(pa.int64())),
                        pa.array([first], pa.list_(pa.int64())),
                        pa.array([n], pa.list_(pa.int64())),
                        *[pa.array([x.tobytes()], pa.binary()) for x in (words[cut], counts, pos)],
                    ],
                    ["shard", "doc_ids", "first", "n_words", "terms", "counts", "positions"],
                )
                shard += 1

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "shard long, doc_ids array<long>, first array<long>, n_words array<long>, terms binary, counts binary, positions binary"
    return durable(src.mapInArrow(run, schema), "postings")


def frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each term occurs in the whole corpus; as many numbers as terms."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        import pyarrow as pa

        total = np.zeros(len(shared.value), np.int64)
        for b in batches:
            for t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t, c = np.frombuffer(t, np.uint64), np.frombuffer(c, np.uint32)
                at = np.minimum(np.searchsorted(shared.value, t), len(total) - 1)
                ok = shared.value[at] == t
                np.add.at(total, at[ok], c[ok])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["term", "n"])

    out = np.zeros(len(terms), np.int64)
    if len(terms):
        for r in index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
            out[r["term"]] = r["n"]
    return out


def _lookup(index: DataFrame, query: Query, slop: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(query)  # bounded by PASS_WINDOWS

    def run(batches):
        import pyarrow as pa

        q = shared.value
        names = ["shard", "ord", "doc_id", "n_words", "hits", "items", "near_items"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()), pa.list_(pa.string())]
        for b in batches:
            for shard, ids, first, n, terms, counts, pos in zip(*(b.column(k).to_pylist() for k in range(7))):
                first = np.array(first, np.int64)
                starts = np.concatenate([[0], np.cumsum(np.frombuffer(counts, np.uint32).astype(np.int64))])
                hits: list[list] = [[] for _ in ids]
                items: list[set] = [set() for _ in ids]
                near: list[set] = [set() for _ in ids]
                for w, begin, exact in q.match(np.frombuffer(terms, np.uint64), starts, np.frombuffer(pos, np.uint32).astype(np.int64), slop):
                    doc = np.maximum(np.searchsorted(first, begin, side="right") - 1, 0)
                    owners = q.items(w)
                    for d, s, e in zip(doc.tolist(), (begin - first[doc]).tolist(), exact.tolist()):
                        if e:
                            hits[d].append([s, s + int(q.lens[w])])
                            items[d].update(owners)
                        near[d].update(owners)
                columns = [[shard] * len(ids), list(range(len(ids))), ids, n, hits, [sorted(x) for x in items], [sorted(x - y) for x, y in zip(near, items)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = "shard long, ord int, doc_id long, n_words long, hits array<array<long>>, items array<string>, near_items array<string>"
    return index.select("shard", "doc_ids", "first", "n_words", "terms", "counts", "positions").mapInArrow(run, schema)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """``doc_id, n_words, hits, items, near_items`` of every row of ``docs (doc_id, text)`` against ``benchmark (item_id, text)``.

    Words are runs of digits, letters A-Z (in lower case) and characters beyond ASCII. An item's windows are its runs of
    ``window`` words; an item of fewer words is one window. ``hits`` are the word ranges of exact occurrences,
    ``items`` the ids (as strings) of the items with one, ``near_items`` those with only proximity matches: all words
    within ``slop`` of their places. Null texts have no words; the windows of items without an id hit without a name.
    A benchmark of one pass is known before the index is built, which then holds the lists of its terms only; one of
    more passes gets an index of all terms. Words of any length of text are hashed in parts.
    """
    spark = docs.sparkSession
    bench = item_pieces(benchmark, window)
    total = bench.agg(F.sum("n")).first()[0] or 0
    passes = max(1, math.ceil(total / pass_windows))
    chunk = F.pmod(F.xxhash64("item", "piece", "words"), F.lit(passes))
    queries = []
    for k in range(passes):  # one pass' pieces at a time are on the driver
        part = bench.where(chunk == k) if passes > 1 else bench
        queries.append(lambda part=part: Query([(r["item"], r["words"]) for r in part.select("item", "words").toLocalIterator()], window))
    query = queries[0]()
    index = build_index(docs, query.terms if passes == 1 else None)
    found = None
    for k in range(passes):
        query = queries[k]() if k else query
        query.order(frequencies(index, query.terms))
        got = _lookup(index, query, slop)
        found = got if found is None else found.unionByName(got)
    if passes > 1:
        together = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
        found = found.groupBy("shard", "ord", "doc_id", "n_words").agg(together("hits"), together("items"), together("near_items"))
        found = found.withColumn("near_items", F.array_except("near_items", "items"))
    return found.drop("shard", "ord")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the rows of :func:`find`."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n_hit, names = [], []
            for hits, items in zip(b.column("hits").to_pylist(), b.column("items").to_pylist()):
                end = size = 0
                for i, j in sorted(hits):
                    size += max(0, j - max(i, end))
                    end = max(end, j)
                n_hit.append(size)
                names.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
            count = lambda c: pa.array([len(x) for x in b.column(c).to_pylist()], pa.int64())
            columns = [b.column("doc_id"), b.column("n_words"), pa.array(n_hit, pa.int64()), count("items"), pa.array(names, pa.string()), count("near_items")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "n_near_items"])

    out = found.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, n_near_items long")
    return out.withColumn("contaminated", F.col("n_hit") > 0)
