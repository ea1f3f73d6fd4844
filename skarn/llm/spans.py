"""Substring deduplication with sliding sentence spans (operator 7).

Texts are cut into sentences: after ``.``, ``!`` or ``?`` and white space, and at line ends. At every sentence begins a
span, the shortest run of at least ``size`` sentences and ``min_words`` words. With ``tails``, at every sentence ends one
too, the shortest such run backwards, so that the short sentences that close a passage are covered. Spans are hashed (in
lower case, white space folded) and joined globally. Of each hash that occurs more than once, the first occurrence, by
document id and place, stays; the sentences of all others go.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import durable

#: Sentences of a span, and the words it needs: half of the 50 that make a passage, so that whole sentences inside one
#: reach them, and more than the notices of a line or two that documents share rightly.
SIZE, MIN_WORDS = 2, 25

SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?![ \t\r\n.!?])[^.!?\n]*)*(?:[.!?]+(?:[ \t\r\n]+|\Z)|\n\s*|\Z)")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text, each with what stands between it and the next; joined they are the text."""
    return [s for s in SENTENCE.findall(text) if s] if text else []


def span_hashes(parts: list[str], size: int, min_words: int, tails: bool = False) -> list[tuple[int, int, int]]:
    """``(hash, first sentence, end)`` of each span."""
    words = [s.lower().split() for s in parts]
    one = np.array([xxhash.xxh64_intdigest(" ".join(w)) for w in words], np.uint64).tobytes()
    lens = list(map(len, words))
    out, j, n = [], 0, 0  # n words stand in sentences i to j
    for i, length in enumerate(lens):
        while j < len(lens) and (j < i + size or n < min_words):
            n += lens[j]
            j += 1
        if j >= i + size and n >= min_words:
            out.append((xxhash.xxh64_intdigest(one[8 * i : 8 * j]) - (1 << 63), i, j))
        n -= length
    if tails:
        begun = {(i, j) for _, i, j in out}
        i, n = 0, 0  # n words stand in sentences i to j
        for j, length in enumerate(lens, 1):
            n += length
            while j - i > size and n - lens[i] >= min_words:
                n -= lens[i]
                i += 1
            if j - i >= size and n >= min_words and (i, j) not in begun:
                out.append((xxhash.xxh64_intdigest(one[8 * i : 8 * j]) - (1 << 63), i, j))
    return out


def _spans(docs: DataFrame, size: int, min_words: int, tails: bool) -> DataFrame:
    """``h, id, key``: the distinct spans of each row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                rows, hashes = [], []
                for row, text in enumerate(part.column(2).to_pylist()):
                    own = {h for h, _, _ in span_hashes(sentences(text), size, min_words, tails)}
                    hashes += own
                    rows += [row] * len(own)
                take = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), part.column(0).take(take), part.column(1).take(take)], ["h", "id", "key"])

    return docs.mapInArrow(run, "h long, id long, key long")


def removed(parts: list[str], gone: set[int], size: int, min_words: int, tails: bool) -> list[int]:
    """Sentences that go: those of spans in ``gone``, and of spans that a text repeats all but the first occurrence."""
    out: set[int] = set()
    had: set[int] = set()
    for h, i, j in sorted(span_hashes(parts, size, min_words, tails), key=lambda x: x[1]):
        if h in gone or h in had:
            out.update(range(i, j))
        had.add(h)
    return sorted(out)


def remove(docs: DataFrame, size: int = SIZE, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", tails: bool = False) -> DataFrame:
    """``doc_id, text, n_sentences, removed array<int>, n_words_removed`` of every row; ``text`` is what stays.

    Null text stays null and has no sentences. Rows that share an id are versions of one document and not compared with
    each other: each loses what documents of smaller ids have, and its own repetitions. Rows with a null id are not compared
    with others. A text is cut in one task, in memory of some ten times its size.
    """
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.octet_length(text), text).alias("key"), text.alias("text"))
    spans = durable(_spans(src.where("id is not null and text is not null"), size, min_words, tails), "spans")
    # Longs alone, so the aggregate hashes and combines before its shuffle; as a table, so that the join can split a hot span.
    firsts = durable(spans.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("h", "first"), "repeated-spans")
    later = spans.join(firsts.hint("merge"), "h").where("id > first")
    gone = later.groupBy("id", "key").agg(F.collect_set("h").alias("gone"))  # of one text

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts, n, out, words = [], [], [], []
            for text, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist()):
                parts = sentences(text)
                lost = removed(parts, set(gone or ()), size, min_words, tails)
                drop = set(lost)
                texts.append(text if not lost else "".join(s for k, s in enumerate(parts) if k not in drop))
                n.append(len(parts))
                out.append(lost)
                words.append(sum(len(parts[k].split()) for k in lost))
            columns = [b.column("id"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(out, pa.list_(pa.int32())), pa.array(words, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_sentences", "removed", "n_words_removed"])

    schema = "doc_id long, text string, n_sentences long, removed array<int>, n_words_removed long"
    return src.join(gone.hint("merge"), ["id", "key"], "left").select("id", "text", "gone").mapInArrow(run, schema)


def digest(cleaned: DataFrame) -> DataFrame:
    """Counts of the rows of :func:`remove`, with a digest of the text that stays."""
    return cleaned.select(
        "doc_id",
        "n_sentences",
        F.size("removed").cast("long").alias("n_removed"),
        "n_words_removed",
        F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )
