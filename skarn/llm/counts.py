"""Token counts with a whole-token shortcut (operator 2), for vocabularies of lower-cased words with word ends.

Before the job, each vocabulary string is encoded alone; those that come out as one token are proven
whole tokens. A pre-token that is one of them counts 1 without merging; only the rest is merged, by
the pair occurrence index of :mod:`skarn.llm.bpe`.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.bpe import Bpe, text_buffer

#: Fixed value: the pre-token pattern of the public vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: ASCII white space.
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True

#: Bytes of text that are counted together.
PART = 8 << 20


def whole_tokens(model: Bpe) -> frozenset[str]:
    """Vocabulary strings that, as a pre-token, are exactly one token; bounded by the vocabulary."""
    texts = []
    for i, t in enumerate(model.text_of):
        if t.endswith(model.suffix) and t not in model.added:
            try:
                texts.append(model.bytes_of[i].decode("utf-8"))
            except UnicodeDecodeError:
                pass  # part of a character: never a whole pre-token
    texts = sorted({t for t in texts if t})
    _, at = model.encode_words([t.encode() for t in texts])
    return frozenset(t for t, n in zip(texts, (at[1:] - at[:-1]).tolist()) if n == 1)


class WordCounter:
    """Counts of tokens of texts; distinct chunks between white space are counted once a part."""

    def __init__(self, model: Bpe, proven: frozenset[str], part: int = PART):
        self.model, self.proven, self.part = model, proven, part
        self.pattern = regex.compile(WORD_PATTERN)
        self.space = regex.compile(r"\s+")
        self.merged = 0  # pre-tokens that needed merging

    @staticmethod
    def normal(chunk: str) -> str:
        """NFC, then lower case character by character (no final sigma)."""
        return unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()

    def pre_tokens(self, chunk: str) -> tuple[list[str], int]:
        """Pre-tokens of a chunk that may hold special tokens and white space beyond ASCII, and the number of the former."""
        special = self.model.special
        parts = special.split(chunk) if special and special.search(chunk) else [chunk]
        return [w for p in parts for c in self.space.split(p) for w in self.pattern.findall(self.normal(c))], len(parts) - 1

    def sizes(self, chunks: list[str]) -> np.ndarray:
        """Tokens of each chunk."""
        out = np.ones(len(chunks), np.int64)
        rest: list[bytes] = []
        which, ends = [], []
        proven = self.proven
        for k, c in enumerate(chunks):
            if c.isascii() and c.isalpha():
                words, whole = [c.lower()], 0
            else:
                words, whole = self.pre_tokens(c)
            start = len(rest)
            for w in words:
                if w in proven:
                    whole += 1
                else:
                    rest.append(w.encode("utf-8", "surrogatepass"))
            out[k] = whole
            if len(rest) > start:
                which.append(k)
                ends.append(len(rest))
        if rest:
            at = self.model.encode_words(rest)[1]
            out[which] += np.diff(at[np.array([0, *ends])])
            self.merged += len(rest)
        return out

    def _part(self, buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens before each of the ``ends``, at which chunks end."""
        import pyarrow as pa

        word = ~_SPACE[buf]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = ends[ends < len(buf)]
        first[inner] = word[inner]
        starts = np.flatnonzero(first)
        # A chunk is stored with the white space behind it: pieces then cover the buffer without a gap.
        if not len(starts):
            return np.zeros(len(ends), np.int64)
        offsets = np.append(starts, len(buf))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf)]).dictionary_encode()
        sizes = self.sizes([x.decode("utf-8", "surrogatepass").strip(" \t\n\r\x0b\x0c") for x in pieces.dictionary.to_pylist()])
        upto = np.concatenate([[0], np.cumsum(sizes[pieces.indices.to_numpy()])])
        return upto[np.searchsorted(starts, ends)]

    def count(self, buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of texts that lie one after another in ``buf`` (UTF-8) up to ``ends``."""
        texts, ends = ends, ends[np.diff(ends, prepend=0) > 0]
        upto = [np.zeros(1, np.int64)]
        at = n = 0
        while at < len(buf):
            stop, size = len(buf), self.part
            while at + size < len(buf):  # a part ends at white space or a text's end
                i, j = np.searchsorted(ends, [at, at + size], side="right")
                space = np.flatnonzero(_SPACE[buf[at + 1 : at + size]])[-1:] + 1
                if j > i or len(space):
                    stop = max([*ends[i:j][-1:].tolist(), *(at + space).tolist()])
                    break
                size *= 2
            i, j = np.searchsorted(ends, [at, stop], side="right")
            inside = np.append(ends[i:j] - at, stop - at)
            before = self._part(buf[at:stop], inside) + n
            upto.append(before[:-1])
            n = int(before[-1])
            at = stop
        return np.diff(np.concatenate(upto)[np.searchsorted(ends, texts, side="right")], prepend=0)

    def count_batch(self, texts: list[str | None]) -> list[int]:
        import pyarrow as pa

        return self.count(*text_buffer(pa.array(texts, pa.large_string()))).tolist()


def count_tokens(docs: DataFrame, model: Bpe, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every whole text.

    Null text counts as empty: no bytes, no tokens. Repeated rows stay; other columns are ignored. Texts of any length
    are counted in parts of ``PART`` bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, whole_tokens(model)))  # bounded by the vocabulary

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        counter = WordCounter(*shared.value)
        for b in batches:
            n = counter.count(*text_buffer(b.column(1)))
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
