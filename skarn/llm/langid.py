"""Language identification with error-correcting output codes (operator 6).

Each language gets a binary codeword; for each bit a linear classifier over hashed byte n-grams (orders 1 to 3 of
the lower-cased whole text) separates the languages with 1 from those with 0. A text's margins are decoded to the
language whose codeword has the least weighted loss, each bit weighted by its accuracy on the training rows. Two
codewords at nearly the same loss flag the text as ambiguous.

The classifiers are fitted on a bounded sample: at most about ``per_language`` labelled rows of each language and
``sample`` in all, those with the smallest hashes of their ids; everything else runs over all rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import LOWER

DIMS = 4096
PER_LANGUAGE = 250
#: Rows of the sample; of more labels than a quarter of it the most frequent ones are learned. It bounds what the driver solves.
SAMPLE = 4096
AMBIGUOUS = 0.55
#: Bytes of a text that are counted at a time.
SLICE = 1 << 20
UNKNOWN = "und"


def features(texts: list[str | None]) -> np.ndarray:
    """Square roots of hashed n-gram counts, scaled to length 1; a row a text, whose length takes no memory beyond its copy."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for k, t in enumerate(texts):
        if not t:
            continue
        raw = np.frombuffer(b" " + t.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)
        row = np.zeros(DIMS, np.int64)
        for i in range(0, len(raw), SLICE):  # with the two bytes behind it
            x = LOWER[raw[i : i + SLICE + 2]].astype(np.uint32)
            two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA6B)
            three = two[:-1] * np.uint32(0xC2B2AE35) + x[2:] * np.uint32(0x27D4EB2F)
            grams = np.concatenate([x[:SLICE] * np.uint32(0x165667B1), two[:SLICE], three[:SLICE]])
            row += np.bincount(grams >> np.uint32(20), minlength=DIMS)
        row = np.sqrt(row)
        out[k] = row / np.linalg.norm(row)
    return out


def codewords(n: int) -> np.ndarray:
    """(n, bits) of -1 and 1: the exhaustive code up to 6 languages, beyond that the best of some random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        bits = 2 ** (n - 1) - 1
        rows = [[1] * bits] + [[-1 if (b >> (n - 2 - k)) & 1 == 0 else 1 for b in range(bits)] for k in range(n - 1)]
        return np.array(rows, float)
    rng, best, gap = np.random.default_rng(7), None, -1
    bits = max(15, int(np.ceil(10 * np.log2(n))))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        if (np.abs(code.sum(0)) == n).any():
            continue
        near = (bits - (code @ code.T - 2 * bits * np.eye(n)).max()) / 2
        if near > gap:
            best, gap = code, near
    return best


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray  # (DIMS + 1, bits)
    trust: np.ndarray  # of each bit, from its accuracy in training

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language (of equal ones the first by name), score (0 to 1) and whether it is ambiguous."""
        n = len(texts)
        readable = np.array(list(map(has_letter, texts)), bool)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        margin = features(texts) @ self.weights[:-1] + self.weights[-1]
        loss = np.exp(-np.clip(margin[:, None, :] * self.codes[None], -8, 8)) @ self.trust
        share = np.exp(-6.0 * loss / self.trust.sum())
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        score = np.where(readable, share[np.arange(n), best], 0.0)
        lang = [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, readable)]
        return lang, score, (score < AMBIGUOUS) | ~readable


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model:
    """Fit on at most about ``per_language`` rows a language and ``sample`` in all of ``docs`` (text and label not null).

    Of more than ``sample / 4`` labels the most frequent ones are learned, by name where counts are equal.
    """
    rows = docs.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max(1, sample // 4)).collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((DIMS + 1, 1)), np.ones(1))
    # Rows below a hash limit: about as many of each, chosen by hash alone and the same at any partitioning.
    most = min(per_language, sample // len(languages))
    limits = [(r["lang"], min(-(2**63) + int(min(1.0, most / r["count"]) * (2**64 - 1)), 2**63 - 1)) for r in counts]
    limits = docs.sparkSession.createDataFrame(limits, "lang string, most long")  # sample / 4 rows at most
    chosen = rows.join(F.broadcast(limits), "lang").where("h <= most")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            f = features(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in f], pa.binary())], ["lang", "f"])

    got = chosen.select("lang", "text").mapInArrow(run, "lang string, f binary").collect()  # about ``sample`` rows
    got = sorted((r["lang"], bytes(r["f"])) for r in got)
    lang = np.searchsorted(languages, [g[0] for g in got])
    x = np.array([np.frombuffer(g[1], np.float32) for g in got], np.float64)
    codes = codewords(len(languages))
    y = codes[lang]
    if not len(x):  # no row of the sample
        return Model([], np.ones((0, 1)), np.zeros((DIMS + 1, 1)), np.ones(1))
    share = np.bincount(lang, minlength=len(languages)).astype(float)
    w = np.sqrt(len(lang) / (len(languages) * share[lang]))[:, None]  # languages count alike
    xa = np.hstack([x, np.ones((len(x), 1))]) * w
    dual = np.linalg.solve(xa @ xa.T + 0.05 * np.eye(len(x)), y * w)
    weights = xa.T @ dual
    right = ((x @ weights[:-1] + weights[-1]) * y > 0).mean(0)
    # The margins are scaled so that a typical training margin is 2: the loss then tells sure bits from unsure ones.
    weights *= 2.0 / np.abs(x @ weights[:-1] + weights[-1]).mean()
    return Model(languages, codes, weights, np.clip(2 * right - 1, 0.05, 1.0))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for every whole text; ``und`` where it is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages and DIMS

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                lang, score, vague = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(vague, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language; only null texts and texts without a letter go,
    whether any label was learned or not."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = part.column(at).to_pylist()
                if shared.value.languages:
                    keep = [x != UNKNOWN for x in shared.value.predict(texts)[0]]
                else:
                    keep = list(map(has_letter, texts))
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_text: str) -> bool:
    """Whether a row is kept out of learning."""
    return zlib.crc32(id_text.encode()) % 4 == 2
