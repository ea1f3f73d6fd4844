"""BPE, token counts and token-id files against the public libraries and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.llm import bpe, counts, idcodec
from skarn.llm.queries import tokenizer_path

SPECIAL = ["", " ", "  ", "a", " a", "a ", "\n x", "x\n\n  y", "aaaa" * 50, "it's I'LL", "<|endoftext|>", "a<|endoftext|> b<|startoftext|>", "é́ ΑΣ İ", "\x1c \x1d\x85", "日本語 😀", "1234 56", "x" * 20_000, "{" * 500, " a 　b"]


def texts(n=300, seed=1):
    rng = random.Random(seed)
    pool = [chr(c) for c in range(0x250)] + list("日本 語 ΣσςĲﬁ😀́‍ ")
    bits = [" ", "  ", "\n", "the", " and", "'s", "'LL", "12", "<|endoftext|>", ". "]
    return SPECIAL + ["".join(rng.choice(bits + rng.sample(pool, 3)) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_level():
    path = tokenizer_path("byte_bpe_50k.json")
    return bpe.Bpe.from_file(path), pytest.importorskip("tokenizers").Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def word_level():
    path = tokenizer_path("word_bpe_49k.json")
    return bpe.Bpe.from_file(path), pytest.importorskip("tokenizers").Tokenizer.from_file(path)


def test_ids_and_text(byte_level):
    model, lib = byte_level
    all_ = texts()
    got = [x.tolist() for x in bpe.ByteLevelEncoder(model).encode_batch(all_)]
    want = [e.ids for e in lib.encode_batch(all_, add_special_tokens=False)]
    assert [t for t, a, b in zip(all_, got, want) if a != b] == []
    assert [model.decode_ids(x) for x in got] == [lib.decode(x, skip_special_tokens=False) for x in want]


@pytest.mark.parametrize("part", [7, 100, 5000])
def test_parts_may_be_tiny(byte_level, word_level, part):
    all_ = texts(80, seed=5) + ["word " * 3000 + "end", "a" * 9000]
    model, lib = byte_level
    assert [x.tolist() for x in bpe.ByteLevelEncoder(model, part).encode_batch(all_)] == [e.ids for e in lib.encode_batch(all_, add_special_tokens=False)]
    model, lib = word_level
    counter = counts.WordCounter(model, counts.whole_tokens(model), part)
    assert counter.count_batch(all_) == [len(e.ids) for e in lib.encode_batch(all_, add_special_tokens=False)]


@pytest.mark.parametrize("word", ["a" * 30_001, "=" * 30_000, "ab" * 20_000, "aaab" * 10_000, "abcdefgh" * 5000])
def test_long_runs_of_one_word(byte_level, word):
    model, lib = byte_level
    assert next(bpe.ByteLevelEncoder(model).encode_batch([word])).tolist() == lib.encode(word, add_special_tokens=False).ids


def test_words_are_merged_once_and_in_bounded_memory(byte_level, monkeypatch):
    """Words that an earlier part had are not merged again, and room for known words changes no id."""
    import tracemalloc

    model, lib = bpe.Bpe.from_file(tokenizer_path("byte_bpe_50k.json")), byte_level[1]
    merged, merge = [], model.encode_bytes
    monkeypatch.setattr(model, "encode_bytes", lambda data, ends: merged.append(len(ends)) or merge(data, ends))
    enc = bpe.ByteLevelEncoder(model, 200)
    text = "some words, and more words; 12 of them " * 50
    want = lib.encode(text, add_special_tokens=False).ids
    assert next(enc.encode_batch([text])).tolist() == want and sum(merged) < 30
    before = len(merged)
    assert next(enc.encode_batch([text])).tolist() == want and len(merged) == before
    for words, size in ((0, 1 << 20), (3, 1 << 20), (1 << 18, 0), (1 << 18, 9)):
        monkeypatch.setattr(bpe, "KNOWN_WORDS", words)
        monkeypatch.setattr(bpe, "KNOWN_BYTES", size)
        model.known = None
        assert next(enc.encode_batch([text])).tolist() == want
        assert model.known is None or len(model.known[0]) <= words and len(model.known[1]) == model.known[2][-1]
    rng = random.Random(4)
    long = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(1_200_000))
    tracemalloc.start()
    next(bpe.ByteLevelEncoder(byte_level[0]).encode_batch([long]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20, peak


def other_vocabulary(suffix=""):
    """A vocabulary of bytes and ten merges."""
    spec = {"type": "BPE", "end_of_word_suffix": suffix}
    alphabet = bpe.byte_alphabet()
    tokens = alphabet + ([c + suffix for c in alphabet] if suffix else [])
    merges = [f"{a} {b}{suffix}" for a, b in ("he", "in", "re", "on", "at", "er", "an", "nd", "ou", "is")]
    return bpe.Bpe({"model": spec | {"vocab": {t: i for i, t in enumerate(tokens + [m.replace(" ", "") for m in merges])}, "merges": merges}, "added_tokens": []})


def test_two_vocabularies_in_one_session(spark, byte_level, word_level):
    rows = spark.createDataFrame([(1, "the rain in spain is over")], "doc_id long, text string").repartition(1)
    other = other_vocabulary()
    for _ in range(2):
        for model in (byte_level[0], other):
            want = next(bpe.ByteLevelEncoder(model).encode_batch(["the rain in spain is over"])).tolist()
            assert bpe.encode(rows, model).first()["ids"] == want
            assert bpe.decode(bpe.encode(rows, model), model).first()["text"] == "the rain in spain is over"
            assert bpe.round_trip(rows, model).first()["n_tokens"] == len(want)
            assert idcodec.read_ids(idcodec.write_ids(rows, model)).first()["ids"] == want + [2]
        for model in (word_level[0], other_vocabulary("</w>")):
            want = counts.WordCounter(model, counts.whole_tokens(model)).count_batch(["the rain in spain is over"])
            assert [counts.count_tokens(rows, model).first()["n_tokens"]] == want


def test_broken_ids_decode_to_replacements(byte_level):
    model, lib = byte_level
    ids = [220, 145, 233, 50256, 8582]
    assert model.decode_ids(ids) == lib.decode(ids, skip_special_tokens=False)


def test_unordered_merges_are_refused(byte_level):
    alphabet = bpe.byte_alphabet()
    vocab = {c: i for i, c in enumerate(alphabet)} | {"ab": 256, "abc": 257}
    spec = {"model": {"type": "BPE", "vocab": vocab, "merges": ["ab c", "a b"]}, "added_tokens": []}
    with pytest.raises(ValueError):
        bpe.Bpe(spec)


def test_counts(word_level):
    model, lib = word_level
    proven = counts.whole_tokens(model)
    assert all(len(lib.encode(w, add_special_tokens=False).ids) == 1 for w in random.Random(2).sample(sorted(proven), 300))
    all_ = texts(seed=2)
    counter = counts.WordCounter(model, proven)
    assert counter.count_batch(all_) == [len(e.ids) for e in lib.encode_batch(all_, add_special_tokens=False)]
    before = counter.merged
    assert counter.sizes(["the", "and"]).tolist() == [1, 1]
    assert counter.merged == before  # whole tokens are never merged


def docs(spark):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (3, "", "z"), (1, "Hello world", "x"), (None, "no id", None), (5, "a " * 3000, "w")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_encode_decode_frames(spark, byte_level):
    model, _ = byte_level
    rows = bpe.encode(docs(spark), model)
    assert sorted((r["id"] or 0, r["text"][:5]) for r in bpe.decode(rows, model).collect()) == [(0, "no id"), (1, "Hello"), (1, "Hello"), (2, ""), (3, ""), (5, "a a a")]
    got = {r["doc_id"]: r for r in bpe.round_trip(docs(spark), model).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[2]["n_tokens"] == 0 and got[2]["ids_sha256"] == got[2]["decoded_sha256"] == empty
    assert bpe.round_trip(docs(spark).limit(0), model).collect() == []


def test_count_frames(spark, word_level):
    model, _ = word_level
    got = {r["doc_id"]: r for r in counts.count_tokens(docs(spark), model).collect()}
    assert (got[5]["n_bytes"], got[5]["n_tokens"], got[5]["over_limit"]) == (6000, 3000, True)
    assert (got[2]["n_bytes"], got[2]["n_tokens"], got[2]["over_limit"]) == (0, 0, False) and len(got) == 5
    assert counts.count_tokens(docs(spark).limit(0), model).collect() == []


def code(spark, rows, block, reads=False):
    """Each of some arrays or byte strings through the coder, in one query."""
    data = [(k, bytearray(np.asarray(x).astype("<u4").tobytes() if not reads else x)) for k, x in enumerate(rows)]
    f = (idcodec.decoder if reads else idcodec.encoder)(spark, block)
    return [bytes(r["x"]) for r in spark.createDataFrame(data, "k int, x binary").select("k", f(F.col("x")).alias("x")).orderBy("k").collect()]


def heads(coded):
    """Where the blocks of some code begin, and their ids, checksums, bits and bytes."""
    at, out = 0, []
    while at < len(coded):
        out.append((at, *np.frombuffer(coded[at : at + 16], "<u4").tolist()))
        at += 16 + out[-1][4]
    return out


@pytest.mark.parametrize("block", [64, 512, 8192, 32768])
def test_codec_round_trip(spark, block):
    rows = [np.zeros(0)]
    for n in (1, 63, 64, 65, 5000, 20_000):
        rng = np.random.default_rng(n)
        rows += [rng.integers(0, 50257, n), np.minimum(rng.zipf(1.3, n), 50256), np.full(n, 7), np.tile(np.arange(5), n)[:n], rng.integers(0, 2**32 - 1, n), rng.integers(0, 2, n) * 65536 + 65535]
        rows += [np.where(rng.random(n) < 0.9, np.arange(n) % 300, rng.integers(0, 300, n)), np.zeros(n), np.full(n, 2**32 - 2)]
    coded = code(spark, rows, block)
    for x, c in zip(rows, coded):
        assert [h[1] for h in heads(c)] == [min(block, len(x) - i) for i in range(0, len(x), block)]
        assert [h[2] for h in heads(c)] == [zlib.crc32(x[i : i + block].astype("<u4").tobytes()) for i in range(0, len(x), block)]
    assert code(spark, coded, block, reads=True) == [np.asarray(x).astype("<u4").tobytes() for x in rows]


def test_codec_compresses_and_blocks_stand_alone(spark):
    ids = np.tile(np.arange(100), 100)
    (coded,) = code(spark, [ids], 1024)
    assert len(coded) < len(ids) / 2
    at = [h[0] for h in heads(coded)] + [len(coded)]
    assert code(spark, [coded[at[3] : at[4]]], 1024, reads=True) == [ids[3072:4096].astype("<u4").tobytes()]
    skewed = np.minimum(np.random.default_rng(3).geometric(0.3, 8192), 50)
    (coded,) = code(spark, [skewed], 8192)
    p = np.bincount(skewed) / len(skewed)
    assert len(coded) * 8 < 1.1 * len(skewed) * -(p[p > 0] * np.log2(p[p > 0])).sum()  # within a tenth of the entropy


def test_codec_finds_damage(spark):
    ids = np.random.default_rng(0).integers(0, 5000, 2000)
    (coded,) = code(spark, [ids], 1024)
    second = heads(coded)[1][0]
    for where in (second + 4, second + 40, second + 200, len(coded) - 8):
        bad = bytearray(coded)
        bad[where] ^= 1
        with pytest.raises(Exception, match="block 1 is damaged"):
            code(spark, [bytes(bad)], 1024, reads=True)
    for bad in (coded[:-20], coded[: second + 7], coded[:second] + b"\xff" * 16):
        with pytest.raises(Exception, match="head is damaged"):
            code(spark, [bad], 1024, reads=True)
    with pytest.raises(Exception, match="must be below"):
        code(spark, [np.array([2**32 - 1])], 1024)


@pytest.mark.parametrize("frame_ids", [1, 4, 10_000])
def test_token_files(spark, byte_level, frame_ids):
    model, lib = byte_level
    frames = idcodec.write_ids(docs(spark).coalesce(1), model, frame_ids=frame_ids)
    if frame_ids == 1:
        assert frames.count() == 6  # several frames a part
    got = sorted(idcodec.read_ids(frames).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2, 3, 5]
    start = 0
    for r, t in zip(got, ["no id", "Hello world", "Hello world", "", "", "a " * 3000]):
        want = lib.encode(t, add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids"]) == (start, len(want), want)
        start += len(want)
    crc = {r["start"]: r["ids_crc32"] for r in idcodec.read_ids(frames, digest=True).collect()}
    assert crc == {r["start"]: zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got}
    assert idcodec.read_ids(idcodec.write_ids(docs(spark).limit(0), model)).collect() == []


def test_token_files_that_last(spark, byte_level, tmp_path):
    path = f"file://{tmp_path}/ids"
    idcodec.write_ids(docs(spark), byte_level[0], path=path)
    lasting = sorted(tuple(r) for r in idcodec.read_ids(spark.read.parquet(path), digest=True).drop("doc_id").collect())
    assert lasting == sorted(tuple(r) for r in idcodec.read_ids(idcodec.write_ids(docs(spark), byte_level[0]), digest=True).drop("doc_id").collect()) and len(lasting) == 6
