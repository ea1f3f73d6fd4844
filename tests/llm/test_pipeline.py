"""The pipeline's stages against brute force, one by one and together."""

import hashlib
import random

import corpus_pipeline
from skarn.llm import bpe
from skarn.llm.queries import tokenizer_path
from tests.llm.test_operators import plain_components, plain_hits, prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(rng):
    base = prose(rng, 120)
    out = [(0, base), (1, base), (2, base + " extra"), (3, None), (4, "12 34"), (5, ""), (6, prose(rng, 50) + ' token = "0123456789abcdef0123"'), (7, prose(rng, 40) + " q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11"), (8, "A.")]
    out += [(20 + i, prose(rng, 60)) for i in range(20)]
    return [(d, t, "en" if d % 2 else "fr", "s", len(t or "")) for d, t in out]


def tables(spark, tmp_path):
    data = rows(random.Random(8))
    spark.createDataFrame(data, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return {r[0]: r[1] for r in data}, str(tmp_path)


def test_stages(spark, tmp_path):
    docs, sf = tables(spark, tmp_path)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    step = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, sf)
        if name != "bpe":
            assert df.columns == [c.split()[0] for c in COLUMNS.split(", ")]
            step[name] = {r["doc_id"]: r["text"] for r in df.collect()}
    want = {d: t for d, t in docs.items() if t and any(map(str.isalpha, t))}
    assert step["language_id"] == want
    comp = plain_components(list(want.items()), 5, 80)
    want = {d: t for d, t in want.items() if comp[d][1] == d}
    assert step["near_duplicates"] == want and 1 not in want and 2 not in want
    hit = plain_hits(list(want.items()), [(1, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10")], 10)
    want = {d: t for d, t in want.items() if not hit[d][4]}
    assert step["decontamination"] == want and 7 not in want
    assert step["secret_scan"][6].endswith("[REDACTED]\"") or step["secret_scan"][6].endswith("[REDACTED]")
    assert {d: t for d, t in step["secret_scan"].items() if d != 6} == {d: t for d, t in want.items() if d != 6}

    model = bpe.Bpe.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(want)
    for d, t in step["secret_scan"].items():
        ids = next(bpe.ByteLevelEncoder(model).encode_batch([t])).tolist()
        assert got[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_texts_stay_without_labels(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text", None, "s", 9), (2, None, None, "s", 0), (3, "12 34", None, "s", 5)], COLUMNS)
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()] == [1]


def test_shared_ids_lose_no_text(spark, tmp_path):
    """Against brute force: each text that is kept or has a near-copy that is kept, at the stage and at the end."""
    _, sf = tables(spark, tmp_path)
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    data = [(3, a), (5, a), (5, b), (9, b + " x"), (5, c), (5, c), (1, d), (1, d + " y"), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], COLUMNS)
    want = [(3, a), (5, b), (5, c), (1, min(d, d + " y")), (None, a)]
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()]
    assert {k for k in kept if k[0] != 1} == {k for k in want if k[0] != 1} and len(kept) == len(want)
    assert [t for i, t in kept if i == 1] in ([d], [d + " y"])
    docs.write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    end = sorted(r["decoded_sha256"] for r in corpus_pipeline.run(spark, sf).collect())
    assert end == sorted(hashlib.sha256(t.encode()).hexdigest() for _, t in kept)


def test_shared_ids_and_no_rows(spark, tmp_path):
    _, sf = tables(spark, tmp_path)
    twice = spark.createDataFrame([(1, "b c d e f g", "en", "s", 1), (1, "b c d e f g", "en", "s", 1), (1, "other text of the same id", "en", "s", 1), (None, "no id here at all", "en", "s", 1)], COLUMNS)
    kept = corpus_pipeline.near_duplicates(spark, twice, sf).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("1", "b c d e f g"), ("1", "other text of the same id"), ("None", "no id here at all")]
    df = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, sf)
    assert df.collect() == []
