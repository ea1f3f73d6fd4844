"""Secrets, chat, language ID, span dedup, near-duplicates, search, decontamination: small cases and brute force."""

import hashlib
import pickle
import random
import re
import subprocess
import sys
import time
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.llm import chat, common, components, decontam, langid, neardup, secrets, spans, topk
from skarn.llm import superminhash as smh

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


# --- secrets ---


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def test_base_spans_are_leftmost_and_whole():
    rng = random.Random(4)
    bits = ["password", "SECRET", "token", "api_key", "apikey", "ſecret", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJKLMN", "0123456789abcdef", "short", "abcdefghijkl", "\n", "é", "+", "."]
    for _ in range(400):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert [s[:3] for s in secrets.find_spans(t) if s[1] < 3] == plain_spans(t)


@pytest.mark.parametrize(
    "text,found",
    [
        ("db_password = 'hunter2-hunter2'", ["hunter2-hunter2"]),
        ("KEY = 'a8Zk29-LLq-77'\nAPI_KEY = KEY", ["a8Zk29-LLq-77"]),
        ("A = 'a8Zk29-LLq-77'\nB = A\nclient_secret: B\n", ["a8Zk29-LLq-77"]),
        ("password = 'changeme'", []),
        ("title = 'a8Zk29-LLq-77'", []),
        ("secret = ${SECRET_VALUE}", []),
        ("loop_secret = x\nx = loop_secret", []),
        ('{"auth_token": "Zx81-Qw73-Pl29"}', ["Zx81-Qw73-Pl29"]),
    ],
)
def test_literals_follow_names(text, found):
    assert [text[i:j] for i, j, _ in secrets.literal_spans(text)] == found


@pytest.mark.parametrize(
    "text,found",
    [
        ('{"password":\n  "hunter2-hunter2"}', ["hunter2-hunter2"]),
        ('SECRET = (\n    "a8Zk29-LLq-77"  # note\n    "b8Zk29-LLq-77"\n)\n', ["a8Zk29-LLq-77", "b8Zk29-LLq-77"]),
        ('SECRETS = [\n  "a8Zk29-LLq-77",\n  "b8Zk29-LLq-77",\n]\n', ["a8Zk29-LLq-77", "b8Zk29-LLq-77"]),
        ('SECRET = \\\n    "hunter2-hunter2"', ["hunter2-hunter2"]),
        ('SECRET = "a8Zk29-LLq-77" + \\\n    "b8Zk29-LLq-77"', ["a8Zk29-LLq-77", "b8Zk29-LLq-77"]),
        ("password: |\n  hunter2-hunter2\nuser: bob", ["hunter2-hunter2"]),
        ("- password: >-\n    hunter2-hunter2\n  user: Zx81-Qw73-Pl29", ["hunter2-hunter2"]),
        ("password:\n  hunter2-hunter2\n", ["hunter2-hunter2"]),
        ("secrets:\n- a8Zk29-LLq-77\n- b8Zk29-LLq-77\n", ["a8Zk29-LLq-77", "b8Zk29-LLq-77"]),
        ("password:\nuser_Zx81-Qw73: bob", []),
        ('SECRET = """hunter2-hunter2"""', ["hunter2-hunter2"]),
        ("SECRET = '''\nhunter2-hunter2\n'''\nx = 1", ["hunter2-hunter2"]),
        ("const token = `\n  Zx81-Qw73-Pl29\n`;", ["Zx81-Qw73-Pl29"]),
        ('SECRET = b"hunter2-hunter2"', ["hunter2-hunter2"]),
        ('password: str = "hunter2-hunter2"', ["hunter2-hunter2"]),
        ('password: dict[str, str] | None = "hunter2-hunter2"', ["hunter2-hunter2"]),
        ('const token: string = "Zx81-Qw73-Pl29";', ["Zx81-Qw73-Pl29"]),
        ('token?: string | undefined = "Zx81-Qw73-Pl29";', ["Zx81-Qw73-Pl29"]),
        ("const API_KEY: &'static str = \"Zx81-Qw73-Pl29\";", ["Zx81-Qw73-Pl29"]),
        ('def f(password: str = "hunter2-hunter2", n: int = 3):', ["hunter2-hunter2"]),
        ('A: str = (\n  "a8Zk29-LLq-77")\nclient_secret = [A]', ["a8Zk29-LLq-77"]),
        ('if token: title = "a8Zk29-LLq-77"', []),
        ('else: password = "hunter2-hunter2"', ["hunter2-hunter2"]),
        ('name: str = "a8Zk29-LLq-77"\ndef f(token: str): pass', []),
        ('doc = """\npassword = "hunter2-hunter2"\n"""', ["hunter2-hunter2"]),
    ],
)
def test_literals_on_later_lines_and_behind_types(text, found):
    assert [text[i:j] for i, j, _ in sorted(secrets.literal_spans(text))] == found


@pytest.mark.parametrize(
    "text,found",
    [
        ("DB_PASSWORD=Xy7kq9LmP2!vR4tZ", ["Xy7kq9LmP2!vR4tZ"]),
        ("password: p@ssw0rd-2024", ["p@ssw0rd-2024"]),
        ("password: p@ssw0rd-2024 # note", ["p@ssw0rd-2024"]),
        ("password = !p@ssw0rd-2024\nuser = x", ["!p@ssw0rd-2024"]),
        ("password=+p@ssw0rd-2024", ["+p@ssw0rd-2024"]),
        ("password=Pass(word)99-2024", ["Pass(word)99-2024"]),
        ("{password: p@ssw0rd-2024, user: bob}", ["p@ssw0rd-2024"]),
        ("{password: p@ssw0rd-2024}", ["p@ssw0rd-2024"]),
        ("connect(password=p@ssw0rd-2024)", ["p@ssw0rd-2024"]),
        ("host=db;password=p@ssw0rd-2024;user=Zx81-Qw73-Pl29", ["p@ssw0rd-2024"]),
        ("<b>token = Zx81-Qw73~Pl29</b><p>", ["Zx81-Qw73~Pl29"]),
        ("url=https://h/?token=Zx81-Qw73~Pl29&x=1", ["Zx81-Qw73~Pl29"]),
        ('api_key = os.environ["API_KEY_2024x"]', []),
        ("password = getpass.getpass(prompt, Zx81)", []),
        ("password = cfg->get_password2", []),
        ("password = $DATABASE_PASSWORD2", []),
        ("A = 'a8Zk29-LLq-77'\nclient_secret: A, other: b", ["a8Zk29-LLq-77"]),
    ],
)
def test_unquoted_values_are_whole(text, found):
    assert [text[i:j] for i, j, _ in sorted(secrets.literal_spans(text))] == found


def test_unquoted_values_are_redacted_whole(spark):
    df = spark.createDataFrame([(1, "DB_PASSWORD=Xy7kq9LmP2!vR4tZ\nA=1")], "doc_id long, text string")
    assert secrets.redact(df).first()["text"] == "DB_PASSWORD=[REDACTED]\nA=1"


def test_open_values_cost_no_more_than_the_text():
    began = time.perf_counter()
    for t in ("a = (\n" * 50_000, "token: (\n" * 50_000, "a: b [ " * 50_000, 'a = """\n' * 50_000, "token:\n- x\n" * 50_000, "a = [" + '"b",\n' * 50_000, "a=b" * 50_000, "a=(" * 50_000, "token:x(" * 50_000, "token=b" * 50_000):
        secrets.find_spans(t)
    assert time.perf_counter() - began < 30


def test_keys_within_long_values_are_read_whole():
    """Beyond 1024 characters as well as below, at a cost that follows the text."""
    for n in (3, 40, 2000):
        text = "a=b!" + "token=ab1!" * n
        want = [(text.index("=", 10 * k + 4) + 1, len(text)) for k in range(n)]
        got = {x[:2]: x[2] for x in secrets.literal_spans(text)}
        assert sorted(got) == [(i, j) for i, j in want if secrets.literal_score(text[i:j]) * 0.9 >= secrets.LITERAL_SCORE]
        assert all(abs(s - 0.9 * secrets.literal_score(text[i:j])) < 1e-9 for (i, j), s in got.items())
        brackets = "password=" + "token=Zq8!(" * n + "b" * 30 + ")" * (n + 5)
        second = brackets.index("=", brackets.index("=", 9) + 1) + 1
        assert n < 40 or {(9, len(brackets) - 5), (second, len(brackets) - 6)} <= {x[:2] for x in secrets.literal_spans(brackets)}
    began = time.perf_counter()
    for t in ("token=ab1!" * 50_000, "key=)a1]" * 30_000, "k:-b" * 50_000, "k=f(b=" * 50_000, "k=$(" * 50_000, "a:b!" * 50_000):
        secrets.find_spans(t)
    assert time.perf_counter() - began < 40


def test_long_chains_and_escapes_cost_no_more_than_the_text():
    began = time.perf_counter()
    chain = "token_0 = 'a8Zk29-LLq-77'\n" + "".join(f"token_{k} = token_{k - 1}\n" for k in range(1, 20_000))
    assert [chain[i:j] for i, j, _ in secrets.literal_spans(chain)] == ["a8Zk29-LLq-77"]
    for t in ("a=1" + '\\"' * 200_000, "a=1" + "\\'" * 200_000, "a=" + "\\\\" * 200_000, 'token = "' + '\\"' * 200_000):
        secrets.find_spans(t)
    assert time.perf_counter() - began < 20


def test_secret_frames(spark):
    rows = [(1, "token = abcdefghijklmnop é", "a"), (2, None, "b"), (3, "", "c"), (1, "token = abcdefghijklmnop é", "a"), (None, "deadbeefdeadbeef01", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = secrets.digest(secrets.scan(df)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 5 and (by[1]["n_assign"], by[1]["spans"].split(",")[0]) == (1, "assign:0:24")
    assert by[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and by[2]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert clean == {1: "[REDACTED] é", 2: None, 3: "", None: "[REDACTED]"}
    assert secrets.scan(df.limit(0)).collect() == []


# --- chat ---


def test_chat_collapses_snapshots(spark):
    rows = [
        (1, 0, "user", "hi", 0), (1, 1, "assistant", "yo", 0),
        (2, 0, "user", "hi", 0), (2, 1, "assistant", "yo", 0), (2, 2, "user", "bye", 0),
        (3, 5, "user", "hi", 0), (3, 6, "assistant", "yo", 0), (3, 9, "user", "bye", 0),
        (4, 0, "user", "other", 0), (5, None, None, None, 0), (None, 0, "user", "hi", 0), (6, 0, "user", "hi", 0), (6, 0, "user", "hi", 0),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    got = {r["conv_id"]: (r["n_turns"], r["chat"]) for r in chat.render(df).collect()}
    assert set(got) == {2, 4, 5, 6}
    assert got[2] == (3, "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n<|user|>\nbye<|end|>\n")
    assert got[5] == (1, "<|unknown|>\n<|end|>\n") and got[6][0] == 2
    assert chat.render(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op5_chat", "op8_near_dup", "op9_topk", "op10_decontaminate"])
def test_sql(spark, name):
    from skarn.llm.queries import ORACLE_SQL, QUERIES
    from tests.compare import difference, duck

    sf = "/root/testdata/sf0.001"
    assert difference(QUERIES[name](spark, sf), duck(sf), ORACLE_SQL[name]) == ""


# --- language ID ---


def test_codewords_differ_in_many_bits():
    for n in (2, 4, 6, 9, 30):
        c = langid.codewords(n)
        assert min(int((c[i] != c[j]).sum()) for i, j in combinations(range(n), 2)) >= (1 if n == 2 else c.shape[1] // 5)


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit(d.where(~held))
    got = langid.predict(d.where(held), model).join(d.where("n_chars > 40"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    odd = spark.createDataFrame([(1, None, "x"), (2, "123 ...", "y"), (3, "", "z"), (4, "the and " * 20_000, "w")], "doc_id long, text string, lang_pred string")
    by = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert [by[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and by[1]["score"] == 0 and by[1]["ambiguous"] and 0 <= by[4]["score"] <= 1
    assert {r["doc_id"] for r in langid.accepted(odd, model).collect()} == {4}
    assert langid.held_out("7") == bool(spark.sql("select crc32(cast('7' as binary)) % 4 = 2").first()[0])


def test_language_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(empty)
    got = langid.predict(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string"), model).first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)


def test_many_labels(spark):
    """300 labels, of which each has words of its own; and no more than a bounded number of them."""
    rng = random.Random(4)
    rows = [(k, " ".join(f"{chr(97 + lang % 26)}{chr(97 + lang // 26)}{rng.choice('aeiou')}" * 3 for _ in range(20)), f"l{lang:03}") for k in range(3000) for lang in [k % 300]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("most", F.lit("clash"))
    model = langid.fit(docs)
    assert model.languages == [f"l{k:03}" for k in range(300)]
    got = langid.predict(docs, model).join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.9
    assert langid.fit(docs.where("lang < 'l009' or doc_id < 1000"), sample=36).languages == [f"l{k:03}" for k in range(9)]


def plain_codes(texts, labels, seed_texts):
    """Error-correcting output codes in plain steps: ridge regression of each bit over n-gram counts, loss-weighted decoding."""
    names = sorted(set(labels))
    codes = langid.codewords(len(names))

    def grams(t):
        row = [0.0] * langid.DIMS
        x = [c + 32 if 65 <= c <= 90 else c for c in (" " + t.lower() + " ").encode()]
        for i, c in enumerate(x):
            row[(c * 0x165667B1 % 2**32) >> 20] += 1
            if i + 1 < len(x):
                two = (c * 0x9E3779B1 + x[i + 1] * 0x85EBCA6B) % 2**32
                row[two >> 20] += 1
            if i + 2 < len(x):
                row[((two * 0xC2B2AE35 + x[i + 2] * 0x27D4EB2F) % 2**32) >> 20] += 1
        row = [v**0.5 for v in row]
        norm = sum(v * v for v in row) ** 0.5
        return [v / norm for v in row] + [1.0]

    x = np.array([grams(t) for t in texts])
    n = [labels.count(c) for c in names]
    w = np.array([len(texts) / (len(names) * n[names.index(c)]) for c in labels])
    y = np.array([codes[names.index(c)] for c in labels])
    weights = np.linalg.solve(x.T @ (x * w[:, None]) + 0.05 * np.eye(x.shape[1]), x.T @ (y * w[:, None]))  # the primal form
    margin = x @ weights
    trust = np.clip(2 * (margin * y > 0).mean(0) - 1, 0.05, 1)
    weights *= 2 / np.abs(margin).mean()
    out = []
    for t in seed_texts:
        m = np.array(grams(t)) @ weights
        loss = [sum(b * np.exp(-min(8, max(-8, v * c))) for v, c, b in zip(m, code, trust)) for code in codes]
        share = [np.exp(-6 * v / trust.sum()) for v in loss]
        out.append((names[int(np.argmax(share))], max(share) / sum(share)))
    return out


def test_predictions_are_those_of_plain_steps(spark, tmp_path):
    """The registered query against the classifier in plain steps over the same sample."""
    from skarn.llm.queries import QUERIES

    rng = random.Random(13)
    words = {"en": "the of and to in that is was", "de": "der die und in den von zu das", "fr": "le de un être et à il avoir"}
    rows = [(k, " ".join(rng.choice(words[c].split()) for _ in range(rng.randint(3, 30))).title(), c) for k in range(150) for c in [rng.choice("en en de fr".split())]]
    rows += [(200, None, "en"), (201, "12 34", "de"), (202, "", None), (203, "the of and", None), (203, "the of and", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    learn = [(t, c) for k, t, c in rows if t is not None and c is not None and not langid.held_out(str(k))]
    got = {r["doc_id"]: r for r in QUERIES["op6_language"](spark, str(tmp_path)).collect()}
    texts = [(k, t) for k, t, _ in rows if t and any(map(str.isalpha, t))]
    for (k, _), (lang, score) in zip(texts, plain_codes([t for t, _ in learn], [c for _, c in learn], [t for _, t in texts])):
        assert (got[k]["lang_pred"], got[k]["held_out"]) == (lang, langid.held_out(str(k))) and abs(got[k]["score"] - score) < 1e-4
    assert [(got[k]["lang_pred"], got[k]["score"]) for k in (200, 201, 202)] == [("und", 0.0)] * 3


# --- span dedup ---


def test_sentences_are_the_text():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(["a", "b c", ".", "!", "?", "\n", " ", "...", "3.5", "\r\n", "é"]) for _ in range(rng.randint(0, 30)))
        assert "".join(spans.sentences(t)) == t
    assert spans.sentences("One two. Three 3.5 four!\nFive") == ["One two. ", "Three 3.5 four!\n", "Five"]


def plain_removed(rows, size, least):
    gone, keys = {k: set() for k, _ in rows}, {}
    for k, t in rows:
        parts = [tuple(s.lower().split()) for s in spans.sentences(t)]
        for i in range(len(parts)):
            for j in range(i + size, len(parts) + 1):
                if sum(map(len, parts[i:j])) >= least:
                    keys.setdefault(tuple(parts[i:j]), []).append((k, i, j))
                    break
    for places in keys.values():
        for k, i, j in sorted(places)[1:]:
            gone[k] |= set(range(i, j))
    return gone


@pytest.mark.parametrize("least", [10, spans.MIN_WORDS])
def test_repeated_spans_go(spark, least):
    rng = random.Random(3)
    passages = [". ".join(prose(rng, 9) for _ in range(6)) + ". " for _ in range(3)]
    rows = []
    for k in range(60):
        body = [prose(rng, rng.choice([1, 2, 8, 25])) + ". " for _ in range(rng.randint(0, 6))] + ["No. ", "Yes. "] * (k % 3)
        if k % 2:
            body.insert(rng.randint(0, len(body)), rng.choice(passages))
        rows.append((k, "".join(body)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("places", F.lit(1))
    gone = plain_removed(rows, 2, least)
    got = {r["doc_id"]: r for r in spans.remove(df, min_words=least).collect()}
    assert {k: set(r["removed"]) for k, r in got.items()} == gone and any(gone.values())
    for k, t in rows:
        assert got[k]["text"] == "".join(s for i, s in enumerate(spans.sentences(t)) if i not in gone[k])


def test_tails_of_repeated_passages_go(spark, tmp_path):
    """The registered query against brute force over the runs that begin and end at each sentence."""
    from skarn.llm.queries import QUERIES

    rng = random.Random(7)
    passage = ". ".join(prose(rng, 9) for _ in range(4)) + ". Yes it is. So it was. "
    rows = [(k, prose(rng, 12) + ". " + passage + prose(rng, 12) + f". {k}.") for k in range(6)] + [(9, "")]
    rows += [(10 + k, "".join(rng.choice(["No. ", "Go on. ", passage, prose(rng, 11) + ". "]) for _ in range(6))) for k in range(20)]
    least = spans.MIN_WORDS
    gone, keys = plain_removed(rows, 2, least), {}
    for d, t in rows:
        parts = [tuple(s.lower().split()) for s in spans.sentences(t)]
        words = lambda i, j: sum(map(len, parts[i:j]))  # noqa: B023, E731
        runs = {(i, j) for j in range(len(parts) + 1) for i in [max((i for i in range(j - 1) if words(i, j) >= least), default=None)] if i is not None}
        runs |= {(i, j) for i in range(len(parts)) for j in [min((j for j in range(i + 2, len(parts) + 1) if words(i, j) >= least), default=None)] if j}
        for i, j in runs:
            keys.setdefault(tuple(parts[i:j]), []).append((d, i, j))
    more = {d: set(g) for d, g in gone.items()}
    for places in keys.values():
        for d, i, j in sorted(places)[1:]:
            more[d] |= set(range(i, j))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["removed"] for r in QUERIES["op7_span_dedup"](spark, str(tmp_path)).collect()}
    assert got == {d: ",".join(map(str, sorted(g))) for d, g in more.items()}
    assert more[1] == {1, 2, 3, 4, 5, 6} and gone[1] != more[1]


def test_span_edges(spark):
    same = "One two three four five. Six seven eight nine ten. "
    df = spark.createDataFrame([(1, same), (1, same), (None, same), (2, None), (3, ""), (4, same + same)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_sentences"], list(r["removed"])) for r in spans.remove(df, min_words=10).collect())
    assert got == [(0, 2, []), (1, 2, []), (1, 2, []), (2, 0, []), (3, 0, []), (4, 4, [0, 1, 2, 3])]
    assert spans.remove(df.limit(0)).collect() == []


# --- near-duplicates ---


def plain_components(rows, k, percent):
    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = {d: shingles(t) for d, t in rows}
    up = components.UnionFind()
    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            up.join(a, b)
    return {d: (len(s), up.find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_CLASSES", 7)  # so that families are cut into blocks
    rng = random.Random(k)
    rows = [(0, None), (1, ""), (2, " \t"), (3, "One"), (4, "one"), (5, "É x"), (6, "é x")]
    base = [prose(rng, 80).split() for _ in range(6)]
    for d in range(10, 130):
        w = list(rng.choice(base)) if d % 3 else prose(rng, rng.randint(1, 90)).split()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((d, " ".join(w).upper() if d % 7 == 0 else " ".join(w)))
    want = plain_components(rows, k, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit("x"))
    got = {r["doc_id"]: r for r in neardup.group(df, k=k).collect()}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())
    assert len({c for _, c in want.values()}) < len(rows) - 20


def test_near_duplicate_edges(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in neardup.group(df, k=2).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert neardup.group(df.limit(0)).collect() == []


def test_rows_that_share_an_id_are_documents_by_themselves(spark):
    rng = random.Random(11)
    a, b, c = (prose(rng, 60) for _ in range(3))
    near = lambda t: t + " more"
    rows = [(3, a), (5, a), (5, b), (9, b), (9, near(b)), (-4, c), (-4, near(a)), (5, ""), (7, None), (7, c), (2**62, near(c)), (-(2**63), "lone words here now one")]
    got = sorted((r["doc_id"], r["key"], r["component_id"]) for r in neardup.group(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect())
    keys = {r["text"]: r["k"] for r in spark.createDataFrame(rows, "doc_id long, text string").select("text", neardup.text_key(F.col("text")).alias("k")).collect()}
    best = {a: -4, near(a): -4, b: 5, near(b): 5, c: -4, near(c): -4}
    assert got == sorted((d, keys[t], best.get(t, d)) for d, t in rows)


def test_smallest_ids_of_nodes(spark):
    ids = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901]
    df = spark.createDataFrame([(i, bytearray(b"0123456789abcdef")) for i in ids], "id long, d binary").withColumn("node", neardup.node_of(F.col("id"), F.col("d")))
    assert [r["id"] for r in df.orderBy("node").collect()] == sorted(ids)
    assert df.where(neardup.id_of(F.col("node")) != F.col("id")).count() == 0 and df.where("length(node) <> 16").count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 300).astype(np.uint64)
        n = int(rng.integers(0, 300))
        a, b = np.unique(x), np.unique(np.concatenate([x[:n], rng.integers(0, 2**63, 300 - n).astype(np.uint64)]))
        sig = smh.signatures([a, b])
        errors.append((sig[0] == sig[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_signature_is_that_of_the_definition():
    """Level by level over all elements, without stopping early."""
    x = np.random.default_rng(1).integers(0, 2**63, 20).astype(np.uint64)
    want = np.full(smh.M, 2**32 - 1, np.uint64)
    for e in x:
        p = list(range(smh.M))
        for j in range(smh.M):
            r = int(smh.mix(np.array([e], np.uint64) + np.uint64((0x632BE59BD9B4E019 * (j + 1)) % 2**64))[0])
            k = j + (r >> 32) % (smh.M - j)
            p[j], p[k] = p[k], p[j]
            want[p[j]] = min(want[p[j]], (r & (2**25 - 1)) | j << 25)
    assert (smh.signatures([np.sort(x)])[0] == want).all()


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    up = components.UnionFind()
    for a, b in edges:
        up.join(a, b)
    want = {x: up.find(x) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {r["node"]: r["component"] for r in components.components(df, "a", "b").collect()} == want
    assert components.components(df.limit(0), "a", "b").collect() == []


# --- search ---


def plain_topk(rows, queries, k):
    out = set()
    for q, v in queries:
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(s)}
    return out


def test_search(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "PACK", 16)
    monkeypatch.setattr(topk, "CHUNK", 3)
    rng = np.random.default_rng(3)
    vecs = [(i, [float(x) for x in rng.normal(0, 0.3, 6).round(1)]) for i in range(150)]
    vecs += [(200, vecs[0][1]), (201, vecs[0][1]), (300, [1.0, 2.0]), (350, [0.5, 1.0])]
    bad = [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6), (404, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vecs + bad], "vec_id long, embedding array<double>, pack int").repartition(3)
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vecs]
    got = topk.search(df, df.where("vec_id % 50 = 0")).collect()
    assert {tuple(r) for r in got} == plain_topk(whole, [q for q in whole if q[0] % 50 == 0], 5)
    assert topk.search(df.limit(0), df.limit(0)).collect() == []


def test_blocks_are_skipped():
    rng = np.random.default_rng(1)
    centers = rng.integers(-200, 200, (20, 16))
    x = np.concatenate([c + rng.integers(-3, 3, (topk.BLOCK, 16)) for c in centers])
    x = x[topk.bisect_order(x, topk.BLOCK)]
    pack = topk.Pack(np.arange(len(x)).tobytes(), topk.narrow(x).tobytes(), 16)
    best, _, scored = pack.search(np.array([-1]), centers[:1], np.array([-(2**62)]), 5)
    assert scored < 10 and best[0][0].tolist() == sorted((x @ centers[0]).tolist(), reverse=True)[:5]


def test_large_products_stay_exact():
    a = np.array([[2**30, -(2**30)]])
    assert topk.product(a, a).tolist() == [[2**61]]
    assert topk.product(np.array([[2**40, 3]]), np.array([[2**22, -7], [0, 1]])).tolist() == [[2**62 - 21, 3]]
    assert topk.product(np.array([[2**40]]), np.array([[2**40], [-(2**40)]]), clip=True).tolist() == [[2**63 - 1, -(2**63)]]
    with pytest.raises(OverflowError):
        topk.product(np.array([[2**40]]), np.array([[2**40]]))


def test_large_components_take_part(spark):
    rng = random.Random(2)
    vecs = [(0, [1.0, 0.0]), (1, [1e14, 0.0]), (2, [2.0, 0.0]), (3, [-1e14, 5.0]), (50, [0.25, -3.0]), (4, [0.0, 3e13])]
    vecs += [(10 + k, [rng.uniform(-1, 1) * 10 ** rng.randint(0, 14), rng.uniform(-9, 9)]) for k in range(30)]
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vecs]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    got = topk.search(df, df.where("vec_id % 50 = 0")).collect()
    assert {tuple(r) for r in got} == plain_topk(whole, [q for q in whole if q[0] % 50 == 0], 5)
    for v, q in (([1e300], [1.0]), ([1e16], [1e16])):
        df = spark.createDataFrame([(1, v), (50, q)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="beyond 64 bits"):
            topk.search(df, df.where("vec_id = 50")).collect()


def test_long_vectors(spark):
    rng = np.random.default_rng(8)
    vecs = [(i, rng.normal(0, 1, 20_000).tolist()) for i in range(12)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    whole = [(i, [int(x) for x in np.floor(256 * np.array(v))]) for i, v in vecs]
    assert {tuple(r) for r in topk.search(df, df.where("vec_id = 0")).collect()} == plain_topk(whole, whole[:1], 5)


# --- decontamination ---


def plain_hits(docs, items, size):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = {}
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            found.setdefault(tuple(w[k : k + n]), set()).update([] if i is None else [str(i)])
    out = {}
    for d, t in docs:
        w = words(t)
        hit, names = set(), set()
        for key, ids in found.items():
            for k in range(len(w) - len(key) + 1):
                if tuple(w[k : k + len(key)]) == key:
                    hit |= set(range(k, k + len(key)))
                    names |= ids
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("pass_windows,piece", [(1 << 20, 4096), (20, 3)])
def test_contamination(spark, monkeypatch, pass_windows, piece):
    monkeypatch.setattr(decontam, "PIECE", piece)
    rng = random.Random(6)
    items = [(i, prose(rng, rng.choice([3, 10, 25]))) for i in range(12)] + [(50, None), (51, ""), (52, "!!"), (53, "Ünï çode"), (3, "alpha1"), (None, "beta2 no id")]
    docs = [(0, None), (1, ""), (2, "x ÜNï--çode y"), (3, "?"), (4, "a BETA2 no-id b")]
    for d in range(10, 60):
        w = prose(rng, rng.randint(0, 60)).split()
        if d % 2:
            part = rng.choice(items[:12])[1].upper().split()
            w[len(w) // 2 : len(w) // 2] = part[rng.randint(0, 2) :]
        docs.append((d, ", ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit(1)).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.digest(decontam.find(df, bench, pass_windows=pass_windows)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got} == plain_hits(docs, items, 10)


def test_proximity_and_empty(spark):
    item = "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10"
    docs = spark.createDataFrame([(1, item.replace("e5", "x e5")), (2, item.replace("e5 ", "")), (3, "z " * 5000 + item), (4, item), (4, item), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.find(docs, bench).collect()}
    assert list(got[1]["near_items"]) == ["7"] and list(got[1]["items"]) == [] and list(got[2]["near_items"]) == []
    assert [list(x) for x in got[3]["hits"]] == [[5000, 5010]] and list(got[4]["items"]) == ["7"]
    assert decontam.find(docs.limit(0), bench).collect() == []
    assert all(not r["hits"] for r in decontam.find(docs, bench.limit(0)).collect())


def test_broadcast_is_within_its_bound():
    words = np.random.default_rng(0).integers(0, 2**63, 50_009).astype(np.uint64)
    query = decontam.Query([(f"item {k}", words[i : i + 109].tobytes()) for k, i in enumerate(range(0, 50_000, 100))], 10)
    query.order(np.zeros(len(query.terms), np.int64))
    assert len(query.lens) == 50_000 and len(pickle.dumps(query)) < 85 * 50_000


def test_long_texts_of_words():
    """Hashes in parts are those of the whole; 50 MB take less than 1 GB."""
    rng = np.random.default_rng(1)
    buf = np.frombuffer(rng.choice(np.frombuffer(b"abcXYZ09 .\n", np.uint8), 400_000).tobytes(), np.uint8)
    ends = np.sort(np.append(rng.integers(0, len(buf), 40), [0, 0, len(buf), len(buf)]))
    for kind in (common.ALNUM, common.NOT_SPACE):
        want = common._hash_part(buf, ends, kind)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(common, "CHUNK_BYTES", 5000)
            got = common.hash_words(buf, ends, kind)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    code = "import resource, pyarrow as pa, sys; sys.path.insert(0, '.'); from skarn.llm import common, superminhash, langid; t = 'some words of 1 text, ' * 2_300_000;"
    code += "c = pa.array([t], pa.large_string()); [None for _, buf, ends in common.text_chunks(c) for _ in [common.hash_words(buf, ends, common.ALNUM)]];"
    code += "[len(s) for _, s in superminhash.shingle_sets(c, 5)]; langid.features([t]); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], timeout=300)
    assert int(out.stdout.split()[-1]) < 1_000_000, out.stderr


def test_whole_index_gives_the_same(spark):
    docs = spark.createDataFrame([(1, "a b c a"), (2, "b")], "doc_id long, text string").coalesce(1)
    row = decontam.build_index(docs).first()
    assert (list(row["doc_ids"]), list(row["n_words"]), list(row["first"])) == ([1, 2], [4, 1], [0, 4 + decontam.GAP])
    assert sorted(np.frombuffer(row["counts"], np.uint32).tolist()) == [1, 2, 2]


# --- very long texts ---


def test_one_very_long_text_among_short_ones(spark):
    """4 MB of text, through each operator on documents."""
    from skarn.llm import bpe, counts, idcodec
    from skarn.llm.queries import tokenizer_path

    rng = random.Random(21)
    item = "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10"
    body = ". ".join(prose(rng, 12) for _ in range(40_000))
    long_ = f"{body}. {item}. password = 'hunter2-hunter2'"
    short = prose(rng, 30) + ". " + item
    docs = spark.createDataFrame([(1, short, "en"), (2, long_, "en"), (3, long_, "en"), (4, None, None)], "doc_id long, text string, lang string").repartition(2)
    model = bpe.Bpe.from_file(tokenizer_path("byte_bpe_50k.json"))
    trip = {r["doc_id"]: r for r in bpe.round_trip(docs, model).collect()}
    assert trip[2]["decoded_sha256"] == hashlib.sha256(long_.encode()).hexdigest() and trip[2]["ids_sha256"] == trip[3]["ids_sha256"]
    ids = {r["doc_id"]: r["n_tokens"] for r in idcodec.read_ids(idcodec.write_ids(docs, model), digest=True).collect()}
    assert ids == {d: r["n_tokens"] + 1 for d, r in trip.items()}
    n = {r["doc_id"]: r["n_bytes"] for r in counts.count_tokens(docs, bpe.Bpe.from_file(tokenizer_path("word_bpe_49k.json"))).collect()}
    assert n == {1: len(short), 2: len(long_), 3: len(long_), 4: 0}
    spans_ = {r["doc_id"]: [long_[s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "literal"] for r in secrets.scan(docs.where("doc_id > 1")).collect()}
    assert spans_ == {2: ["hunter2-hunter2"], 3: ["hunter2-hunter2"], 4: []}
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.fit(docs)).collect()} == {1: "en", 2: "en", 3: "en", 4: "und"}
    gone = {r["doc_id"]: (r["n_sentences"], len(r["removed"])) for r in spans.remove(docs, tails=True).collect()}
    assert gone[2] == (40_002, 0) and gone[3] == (40_002, 40_002) and gone[4] == (0, 0)
    assert {r["doc_id"]: r["component_id"] for r in neardup.group(docs).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    hits = {r["doc_id"]: [list(h) for h in r["hits"]] for r in decontam.find(docs, bench).collect()}
    assert hits == {1: [[30, 40]], 2: [[480_000, 480_010]], 3: [[480_000, 480_010]], 4: []}
