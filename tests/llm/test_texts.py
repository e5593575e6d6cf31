"""Token counts, encoding, secrets and quality rules against the libraries and plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from math import log2

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmatch.llm import bpe, quality, secrets, tokens
from tests.conftest import DATA

ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one Two\nthree"), (4, "one Two\nthree"), (5, "ab" * 40_000), (None, "null id")]
SCHEMA = "doc_id long, text string, n_tokens string, kept string, spans string"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], SCHEMA)


def strings(seed, n=3000):
    r = random.Random(seed)
    return ["".join(r.choice("aAbBéÉΣσİ' \n\t!?sdre1290日本▁  \0</s><s>🙂́") for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_bpe_agrees_with_the_library_and_round_trips():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.WordBPE(path)
    texts = [*strings(1), "", "a<|endoftext|>B <|startoftext|>", "aaaa" * 500, "!" * 999, "Straße ǅ", "Ᲊx ՘"]
    for text, e, (ids, said) in zip(texts, lib.encode_batch(texts, add_special_tokens=False), own.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, text
        assert said.decode() == lib.decode(e.ids, skip_special_tokens=False) == own.decode(e.ids).decode()


def test_bpe_cache_may_be_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 5)
    monkeypatch.setattr(bpe, "GROUP_BYTES", 10)
    test_bpe_agrees_with_the_library_and_round_trips()


def test_bpe_query_against_the_library(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want = {}
    for i, e in zip(docs, lib.encode_batch(list(docs.values()), add_special_tokens=False), strict=True):
        said = lib.decode(e.ids, skip_special_tokens=False)
        want[i] = (len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op9_bpe(spark, DATA).collect()} == want


def test_bpe_edge_cases(spark):
    got = bpe.encoded(frame(spark), keep=("spans",), ids=True).collect()
    assert len(got) == len(ROWS) and [r.n_tokens for r in got if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert all(len(r.ids) == r.n_tokens and r.spans == "clash" for r in got)
    assert bpe.encoded(frame(spark, [])).count() == 0


def test_counts_agree_with_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), tokens.Counts(path)
    texts = [*strings(2), "", " ", "  ", "\n", " \n", "\n\n", "▁", "a" * 3000, " " * 100]
    table = tokens.Lengths({w: n for w, n in zip([b"a", b"", b"\nb"], own.lengths([b"a", b"", b"\nb"]), strict=True)})
    assert list(own.count([t.encode() for t in texts], table)) == [len(lib.encode(t)) for t in texts]


def test_compact_table_has_what_was_put_in():
    words = {f"w{i}".encode(): i % 500 for i in range(3000)} | {b"": 1}
    table = tokens.Lengths(words)
    assert all(table.get(w) == n for w, n in words.items()) and table.get(b"none") is None
    assert tokens.Lengths({}).get(b"x") is None


def test_count_query_against_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want = {i: (len(t.encode()), n := len(lib.encode(t)), n > 4096) for i, t in docs.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.op8_tokens(spark, DATA).collect()} == want


def test_frequencies_are_those_of_all_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = Counter(w for r in docs.collect() for w in tokens.pre_tokens((r.text or "").encode()) if len(w) <= tokens.LONGEST)
    for most in (tokens.COUNTED, 50):
        assert {bytes(r.word): r.n for r in tokens.frequencies(docs, counted=most).collect()} == want
    path = public_tokenizers.path("piece_bpe_32k.model")
    table = tokens.frequent_lengths(docs, "text", path, most=40)
    least = sorted(want.values(), reverse=True)[40]
    first = [w for w, n in want.items() if n > least]
    assert 30 < len(first) <= 40 and [table.get(w) for w in first] == tokens.Counts(path).lengths(first) and len(table.counts) == len(first)


def test_count_edge_cases(spark):
    got = tokens.token_counts(frame(spark)).collect()
    assert len(got) == len(ROWS) and [r.n_tokens for r in got if r.doc_id in (1, 2)] == [0, 0]
    assert tokens.token_counts(frame(spark, [])).count() == 0


# --- secrets --------------------------------------------------------------------------------------------------------------


def plain_base(text):
    out = []
    for kind, pattern, ok in (
        (0, re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        (1, re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        (2, re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if ok(m)]
    return sorted(out)


def test_base_spans_against_plain_patterns():
    r = random.Random(3)
    parts = ["password", "PassWD", "secret", "token", "api_key", "ApiKey", ":", "=", " ", "'", '"', "abcdef", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "x", "é", "\n", "ſecret", "toKen"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        assert secrets.base_spans(t) == plain_base(t), t


def test_sliding_entropy_against_counting_anew():
    r = random.Random(4)
    for _ in range(200):
        s = "".join(r.choice("ab1" if r.random() < 0.5 else "abcdefghijkl0123456789") for _ in range(r.randint(20, 60)))
        for i, h in enumerate(secrets.windows(s)):
            w = s[i : i + 20]
            assert abs(h + sum(w.count(c) / 20 * log2(w.count(c) / 20) for c in set(w))) < 1e-9


def plain_entropy(text, base):
    """Added spans by trying every window of every run of a class anew."""

    def entropy(w):
        return -sum(w.count(c) / len(w) * log2(w.count(c) / len(w)) for c in set(w))

    def random_run(s, least):
        windows = [s[i : i + 20] for i in range(len(s) - 19)]
        return any(map(str.isdigit, s)) and any(map(str.isalpha, s)) and any(entropy(w) >= least - 1e-9 for w in windows)

    def listed(s):
        uuid = re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s)
        return uuid or any(x in s.lower() for x in ("example", "placeholder", "changeme", "dummy", "xxxx", "1234567890", "abcdefgh"))

    def of(a, b, kind):
        pattern, least = ((r"[0-9A-Za-z+/_-]{20,}={0,2}", 3.7), (r"[0-9A-Za-z]{20,}", 3.6), (r"[0-9A-Fa-f]{20,}", 3.0))[kind]
        for m in re.finditer(pattern, text[a:b]):
            x, y = a + m.start(), a + m.end()
            if random_run(text[x:y], least) and not listed(text[x:y]):
                yield x, y
            elif kind < 2:
                yield from of(x, y, kind + 1)

    covered = {i for x, _, y in base for i in range(x, y)}
    touching = {i for x, _, y in base for i in range(x, y + 1)}
    for a, b in of(0, len(text), 0):
        if not (set(range(a, b)) <= covered | (touching & {i for i in range(a, b) if i in covered or (i in touching and i - 1 in covered and i in covered)})):
            yield a, 3, b


def test_all_spans_against_trying_every_window():
    r = random.Random(7)
    parts = ["password=", "KEY=", "deadBEEF09" * 3, "AKIA", "ABCDEFGH12345678", "/", "-", "==", " ", "example", "é", "\n", "0f" * 13, "123e4567-e89b-12d3-a456-426614174000"]
    for _ in range(1500):
        t = "".join(r.choice(parts) if r.random() < 0.5 else "".join(r.choices("abcdefXYZ0123456789+/", k=r.randint(1, 30))) for _ in range(r.randint(1, 9)))
        base = plain_base(t)
        assert secrets.scan(t)[1] == sorted(base + list(plain_entropy(t, base))), t


def test_all_spans_of_the_table_against_trying_every_window(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in secrets.op7_secrets(spark, DATA).collect():
        base = plain_base(docs[r.doc_id])
        assert r.spans == secrets.told(base + list(plain_entropy(docs[r.doc_id], base)))


def test_each_class_is_judged_by_its_own_entropy():
    key = "".join(random.Random(1).choices("0123456789ABCDEF", k=40))
    assert secrets.scan(f"KEY={key}")[1] == [(4, 3, 44)]
    assert secrets.scan("/example/path/" + (s := "kR9xQ2vT7mZ4pL8wB3nYc"))[1] == [(14, 3, 14 + len(s))]


def test_many_spans_take_no_more_time_each():
    import time

    text = " ".join(f"{i:024x}" for i in range(100_000)) + " " + "-" * 100_000 + "1a" + " ab1" * 10
    began = time.perf_counter()
    assert len(secrets.scan(text)[0]) == 100_000
    assert time.perf_counter() - began < 30


def test_entropy_adds_secrets_and_leaves_look_alikes():
    assert [k for _, k, _ in secrets.scan("key kR9xQ2vT7mZ4pL8wB3nY here")[1]] == [3]
    for text in ("123e4567-e89b-12d3-a456-426614174000", "path/to/some/longer/folder/name", "2024-01-02-03-04-05-06-07-08", "AbExample1234567890abcdefgh", "zzzzzzzzzzzzzzzzzzzzzzzzz1"):
        assert secrets.scan(text)[1] == [], text
    assert secrets.masked("a token=abcdef b") == "a [SECRET] b"


def test_secret_edge_cases(spark):
    rows = [*ROWS, (9, "x " * 60_000 + "token=abcdefg")]
    got = {r.doc_id: r for r in secrets.secrets(frame(spark, rows)).collect()}
    assert got[1].spans == got[2].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[9].spans == "assign:120000:120013" and got[9].n_assign == 1
    assert secrets.secrets(frame(spark, [])).count() == 0


def test_secret_query_against_plain_patterns(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in secrets.op7_secrets(spark, DATA).collect():
        base = plain_base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(secrets.told(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in base) for x in range(3)]


# --- quality --------------------------------------------------------------------------------------------------------------


def test_order_of_rules_follows_rejection_per_cost_and_changes_no_verdict(spark):
    slow = quality.Rule("slow", lambda t: sum(range(20_000)) < 0)
    cascade = quality.Cascade([slow, *quality.RULES], rows=4, step=2)
    for i in range(10):
        assert cascade.failing(quality.Text("%%% a b " * 40)) == "symbols"
        assert cascade.order[0].name == "symbols" and cascade.order[-1].name == "slow"
    assert cascade.sampled == 4
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    a = {(r.doc_id, r.kept) for r in quality.judged(docs).collect()}
    assert a == {(r.doc_id, r.kept) for r in quality.judged(docs, rules=quality.RULES[::-1], sample_rows=1).collect()}
    assert {i for i, k in a if k} == {r.doc_id for r in quality.keep_good(docs).collect()}


def test_no_rule_is_tried_after_a_rejection():
    tried = []

    def rule(name, verdict):
        return quality.Rule(name, lambda t: tried.append(name) or verdict)

    cascade = quality.Cascade([rule("a", False), rule("b", True), rule("c", True)], rows=0)
    assert cascade.failing(quality.Text("x")) == "b" and tried == ["a", "b"]
    text = quality.Text("some words here")
    assert not quality.RULES[1].rejects(text) and "n_repeat_words" not in text._found


def test_each_rule_of_the_cascade_rejects_something():
    prose = " ".join(f"word{i}" for i in range(60))
    assert quality.failing(quality.Text(prose), quality.KEEP) is None and quality.failing(quality.Text("Short."), quality.KEEP) is None
    bad = {
        "empty": " \n",
        "repeated": "one two three " * 30,
        "symbols": prose + " |" * 20,
        "exclaims": prose + "!" * 20,
        "broken": prose + "\ufffd" * 20,
        "lines": "\n".join(["a b"] * 9 + [f"x{i} y{i}" for i in range(3)]),
        "bullets": "\n".join(f" - point{i} of{i}" for i in range(20)),
        "teasers": "\n".join(f"news{i} of{i} ..." for i in range(20)),
        "letters": " ".join(str(i) for i in range(60)),
        "one_word": " ".join(f"la w{i}" for i in range(60)),
    }
    by = {r.name: r for r in quality.KEEP}
    assert set(by) == set(bad) and all(by[n].rejects(quality.Text(t)) for n, t in bad.items())


def test_clean_labelled_documents_stay_in_the_pipeline(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(labels, "doc_id")
    kept = quality.keep_good(docs, rules=quality.KEEP)
    assert kept.where("quality = 1").count() == docs.where("quality = 1").count()
    assert kept.where("quality = 0").count() <= 0.1 * docs.where("quality = 0").count()


def test_labelled_documents(spark):
    """Documents labelled good are kept, but for short or repeated ones, which the base rejects; most labelled bad go."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    told = quality.judged(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id")
    good, bad = told.where("quality = 1 and not base_failed"), told.where("quality = 0")
    assert good.where("not kept").count() == 0
    assert bad.where("not kept").count() >= 0.9 * bad.count()


def test_quality_edge_cases(spark):
    rows = [*ROWS, (8, " ".join(f"w{i}" for i in range(50)))]
    got = {r.doc_id: r for r in quality.judged(frame(spark, rows)).collect()}
    assert got[1].n_words == got[2].n_words == 0 and got[1].base_failed and not got[1].kept and got[8].kept
    assert quality.judged(frame(spark, [])).count() == 0
    assert quality.keep_good(frame(spark, rows)).select(F.sum("doc_id")).first()[0] == 8
