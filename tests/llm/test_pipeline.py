from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillmatch.llm import mixing, near, quality, simhash
from tests.conftest import DATA
from tests.llm.test_near import firsts

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_each_stage_works_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, texts = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, DATA)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        texts[name] = docs
        was = {r.doc_id: r.text for r in before.collect()}
        if name != "bpe_encoding":
            assert docs.columns == columns
            now = {r.doc_id for r in docs.collect()}
            assert now <= set(was)
        if name == "quality_rules":
            want = {i for i, t in was.items() if quality.failing(quality.Text(t), quality.KEEP) is None}
        elif name == "exact_dedup":
            first = {}
            for i, t in sorted(was.items(), key=lambda x: (-len(x[1]), x[0])):
                first.setdefault(t.translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))), i)
            want = set(first.values())
        elif name == "simhash_near_dedup":
            want = {i for i, _ in firsts(list(was.items()))}
        else:
            continue
        assert now == want, name
    mixed, out = texts["source_mixing"].collect(), texts["bpe_encoding"].collect()
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r.doc_id, hashlib.sha256(np.array(lib.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in mixed)
    assert sorted((r.doc_id, r.ids_sha256) for r in out) == want and all(len(r.ids) == r.n_tokens for r in out)
    told = {r.source: r.target for r in mixing.mix(texts["simhash_near_dedup"]).collect()}
    got = {}
    for r in mixed:
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    longest = max(len(r.text.split()) for r in mixed)
    assert all(abs(got[s] - t) <= longest for s, t in told.items())


def test_stages_call_the_operators_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "source_mixing", "bpe_encoding"]


def test_near_dups_are_linked_by_fingerprints_and_by_shingles(spark):
    """Texts 1 and 2 have one fingerprint and few shingles in common; 2 and 3 have shingles in common and fingerprints far apart."""
    tails = [" ".join(f"{x}{i}" for i in range(100)) for x in "pqr"]
    texts = ["a b c " * 600 + tails[0], "a b c " * 600 + tails[1], "a b c a b c a b c " + tails[1], tails[2], None]
    prints = [simhash.simhash(t) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 2 < (prints[1] ^ prints[2]).bit_count()
    rows = [(i + 1, t, "s") for i, t in enumerate(texts)] + [(None, texts[3], "s"), (4, texts[3], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, DATA)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 4, 5] and kept.columns == docs.columns
    assert sorted(r.doc_id for r in near.drop_near_duplicates(docs).collect()) == [1, 2, 4, 4, 5]


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0


def test_stages_take_nulls_repeated_rows_long_texts_and_any_columns(spark, tmp_path):
    words = [f"w{i}" for i in range(70_000)]
    rows = [(None, None, None), (1, "", "s"), (2, " ".join(words), "s"), (2, " ".join(words), "s"), (3, " ".join(words[5:]), None), (None, "a short text", "s"), (None, "a shorter one", "s"), (7, "ab cd ef", "t"), (8, "abcdef", "t")]
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], "doc_id long, text string, source string, _row_hash string, _KEY string, _of string, _copy string")
    want = [{2, 3, None, 7, 8}, {2, 3, None, 7}, {2, None, 7}, None, None]
    for (name, stage), ids in zip(corpus_pipeline.STAGES, want, strict=True):
        was = docs.columns
        docs = stage(spark, docs, DATA)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == was or name == "bpe_encoding"
        if ids is not None:
            assert {r.doc_id for r in docs.select("doc_id").collect()} == ids, name
        if name == "simhash_near_dedup":
            assert docs.count() == 4
