from __future__ import annotations

import random
import re

import corpus_pipeline
from quillmatch.llm import near
from tests.conftest import DATA

SCHEMA = "doc_id long, text string"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def firsts(rows):
    """Rows (id, text) that stay, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or len(a & b) / len(a | b) >= 0.8:
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if r not in best or (d is None, d) < (rows[best[r]][0] is None, rows[best[r]][0]):
            best[r] = i
    return {rows[i] for i in best.values()}


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_stage_against_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "one", "One", "two words"]
    for _ in range(40):
        base = words(rng, rng.choice([8, 40, 150, 600]))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(1, 2 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, SCHEMA), DATA)
    want = firsts(rows)
    assert len(want) < len(rows) - 10
    assert {tuple(r) for r in got.collect()} == want


def test_large_group_takes_stars_and_what_stays_apart_is_compared(spark, monkeypatch):
    rng = random.Random(2)
    base, rows = words(rng, 200), []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(1, 12)):
            copy[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    want = firsts(rows)
    for rounds in (0, 1, 3):
        monkeypatch.setattr(near, "STAR_ROUNDS", rounds)
        assert {tuple(r) for r in near.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_null_ids_repeated_ids_and_nothing(spark):
    rng = random.Random(3)
    a, b, c, d = (" ".join(words(rng, 60)) for _ in range(4))
    rows = [(None, a), (None, b), (5, c), (5, d), (7, a + " end")]
    got = {tuple(r) for r in near.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(7, a + " end"), (None, b), (5, c), (5, d)}
    assert near.drop_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shingles_are_told_apart_as_texts_are(monkeypatch):
    rng = random.Random(4)
    texts = ["", "a", "a b", "A  b", "b a", "a a a a a", "a a a a a a", " ".join(words(rng, 5000)), "x" * 70_000 + " y", "é è " * 5]
    monkeypatch.setattr(near, "PART_BYTES", 100)
    cut = [near.shingles(t).tolist() for t in texts]
    monkeypatch.setattr(near, "PART_BYTES", 1 << 16)
    whole = [near.shingles(t).tolist() for t in texts]
    assert cut == whole
    for t, s in zip(texts, whole, strict=True):
        assert len(s) == len(shingle_set(t)), t[:20]
    for i, a in enumerate(texts):
        for j in range(i):
            assert len(set(whole[i]) & set(whole[j])) == len(shingle_set(a) & shingle_set(texts[j]))


def test_bands_find_pairs_at_the_border():
    """Of pairs of similarity 0.8 to 0.84 hardly one shares no band."""
    rng, found, all_ = random.Random(5), 0, 0
    for n in (30, 100, 400):
        for _ in range(400):
            base = words(rng, n)
            copy = list(base)
            for _ in range(max(1, n // 45)):
                copy[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
            a, b = (near.shingles(" ".join(x)) for x in (base, copy))
            both = len(set(a.tolist()) & set(b.tolist()))
            if 0.8 <= both / (len(a) + len(b) - both) < 0.84:
                all_ += 1
                found += bool((near.band_keys(a) == near.band_keys(b)).any())
    assert all_ > 100 and found >= 0.99 * all_
