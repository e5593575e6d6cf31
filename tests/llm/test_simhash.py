from __future__ import annotations

import re

import xxhash

from quillmatch.llm import simhash
from quillmatch.llm.common import Scratch
from quillmatch.llm.components import connected_components, more_linked
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, fp string, component_id long"


def fingerprint(text):
    """Bit by bit, from the definition."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Smallest id reachable, by comparing all pairs."""
    distinct = sorted(set(prints.values()))
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for i in sorted(prints):
        low.setdefault(find(prints[i]), i)
    return {i: low[find(p)] for i, p in prints.items()}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    prints = {i: fingerprint(t) for i, t in docs.items()}
    want = classes(prints)
    got = simhash.op1_simhash(spark, DATA).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{prints[i]:016x}", want[i]) for i in docs}
    assert len(got) == len(docs)


def test_edge_cases(spark):
    texts = [None, "", " \n\t", "One", "one two", "ONE TWO", "É a b c", "x " * 70_000]
    for t in texts:
        assert simhash.simhash(t) == signed(fingerprint(t))
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(5, "ONE TWO", "clash", 9)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.component_id for r in got}
    assert by[0] == by[1] == by[2] == 0 and by[4] == by[5] == 4
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_links_find_every_pair_within_two_bits(spark):
    base = 0x0123456789ABCDEF
    prints = [base, base ^ 1, base ^ 3, base ^ 7, base ^ (1 << 63), base ^ (5 << 40), base ^ 0xFF00]
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = connected_components(simhash.links(frame), Scratch(spark)).collect()
    roots = {r.node: r.root for r in found}
    want = classes(dict(enumerate(prints)))
    group = {i: roots.get(signed(p), signed(p)) for i, p in enumerate(prints)}
    assert all((want[i] == want[j]) == (group[i] == group[j]) for i in group for j in group)


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, i) for i in range(1001, 1400)]
    for small in (0, 10_000):
        got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain + star + [(5, 5)], "u long, v long"), Scratch(spark), small=small).collect()}
        assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(1000, 1400)} == {1000}
    first = Scratch(spark).keep(connected_components(spark.createDataFrame(chain[:20] + star, "u long, v long"), Scratch(spark)), "first")
    more = {r.node: r.root for r in more_linked(first, spark.createDataFrame([*chain[20:], (1005, 60), (7, 3)], "u long, v long"), Scratch(spark), "more").collect()}
    assert set(more) == {*range(61), *range(1000, 1400)} and set(more.values()) == {0}
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark)).count() == 0


def test_one_document_of_a_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(3000))
    rows = [(3, text, "", 0), (1, text + " end", "", 0), (2, "other words here", "", 0), (None, None, "", 0)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "component_id"]
    assert {r.doc_id for r in kept.collect()} == {1, 2, None}


def test_null_and_repeated_ids_do_not_join_groups(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(300)) for w in "ab")
    for rows in ([(None, one, "", 0), (None, two, "", 0)], [(1, one, "", 0), (1, two, "", 0)]):
        kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
        assert {r.text for r in kept.collect()} == {one, two}
