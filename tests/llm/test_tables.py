"""Deduplication, mixing, line, url and archive operators on edge cases and against plain versions."""

from __future__ import annotations

import gzip
import io
import random
import re
import zlib
from collections import Counter
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from quillmatch.llm import exact, lines, mixing, urls, warc
from quillmatch.llm.common import Bloom, Scratch
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, source string, kept string, size string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") if len(r) == 3 else (*r, "s", "clash", "clash") for r in rows], SCHEMA)


# --- exact ----------------------------------------------------------------------------------------------------------------


def test_exact_edge_cases(spark):
    rows = [(1, "a b"), (2, "a  b"), (3, "ab"), (4, None), (5, ""), (6, " "), (7, "x"), (7, "x"), (None, "q"), (8, "q")]
    index = exact.DigestIndex(spark, "digests_edge")
    for got in (exact.deduplicate(frame(spark, rows), index, "one").collect(), exact.deduplicate_table(frame(spark, rows)).collect(), exact.deduplicate_table(frame(spark, rows), parts=5).collect()):
        by = Counter()
        for r in {(r.doc_id, r._row_hash): r for r in got}.values():
            by[r.doc_id] += r.kept
        assert by == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1, 7: 1, None: 0, 8: 1}
        assert {r.keep_id for r in got if r.doc_id in (1, 2, 3)} == {2} and {r.group_size for r in got if r.doc_id == 7} == {2}
        assert len(got) == len(rows) and {r.group_size for r in got if r.doc_id in (4, 5, 6)} == {3}
    assert index.unseen(spark.createDataFrame([("none",)], "text_sha256 string")).count() == 1
    assert exact.deduplicate(frame(spark, []), index, "two").count() == 0 and exact.deduplicate_table(frame(spark, [])).count() == 0
    index.drop()


def test_index_outlives_its_table_and_takes_new_texts_only(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first = exact.DigestIndex(spark, "digests_a", path, 4)
    assert exact.deduplicate(frame(spark, [(1, "a"), (2, "b")]), first, "a").where("kept").count() == 2
    first.drop()
    again = exact.DigestIndex(spark, "digests_b", path, 4)
    got = {r.doc_id: (r.kept, r.keep_id) for r in exact.deduplicate(frame(spark, [(3, "a"), (4, "c"), (5, "c")]), again, "b").collect()}
    assert got == {3: (False, 1), 4: (True, 4), 5: (False, 4)}
    assert spark.table("digests_b").count() == 3
    plan = again.unseen(spark.createDataFrame([("x",)], "text_sha256 string"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    again.drop()


def test_the_same_batch_again_loses_nothing(spark):
    index = exact.DigestIndex(spark, "digests_again", id_type="STRING")
    docs = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x ")], "doc_id string, text string")
    for batch in ("one", "one", "two", "one"):
        got = {r.doc_id for r in exact.deduplicate(docs, index, batch).where("kept").collect()}
        assert got == (set() if batch == "two" else {"b", "c"})
    assert index.table().count() == 2
    index.drop()


def test_a_table_comes_in_parts_and_the_index_drops_what_it_has(spark):
    r = random.Random(9)
    rows = [(i, " " * r.randint(0, 5) + r.choice("abcdefgh") * r.randint(1, 3)) for i in range(300)] + [(i, str(i)) for i in range(300, 400)]
    index = exact.DigestIndex(spark, "digests_parts")
    for _ in range(2):
        got = exact.deduplicate_table(frame(spark, rows), index=index, parts=3).collect()
        groups = {}
        for i, t in rows:
            groups.setdefault(t.strip(), []).append((-len(t), i))
        assert {(x.doc_id, x.keep_id, x.group_size, x.kept) for x in got} == {(i, min(groups[t.strip()])[1], len(groups[t.strip()]), min(groups[t.strip()])[1] == i) for i, t in rows}
    sizes = {x.batch: x["count"] for x in index.table().groupBy("batch").count().collect()}
    assert sum(sizes.values()) == len(groups) and len(sizes) > 1
    assert exact.deduplicate(frame(spark, rows), index, "later").where("kept").count() == 0
    index.drop()


def test_rows_that_stay_are_whole_and_single(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "ab c"), (3, None), (3, None), (9, "z")]
    kept = exact.drop_exact_duplicates(frame(spark, rows).withColumn("_Row_Hash", F.lit("clash")))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b c"), (3, None), (9, "z")]
    assert kept.columns == [*frame(spark, []).columns, "_Row_Hash"] and {r["_Row_Hash"] for r in kept.collect()} == {"clash"}


def test_a_bloom_filter_has_no_false_negative_and_few_false_positives(spark):
    few, many = spark.range(5000).select(F.xxhash64("id").alias("h")), spark.range(5000, 105_000).select(F.xxhash64("id").alias("h"))
    bloom = Bloom(few, 5000, Scratch(spark))
    assert bloom.blocks > 500
    assert bloom.passed(few, few["h"]).count() == 5000 and bloom.passed(few, few["h"], outside=True).count() == 0
    wrong = bloom.passed(many, many["h"]).count()
    assert wrong < 8000 and bloom.passed(many, many["h"], outside=True).count() == 100_000 - wrong


# --- mixing ---------------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Water filling by repeated sharing."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, full, out = share * sum(sizes.values()), set(), {}
    while True:
        free = [s for s in order if s not in full]
        if not free:
            return out
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_repeated_sharing(spark, seed):
    r = random.Random(seed)
    sizes = {s: r.choice([0, 1, 10, 1000, 50_000]) for s in ["a", "b", "B", "é", None][: r.randint(1, 5)]}
    totals = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_docs long")
    got = {x.source: x.target for x in mixing.targets(totals).collect()}
    assert got == {s: pytest.approx(t) for s, t in plain_targets(sizes).items()}


def test_mix_edge_cases(spark):
    rows = [(i, "w " * (1 + i % 7), "hot") for i in range(400)] + [(1000, None, None), (1001, "", None), (1002, "a b", None), (1003, "a b c", "z"), (1003, "a b c", "z")]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    whole = mixing.mixed(docs.withColumn("_ROW", F.lit("clash")))
    assert whole.columns == [*docs.columns, "_ROW"]
    words = sum(len(r.text.split()) for r in whole.where("source = 'hot'").collect())
    assert abs(words - next(r.target for r in got if r.source == "hot")) <= 7
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mixed(frame(spark, [])).count() == 0


def test_heavier_documents_come_sooner(spark):
    docs = frame(spark, [(i, "word " * 10, "s") for i in range(3000)])
    w = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)
    got = mixing.mix(docs, weight=w, share=0.5).collect()
    even = sum(r.taken for r in got if r.doc_id % 2 == 0)
    assert even > 2 * sum(r.taken for r in got if r.doc_id % 2)


@pytest.mark.parametrize("share", [0.5, 1.5, 1.99])
def test_the_mix_against_sorting_each_source(spark, share):
    r = random.Random(share)
    rows = [(r.choice([None, i, 7]), r.choice(["a b c", f"w{i} " * r.randint(0, 9), "# 1 2"]), r.choice(["s", "s", "t", None])) for i in range(500)]
    docs = frame(spark, rows)
    keys = docs.select("doc_id", "text", "source", *(c.alias(f"k_{n}") for n, c in mixing.keyed(docs, "doc_id", "text", "source").items())).collect()
    told = mixing.mix(docs, share=share).collect()
    plan = {x.source: x for x in told}
    want, whole = Counter(), Counter()
    for s, x in plan.items():
        left = int(x.target - x.epochs * x.source_size + 0.5)
        for k in sorted((k for k in keys if k.source == s), key=lambda k: (k.k_key, k.doc_id is not None, k.doc_id or 0, k.k__row_hash, k.k_size)):
            part = max(0, min(k.k_size, left))
            want[(k.doc_id, k.k__row_hash, s, x.epochs * k.k_size + part)] += 1
            whole[(k.doc_id, k.text, s)] += x.epochs + (k.k_size > 0 and 2 * left >= k.k_size)
            left -= k.k_size
    assert Counter((x.doc_id, x._row_hash, x.source, x.taken) for x in told) == want
    assert Counter((x.doc_id, x.text, x.source) for x in mixing.mixed(docs, share=share).collect()) == +whole


def test_ranges_of_keys_are_filled_evenly_without_ids_and_with_any_weights(spark):
    docs = frame(spark, [(None, f"w{i} " * 3 + "#" * (i % 5), "s") for i in range(4000)])
    rows = docs.select(*(c.alias(n) for n, c in mixing.keyed(docs, "doc_id", "text", "source").items()))
    plan = mixing.ranges(rows)
    at = rows.crossJoin(plan).select(F.floor(64 * mixing.below(F.col("key"), F.col("levels")) / 4000).alias("b")).groupBy("b").count().collect()
    assert len(at) == 64 and max(x["count"] for x in at) < 110


def test_rows_repeated_whole_are_dealt_out_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 10)
    docs = frame(spark, [(None, "a b", "s")] * 95 + [(1, "c", "s")])
    got = mixing.mix(docs, share=0.5).collect()
    assert len(got) == 96 and sum(x.taken for x in got) == round(191 * 0.5)
    assert abs(mixing.mixed(docs, share=0.5).select(F.sum(F.when(F.col("text") == "c", 1).otherwise(2))).first()[0] - 95.5) <= 1.5


# --- lines ----------------------------------------------------------------------------------------------------------------


def plain_lines(docs, k=3):
    """Removed lines of each text, one window after the other."""
    first, out = {}, {i: set() for i in docs}
    for i in sorted(docs):
        ls = [(n, x.strip(" \t\n\x0b\x0c\r")) for n, x in enumerate((docs[i] or "").split("\n"))]
        ls = [x for x in ls if x[1]]
        for j in range(len(ls) - k + 1):
            w = tuple(x[1] for x in ls[j : j + k])
            a, z = ls[j][0], ls[j + k - 1][0]
            if w in first:
                f, _, fz = first[w]
                out[i] |= set(range(max(a, fz + 1) if f == i else a, z + 1))
            else:
                first[w] = (i, a, z)
    return out


def test_lines_against_a_plain_pass(spark):
    r = random.Random(5)
    docs = {i: "\n".join(r.choice(["a", "b", " c ", "", "dd", f"u{r.random()}"]) for _ in range(r.randint(0, 14))) for i in range(300)}
    want = plain_lines(docs)
    got = lines.without_repeated_lines(frame(spark, docs.items())).collect()
    for x in got:
        kept = "\n".join(t for n, t in enumerate(docs[x.doc_id].split("\n")) if n not in want[x.doc_id])
        assert (x.text, x._n_removed) == (kept, len(want[x.doc_id])), docs[x.doc_id]


def test_line_edge_cases(spark):
    body = "one\ntwo\nthree\nfour"
    rows = [(1, body), (1, body), (2, "x\n" + body), (3, None), (4, ""), (5, "one\ntwo"), (6, "a\n" * 5), (None, body + "\nlast")]
    clash = frame(spark, rows).withColumn("_n_lines", F.lit("clash")).withColumn("_row_hash", F.lit("clash")).withColumn("_spans", F.lit("clash"))
    out = lines.without_repeated_lines(clash)
    assert out.columns == [*frame(spark, []).columns, "_row_hash", "_spans", "_n_lines", "_n_removed"]
    got = {r.doc_id: r for r in out.collect()}
    assert {r._row_hash + r._spans for r in got.values()} == {"clashclash"} and got[2]._n_lines == 5 and got[3]._n_lines == 0
    assert got[None].text == body + "\nlast" and got[1].text == "" and got[2].text == "x"
    assert got[3].text is None and got[4].text == "" and got[5].text == "one\ntwo" and got[6].text == "a\na\na\n"
    assert got[1].kept == "clash"
    assert lines.without_repeated_lines(frame(spark, [])).count() == 0


# --- urls -----------------------------------------------------------------------------------------------------------------


def fits(rule, host, path):
    h, _, p = rule.partition("/")
    return (host == h or host.endswith("." + h)) and path.startswith("/" + p)


def test_urls_against_trying_every_rule(spark):
    r = random.Random(6)
    rules = [(f"{h}/{p}", r.choice(["allow", "block"])) for h in ("net", "a.net", "b.a.net", "com", "x.com") for p in ("", "en/", "en/q", "de/x/")]
    pages = [(i, f"http{r.choice(['', 's'])}://{r.choice(['', 'w.'])}{r.choice(['a.net', 'A.NET', 'b.a.net', 'aa.net', 'x.com', 'org'])}{r.choice(['', '/', '/en', '/en/', '/en/qq', '/de/x/y', '//en/'])}{r.choice(['', '?a=/en/', '#f'])}") for i in range(400)]
    frame = spark.createDataFrame([(i, u, "clash", "clash") for i, u in pages], "page_id long, url string, host string, rule string")
    for x in urls.filter_urls(frame, rules=rules, listed=["org/en"]).collect():
        hits = sorted(((-len(s), s, v) for s, v in rules if fits(s, x.host, x.path)))
        listed = fits("org/en", x.host, re.sub("/+", "/", f"/{x.path}"))
        want = (hits[0][1], hits[0][2]) if hits else (None, "block" if listed else "allow")
        assert (x.rule, x.verdict) == want, x


def test_url_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "://"), (5, "x://EXAMPLE.Net/en/\n?q"), (5, "x://EXAMPLE.Net/en/\n?q"), (None, "https://a.org"), (7, "a://b://c.net/"), (8, "h://" + "a." * 300 + "net/" + "d/" * 300)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == got[2] == got[3] == got[4] == ("", "", None, "allow")
    assert got[5] == ("example.net", "/en/\n", "example.net/en/", "allow") and got[7] == ("b:", "//c.net/", None, "allow")
    assert got[8][2:] == ("net/", "block") and got[None] == ("a.org", "", None, "allow")
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_listed_urls_against_trying_every_entry(spark):
    r = random.Random(8)
    listed = [f"site{i}.example.{r.choice(['com', 'org'])}/{r.choice(['', '', 'a/', 'a/b', 'c%20d/'])}" for i in range(3000)] + ["UP.example.com:80/", "no slash"]
    pages = [(i, f"http://{r.choice(['', 'www.', 'u:p@', 'a.b.'])}site{r.randint(0, 6000)}.example.{r.choice(['com', 'org', 'COM'])}{r.choice(['', ':8080', '.'])}{r.choice(['', '/', '/a/x', '//a//bc', '/%61/', '/c d/', '/c%20d/e', '/zz?a/'])}") for i in range(3000)]
    pages += [(5000, "http://up.example.com/x"), (5001, "http://up.example.com"), (5002, "http://no slash/")]
    rows = spark.createDataFrame(pages, "page_id long, url string")
    found = {x.url for x in urls.listed_urls(rows, spark.createDataFrame([(x,) for x in listed], "rule string")).collect()}

    def canonical(h, p):
        h = re.sub(r"\.+$", "", re.sub(":[0-9]*$", "", h.rpartition("@")[2])).lower()
        return h, re.sub("/+", "/", "/" + unquote(p))

    entries = {canonical(x.partition("/")[0], x.partition("/")[2]) for x in listed if "/" in x}
    by = {}
    for h, p in entries:
        by.setdefault(h, []).append(p)
    want = set()
    for _, u in pages:
        rest = re.split("[?#]", u.partition("://")[2])[0]
        h, p = canonical(rest.partition("/")[0], rest.partition("/")[2])
        names = [h[m:] for m in [0, *(i + 1 for i, c in enumerate(h) if c == ".")]]
        want |= {u for n in names for s in by.get(n, ()) if p.startswith(s)}
    assert found == want and len(want) > 300


def test_listed_sites_are_many_and_the_filter_has_many_blocks(spark):
    sites = urls.listed_sites(spark)
    assert sites.count() == sites.distinct().count() == len(urls.FAMILIES) * len(urls.ENDINGS) * urls.MIRRORS
    pages = spark.createDataFrame([(1, "http://www.casino-win.example.com/en/"), (2, "http://casino-win7.biz./x"), (3, "http://casino-win1.biz/x"), (4, "http://mycasino-win.biz/"), (5, "http://casino-win5000.top:80?x")], "page_id long, url string")
    assert [x.verdict for x in urls.filter_urls(pages).orderBy("page_id").collect()] == ["block", "block", "allow", "allow", "block"]


# --- archives -------------------------------------------------------------------------------------------------------------


def test_archive_edge_cases(spark):
    big = "é" * 600
    rows = [(1, "http://a", big), (2, None, big), (2, None, big), (3, "u\r\nX: y", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "\r\n\r\nWARC/1.1" * 200)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    scratch = Scratch(spark)
    warc.write_pages(pages, f"{scratch.root}/w", scratch)
    back = warc.read_pages(spark, f"{scratch.root}/w")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in back.collect()}
    assert got == {(1, "revisit", 2, 1200), (2, "response", None, 1200), (3, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0), (6, "response", None, 0), (None, "revisit", 2, 1200), (7, "response", None, 2400)}
    assert back.count() == len(rows)
    none = Scratch(spark)
    warc.write_pages(pages.where("false"), f"{none.root}/w", none)
    assert warc.read_pages(spark, f"{none.root}/w").count() == 0


def test_predicates_are_decided_in_the_reader(spark):
    scratch = Scratch(spark)
    path = f"{scratch.root}/w"
    warc.write_pages(spark.read.parquet(f"{DATA}/pages.parquet"), path, scratch)
    found = spark.read.format("warc").schema("record_id string, record_type string, target_uri string").load(path)
    few = found.where("record_type = 'response' and target_uri like 'https%'")
    assert few.count() == found.toPandas().query("record_type == 'response' and target_uri.str.startswith('https')").shape[0]
    reader = warc.WarcReader(found.schema, {"path": path})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload_bytes",), 1)]))
    assert len(left) == 1 and reader.wanted({"warc-type": "response"}) and not reader.wanted({"warc-type": "revisit"})


def plain(i, payload, extra=b""):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + payload
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:%d>\r\n%bContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % (i, extra, len(http)) + http + b"\r\n\r\n"


@pytest.mark.parametrize("form", ["plain", "members", "skippable", "mixed"])
def test_reader_takes_archives_of_others(form):
    bodies = [b"a" * n for n in (0, 5, 20_000, 300_000)]
    made = [plain(i, b) for i, b in enumerate(bodies)]
    pack = {"plain": lambda i, r: r, "members": lambda i, r: gzip.compress(r), "skippable": lambda i, r: warc.member(r), "mixed": lambda i, r: gzip.compress(r) if i % 2 else warc.member(r)}[form]
    data = b"".join(pack(i, r) for i, r in enumerate(made))
    got = list(warc.records(io.BytesIO(data), lambda h: True, True))
    assert [r["payload"] for r in got] == bodies and [r["payload_bytes"] for r in got] == list(map(len, bodies))
    some = list(warc.records(io.BytesIO(data), lambda h: h["warc-record-id"] in ("<urn:x:1>", "<urn:x:3>"), False))
    assert [(r["record_id"], r["payload_bytes"], r["payload"]) for r in some] == [("urn:x:1", 5, None), ("urn:x:3", 300_000, None)]


def test_long_headers_come_back_and_cut_records_are_errors(spark):
    url = "http://a/" + "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=2_000_000))
    pages = spark.createDataFrame([(1, url, "x" * 2000), (2, "<u> ", "y")], "page_id long, url string, html string")
    scratch = Scratch(spark)
    warc.write_pages(pages, f"{scratch.root}/w", scratch)
    assert {(r.page_id, r.payload_bytes) for r in warc.read_pages(spark, f"{scratch.root}/w").collect()} == {(1, 2000), (2, 1)}
    found = spark.read.format("warc").load(f"{scratch.root}/w").orderBy("record_id").collect()
    assert [r.target_uri for r in found] == [url, "%3Cu%3E%20"]
    whole = plain(1, b"a" * 50_000)
    for data in (whole[:40_000], warc.member(whole)[:-20], whole[:60], b"WARC/1.0\r\nno end"):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(io.BytesIO(data), lambda h: True, True))
    assert len(list(warc.records(io.BytesIO(plain(1, b"", b"X: " + b"x" * 3_000_000 + b"\r\n")), lambda h: True, True))) == 1


def test_the_query_asks_for_types_of_records(spark):
    scratch = Scratch(spark)
    warc.write_pages(spark.read.parquet(f"{DATA}/pages.parquet"), f"{scratch.root}/w", scratch)
    plan = warc.read_pages(spark, f"{scratch.root}/w")._jdf.queryExecution().executedPlan().toString()
    assert "= response" not in plan and "= revisit" not in plan and plan.count("BatchScan warc") == 2


def test_unwanted_payloads_are_not_inflated(monkeypatch):
    data = b"".join(warc.member(plain(i, random.Random(i).randbytes(500_000))) for i in range(4))

    class Counting(io.BytesIO):
        n = 0

        def read(self, size=-1):
            got = super().read(size)
            Counting.n += len(got)
            return got

    assert list(warc.records(Counting(data), lambda h: False, True)) == []
    assert Counting.n < len(data) / 20
