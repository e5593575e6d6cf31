from __future__ import annotations

from pyspark.sql import functions as F

from quillmatch.functions import text as T
from quillmatch.plans.adapters import table
from quillmatch.sources import connectors, feeds, files, html, payloads
from quillmatch.streaming import cycle as C
from tests.conftest import DATA


def test_anchor_scan_dedups_within_a_page_before_seen(spark):
    p = spark.createDataFrame([(1, "My Src", "https://x.org/a/", "<a href='/grants/1'>A grand <b>opportunity</b> here</a><a href='/grants/1'>A grand opportunity again</a><a href='/grants/2'>LEARN MORE</a><a href='/grants/3'>About our opportunities</a>")], "page int, source string, url string, html string")
    got = html.scanned(p, "page", ["/grants"])
    assert [r.title for r in got.collect()] == ["A grand opportunity here"]
    assert html.scanned(p, "page", ["/grants"], seen=got.select("id")).count() == 0


def test_bad_html_is_no_error(spark):
    p = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, "u", "<a href='x'>open <p>never closed"), (4, "http://[", "<a href='y'>z</a>")], "page int, url string, html string")
    assert sorted(r.page for r in html.links(p).collect()) == [3, 4]


def test_directory_lines(spark):
    p = spark.createDataFrame([(1, "<p>a@b.edu</p><p>Jane Roe, MD</p><p>Keywords: gene therapy, lung</p><p>Jim Poe, PhD</p><p>Keywords: brain</p>")], "page int, html string")
    got = sorted(html.directory(html.lines(p), "page").collect())
    assert [(r.name, r.email, r.keywords) for r in got] == [("Jane Roe, MD", "a@b.edu", ["gene therapy", "lung"]), ("Jim Poe, PhD", "", ["brain"])]


def test_profile_strategies(spark):
    p = spark.createDataFrame([(1, "<p>Research Interests</p><p>gene therapy, lung cancer</p><p>Keywords: x1x</p>"), (2, "<p>Keywords: brain, bone</p>"), (3, "<p>cardiac tissue</p>")], "page int, html string")
    got = {r.page: (r.strategy, r.keywords[0]) for r in html.profile_keywords(html.lines(p), "page").collect()}
    assert got == {1: ("interests", "gene therapy"), 2: ("keywords", "brain"), 3: ("page", "cardiac")}


def test_status_prefixes_go_one_after_the_other(spark):
    assert spark.range(1).select(html.without_status(F.lit("Open Upcoming Call"))).first()[0] == "Call"


def test_feeds(spark):
    f = spark.createDataFrame([("u1", "<rss><channel><item><title>A long title</title><link>http://a/1</link></item><item><title>x</title></item></channel></rss>"), ("u2", '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Atom entry title</title><link href="http://b/2"/></entry></feed>'), ("u3", "no xml")], "url string, body string")
    assert sorted((r.url, r.link) for r in feeds.feed_items(f).collect()) == [("u1", "http://a/1"), ("u2", "http://b/2")]


def test_payload_forms(spark):
    b = spark.createDataFrame([('{"data":{"oppHits":[{"id":"7","title":null,"agencyCode":"NIH","description":"D"}]}}',), ('{"data":[1,[{"x":1}],[{"id":"9","title":"T"}]]}',), ("broken",), (None,)], "body string")
    got = {r.id: r for r in payloads.main_grants(b).collect()}
    assert set(got) == {"7", "9"}
    assert (got["7"].title, got["7"].agency, got["7"].synopsis, got["7"].searchable_text) == ("Untitled", "NIH", "D", "none none")
    assert payloads.search_payload()["oppStatuses"] == "posted|forecasted"


def test_project_payloads(spark):
    a = spark.createDataFrame([('{"results":[{"appl_id":1,"project_title":"P","agency_ic_fundings":[{"name":"A"},{"name":"B"}]},{"appl_id":2,"agency_code":"C"},{"appl_id":3}]}',)], "body string")
    b = spark.createDataFrame([('{"items":[{"projectNumber":"R1","title":"Q","ic":{"name":"I"}}]}',)], "body string")
    got = {r.id: r.agency for r in payloads.reporters(a, b).collect()}
    assert got == {"nih-reporter-1": "A; B", "nih-reporter-2": "C", "nih-reporter-3": "NIH", "fed-reporter-R1": "I"}
    assert payloads.reporters(None, None) is None


def test_surrogate_key(spark):
    import hashlib

    want = "my-src-" + hashlib.md5(b"My Src|T|u").hexdigest()[:12]
    assert spark.range(1).select(T.surrogate_key(F.lit("My Src"), F.lit("T"), F.lit("u"))).first()[0] == want


def test_fetch_isolates_failures(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}')
    got = connectors.fetch(spark, [{"url": f"file://{tmp_path}/a.json"}, {"url": f"file://{tmp_path}/none"}], 0).collect()
    assert sorted(r.status for r in got) == [-1, 200]


def test_registry_and_union(spark):
    sources = [("a", "A", "u", "x"), ("b", "B", "v", "y")]
    assert [r.key for r in connectors.registry(spark, sources, exclude=["a"]).collect()] == ["b"]
    out, n = connectors.combined({"a": spark.range(2).withColumn("x", F.lit(1)), "b": spark.range(1)})
    assert out.count() == 3 and {r.source_key: r.n for r in n.collect()} == {"a": 2, "b": 1}


def test_history_is_newest_first_and_capped(spark, tmp_path):
    path = str(tmp_path / "h")
    for run in range(3):
        files.prepend_history(spark.range(4).select(F.col("id").alias("pos"), F.lit(run).alias("run")), path, 6)
    got = [(r.gen, r.pos, r.run) for r in spark.read.parquet(path).orderBy("gen", "pos").collect()]
    assert got == [(0, 0, 2), (0, 1, 2), (0, 2, 2), (0, 3, 2), (1, 0, 1), (1, 1, 1)]


def test_stats_keep_what_a_run_lacks(spark, tmp_path):
    path = str(tmp_path / "s")
    files.upsert_stats(spark.createDataFrame([(1, "x")], "a int, b string"), path)
    files.upsert_stats(spark.createDataFrame([(2,)], "a int"), path)
    assert spark.read.parquet(path).first().asDict() == {"a": 2, "b": "x"}


def test_run_log_replaces_its_own_day(spark, tmp_path):
    path = str(tmp_path / "l")
    for day, n in (("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-01", 3)):
        files.write_run_log(spark.createDataFrame([(day, n)], "run_date string, n int"), path)
    assert {(str(r.run_date), r.n) for r in spark.read.json(path).collect()} == {("2024-01-01", 3), ("2024-01-02", 2)}


def test_profile_cache_must_be_whole_and_young(spark, tmp_path):
    path = str(tmp_path / "c")
    assert files.fresh_profiles(spark, path, "2024-01-08 00:00:00") is None
    spark.createDataFrame([("a", ["k"], "2024-01-02T00:00:00")], "name string, keywords array<string>, scraped_at string").write.parquet(path)
    assert files.fresh_profiles(spark, path, "2024-01-08 00:00:00").count() == 1
    assert files.fresh_profiles(spark, path, "2024-01-10 00:00:00") is None


def test_stream_batches_see_an_id_once(spark, tmp_path):
    for i, ids in enumerate((["a", "b"], ["b", "c"])):
        spark.createDataFrame([(x,) for x in ids], "id string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("id string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = []
    for _ in range(2):  # a second run finds nothing new
        C.cycle(C.once(stream), lambda b, n: got.extend(r.id for r in b.collect()), str(tmp_path / "state")).awaitTermination()
    assert sorted(got) == ["a", "b", "c"]


def test_stream_days_equal_batch(spark, tmp_path):
    e = spark.readStream.schema(table(spark, DATA, "events").schema).parquet(f"{DATA}/events*.parquet")
    rows = {}
    C.cycle(C.daily(e), lambda b, n: rows.update({(r.day, r.event_type): r.n for r in b.collect()}), str(tmp_path / "state"), mode="update").awaitTermination()
    want = table(spark, DATA, "events").groupBy(F.date_format("ts", "yyyy-MM-dd"), "event_type").count().collect()
    assert rows == {(r[0], r[1]): r[2] for r in want}


def test_a_table_half_replaced_is_put_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t.old")
    spark.range(5).write.parquet(f"{path}.new")
    assert files.read_or_empty(spark, path, "id long").count() == 5
    files.replace(spark.range(2), path)
    assert files.read_or_empty(spark, path, "id long").count() == 2 and not (tmp_path / "t.old").exists()
    (tmp_path / "t").rename(tmp_path / "t.old")
    assert files.read_or_empty(spark, path, "id long").count() == 2


def test_requests_of_sources(spark):
    from quillmatch.sources import registry

    asked = registry.requests(registry.sources(spark, include=["nsf_funding", "hhmi"]))
    assert [r["source"] for r in asked] == ["nsf_funding", "nsf_funding", "hhmi"]
    assert registry.sources(spark, exclude=["hhmi"]).count() == len(registry.SOURCES) - 1 == 30
    api = payloads.api_requests("https://m/", "https://r/", "https://f/", "2024-01-30")
    assert [r["source"] for r in api] == ["main", "reporter", "federal"] and api[1]["body"]["criteria"]["project_start_date"]["from_date"] == "2023-12-31" and "2023-12-31" in api[2]["url"]


def test_second_probe_where_the_first_has_no_links(spark):
    p = spark.createDataFrame([(1, "<p>x</p>"), (2, "<a href='/grant'>x</a>"), (3, None)], "page_id int, html string")
    other = spark.createDataFrame([(1, "<a href='/award/1'>x</a>"), (2, "<p/>")], "page_id int, html string")
    got = {r.page_id: (r.links, r.hits) for r in html.probe_again(html.probe(p, patterns=["grant"]), html.probe(other, patterns=["award"])).collect()}
    assert got == {1: (1, [1]), 2: (1, [1]), 3: (0, [0])}


def test_scripts_are_not_visible(spark):
    p = spark.createDataFrame([(1, "<script>" + "x" * 900 + "</script><style>y</style><p>few</p>")], "page_id int, html string")
    assert html.probe(p).first().visible == 3


def test_health_state_does_not_mind_the_order_of_chunks():
    import pandas as pd

    class State:
        exists, get = True, (2, 5)

        def update(self, x):
            self.now = x

    captured = {}

    class Stream:
        def groupBy(self, *_):
            return self

        def applyInPandasWithState(self, step, *_):
            captured["step"] = step

    C.health(Stream())
    rows = pd.DataFrame({"run": list("abcdef"), "found": [0, 3, 0, -1, 0, 0]})
    for parts in ([rows], [rows[3:], rows[:3]], [rows[i : i + 1] for i in (5, 1, 0, 4, 3, 2)]):
        state = State()
        out = list(captured["step"](("s",), iter(parts), state))
        assert state.now == (3, 8) and bool(out[0]["alert"][0])
    state = State()
    list(captured["step"](("s",), iter([rows[:1]]), state))
    assert state.now == (3, 5)
