from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillmatch.functions import score as S
from quillmatch.functions import text as T
from quillmatch.operators import diagnostics as D
from quillmatch.operators import identity as I
from quillmatch.operators import relevance as R
from quillmatch.operators import report as P
from quillmatch.operators import views as V
from quillmatch.plans import config as C
from quillmatch.plans.config import Config


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_list_sizes():
    assert [len(x) for x in (C.AGENCY_ALLOW, C.AGENCY_BLOCK, C.ADMIN_PREFIXES, C.JUNK_EXACT, C.JUNK_PREFIXES, C.JUNK_PARTS)] == [68, 43, 9, 29, 23, 8]


@pytest.mark.parametrize(
    ("agency", "title", "number", "relevant", "reason"),
    [
        ("NIH", "Collaborative work", "", False, "blocked: labor"),
        ("NIH", "Hepatitis", "", False, "blocked: epa"),
        ("NIH", "Anything", "", True, "allowed: nih"),
        ("Other", "Anything", "93.1", True, "number: 93.1"),
        ("Other", "On the brain and the oncol", "", True, "vocabulary: 2"),
        ("Other", "oncology-like oncolx", "", False, "nothing relevant"),
    ],
)
def test_relevance(spark, agency, title, number, relevant, reason):
    g = spark.createDataFrame([(agency, title, number, "", "")], "agency string, title string, number string, searchable_text string, synopsis string")
    r = R.relevance(g).first()
    assert (r.is_relevant, r.reason) == (relevant, reason)


def test_word_boundaries_can_be_asked_for(spark):
    g = spark.createDataFrame([("NIH", "Hepatitis", "", "", "")], "agency string, title string, number string, searchable_text string, synopsis string")
    assert R.relevance(g, word_boundary=True).first().is_relevant


def test_notices_and_junk(spark):
    assert one(spark, R.is_admin_notice(F.lit(" Notice of Change to X")))
    assert not one(spark, R.is_admin_notice(F.lit("A notice of change")))
    for title, junk in (("LEARN MORE", True), ("GRANT NEWS", True), ("1234", False), ("GRANTS FOR ALL THE PEOPLE", False), ("Our cookie policy", True), ("Meeting Dates 2024", True), ("A real title", False)):
        assert one(spark, R.is_junk_title(F.lit(title))) is junk, title


def test_text_functions(spark):
    assert one(spark, T.normalize(F.lit("T-cell, Activated"))) == "t cell  activated"
    assert one(spark, T.collapse(F.lit("\t a \n b "))) == "a b"
    for kws, want in ((["a"], "focuses on a."), (["a", "b"], "include a and b."), (["a", "b", "c"], "include a, b, and c.")):
        assert one(spark, T.profile_sentence(F.lit("N"), F.lit(""), T.literal_array(kws))).endswith(want)
    assert one(spark, T.profile_sentence(F.lit("N"), F.lit(""), T.literal_array([]))) == "N is a biomedical researcher."
    assert one(spark, T.keyword_line(F.lit("Keywords: gene; lung, ab"))) == ["gene", "lung"]
    assert one(spark, T.listed(F.lit("gene therapy"))) == [] and one(spark, T.listed(F.lit("gene, lung")))== ["gene", "lung"]
    assert one(spark, T.without_titles(F.lit("Jane Smith, MD, PhD"))) == "Jane Smith"
    assert one(spark, T.without_titles(F.lit("Adams Bob, MD"))) == "Adams Bob"
    assert one(spark, T.author_query(F.lit("Jane Q. Smith, MD"))) == "Smith J"
    assert one(spark, T.merged_keywords(T.literal_array(["A"]), T.literal_array(["a", "b", "b"]))) == ["A", "b", "b"]
    assert one(spark, T.source_base(F.lit("PubMed (3)"))) == "PubMed"
    assert one(spark, T.initials(F.lit("Jane Roe, MD"))) == "JR"
    assert one(spark, T.highlighted(F.lit("Gene therapy"), T.literal_array(["gene"]))) == "<mark>Gene</mark> therapy"
    assert tuple(one(spark, T.log_fields(F.lit("2024-01-01 10:00:00,1 [INFO] mod.a: hello")))) == ("2024-01-01 10:00:00", "INFO", "mod.a", "hello")
    assert one(spark, T.phrases(F.lit("cardiac stem cells with tau"))) == ["cardiac", "cells", "cardiac stem", "stem cells", "cardiac stem cells", "stem cells with"]


def test_scores_and_dates(spark):
    assert one(spark, S.money(F.lit("$1,000"))) == 1000 and one(spark, S.money(F.lit("n/a"))) is None
    assert one(spark, S.money_label(F.lit("1500000"))) == "$1.5M"
    assert str(one(spark, S.close_date(F.lit("03/04/2024")))) == "2024-03-04"
    assert one(spark, S.days_left(F.lit("2024-01-31T00:00"), "2024-01-30")) == 1
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert one(spark, S.time_ago(F.lit("2024-01-01 22:00:00").cast("timestamp"), now)) == "2h ago"
    assert one(spark, S.next_run(F.lit("2024-01-01 01:30:00").cast("timestamp"), 24, now)) == "1h 30m"
    assert one(spark, S.health_score(F.lit(80), F.lit(90), F.lit(1), F.lit(1), F.lit(11))) == 85


def test_unique_profiles_keep_the_first(spark):
    p = spark.createDataFrame([(1, "N1", "a@x"), (2, "N2", "a@x"), (3, "N1", ""), (4, "N3", "")], "pos long, name string, email string")
    assert sorted(r.pos for r in I.unique_profiles(p).collect()) == [1, 4]


def test_snapshot_knows_a_profile_by_email_too(spark):
    before = spark.createDataFrame([("A", "a@x"), ("B", "b@x"), ("C", "")], "name string, email string")
    now = spark.createDataFrame([("A2", "a@x"), ("C", "")], "name string, email string")
    got = {r.name: r.inactive for r in I.snapshot(before, now, "2024-01-01").collect()}
    assert got == {"A2": False, "C": False, "B": True}


def test_seen_ids_forget_the_oldest(spark):
    seen = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02")], "id string, first_seen string")
    new = spark.createDataFrame([("c",), ("b",)], "id string")
    assert {r.id for r in I.seen_after(seen, new, "2024-01-03", 2).collect()} == {"b", "c"}
    assert [r.id for r in I.unseen(new, seen).collect()] == ["c"]


@pytest.mark.parametrize(("found", "zeros", "alert"), [([0, 0, 0], 3, True), ([0, 0, 0, 5, 0], 1, False), ([5, -1], 0, False), ([0, -1, 0, 0], 3, True)])
def test_source_health(spark, found, zeros, alert):
    rows = spark.createDataFrame([("s", i, n) for i, n in enumerate(found)], "source string, run int, found int")
    r = I.source_health(rows).first()
    assert (r.consecutive_zeros, r.alert) == (zeros, alert)


def test_candidate_choice(spark):
    c = spark.createDataFrame([("p", 0, "x", True, False), ("p", 1, "y", True, True), ("q", 0, "z", True, False), ("r", 0, "w", False, True)], "profile string, pos int, candidate string, name_ok boolean, affiliation_ok boolean")
    assert {r.profile: r.candidate for r in I.choose_candidate(c).collect()} == {"p": "y", "q": "z"}


def test_position_stats_do_not_interpolate(spark):
    r = D.position_stats(spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int"), F.col("v")).first()
    assert (r["count"], r.p25, r.p50, r.p75, r["mean"]) == (4, 2, 3, 4, 2.5)


def test_deciles_and_legacy_confidence(spark):
    m = spark.createDataFrame([(0, 0), (9, 0), (10, 0), (99, 0), (120, 0), (None, 4)], "confidence_score int, match_score int")
    assert {r.label: r.n for r in V.confidence_deciles(m).collect() if r.n} == {"0-9": 2, "10-19": 1, "90-99": 2, "30-39": 1}


def test_legacy_composite_confidence(spark):
    base = ("t", "a", "n", "l", "2024-02-01", "$5", "s", "2024-01-01T00", "f", "d", "e", ["k"])
    cols = "grant_title string, grant_agency string, grant_number string, grant_link string, grant_close_date string, grant_award_ceiling string, grant_synopsis string, timestamp string, faculty_name string, faculty_department string, faculty_email string, matched_keywords array<string>, pos long, grant_id string, match_score int, match_type string, similarity_score double, confidence_score int"
    m = spark.createDataFrame([(*base, 1, "g", 3, "keyword", 0.0, 20), (*base, 2, "g", 9, "keyword", 0.0, 60)], cols)
    assert V.grant_rollup(m, "2024-01-30").first().confidence == 60
    assert V.grant_rollup(m, "2024-01-30", legacy_confidence=True).first().confidence == 30
    assert V.grants_view(m, "2024-01-30", sort="deadline").first().days_until_close == 2


def test_logs_and_rules(spark):
    lines = spark.createDataFrame([(1, "x [INFO] a: Pass 1/8"), (2, "x [ERROR] b: Pass 1: failed"), (3, "x [INFO] a: 5 raw matches"), (4, "x [WARNING] a: 7 raw matches, dropped 3: too short"), (5, "score below the threshold")], "line_no long, value string")
    assert {r["pass"]: r.status for r in D.pass_status(lines, 2).collect()} == {1: "error", 2: "unknown"}
    assert D.log_metrics(lines).where("metric = 'total_matches_raw'").first().value == 7
    assert {r.module for r in D.log_modules(lines).collect()} == {"a", "b"}
    assert {r.reason: r.n for r in D.drop_reasons(lines).collect()} == {"too short": 1, "below_threshold": 1}
    assert [r.line_no for r in D.filter_logs(lines, "errors").collect()] == [4, 2] and D.error_lines(lines).count() == 1
    cols = "total_matches long, suspicious long, top_faculty long, below_semantic long, below_confidence long"
    assert {r.item for r in D.action_items(spark.createDataFrame([(0, 1, 60, 0, 0)], cols)).collect()} == {"no matches", "navigation titles", "one profile has over 50 matches"}
    assert D.action_items(spark.createDataFrame([(10, 0, 5, 0, 0)], cols).select("*")).first().item == "no action items"
    assert D.config_drift({"semantic_threshold": 0.4, "use_idf": False}) == ["semantic_threshold", "use_idf"]


def test_config_from_the_environment():
    c = Config().with_env({"QUILLMATCH_RECIPIENTS": "a@x, ,b@x", "QUILLMATCH_MIN_CONFIDENCE": "40"})
    assert c.recipients == ("a@x", "b@x") and c.min_confidence == 40


def test_labels_of_halves_are_those_of_the_sql(spark, duck):
    """Millions that lie between two tenths, and thousands between two: 2,150,000 is no 2.1499 millions."""
    sums = ", ".join(f"({v})" for v in [*range(50_000, 20_000_000, 100_000), *range(500, 1_000_000, 7_500), 10**12 + 50_000, 0])
    want = dict(duck.sql(f"SELECT v, CASE WHEN v >= 1000000 THEN '$' || printf('%.1f', round_even(v / 1000000.0, 1)) || 'M' WHEN v > 0 THEN '$' || round_even(v / 1000.0, 0)::BIGINT || 'K' END FROM (VALUES {sums}) AS t(v)").fetchall())
    got = spark.sql(f"SELECT v FROM VALUES {sums} AS t(v)").select("v", S.money_label(F.col("v").cast("string")).alias("label"))
    assert {r.v: r.label for r in got.collect()} == want and want[2_150_000] == "$2.2M"


def test_titles_are_looked_at_once_for_each_opportunity(spark, monkeypatch):
    cols = "faculty_name string, grant_id string, grant_title string, grant_agency string, similarity_score double, confidence_score int, matched_keywords array<string>"
    rows = [("a", "g", "Login", None, 0.0, 20, ["k"]), ("b", "g", "Login", None, 0.9, 60, []), (None, None, "Home page", "x", 0.0, 30, ["k", "l"]), ("a", "h", None, "x", 0.1, 40, None)]
    m = spark.createDataFrame(rows, cols)
    assert D.overview(m).first().asDict() == {"total_matches": 4, "unique_faculty": 2, "unique_grants": 2, "suspicious": 3}
    assert D.overview(m.limit(0)).first().asDict() == dict.fromkeys(("total_matches", "unique_faculty", "unique_grants", "suspicious"), 0)
    told = json.loads(P.report(m, "2024-01-30").first().report)
    assert told["suspicious_titles"] == [{"name": "g: Login", "n": 2}, {"name": "Home page", "n": 1}] and told["by_source"] == [{"name": "Unknown", "n": 2}, {"name": "x", "n": 2}]
    assert "Expand" not in D.overview(m)._jdf.queryExecution().optimizedPlan().toString()
