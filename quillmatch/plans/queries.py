"""Registered queries of the engine: each applies one operator to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.functions import score as S
from quillmatch.functions import text as T
from quillmatch.functions.ship import kept
from quillmatch.operators import diagnostics as D
from quillmatch.operators import identity as I
from quillmatch.operators import matching as M
from quillmatch.operators import relevance as R
from quillmatch.operators import views as V
from quillmatch.plans import adapters as A
from quillmatch.plans.adapters import AS_OF, QUERY_CONFIG, grants, matches, profiles, table

BLOCK, ALLOW, VOCAB = ("spam", "casino", "src13", "nda"), ("src1", "src2"), "licensed|mail|apache|version"


def bar(c: str):
    return F.array_join(F.array_sort(c), "|")


def match_keyword(s, d) -> DataFrame:
    best = M.KeywordPass(grants(s, d), kept(profiles(s, d)), QUERY_CONFIG).best()
    return best.select(F.col("id").alias("grant_id"), F.col("name").alias("faculty_name"), "n_keywords", F.col("confidence_score").cast("long").alias("confidence"))


def keyword_join(s, d):
    good = kept(M.eligible_keywords(kept(M.idf_table(profiles(s, d))), QUERY_CONFIG))
    return M.grant_keywords(grants(s, d), good.select("kw")).groupBy("id").agg(F.count("*").alias("n_keywords"), F.sum("in_title").alias("n_title"), F.min("kw").alias("first_kw"))


def pair_scores(s, d):
    kw = M.keyword_matches(grants(s, d), profiles(s, d), QUERY_CONFIG)
    return kw.select("id", "name", bar("matched_keywords").alias("keywords"), "n_matched", "title_hits", "match_score", F.col("confidence_score").cast("long").alias("confidence_score"))


def semantic_pairs(s, d):
    out = M.semantic_matches(A.grant_vectors(s, d), profiles(s, d), QUERY_CONFIG.semantic_threshold)
    return out.select("id", "name", F.floor(F.col("similarity_score") * 10000).alias("sim_e4"))


def semantic_distribution(s, d):
    out = M.semantic_distribution(A.grant_vectors(s, d), profiles(s, d), QUERY_CONFIG.semantic_threshold)
    e4 = [F.floor(F.col(c) * 10000).alias(c) for c in ("max_sim", "p95", "p90", "median")]
    return out.select("id", *e4, *(F.col(f"n_{x}").alias(f"n_{x}") for x in ("threshold", 50, 55, 60, 65)), F.array_join(F.transform("top", lambda x: x["name"]), "|").alias("top"))


def merge_full(s, d):
    kw = kept(M.KeywordPass(grants(s, d), profiles(s, d), QUERY_CONFIG).scores())
    sem = M.semantic_matches(A.grant_vectors(s, d), profiles(s, d), QUERY_CONFIG.semantic_threshold)
    return M.merged(kw, sem, full=True).groupBy("match_type").agg(F.count("*").alias("n"), F.sum("confidence_score").cast("long").alias("conf"), F.sum("match_score").cast("long").alias("score"))


def match_table(s, d):
    m = A.run_matches(s, d)
    return m.select("pos", "grant_id", "faculty_name", "faculty_department", "match_type", "match_score", F.col("confidence_score").cast("long").alias("confidence_score"), bar("matched_keywords").alias("keywords"), F.floor(F.col("similarity_score") * 10000).alias("sim_e4"))


def top_k(s, d):
    m = A.run_matches(s, d)
    return m.groupBy("grant_id").agg(F.count("*").alias("n"), F.min("confidence_score").cast("long").alias("min_conf"), F.max("confidence_score").cast("long").alias("max_conf"))


def relevance(s, d):
    return R.relevance(grants(s, d), BLOCK, ALLOW, VOCAB, 3).select("id", "is_relevant", "reason")


def profile_phrases(s, d):
    c = table(s, d, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", F.array_join(T.phrases(F.col("text")), "|").alias("phrases"))


def rollup(s, d):
    g = V.rollup_of_lists(A.match_lists(s, d), AS_OF)
    return g.select("grant_id", "grant_agency", "first_seen", F.array_join("match_types", "|").alias("types"), F.array_join("all_keywords", "|").alias("keywords"), "max_score", "faculty_count", "days_until_close", "award_int", F.col("confidence").cast("long").alias("confidence"), F.get("faculty_matches", F.lit(0))["faculty_name"].alias("first_faculty"))


def grants_page(s, d):
    g = V.rollup_view(V.rollup_of_lists(A.match_lists(s, d), AS_OF), search="the", agency="src1", sort="confidence", page=2, per_page=5)
    return g.select("grant_id", F.col("confidence").cast("long").alias("confidence"), "faculty_count")


def seen_items(s, d):
    g = grants(s, d)
    seen = g.where("pos % 3 = 0").select("id")
    return I.unseen(g.select("id", "source"), seen).groupBy("source").agg(F.count("*").alias("n"))


def duplicate_profiles(s, d):
    p = profiles(s, d).select("pos", F.concat(F.lit("n-"), F.col("pos") % 40).alias("name"), F.when(F.col("pos") % 3 == 0, "").otherwise(F.concat(F.lit("m"), F.col("pos") % 25, F.lit("@x.org"))).alias("email"))
    return I.unique_profiles(p).select("pos", "name", "email")


def inactive_profiles(s, d):
    p = profiles(s, d).select("pos", "name", "email")
    before = p.where("pos % 5 <> 0")
    now = p.where("pos % 3 <> 0").withColumn("name", F.when(F.col("pos") % 4 == 1, F.concat("name", F.lit("-new"))).otherwise(F.col("name")))
    return I.snapshot(before, now, AS_OF).select("pos", "name", "email", "inactive", "inactive_since")


def event_health(s, d):
    """Sources are users, runs are days, and what a run finds is its purchases."""
    e = table(s, d, "events")
    per = e.groupBy((F.col("user_id") % 50).alias("source"), F.to_date("ts").cast("string").alias("run")).agg(F.count_if(F.col("event_type") == "purchase").alias("found"), F.count_if(F.col("event_type") == "error").alias("bad"))
    return I.source_health(per.withColumn("found", F.when(F.col("bad") > 3, -1).otherwise(F.col("found"))).select(F.col("source").cast("string").alias("source"), "run", "found"))


def log_lines(s, d) -> DataFrame:
    """Events as lines of a log."""
    e = table(s, d, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    body = F.when(F.col("event_type") == "signup", F.concat(F.lit("Pass "), F.col("event_id") % 9, F.lit(": complete, Processing "), F.col("user_id"), F.lit(" faculty"))).when(F.col("event_type") == "error", F.concat(F.lit("dropped: reason "), F.col("user_id") % 7)).otherwise(F.concat(F.col("user_id"), F.lit(" raw matches")))
    return e.select(F.col("event_id").alias("line_no"), F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), level, F.lit("] mod"), F.col("user_id") % 4, F.lit(": "), body).alias("value"))


def log_parsed(s, d):
    f = T.log_fields(F.col("value"))
    return log_lines(s, d).select(f["level"].alias("level"), f["module"].alias("module")).groupBy("level", "module").agg(F.count("*").alias("n"))


def order_money(s, d):
    """Orders as sums with text amounts."""
    o = table(s, d, "orders").select(F.concat(F.lit("$"), F.format_number(F.floor("o_totalprice"), 0)).alias("grant_award_ceiling"))
    return V.award_buckets(o)


def customer_page(s, d):
    return V.paged(table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], 3, 20)


def event_trend(s, d):
    e = table(s, d, "events")
    kind = F.when(F.col("event_type") == "click", "keyword").when(F.col("event_type") == "view", "semantic").when(F.col("event_type") == "purchase", "both").otherwise("other")
    return V.daily_trend(e.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), kind.alias("match_type")), AS_OF)


def text_functions(s, d):
    c, t = table(s, d, "conversations"), F.col("text")
    return c.select(
        "conv_id", "turn", "role",
        F.md5(T.normalize(t)).alias("normalized"),
        F.md5(T.collapse(t)).alias("collapsed"),
        F.array_join(T.mined_tokens(t), "|").alias("mined"),
        T.surrogate_key(F.lit("My Source"), F.substring(t, 1, 20), F.lit("u")).alias("key"),
        T.initials(t).alias("initials"),
    )


def sentences(s, d):
    p = profiles(s, d)
    return p.select("name", F.md5(T.profile_sentence(F.col("name"), F.col("department"), F.col("keywords"))).alias("profile"))


def grant_texts(s, d):
    return grants(s, d).select("id", F.md5(T.grant_sentence(F.col("title"), F.col("agency"), F.col("synopsis"))).alias("text"))


def grant_fields(s, d):
    g, days = grants(s, d), S.days_left(F.col("close_date"), AS_OF)
    return g.select("id", S.money(F.col("award_ceiling")).alias("award"), days.cast("long").alias("days"), S.urgency(days).alias("urgency"), S.mail_deadline(days).alias("mail"), R.is_junk_title(F.col("title"), prefixes=("the ", "de ")).alias("junk"), R.is_admin_notice(F.col("title"), ("the and", "en la")).alias("notice"))


def screening(s, d):
    return R.screening_counts(grants(s, d), block=BLOCK, allow=ALLOW, vocabulary=VOCAB, min_hits=3)


def purge(s, d):
    return R.recount(R.purged(matches(s, d), F.col("grant_link").endswith("7")))


def conf_cast(df):
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint") else c for c, t in df.dtypes))


QUERIES = {
    "match_keyword": match_keyword,
    "normalize": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("normalized")),
    "text_functions": text_functions,
    "profile_phrases": profile_phrases,
    "profile_sentence": sentences,
    "grant_sentence": grant_texts,
    "grant_fields": grant_fields,
    "idf": lambda s, d: M.idf_table(profiles(s, d)).select("kw", "df", F.floor(F.col("idf") * 1e6).alias("idf_e6")),
    "dynamic_stops": lambda s, d: M.dynamic_stops(M.idf_table(profiles(s, d)), QUERY_CONFIG.max_keyword_prevalence),
    "eligible_keywords": lambda s, d: M.eligible_keywords(kept(M.idf_table(profiles(s, d))), QUERY_CONFIG).select("kw"),
    "keyword_join": keyword_join,
    "pair_scores": pair_scores,
    "cosine_join": semantic_pairs,
    "semantic_distribution": semantic_distribution,
    "merge_full_outer": merge_full,
    "match_table": match_table,
    "top_k_per_grant": top_k,
    "relevance": relevance,
    "screening_counts": screening,
    "purge_recount": purge,
    "unseen_items": seen_items,
    "unique_profiles": duplicate_profiles,
    "inactive_profiles": inactive_profiles,
    "source_health": event_health,
    "coverage": lambda s, d: V.coverage(profiles(s, d)),
    "type_breakdown": lambda s, d: V.type_breakdown(matches(s, d)),
    "type_share": lambda s, d: V.type_share(matches(s, d)),
    "daily_trend": lambda s, d: V.daily_trend(matches(s, d), AS_OF),
    "event_trend": event_trend,
    "top_agencies": lambda s, d: V.top_agencies(matches(s, d)),
    "department_coverage": lambda s, d: V.department_coverage(profiles(s, d)),
    "award_buckets": lambda s, d: conf_cast(V.award_buckets(matches(s, d))),
    "order_award_buckets": lambda s, d: conf_cast(order_money(s, d)),
    "top_faculty": lambda s, d: V.top_faculty(matches(s, d)),
    "top_departments": lambda s, d: V.top_departments(matches(s, d)),
    "top_keywords": lambda s, d: V.top_keywords(matches(s, d)),
    "source_breakdown": lambda s, d: V.source_breakdown(profiles(s, d)),
    "department_keywords": lambda s, d: V.department_keywords(profiles(s, d)),
    "confidence_deciles": lambda s, d: conf_cast(V.confidence_deciles(matches(s, d))),
    "similarity_buckets": lambda s, d: conf_cast(V.similarity_buckets(matches(s, d))),
    "upcoming_deadlines": lambda s, d: conf_cast(V.upcoming(matches(s, d), AS_OF)),
    "grant_rollup": lambda s, d: conf_cast(rollup(s, d)),
    "grants_page": grants_page,
    "faculty_page": lambda s, d: V.faculty_view(profiles(s, d), matches(s, d), sort="matches", page=1, per_page=10, dept="dept-").select("name", "match_count"),
    "faculty_detail": lambda s, d: V.faculty_detail(matches(s, d), "FAC-3").select("pos", "grant_id"),
    "filter_matches": lambda s, d: V.filter_matches(matches(s, d), search="the", match_type="keyword", agency="src1").select("pos", "grant_id", "faculty_name"),
    "keyword_detail": lambda s, d: V.keyword_detail(matches(s, d)),
    "keyword_count_histogram": lambda s, d: conf_cast(V.keyword_count_histogram(profiles(s, d))),
    "department_leaderboard": lambda s, d: V.department_leaderboard(matches(s, d)),
    "confidence_quintiles": lambda s, d: conf_cast(V.confidence_quintiles(matches(s, d))),
    "digest": lambda s, d: conf_cast(V.digest(matches(s, d))),
    "digest_agencies": lambda s, d: V.digest_agencies(matches(s, d)),
    "export_matches": lambda s, d: conf_cast(V.export_matches(matches(s, d), search="fac-1")),
    "export_faculty": lambda s, d: conf_cast(V.export_faculty(profiles(s, d), matches(s, d))),
    "customer_page": customer_page,
    "confidence_histogram": lambda s, d: D.confidence_histogram(matches(s, d), ["match_type"]),
    "position_stats": lambda s, d: conf_cast(D.position_stats(matches(s, d), F.col("confidence_score").cast("long"), ["match_type"])),
    "matches_per_faculty": lambda s, d: D.matches_per_faculty(matches(s, d)),
    "keyword_frequency": lambda s, d: D.keyword_frequency(matches(s, d)),
    "violations": lambda s, d: D.violations(matches(s, d)),
    "diagnostics_overview": lambda s, d: D.overview(matches(s, d)),
    "breakdown_by_source": lambda s, d: D.breakdown_by_source(grants(s, d)),
    "stale_embeddings": lambda s, d: D.stale_embeddings(profiles(s, d), 5),
    "log_parsed": log_parsed,
    "log_metrics": lambda s, d: D.log_metrics(log_lines(s, d)),
    "drop_reasons": lambda s, d: D.drop_reasons(log_lines(s, d)),
    "filter_logs": lambda s, d: D.filter_logs(log_lines(s, d), "errors", "mod1"),
    "pass_status": lambda s, d: conf_cast(D.pass_status(log_lines(s, d))),
}
