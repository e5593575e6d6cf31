"""Dashboard views over the match table and the profiles; all are aggregates that Spark combines before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions import score as S
from quillmatch.functions import text as T
from quillmatch.functions.ship import kept
from quillmatch.operators import matching


def department() -> Column:
    return F.coalesce(F.nullif(F.col("department"), F.lit("")), F.lit("Unknown"))


def spine(df: DataFrame, labels: Sequence[str], counts: DataFrame) -> DataFrame:
    """A row for each label in order, with the count of the label or 0."""
    rows = df.sparkSession.range(1).select(F.posexplode(T.literal_array(list(labels))).alias("slot", "label"))
    return rows.join(counts, "label", "left").select("slot", "label", F.coalesce("n", F.lit(0)).alias("n"))


def ranked(df: DataFrame, most: int, *order: Column) -> DataFrame:
    """A top-k report."""
    return df.orderBy(*order).limit(most)


def coverage(faculty: DataFrame) -> DataFrame:
    n = F.count("*")
    kw, emb = F.count_if(F.size("keywords") > 0), F.count_if(F.col("embedding").isNotNull())
    pct = [F.when(n > 0, F.round(x / n * 100, 1)).otherwise(0.0) for x in (kw, emb)]
    return faculty.agg(n.alias("total"), kw.alias("with_keywords"), emb.alias("with_embeddings"), pct[0].alias("keyword_pct"), pct[1].alias("embedding_pct"))


def type_breakdown(matches: DataFrame) -> DataFrame:
    t = F.col("match_type")
    return matches.agg(F.count_if(t.isin("keyword", "both")).alias("keyword_matches"), F.count_if(t.isin("semantic", "both")).alias("semantic_matches"), F.count_if(t == "both").alias("both_matches"))


def type_share(matches: DataFrame) -> DataFrame:
    """Exclusive shares of the three types."""
    return matches.agg(*(F.count_if(F.col("match_type") == t).alias(t) for t in ("keyword", "semantic", "both")))


def daily_trend(matches: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Matches by type for each of the last days; days without any are 0, and unknown types are left out."""
    per = matches.groupBy(F.to_date(F.substring("timestamp", 1, 10)).alias("day")).pivot("match_type", ["keyword", "semantic", "both"]).count()
    end = F.lit(as_of).cast("date")
    all_days = matches.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    return all_days.join(per, "day", "left").select(F.col("day").cast("string").alias("day"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("keyword", "semantic", "both")))


def top_agencies(matches: DataFrame, most: int = 8) -> DataFrame:
    per = matches.groupBy(F.coalesce("grant_agency", F.lit("Unknown")).alias("agency")).agg(F.count("*").alias("n"), F.min("pos").alias("_first"))
    return ranked(per, most, F.desc("n"), F.col("_first")).drop("_first")


def department_coverage(faculty: DataFrame, most: int = 15) -> DataFrame:
    per = faculty.groupBy(department().alias("dept")).agg(F.count("*").alias("total"), F.count_if(F.size("keywords") > 0).alias("with_kw"))
    return ranked(per.withColumn("pct", F.rint(F.col("with_kw") / F.col("total") * 100).cast("long")), most, F.desc("total"), F.col("dept"))


def award_buckets(matches: DataFrame) -> DataFrame:
    per = matches.select(S.money(F.col("grant_award_ceiling")).alias("c")).where("c > 0").groupBy(S.banded(F.col("c"), S.AWARD_BANDS, ">5M").alias("label")).agg(F.count("*").alias("n"))
    return spine(matches, [x[1] for x in S.AWARD_BANDS] + [">5M"], per)


def top_faculty(matches: DataFrame, most: int = 15) -> DataFrame:
    per = matches.groupBy(F.col("faculty_name").alias("name")).agg(F.count("*").alias("n"), F.min("pos").alias("_first"))
    return ranked(per, most, F.desc("n"), F.col("_first")).drop("_first")


def top_departments(matches: DataFrame, most: int = 10) -> DataFrame:
    per = matches.groupBy(F.col("faculty_department").alias("dept")).agg(F.count("*").alias("n"), F.min("pos").alias("_first"))
    return ranked(per, most, F.desc("n"), F.col("_first")).select(F.coalesce(F.nullif("dept", F.lit("")), F.lit("Unknown")).alias("dept"), "n")


def match_keywords(matches: DataFrame) -> DataFrame:
    return matches.select("pos", "grant_id", "faculty_name", "faculty_department", F.explode("matched_keywords").alias("kw")).withColumn("kw", F.lower("kw"))


def top_keywords(matches: DataFrame, most: int = 20) -> DataFrame:
    return ranked(match_keywords(matches).groupBy(F.col("kw").alias("keyword")).agg(F.count("*").alias("n")), most, F.desc("n"), F.col("keyword"))


def source_breakdown(faculty: DataFrame) -> DataFrame:
    per = faculty.select(F.explode("keyword_sources").alias("s")).groupBy(T.source_base(F.col("s")).alias("source"))
    return per.agg(F.count("*").alias("n"))


def department_keywords(faculty: DataFrame, most: int = 12) -> DataFrame:
    per = faculty.groupBy(department().alias("dept")).agg(F.sum(F.size("keywords")).alias("n_keywords"), F.count("*").alias("faculty_count"))
    per = per.withColumn("avg_keywords", F.round(F.col("n_keywords") / F.col("faculty_count"), 1))
    return ranked(per, most, F.desc("avg_keywords"), F.col("dept")).select("dept", "avg_keywords", "faculty_count")


def confidence_deciles(matches: DataFrame) -> DataFrame:
    low = S.floor_to(F.least(S.legacy_confidence(F.col("confidence_score"), F.col("match_score")), F.lit(99)), 10)
    per = matches.groupBy(F.concat(low, F.lit("-"), low + 9).alias("label")).agg(F.count("*").alias("n"))
    return spine(matches, [f"{i}-{i + 9}" for i in range(0, 100, 10)], per)


SIMILARITY_BANDS = ((0.60, "<0.60"), (0.65, "0.60-0.65"), (0.70, "0.65-0.70"), (0.75, "0.70-0.75"), (0.80, "0.75-0.80"))


def similarity_buckets(matches: DataFrame) -> DataFrame:
    s = matches.where(F.col("match_type").isin("semantic", "both") & (F.col("similarity_score") != 0))
    per = s.groupBy(S.banded(F.col("similarity_score"), SIMILARITY_BANDS, "0.80+").alias("label")).agg(F.count("*").alias("n"))
    return spine(matches, [x[1] for x in SIMILARITY_BANDS] + ["0.80+"], per)


def upcoming(matches: DataFrame, as_of: str, most: int = 10, least_days: int = -7, most_days: int = 90) -> DataFrame:
    """Deadlines ahead, one row for each opportunity, with its number of matches."""
    per = matches.groupBy("grant_id").agg(F.min_by(F.struct("grant_title", "grant_agency", "grant_close_date"), "pos").alias("f"), F.count("*").alias("faculty_count"))
    days = S.days_left(F.col("f.grant_close_date"), as_of)
    rows = per.select("grant_id", F.substring("f.grant_title", 1, 60).alias("title"), F.col("f.grant_agency").alias("agency"), F.substring("f.grant_close_date", 1, 10).alias("close_date"), days.alias("days_left"), "faculty_count")
    return ranked(rows.where(F.col("days_left").between(least_days, most_days)), most, F.col("days_left"), F.col("grant_id"))


def grant_rollup(matches: DataFrame, as_of: str, legacy_confidence: bool = False) -> DataFrame:
    """One row for each opportunity: attributes of its newest match, its matches, types, keywords, maxima and composite confidence.

    ``first_seen`` is the time of the newest match. Confidence is the highest stored one; the legacy form blends score and similarity of the
    newest match by type.
    """
    first = F.min_by(F.struct("grant_title", "grant_agency", "grant_number", "grant_link", "grant_close_date", "grant_award_ceiling", "grant_synopsis", "timestamp", "match_score", "match_type", "similarity_score"), "pos")
    one = F.struct("pos", "faculty_name", "faculty_department", "faculty_email", "matched_keywords", "match_score", "match_type", "similarity_score", "confidence_score")
    g = matches.where("grant_id <> ''").groupBy("grant_id").agg(
        first.alias("f"),
        F.sort_array(F.collect_list(one)).alias("faculty_matches"),
        F.sort_array(F.collect_set("match_type")).alias("match_types"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("matched_keywords")))).alias("all_keywords"),
        F.max("match_score").alias("max_score"),
        F.max("similarity_score").alias("max_similarity"),
        F.count("*").alias("faculty_count"),
        F.max("confidence_score").alias("stored"),
    )
    return _rolled_up(g, as_of, legacy_confidence)


def rollup_of_lists(lists: DataFrame, as_of: str, legacy_confidence: bool = False) -> DataFrame:
    """``grant_rollup`` of ``matching.match_lists``: an opportunity's row has all its matches in their order, so none is shuffled.

    Only those whose id is in several rows, or that have no ``pos``, are grouped match by match.
    """
    odd = lists.groupBy("id").agg(F.count("*").alias("n"), F.count(matching.newest_first(F.lit(1))).alias("placed")).where("n > 1 or placed < n")
    odd = kept(odd.select("id"))
    columns = ("title", "agency", "number", "link", "close_date", "award_ceiling", "synopsis")

    def match(x: Column, i: Column) -> Column:
        told = (F.get(c, i).alias(f"faculty_{c}") for c in ("department", "email"))
        return F.struct(matching.newest_first(i + 1).alias("pos"), x.alias("faculty_name"), *told, *(F.get(c, i).alias(c) for c in ("matched_keywords", "match_score", "match_type", "similarity_score", "confidence_score")))

    first = F.struct(*(F.col(c).alias(f"grant_{c}") for c in columns), "timestamp", *(F.get(c, F.lit(0)).alias(c) for c in ("match_score", "match_type", "similarity_score")))
    g = lists.where("id <> ''").join(odd, "id", "left_anti").select(
        F.col("id").alias("grant_id"),
        first.alias("f"),
        F.transform("name", match).alias("faculty_matches"),
        F.array_sort(F.array_distinct("match_type")).alias("match_types"),
        F.sort_array(F.array_distinct(F.flatten("matched_keywords"))).alias("all_keywords"),
        F.array_max("match_score").alias("max_score"),
        F.array_max("similarity_score").alias("max_similarity"),
        F.size("name").cast("long").alias("faculty_count"),
        F.array_max("confidence_score").alias("stored"),
    )
    grouped = grant_rollup(matching.match_rows(lists.join(odd, "id", "left_semi")), as_of, legacy_confidence)
    return _rolled_up(g, as_of, legacy_confidence).unionByName(grouped)


def _rolled_up(g: DataFrame, as_of: str, legacy_confidence: bool) -> DataFrame:
    kw, sim, kind = F.least(F.col("f.match_score") / 10, F.lit(1.0)), F.col("f.similarity_score"), F.col("f.match_type")
    old = F.least(F.rint(F.when(kind == "both", kw * 0.5 + sim * 0.5).when(kind == "semantic", sim).otherwise(kw) * 100), F.lit(99.0)).cast("int")
    return g.select(
        "grant_id",
        *(F.col(f"f.{c}").alias(c) for c in ("grant_title", "grant_agency", "grant_number", "grant_link", "grant_close_date", "grant_award_ceiling", "grant_synopsis")),
        F.col("f.timestamp").alias("first_seen"),
        "faculty_matches",
        "match_types",
        "all_keywords",
        "max_score",
        "max_similarity",
        "faculty_count",
        S.days_left(F.col("f.grant_close_date"), as_of).alias("days_until_close"),
        F.coalesce(S.money(F.col("f.grant_award_ceiling")), F.lit(0)).alias("award_int"),
        (old if legacy_confidence else F.col("stored")).alias("confidence"),
    )


def filter_grants(rollup: DataFrame, search: str = "", agency: str = "", match_type: str = "") -> DataFrame:
    """Filters on whole opportunities, after the roll-up: the search looks at title, agency, keywords and names."""
    out = rollup
    if q := search.lower().strip():
        out = out.where(F.lower("grant_title").contains(q) | F.lower("grant_agency").contains(q) | F.exists("all_keywords", lambda k: F.lower(k).contains(q)) | F.exists("faculty_matches", lambda m: F.lower(m["faculty_name"]).contains(q)))
    if a := agency.lower().strip():
        out = out.where(F.lower("grant_agency").contains(a))
    if match_type:
        out = out.where(F.array_contains("match_types", match_type.lower()))
    return out


GRANT_SORTS = {
    "faculty": lambda: [F.desc("faculty_count")],
    "award": lambda: [F.desc("award_int")],
    "deadline": lambda: [F.col("days_until_close").isNull(), F.coalesce(F.nullif("days_until_close", F.lit(0)), F.lit(9999))],
    "confidence": lambda: [F.desc("confidence")],
    "recent": lambda: [F.desc("first_seen")],
}


def paged(df: DataFrame, order: Sequence[Column], page: int = 1, per_page: int = 15) -> DataFrame:
    """A page of rows in a total order."""
    return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def page_counts(df: DataFrame, per_page: int = 15) -> DataFrame:
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.floor((F.col("total") + per_page - 1) / per_page).cast("long"))


def grants_view(matches: DataFrame, as_of: str, search: str = "", agency: str = "", match_type: str = "", sort: str = "recent", page: int = 1, per_page: int = 15) -> DataFrame:
    return rollup_view(grant_rollup(matches, as_of), search, agency, match_type, sort, page, per_page)


def rollup_view(rollup: DataFrame, search: str = "", agency: str = "", match_type: str = "", sort: str = "recent", page: int = 1, per_page: int = 15) -> DataFrame:
    return paged(filter_grants(rollup, search, agency, match_type), [*GRANT_SORTS[sort](), F.col("grant_id")], page, per_page)


def filter_matches(matches: DataFrame, search: str = "", match_type: str = "", agency: str = "", keywords: bool = True) -> DataFrame:
    out = matches
    if q := search.lower().strip():
        hit = F.lower("grant_title").contains(q) | F.lower("faculty_name").contains(q)
        out = out.where(hit | F.exists("matched_keywords", lambda k: F.lower(k).contains(q)) if keywords else hit)
    if match_type:
        out = out.where(F.col("match_type") == match_type)
    if agency:
        out = out.where(F.lower("grant_agency").contains(agency.lower()))
    return out


def filter_faculty(faculty: DataFrame, search: str = "", dept: str = "", keyword: str = "", source: str = "") -> DataFrame:
    """The department's filter minds the case; the others do not."""
    out = faculty
    if q := search.lower().strip():
        out = out.where(F.lower("name").contains(q) | F.lower("email").contains(q))
    if dept:
        out = out.where(F.col("department").contains(dept))
    if keyword:
        out = out.where(F.exists("keywords", lambda k: F.lower(k).contains(keyword.lower())))
    if source:
        out = out.where(F.exists("keyword_sources", lambda s: F.lower(s).contains(source.lower())))
    return out


def with_match_count(faculty: DataFrame, matches: DataFrame) -> DataFrame:
    counts = matches.groupBy(F.col("faculty_name").alias("name")).agg(F.count("*").alias("match_count"))
    return faculty.join(counts, "name", "left").withColumn("match_count", F.coalesce("match_count", F.lit(0)))


FACULTY_SORTS = {
    "name": lambda: [F.lower("name")],
    "keywords": lambda: [F.desc(F.size("keywords"))],
    "matches": lambda: [F.desc("match_count")],
}


def faculty_view(faculty: DataFrame, matches: DataFrame, sort: str = "name", page: int = 1, per_page: int = 25, **filters) -> DataFrame:
    return paged(with_match_count(filter_faculty(faculty, **filters), matches), [*FACULTY_SORTS[sort](), F.col("name")], page, per_page)


def faculty_detail(matches: DataFrame, name: str, most: int = 20) -> DataFrame:
    return ranked(matches.where(F.lower("faculty_name") == name.lower()), most, F.col("pos"))


def keyword_detail(matches: DataFrame, most: int = 30) -> DataFrame:
    """Keywords by number of opportunities, with profiles and the department that has most; ties go to the first seen."""
    k = match_keywords(matches).withColumn("dept", F.coalesce(F.nullif("faculty_department", F.lit("")), F.lit("Unknown")))
    wide = k.groupBy("kw").agg(F.count_distinct("grant_id").alias("grant_count"), F.count_distinct("faculty_name").alias("faculty_count"))
    mode = k.groupBy("kw", "dept").agg(F.count("*").alias("n"), F.min("pos").alias("at")).groupBy("kw").agg(F.min_by("dept", F.struct(-F.col("n"), "at")).alias("top_dept"))
    return ranked(wide.join(mode, "kw"), most, F.desc("grant_count"), F.col("kw")).withColumnRenamed("kw", "keyword")


COUNT_BANDS = ((1, "0"), (11, "1-10"), (26, "11-25"), (51, "26-50"), (101, "51-100"))


def keyword_count_histogram(faculty: DataFrame) -> DataFrame:
    per = faculty.groupBy(S.banded(F.size("keywords"), COUNT_BANDS, "100+").alias("label")).agg(F.count("*").alias("n"))
    return spine(faculty, [x[1] for x in COUNT_BANDS] + ["100+"], per)


def department_leaderboard(matches: DataFrame, most: int = 20) -> DataFrame:
    d = F.coalesce(F.nullif(F.col("faculty_department"), F.lit("")), F.lit("Unknown"))
    sem = F.count_if(F.col("match_type").isin("semantic", "both"))
    per = matches.groupBy(d.alias("dept")).agg(
        F.count("*").alias("total_matches"),
        F.count_distinct("grant_id").alias("unique_grants"),
        F.count_distinct("faculty_name").alias("unique_faculty"),
        F.round(F.sum("match_score") / F.count("*"), 1).alias("avg_score"),
        sem.alias("sem_matches"),
        F.rint(sem / F.count("*") * 100).cast("long").alias("sem_pct"),
    )
    return ranked(per, most, F.desc("total_matches"), F.col("dept"))


QUINTILES = ((20, "0-20"), (40, "20-40"), (60, "40-60"), (80, "60-80"))


def confidence_quintiles(matches: DataFrame) -> DataFrame:
    conf = S.display_confidence(F.col("match_type"), F.col("confidence_score"), F.col("similarity_score"))
    per = matches.groupBy(S.banded(conf, QUINTILES, "80-100").alias("label")).agg(F.count("*").alias("n"))
    return spine(matches, [x[1] for x in QUINTILES] + ["80-100"], per)


def digest(matches: DataFrame) -> DataFrame:
    """Opportunities of a mail: by best confidence, then number of matches."""
    per = matches.groupBy("grant_id").agg(F.max("confidence_score").alias("best"), F.count("*").alias("n"), F.min_by("grant_agency", "pos").alias("agency"))
    return per.withColumn("band", S.colour(F.col("best"))).orderBy(F.desc("best"), F.desc("n"), "grant_id")


def digest_agencies(matches: DataFrame, most: int = 4) -> DataFrame:
    per = matches.groupBy("grant_agency").agg(F.count_distinct("grant_id").alias("n"))
    return ranked(per, most, F.desc("n"), F.col("grant_agency"))


def export_matches(matches: DataFrame, search: str = "", match_type: str = "") -> DataFrame:
    """Columns of the CSV of matches; the search leaves keywords out."""
    cols = ("timestamp", "grant_id", "grant_title", "grant_agency", "grant_number", "grant_link", "grant_close_date", "grant_award_ceiling", "faculty_name", "faculty_department", "faculty_email")
    return filter_matches(matches, search, match_type, keywords=False).select(*cols, F.array_join("matched_keywords", "; ").alias("matched_keywords"), "match_type", "match_score", "confidence_score")


def export_faculty(faculty: DataFrame, matches: DataFrame) -> DataFrame:
    bases = F.array_sort(F.array_distinct(F.transform("keyword_sources", T.source_base)))
    return with_match_count(faculty, matches).select("name", "department", "email", "url", F.size("keywords").alias("keyword_count"), F.array_join(bases, "; ").alias("sources"), "match_count", F.array_join(F.slice("keywords", 1, 20), "; ").alias("keywords"))
