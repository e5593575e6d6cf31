"""Captured API payloads, one JSON text in a row, as opportunities and keywords."""

from __future__ import annotations

from datetime import date, timedelta
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions import text as T

HIT = "struct<id:string,title:string,agency:string,agencyCode:string,number:string,synopsis:string,description:string,closeDate:string,openDate:string,awardCeiling:string>"
GRANT_COLUMNS = ("id", "title", "agency", "number", "synopsis", "close_date", "open_date", "award_ceiling", "link", "searchable_text")


def search_payload(rows: int = 100, statuses: tuple[str, ...] = ("posted", "forecasted"), keyword: str = "") -> dict:
    """The body of a search for new opportunities."""
    return {"keyword": keyword, "oppStatuses": "|".join(statuses), "rows": rows, "oppAge": 2, "sortBy": "openDate|desc"}


def reporter_payload(as_of: str, rows: int = 100, days: int = 30, offset: int = 0) -> dict:
    """The body of a search for projects that began in the last days."""
    first = (date.fromisoformat(as_of) - timedelta(days=days)).isoformat()
    return {"criteria": {"project_start_date": {"from_date": first, "to_date": as_of}, "include_active_projects": True}, "limit": rows, "offset": offset, "sort_field": "project_start_date", "sort_order": "desc"}


def federal_query(as_of: str, rows: int = 100, days: int = 30) -> str:
    """The query string of a search for projects of the last days."""
    first = date.fromisoformat(as_of) - timedelta(days=days)
    return urlencode({"query": f"budgetStartDate:[{first} TO {as_of}]", "offset": 1, "limit": rows})


def api_requests(main: str = "", reporter: str = "", federal: str = "", as_of: str = "", rows: int = 100) -> list[dict]:
    """Requests for ``connectors.fetch`` to the APIs whose addresses are given."""
    found = [{"source": "main", "url": main, "body": search_payload(rows)}] if main else []
    found += [{"source": "reporter", "url": reporter, "body": reporter_payload(as_of, rows)}] if reporter else []
    return found + ([{"source": "federal", "url": f"{federal}?{federal_query(as_of, rows)}"}] if federal else [])


def api_grants(answers: DataFrame) -> DataFrame:
    """Opportunities of all APIs from fetched answers (source, status, body); an API that failed gives none."""
    good = answers.where("status = 200")
    made = {"main": main_grants, "reporter": reporter_grants, "federal": federal_grants}
    out = None
    for name, make in made.items():
        rows = make(good.where(F.col("source") == name)).withColumn("source", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def hits(payload: Column) -> Column:
    """The list of opportunities in a payload: ``data.oppHits``, or of a list ``data`` the first inner list whose first item has an id."""
    normal = F.from_json(payload, f"struct<data:struct<oppHits:array<{HIT}>>>")["data"]["oppHits"]
    inner = F.from_json(payload, "struct<data:array<string>>")["data"]
    lists = F.filter(F.transform(inner, lambda x: F.from_json(x, f"array<{HIT}>")), lambda x: F.get(x, F.lit(0))["id"].isNotNull())
    return F.coalesce(normal, F.try_element_at(lists, F.lit(1)))


def _shown(c: Column) -> Column:
    """A null prints as the word that the searched text has for it."""
    return F.coalesce(c, F.lit("None"))


def main_grants(payloads: DataFrame, body: str = "body", link: str = "https://grants.example.org/detail/") -> DataFrame:
    """Opportunities of the main API. The searched text has the raw title and synopsis, without the fallbacks."""
    h = payloads.select(F.explode(hits(F.col(body))).alias("h")).select("h.*").where("id is not null")
    return h.select(
        "id", T.first_of(F.col("title"), F.lit("Untitled")).alias("title"), T.first_of(F.col("agency"), F.col("agencyCode")).alias("agency"), T.first_of(F.col("number")).alias("number"),
        T.first_of(F.col("synopsis"), F.col("description")).alias("synopsis"), T.first_of(F.col("closeDate")).alias("close_date"), T.first_of(F.col("openDate")).alias("open_date"), T.first_of(F.col("awardCeiling")).alias("award_ceiling"),
        F.concat(F.lit(link), F.col("id")).alias("link"), F.lower(F.concat(_shown(F.col("title")), F.lit(" "), _shown(F.col("synopsis")))).alias("searchable_text"),
    )


REPORTER = "struct<results:array<struct<appl_id:string,project_title:string,abstract_text:string,foa_number:string,agency_code:string,agency_ic_fundings:array<struct<name:string,abbreviation:string>>,organization:struct<org_name:string>,award_amount:string,project_start_date:string,project_detail_url:string>>>"
FEDERAL = "struct<items:array<struct<projectId:string,projectNumber:string,title:string,abstract:string,agency:string,ic:struct<name:string>,orgName:string,totalCostAmount:string,fy_total_cost:string,budgetStartDate:string>>>"


def _project(rows: DataFrame, key: Column, prefix: str, title: Column, agency: Column, number: Column, text: Column, award: Column, start: Column, link: Column) -> DataFrame:
    about = F.substring(text, 1, 2000)
    return rows.where(key != "").select(
        F.concat(F.lit(prefix), key).alias("id"), title.alias("title"), agency.alias("agency"), number.alias("number"), about.alias("synopsis"), F.lit("").alias("close_date"), start.alias("open_date"), award.alias("award_ceiling"), link.alias("link"),
        F.lower(F.concat_ws(" ", title, text)).alias("searchable_text"),
    )


def reporter_grants(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Projects of the first reporter; the agency is the funding institutes' names, then the code, then NIH."""
    r = payloads.select(F.explode(F.from_json(body, REPORTER)["results"]).alias("r")).select("r.*")
    names = F.array_join(F.filter(F.transform("agency_ic_fundings", lambda x: x["name"]), lambda n: n.isNotNull() & (n != "")), "; ")
    return _project(r, T.first_of(F.col("appl_id")), "nih-reporter-", T.first_of(F.col("project_title"), F.lit("Untitled")), T.first_of(names, F.col("agency_code"), F.lit("NIH")), T.first_of(F.col("foa_number")), T.first_of(F.col("abstract_text")), T.first_of(F.col("award_amount")), F.substring(T.first_of(F.col("project_start_date")), 1, 10), T.first_of(F.col("project_detail_url")))


def federal_grants(payloads: DataFrame, body: str = "body") -> DataFrame:
    r = payloads.select(F.explode(F.from_json(body, FEDERAL)["items"]).alias("r")).select("r.*")
    key = T.first_of(F.col("projectId"), F.col("projectNumber"))
    return _project(r, key, "fed-reporter-", T.first_of(F.col("title"), F.lit("Untitled")), T.first_of(F.col("ic")["name"], F.col("agency")), T.first_of(F.col("projectNumber")), T.first_of(F.col("abstract")), T.first_of(F.col("totalCostAmount"), F.col("fy_total_cost")), F.substring(T.first_of(F.col("budgetStartDate")), 1, 10), F.concat(F.lit("https://reporter.example.org/"), key))


def reporters(first: DataFrame | None, second: DataFrame | None) -> DataFrame | None:
    """Both project sources, each only if it is enabled, that is, given."""
    frames = ([reporter_grants(first)] if first is not None else []) + ([federal_grants(second)] if second is not None else [])
    return frames[0].unionByName(frames[1], allowMissingColumns=True) if len(frames) == 2 else (frames or [None])[0]


# --- keywords of profiles ----------------------------------------------------------------------------------------------------


def distinct_terms(terms: Column, most: int) -> Column:
    """Terms in order without repeats, trimmed, at most so many."""
    t = F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.slice(F.array_distinct(t), 1, most)


# Descriptors that are on many articles whatever their topic.
COMMON_MESH = (
    "humans", "male", "female", "adult", "aged", "animals", "mice", "rats", "child", "adolescent", "middle aged", "young adult",
    "united states", "retrospective studies", "prospective studies", "treatment outcome", "time factors", "follow-up studies",
)
# Words of abstracts that name no topic.
ABSTRACT_STOPS = (
    "with", "that", "this", "from", "have", "been", "they", "their", "which", "will", "also", "more", "than", "when", "some", "into",
    "other", "were", "after", "about", "these", "both", "such", "project", "study", "studies", "using", "used", "based", "results",
    "data", "patients", "clinical", "treatment", "university", "maryland", "grant", "funding", "supported",
)


def topical(terms: Column, most: int) -> Column:
    """Terms in lower case without the common descriptors."""
    return distinct_terms(F.filter(F.transform(terms, lambda x: F.lower(x)), lambda x: ~x.isin(*COMMON_MESH)), most)


def article_terms(xml: Column, most: int = 60) -> Column:
    """Descriptors, then author keywords, each of over three characters, of an article set in XML."""
    every = F.concat(F.xpath(xml, F.lit("//DescriptorName/text()")), F.xpath(xml, F.lit("//Keyword/text()")))
    return topical(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: F.length(x) > 3), most)


def project_terms(terms: Column, abstract: Column, most: int = 60, few: int = 20) -> Column:
    """Terms of over three characters parted by ``|`` or ``;``; words of the abstract only if these are fewer than ``few``."""
    listed = F.filter(F.transform(F.split(F.coalesce(terms, F.lit("")), "[|;]"), lambda x: F.lower(F.trim(x))), lambda x: F.length(x) > 3)
    more = F.when(F.size(listed) < few, T.mined_tokens(F.coalesce(abstract, F.lit("")), ABSTRACT_STOPS)).otherwise(F.array().cast("array<string>"))
    return distinct_terms(F.concat(listed, more), most)


ORCID = "struct<person:struct<keywords:struct<keyword:array<struct<content:string>>>>,`activities-summary`:struct<works:struct<group:array<struct<`work-summary`:array<struct<title:struct<title:struct<value:string>>>>>>>>>"


def orcid_terms(body: Column, most: int = 40, works: int = 10) -> Column:
    """Keywords of a record, or words of its first works' titles."""
    r = F.from_json(body, ORCID)
    kw = F.transform(r["person"]["keywords"]["keyword"], lambda k: k["content"])
    titles = F.transform(F.slice(r["activities-summary"]["works"]["group"], 1, works), lambda g: F.get(g["work-summary"], F.lit(0))["title"]["title"]["value"])
    return F.when(F.size(kw) > 0, distinct_terms(kw, most)).otherwise(F.slice(T.mined_tokens(F.array_join(titles, " ")), 1, most))


PAPERS = "struct<papers:array<struct<year:int,fieldsOfStudy:array<string>,s2FieldsOfStudy:array<struct<category:string>>>>>"


def paper_fields(authors: DataFrame, key: str, as_of_year: int, body: str = "body", years: int = 5, most: int = 30) -> DataFrame:
    """(key, fields): fields of the papers of the last years, the most frequent first."""
    p = authors.select(key, F.explode(F.from_json(body, PAPERS)["papers"]).alias("p")).where(F.col("p.year") >= as_of_year - years)
    fields = F.array_union(F.coalesce("p.fieldsOfStudy", F.array().cast("array<string>")), F.coalesce(F.transform("p.s2FieldsOfStudy", lambda x: x["category"]), F.array().cast("array<string>")))
    counts = p.select(key, F.explode(fields).alias("field")).groupBy(key, "field").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "field"))), lambda x: x["field"]), 1, most).alias("fields"))


TRIALS = "struct<studies:array<struct<protocolSection:struct<contactsLocationsModule:struct<overallOfficials:array<struct<name:string,affiliation:string>>>,conditionsModule:struct<conditions:array<string>>,armsInterventionsModule:struct<interventions:array<struct<name:string,type:string>>>>>>>"


def trial_terms(body: Column, last: Column, affiliation: str, most: int = 40) -> Column:
    """Conditions and interventions, but for type OTHER, of the trials with an official of that last name and affiliation."""
    studies = F.transform(F.from_json(body, TRIALS)["studies"], lambda s: s["protocolSection"])

    def ours(s: Column) -> Column:
        return F.exists(s["contactsLocationsModule"]["overallOfficials"], lambda o: F.contains(F.lower(o["name"]), F.lower(last)) & F.contains(F.lower(o["affiliation"]), F.lit(affiliation.lower())))

    def terms(s: Column) -> Column:
        drugs = F.transform(F.filter(s["armsInterventionsModule"]["interventions"], lambda i: ~i["type"].eqNullSafe("OTHER")), lambda i: i["name"])
        return F.concat(F.coalesce(s["conditionsModule"]["conditions"], F.array().cast("array<string>")), F.coalesce(drugs, F.array().cast("array<string>")))

    return distinct_terms(F.flatten(F.transform(F.filter(studies, ours), terms)), most)


EUROPE = "struct<resultList:struct<result:array<struct<affiliation:string,authorList:struct<author:array<struct<lastName:string,affiliation:string>>>,meshHeadingList:struct<meshHeading:array<struct<descriptorName:string>>>,keywordList:struct<keyword:array<string>>>>>>"


def europe_terms(body: Column, last: Column, affiliation: str, most: int = 60) -> Column:
    """Descriptors and keywords of the papers with an author of that last name, at that affiliation."""
    papers = F.from_json(body, EUROPE)["resultList"]["result"]
    where = F.lit(affiliation.lower())

    def ours(p: Column) -> Column:
        author = F.exists(p["authorList"]["author"], lambda a: (F.lower(a["lastName"]) == F.lower(last)) & F.contains(F.lower(F.coalesce(a["affiliation"], p["affiliation"], F.lit(""))), where))
        return F.coalesce(author, F.lit(False))

    def terms(p: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.concat(F.coalesce(F.transform(p["meshHeadingList"]["meshHeading"], lambda m: m["descriptorName"]), none), F.coalesce(p["keywordList"]["keyword"], none))

    return topical(F.flatten(F.transform(F.filter(papers, ours), terms)), most)
