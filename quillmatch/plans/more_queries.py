"""Registered queries of small operators and of whole sources, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.functions import embed
from quillmatch.functions import score as S
from quillmatch.functions import text as T
from quillmatch.operators import diagnostics as D
from quillmatch.operators import identity as I
from quillmatch.operators import matching as M
from quillmatch.operators import relevance as R
from quillmatch.operators import report as P
from quillmatch.operators import views as V
from quillmatch.plans.adapters import AS_OF, grants, match_lists, matches, profiles, table
from quillmatch.plans.io_queries import _into, _stream, folder
from quillmatch.plans.oracles import GRANTS, PM, P as PROFILES_SQL
from quillmatch.sources import connectors, files, html, payloads, registry
from quillmatch.streaming import cycle as C

NOW = "2024-02-01 00:00:00"


def joined(c):
    return F.array_join(c, "|")


# --- matches and profiles -------------------------------------------------------------------------------------------------------


def run_totals(s, d):
    m = matches(s, d)
    return D.run_totals(m.where("confidence_score >= 25"), m)


def probe_summary(s, d):
    return D.probe_summary(html.probe(table(s, d, "pages")))


def faculty_filters(s, d):
    p = profiles(s, d).withColumn("name", F.upper("name"))
    return V.filter_faculty(p, search="fac", dept="dept-3", source="pubmed").select("name")


def keyword_filter(s, d):
    return V.filter_faculty(profiles(s, d), search="@example", keyword="TH").select("name")


def active_profiles(s, d):
    return I.active(profiles(s, d)).select("name", "department")


def reporter_purge(s, d):
    """Matches of which some have ids, sources and links like the reporters', and some only nearly so."""
    n = F.col("pos") % 7
    m = matches(s, d).select("faculty_name", "match_type", F.concat(F.when(n == 0, "nih-reporter-").when(n == 1, "fed-reporter-").when(n == 2, "x-nih-reporter-").otherwise(""), "grant_id").alias("grant_id"), F.when(n == 3, "NIH RePORTER").when(n == 4, "my reporter").otherwise("x").alias("source"), F.when(n == 5, "https://reporter.nih.gov/project-details/1").when(n == 6, "https://reporter.example.org/1").alias("grant_link"))
    return R.recount(R.purged(m, R.from_reporter()))


def candidate_choice(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("profile"), F.col("event_id").alias("candidate"), F.col("event_id").alias("pos"), F.col("event_type").isin("click", "view").alias("name_ok"), (F.col("event_type") == "view").alias("affiliation_ok"))
    return I.choose_candidate(e)


def repeated_names(s, d):
    """Profiles of which many share a name: the last of each matches."""
    p = profiles(s, d).withColumn("name", F.concat(F.lit("n-"), F.col("pos") % 13))
    return M.last_of_name(p).select("name", "pos")


def screened_grants(s, d):
    return R.screened(grants(s, d), block=("spam", "src13"), allow=("src1", "src2"), vocabulary="licensed|mail", min_hits=2).select("id")


def page_counts(s, d):
    return V.page_counts(table(s, d, "customer"), 40)


def grant_sorts(s, d):
    out, g = None, V.rollup_of_lists(match_lists(s, d), AS_OF)
    for sort in V.GRANT_SORTS:
        v = V.rollup_view(g, sort=sort, per_page=7).select(F.lit(sort).alias("sort"), "grant_id")
        out = v if out is None else out.unionByName(v)
    return out


def faculty_sorts(s, d):
    out = None
    for sort in V.FACULTY_SORTS:
        v = V.faculty_view(profiles(s, d), matches(s, d), sort=sort, per_page=9).select(F.lit(sort).alias("sort"), "name")
        out = v if out is None else out.unionByName(v)
    return out


def diagnostic_report(s, d):
    path = folder(s) + "/reports"
    for day in ("2024-01-29", AS_OF):
        P.write_report(P.report(matches(s, d), day), path)
    r = s.read.schema("run_date string, report string, markdown string").json(path).where(F.col("run_date") == AS_OF)
    get = lambda p: F.get_json_object("report", p)
    return r.select("run_date", get("$.overview.total_matches").cast("long").alias("total"), get("$.overview.unique_faculty").cast("long").alias("profiles"), get("$.violations.below_semantic").cast("long").alias("below"), get("$.top_keywords[0].name").alias("keyword"), get("$.top_keywords[0].n").cast("long").alias("n"), get("$.confidence.max").cast("double").alias("best"), F.contains("markdown", F.concat(F.lit("Matches: "), get("$.overview.total_matches"))).alias("told"))


# --- scalar functions -------------------------------------------------------------------------------------------------------------


def names_and_lists(s, d):
    c, seg = table(s, d, "customer"), F.lower("c_mktsegment")
    name = F.concat(F.lit("Anna Lee"), F.col("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, ", M.D., Ph.D.").otherwise(", MD"))
    old, new = F.array(seg, F.lit("x y")), F.array(F.col("c_mktsegment"), F.col("c_name"), F.lit("X Y"), F.lit("new one"))
    return c.select(
        "c_custkey", T.without_titles(name).alias("plain"), T.author_query(name).alias("author"),
        joined(T.listed(F.concat_ws("; ", "c_name", "c_mktsegment", F.lit("abc")))).alias("listed"), joined(T.listed(F.col("c_name"))).alias("one"),
        joined(T.keyword_line(F.concat(F.lit("KEYWORDS : a, "), "c_mktsegment", F.lit(" ; bc;def")))).alias("keywords"),
        joined(T.merged_keywords(old, new)).alias("merged"), joined(T.merged_sources(F.array(F.lit("A")), F.when(F.col("c_custkey") % 2 == 0, "A").otherwise("B"))).alias("sources"),
        T.highlighted(F.concat(F.lit("In "), seg, F.lit(" (x.y) we trust")), F.array(F.col("c_mktsegment"), F.lit("x.y"))).alias("marked"),
    )


def dates_and_money(s, d):
    o, e = table(s, d, "orders"), F.col("o_orderkey")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (e % 60).cast("int"))
    written = F.when(e % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(e % 4 == 1, F.date_format(day, "MM/dd/yyyy")).when(e % 4 == 2, F.date_format(day, "MMM dd, yyyy")).otherwise("soon")
    days = S.days_left(F.date_format(day, "yyyy-MM-dd"), AS_OF)
    return o.select("o_orderkey", S.close_date(written).cast("string").alias("closes"), S.list_urgency(days).alias("urgency"), S.money_label(F.concat(F.lit("$"), F.format_number(F.floor(F.col("o_totalprice") * 10), 0))).alias("label"))


def ages(s, d):
    e, now = table(s, d, "events"), F.lit(NOW).cast("timestamp")
    at = F.date_trunc("second", F.col("ts").cast("timestamp"))
    return e.select("event_id", S.time_ago(at, now).alias("ago"), S.next_run(at, 168, now).alias("next"))


def health_scores(s, d):
    e, u = table(s, d, "events"), F.col("user_id")
    return e.select("event_id", S.health_score(u % 101, u * 7 % 101, F.when(u % 9 > 0, u % 60), F.when(u % 11 > 0, u * 5 % 300), F.col("event_id") % 20).cast("long").alias("score"))


def hashed_vectors(s, d):
    p = table(s, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    v = embed.embedded(p, "text")
    none = embed.embedded(p, "text", None).where("embedding is null")
    return v.select("p_partkey", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("n"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("up"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).alias("norm")).join(none.select("p_partkey"), "p_partkey")


# --- sources ------------------------------------------------------------------------------------------------------------------------


def source_pages(s, d, kinds) -> DataFrame:
    """A page of each source, with a link for each nation to the source's first pattern, one that lacks it and one that is junk."""
    n = table(s, d, "nation").select("n_nationkey")
    link = F.concat(F.lit('<li><a href="/'), F.col("patterns")[0], "n_nationkey", F.lit('">Opening for nation no. '), "n_nationkey", F.lit("</a> text</li>"))
    each = registry.sources(s, kinds=kinds).select("key", "urls", "patterns", "kind").join(F.broadcast(n), how="cross")  # some tens of sources
    body = each.groupBy("key", "kind", F.element_at("urls", -1).alias("url"), F.col("patterns")[0].alias("p")).agg(F.array_join(F.sort_array(F.collect_list(link)), "").alias("links"))
    more = F.concat(F.lit('<a href="/'), "p", F.lit('9">LEARN MORE</a><a href="/'), "p", F.lit('1">Opening told again</a><a href="/zzz">Opening elsewhere</a><script>'), F.repeat(F.lit("var x = 1;"), 20), F.lit("</script>"), F.when(F.col("kind") == "long", F.repeat(F.lit("<p>some words more</p>"), 80)).otherwise(""))
    return body.select("url", F.concat(F.lit("<html><body><ul>"), "links", F.lit("</ul>"), more, F.lit("</body></html>")).alias("html"))


def registry_scan(s, d):
    found = registry.sources(s, kinds=["scan"])
    return registry.scanned(source_pages(s, d, ["scan"]), found).select("key", "id", "source", "title", "agency", "link", F.md5("searchable_text").alias("searched"))


def portal_scan(s, d):
    """The sources with rules of their own, and how many opportunities each source gives."""
    found = registry.sources(s, kinds=["long", "plain"])
    g = registry.scanned(source_pages(s, d, ["long", "plain"]), found)
    answers = s.createDataFrame([("arpa_h", 200), ("dod_cdmrp", -1)], "source string, status int")
    return registry.counted(g.select("key", "link").distinct(), found, answers)


def table_scan(s, d):
    n = table(s, d, "nation")
    row = F.concat(F.lit('<tr><td><a href="/funding-opportunities/announcement/'), "n_nationkey", F.lit('">'), F.when(F.col("n_nationkey") % 2 == 0, "Open").otherwise("Closed"), F.lit(" Award for "), "n_name", F.lit("</a></td><td>x</td><td>2024-05-"), F.lpad("n_nationkey", 2, "0"), F.lit("</td></tr>"))
    page = n.agg(F.array_join(F.sort_array(F.collect_list(row)), "").alias("rows")).select(F.lit("https://www.pcori.org/funding-opportunities").alias("url"), F.concat(F.lit("<table><tr><th>head</th></tr>"), "rows", F.lit("<tr><td>no link</td></tr></table>")).alias("html"))
    return registry.table_rows(page, registry.sources(s, kinds=["table"])).select("id", "title", "link", "close_date", "synopsis")


def feed_sources(s, d):
    """RSS at a source's second address, Atom at another's first; items with short titles or without links are left out."""
    r = table(s, d, "region")
    rss = F.concat(F.lit("<item><title>Opening in "), "r_name", F.lit("</title><link>https://x.example.org/"), "r_regionkey", F.lit("</link><description>&lt;b&gt;about&lt;/b&gt; it</description></item><item><title>short</title><link>u</link></item>"))
    atom = F.concat(F.lit("<entry><title>Entry in "), "r_name", F.lit('</title><link href="https://y.example.org/'), "r_regionkey", F.lit('"/><summary>told</summary></entry>'))
    urls = {r.key: r.urls for r in registry.sources(s, kinds=["feed"]).collect()}
    all_of = lambda x, head, tail: F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list(x)), ""), F.lit(tail))
    bodies = r.agg(all_of(rss, "<rss><channel>", "</channel></rss>").alias("rss"), all_of(atom, "<feed>", "</feed>").alias("atom"))
    pages = bodies.select(F.inline(F.array(F.struct(F.lit(urls["nsf_funding"][1]).alias("url"), F.col("rss").alias("body")), F.struct(F.lit(urls["nih_guide"][0]).alias("url"), F.col("atom").alias("body")), F.struct(F.lit(urls["nsf_funding"][0]).alias("url"), F.lit("<rss></rss>").alias("body")))))
    return registry.fed(pages, registry.sources(s)).select("key", "id", "title", "link", "synopsis")


def api_sources(s, d):
    """Answers of the three APIs, of which one failed once."""
    n = table(s, d, "nation")
    hit = F.struct(F.concat(F.lit("m"), "n_nationkey").alias("id"), F.col("n_name").alias("title"), F.lit("A").alias("agencyCode"))
    result = F.struct("n_nationkey", F.col("n_nationkey").alias("appl_id"), F.col("n_name").alias("project_title"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.struct(F.lit("I1").alias("name")), F.struct(F.lit("I2").alias("name")))).alias("agency_ic_fundings"), F.when(F.col("n_nationkey") % 4 == 1, "C").alias("agency_code"), F.repeat("n_name", 400).alias("abstract_text"))
    item = F.struct(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("P"), "n_nationkey")).alias("projectId"), F.concat(F.lit("R"), "n_nationkey").alias("projectNumber"), F.col("n_name").alias("title"), F.struct(F.lit("Inst").alias("name")).alias("ic"), F.lit("2024-01-02T00:00:00").alias("budgetStartDate"))
    body = n.agg(F.collect_list(hit).alias("h"), F.collect_list(result).alias("r"), F.collect_list(item).alias("i"))
    a = body.select(F.inline(F.array(
        F.struct(F.lit("main").alias("source"), F.lit(200).alias("status"), F.to_json(F.struct(F.struct(F.col("h").alias("oppHits")).alias("data"))).alias("body")),
        F.struct(F.lit("reporter").alias("source"), F.lit(200).alias("status"), F.to_json(F.struct(F.col("r").alias("results"))).alias("body")),
        F.struct(F.lit("federal").alias("source"), F.lit(200).alias("status"), F.to_json(F.struct(F.col("i").alias("items"))).alias("body")),
        F.struct(F.lit("federal").alias("source"), F.lit(-1).alias("status"), F.lit(None).cast("string").alias("body")),
    )))
    return payloads.api_grants(a).select("source", "id", "title", "agency", "number", "open_date", F.length("synopsis").cast("long").alias("n"))


def department_pages(s, d):
    n, k = table(s, d, "nation"), F.col("n_nationkey")
    who, other = (F.element_at(T.literal_array(x), (k % 3 + 1).cast("int")) for x in (["Jane Roe", "Ann Poe", "Kim Lee"], ["Max Kay", "Jane Roe", "Bob Day"]))
    page = n.select(
        F.concat(F.lit("https://x.edu/"), k).alias("url"),
        F.concat(F.lit("<h1>Dept "), k, F.lit(" | School</h1><p>a"), k, F.lit("@b.edu</p><p>"), who, F.lit(", MD</p><p>Keywords: gene, ab, lung cancer; x"), k, F.lit("</p><p>Search Roe, MD</p><p>Keywords: more"), k, F.lit("</p><div><p>"), other, F.lit(", PhD</p><p>c@d.edu</p><p><a href='/p/"), k, F.lit("'>View full profile</a></p></div>")).alias("html"),
    )
    out = html.department_profiles(page, "url", " | School")
    return out.select("url", "name", "department", "email", joined("keywords").alias("keywords"), "profile_url")


def profile_pages(s, d):
    n, k = table(s, d, "nation"), F.col("n_nationkey")
    page = n.select(k, F.concat(F.when(k % 3 == 0, F.concat(F.lit("<h2>Research Interests:</h2><p>gene therapy "), k, F.lit(", lung cancer</p>"))).otherwise(""), F.when(k % 3 < 2, F.concat(F.lit("<p>Keywords: brain "), k, F.lit(", bone</p>"))).otherwise(""), F.when(k % 3 == 2, F.lit("<p>cardiac tissue</p>")).otherwise("")).alias("html"))
    out = html.profile_keywords(html.lines(page), "n_nationkey")
    return out.select("n_nationkey", "strategy", joined("keywords").alias("keywords"))


def anchors(s, d):
    """Links of the pages as they stand, told one by one."""
    return html.links(table(s, d, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "href", F.md5("title").alias("title"))


def enrichment(s, d):
    p = table(s, d, "part")
    words = F.concat_ws(" ", F.lit("alpha beta with"), "p_name")
    named = lambda c, n: c.alias(n)
    article = F.concat(F.lit("<a><DescriptorName>"), "p_type", F.lit("</DescriptorName><DescriptorName>Mice</DescriptorName><DescriptorName>ab</DescriptorName><Keyword>"), "p_brand", F.lit("</Keyword><Keyword>abc</Keyword></a>"))
    orcid = F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(named(F.col("p_type"), "content")), F.struct(named(F.col("p_type"), "content")), F.struct(named(F.col("p_name"), "content"))).alias("keyword")).alias("keywords")).alias("person")))
    official = F.struct(F.when(F.col("p_size") % 2 == 0, "Dr Jane ROE").otherwise("Jim Poe").alias("name"), F.lit("The School, X").alias("affiliation"))
    study = F.struct(F.struct(F.struct(F.array(official).alias("overallOfficials")).alias("contactsLocationsModule"), F.struct(F.array("p_type").alias("conditions")).alias("conditionsModule"), F.struct(F.array(F.struct(named(F.col("p_name"), "name"), F.lit("DRUG").alias("type")), F.struct(F.lit("chat").alias("name"), F.lit("OTHER").alias("type"))).alias("interventions")).alias("armsInterventionsModule")).alias("protocolSection"))
    paper = F.struct(F.struct(F.array(F.struct(F.when(F.col("p_size") % 2 == 0, "roe").otherwise("Poe").alias("lastName"))).alias("author")).alias("authorList"), F.lit("the school").alias("affiliation"), F.struct(F.array(F.struct(named(F.col("p_type"), "descriptorName")), F.struct(F.lit("Humans").alias("descriptorName"))).alias("meshHeading")).alias("meshHeadingList"), F.struct(F.array("p_name").alias("keyword")).alias("keywordList"))
    return p.select(
        "p_partkey", joined(payloads.article_terms(article)).alias("article"), joined(payloads.project_terms(F.concat_ws("|", "p_type", "p_brand", F.lit("abc")), words)).alias("project"),
        joined(payloads.orcid_terms(orcid)).alias("orcid"), joined(payloads.trial_terms(F.to_json(F.struct(F.array(study).alias("studies"))), F.lit("roe"), "school")).alias("trial"),
        joined(payloads.europe_terms(F.to_json(F.struct(F.struct(F.array(paper).alias("result")).alias("resultList"))), F.lit("Roe"), "school")).alias("europe"),
    )


def paper_fields(s, d):
    p = table(s, d, "part")
    one = F.struct(F.when(F.col("p_size") > 10, 2023).otherwise(2010).alias("year"), F.array("p_type").alias("fieldsOfStudy"), F.array(F.struct(F.col("p_brand").alias("category"))).alias("s2FieldsOfStudy"))
    authors = p.groupBy((F.col("p_partkey") % 20).alias("author")).agg(F.to_json(F.struct(F.collect_list(one).alias("papers"))).alias("body"))
    return payloads.paper_fields(authors, "author", 2024, most=3).select("author", joined("fields").alias("fields"))


# --- state ----------------------------------------------------------------------------------------------------------------------------


def union_of_sources(s, d):
    n, r = table(s, d, "nation").select(F.col("n_nationkey").alias("id"), "n_name"), table(s, d, "region").select(F.col("r_regionkey").alias("id"))
    out, counts = connectors.combined({"n": n, "r": r})
    return out.groupBy("source_key").agg(F.count("n_name").alias("named"), F.sum("id").cast("long").alias("ids")).join(counts, "source_key")


def seen_set(s, d):
    e = table(s, d, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("id"), "event_id")
    seen = I.seen_after(e.where("event_id % 2 = 0").select("id", F.lit("2024-01-01").alias("first_seen")).distinct(), e, "2024-01-02", 40)
    return seen.select("id", "first_seen")


def health_table(s, d):
    path = folder(s) + "/health"
    e = table(s, d, "events").select((F.col("user_id") % 30).cast("string").alias("source"), F.to_date("ts").cast("string").alias("day"), "event_type")
    for day in ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"):
        run = e.where(F.col("day") == day).groupBy("source").agg(F.count_if(F.col("event_type") == "purchase").alias("found"))
        out = files.update_health(run, path, day)
    return out


def files_of_a_run(s, d):
    """Statistics, logs, caches and exports, written and read back."""
    top = folder(s)
    files.upsert_stats(s.createDataFrame([("r1", 5, 2)], "run string, total int, new int"), f"{top}/stats")
    files.upsert_stats(s.createDataFrame([("r2", 7)], "run string, total int"), f"{top}/stats")
    for day, n in (("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-01", 3)):
        files.write_run_log(s.createDataFrame([(day, n)], "run_date string, n int"), f"{top}/log")
    p = profiles(s, d).withColumn("scraped_at", F.lit("2024-01-29T00:00:00"))
    files.replace(p.drop("embedding"), f"{top}/profiles")
    young, old = (files.fresh_profiles(s, f"{top}/profiles", now) for now in ("2024-01-30 00:00:00", "2024-03-01 00:00:00"))
    files.export_csv(table(s, d, "nation"), f"{top}/csv")
    table(s, d, "customer").select(F.concat(F.lit("line "), "c_custkey").alias("value")).coalesce(1).write.text(f"{top}/lines")
    first = files.first_existing(s, [f"{top}/none", f"{top}/csv", f"{top}/log"])
    facts = [
        ("stats", s.read.parquet(f"{top}/stats").select(F.concat_ws(",", "run", "total", "new").alias("v"))),
        ("log", s.read.json(f"{top}/log").agg(F.sum("n").cast("string").alias("v"))),
        ("young", young.agg(F.count("*").cast("string").alias("v"))),
        ("old", s.range(1).select(F.lit(str(old is None).lower()).alias("v"))),
        ("csv", s.read.csv(f"{top}/csv", header=True).agg(F.concat_ws(",", F.count("*"), F.max("n_name")).alias("v"))),
        ("tail", files.log_tail(s, f"{top}/lines", 3).agg(F.count("*").cast("string").alias("v"))),
        ("first", s.range(1).select(F.lit(first.rsplit("/", 1)[1]).alias("v"))),
        ("missing", files.read_or_empty(s, f"{top}/none", "a int", "json").agg(F.count("*").cast("string").alias("v"))),
    ]
    out = None
    for name, f in facts:
        f = f.select(F.lit(name).alias("what"), "v")
        out = f if out is None else out.unionByName(f)
    return out


def stream_daily(s, d):
    e = _stream(s, d, "events")
    return s.read.parquet(_into(s, C.daily(e), "update")).groupBy("day", "event_type").agg(F.max("n").alias("n"))


def choose_rows(s, d):
    n = table(s, d, "nation")
    return D.choose_rows(n.where("false"), n.select("n_nationkey", "n_name", "n_regionkey")).select("n_name")


QUERIES = {
    "run_totals": run_totals, "probe_summary": probe_summary, "faculty_filters": faculty_filters, "keyword_filter": keyword_filter, "active_profiles": active_profiles,
    "reporter_purge": reporter_purge, "candidate_choice": candidate_choice, "repeated_names": repeated_names, "screened_grants": screened_grants, "page_counts": page_counts,
    "grant_sorts": grant_sorts, "faculty_sorts": faculty_sorts, "diagnostic_report": diagnostic_report, "names_and_lists": names_and_lists, "dates_and_money": dates_and_money, "ages": ages,
    "health_scores": health_scores, "hashed_vectors": hashed_vectors, "registry_scan": registry_scan, "portal_scan": portal_scan, "table_scan": table_scan, "feed_sources": feed_sources,
    "api_sources": api_sources, "department_pages": department_pages, "profile_pages": profile_pages, "page_links": anchors, "enrichment": enrichment, "paper_fields": paper_fields,
    "union_of_sources": union_of_sources, "seen_set": seen_set, "health_table": health_table, "files_of_a_run": files_of_a_run, "stream_daily": stream_daily, "choose_rows": choose_rows,
}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


def oracles() -> dict[str, str]:
    by = {r[0]: r for r in registry.SOURCES}
    scans = _values([(r[0], r[1], r[2], "/".join(r[4][-1].split("/", 3)[:3]), r[5][0], r[6] or r[1], r[7]) for r in registry.SOURCES if r[3] == "scan"])
    key = lambda source, title, link: f"'{source}-' || substr(md5('{source}|' || {title} || '|' || {link}), 1, 12)"
    links = "SELECT page_id, html, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href=[^>]*>.*?</a>')) AS a, unnest(range(len(regexp_extract_all(html, '(?is)<a\\s[^>]*href=[^>]*>.*?</a>')))) AS pos FROM pages"
    visible = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?is)<noscript\\b[^>]*>.*?</noscript\\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g')"
    return {
        "run_totals": PM + "SELECT count(*) FILTER (conf >= 25) AS total, count(*) FILTER (conf >= 25 AND match_type = 'keyword') AS keyword, count(*) FILTER (conf >= 25 AND match_type = 'semantic') AS semantic, 0::BIGINT AS both, count(DISTINCT grant_id) FILTER (conf >= 25) AS matched_grants, round(avg(conf) FILTER (conf >= 25), 1) AS avg_confidence, count(*) FILTER (conf >= 60) AS high_confidence, count(*) AS raw, count(*) FILTER (conf < 25) AS suppressed FROM m",
        "probe_summary": f"SELECT CASE WHEN html IS NULL THEN 'failed' WHEN len(regexp_extract_all(html, '(?i)<a [^>]*href')) > 0 THEN 'fine' WHEN length({visible}) < 500 THEN 'script' ELSE 'no links' END AS outcome, count(*) AS n FROM pages GROUP BY 1",
        "faculty_filters": PROFILES_SQL + "SELECT upper(name) AS name FROM f WHERE conv_id % 7 = 3 AND src <> 2",
        "keyword_filter": PROFILES_SQL + "SELECT name FROM f WHERE contains(email, '@example') AND len(list_filter(keywords, lambda k: contains(k, 'th'))) > 0",
        "active_profiles": PROFILES_SQL + "SELECT name, department FROM f WHERE conv_id % 11 <> 10",
        "reporter_purge": PM + "SELECT count(*) AS total, count(DISTINCT CASE WHEN pos % 7 = 2 THEN 'x-nih-reporter-' ELSE '' END || grant_id) AS grants, count(DISTINCT faculty_name) AS faculty, count(*) FILTER (match_type = 'keyword') AS keyword, count(*) FILTER (match_type = 'semantic') AS semantic FROM m WHERE pos % 7 IN (2, 4, 6)",
        "candidate_choice": "SELECT user_id AS profile, coalesce(min(event_id) FILTER (event_type = 'view'), min(event_id)) AS candidate FROM events WHERE event_type IN ('click', 'view') GROUP BY 1",
        "repeated_names": "SELECT 'n-' || conv_id % 13 AS name, max(conv_id) AS pos FROM conversations WHERE role = 'user' GROUP BY 1",
        "screened_grants": f"""WITH {GRANTS}, x AS (SELECT id, number, lower(agency) AS a, lower(title) AS t, lower(trim(title)) AS tt, len(regexp_extract_all(lower(title) || ' ' || searchable_text, '\\b(licensed|mail)\\b')) AS hits FROM g)
SELECT id FROM x WHERE NOT (contains(a, 'spam') OR contains(t, 'spam') OR contains(a, 'src13') OR contains(t, 'src13')) AND (contains(a, 'src1') OR contains(a, 'src2') OR starts_with(number, '93.') OR hits >= 2)""",
        "page_counts": "SELECT count(*) AS total, ceil(count(*) / 40)::BIGINT AS pages FROM customer",
        "grant_sorts": PM + """, r AS (SELECT grant_id, count(*) AS n, coalesce(try_cast(replace(any_value(award_ceiling), '$', '') AS BIGINT), 0) AS award, datediff('day', DATE '2024-01-30', try_cast(any_value(close_date) AS DATE)) AS days, max(conf) AS conf, any_value(timestamp) AS seen FROM m GROUP BY 1),
o AS (SELECT 'faculty' AS sort, grant_id, row_number() OVER (ORDER BY n DESC, grant_id) AS k FROM r UNION ALL SELECT 'award', grant_id, row_number() OVER (ORDER BY award DESC, grant_id) FROM r UNION ALL SELECT 'deadline', grant_id, row_number() OVER (ORDER BY days IS NULL, coalesce(nullif(days, 0), 9999), grant_id) FROM r
 UNION ALL SELECT 'confidence', grant_id, row_number() OVER (ORDER BY conf DESC, grant_id) FROM r UNION ALL SELECT 'recent', grant_id, row_number() OVER (ORDER BY seen DESC, grant_id) FROM r) SELECT sort, grant_id FROM o WHERE k <= 7""",
        "faculty_sorts": PM + """, c AS (SELECT faculty_name AS name, count(*) AS n FROM m GROUP BY 1), x AS (SELECT f.name, n_kw, coalesce(c.n, 0) AS n FROM f LEFT JOIN c USING (name)),
o AS (SELECT 'name' AS sort, name, row_number() OVER (ORDER BY lower(name), name) AS k FROM x UNION ALL SELECT 'keywords', name, row_number() OVER (ORDER BY n_kw DESC, name) FROM x UNION ALL SELECT 'matches', name, row_number() OVER (ORDER BY n DESC, name) FROM x) SELECT sort, name FROM o WHERE k <= 9""",
        "diagnostic_report": PM + """, k AS (SELECT keyword, count(*) AS n FROM (SELECT unnest(keywords) AS keyword FROM m) GROUP BY 1 ORDER BY n DESC, keyword LIMIT 1)
SELECT '2024-01-30' AS run_date, count(*) AS total, count(DISTINCT faculty_name) AS profiles, count(*) FILTER (sim < 0.72) AS below, (SELECT keyword FROM k) AS keyword, (SELECT n FROM k) AS n, max(conf)::DOUBLE AS best, true AS told FROM m""",
        "names_and_lists": """SELECT c_custkey, 'Anna Lee' || c_custkey AS plain, 'Lee' || c_custkey || ' A' AS author, c_name || '|' || c_mktsegment AS listed, '' AS one, c_mktsegment || '|def' AS keywords, lower(c_mktsegment) || '|x y|' || c_name || '|new one' AS merged,
 CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'A|B' END AS sources, 'In <mark>' || lower(c_mktsegment) || '</mark> (<mark>x.y</mark>) we trust' AS marked FROM customer""",
        "dates_and_money": """WITH o AS (SELECT o_orderkey, DATE '2024-01-01' + (o_orderkey % 60)::INT AS day, floor(o_totalprice * 10)::BIGINT AS v FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(day, '%Y-%m-%d') END AS closes, CASE WHEN day < DATE '2024-01-30' THEN 'overdue' WHEN day < DATE '2024-02-13' THEN 'soon' ELSE 'ok' END AS urgency,
 CASE WHEN v >= 1000000 THEN '$' || printf('%.1f', round_even(v / 1000000.0, 1)) || 'M' WHEN v > 0 THEN '$' || round_even(v / 1000.0, 0)::BIGINT || 'K' END AS label FROM o""",
        "ages": f"""WITH e AS (SELECT event_id, epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(ts))::BIGINT AS s FROM events), x AS (SELECT *, 168 * 3600 - s AS rest FROM e)
SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'h' ELSE s // 86400 || 'd' END || ' ago' AS ago,
 CASE WHEN rest <= 0 THEN 'overdue' WHEN rest < 60 THEN rest || 's' WHEN rest < 3600 THEN rest // 60 || 'm' ELSE rest // 3600 || 'h ' || rest % 3600 // 60 || 'm' END AS next FROM x""",
        "health_scores": """WITH x AS (SELECT event_id, user_id % 101 AS kw, user_id * 7 % 101 AS emb, CASE WHEN user_id % 9 > 0 THEN user_id % 60 END AS run, CASE WHEN user_id % 11 > 0 THEN user_id * 5 % 300 END AS scrape, event_id % 20 AS err FROM events)
SELECT event_id, greatest(0, CASE WHEN kw >= 80 THEN 25 WHEN kw >= 50 THEN 15 ELSE 5 END + CASE WHEN emb >= 90 THEN 25 WHEN emb >= 50 THEN 15 WHEN emb > 0 THEN 8 ELSE 0 END + CASE WHEN run < 26 THEN 25 WHEN run < 50 THEN 15 ELSE 0 END
 + CASE WHEN scrape < 170 THEN 25 WHEN scrape < 220 THEN 15 ELSE 0 END - CASE WHEN err > 10 THEN 15 ELSE 0 END)::BIGINT AS score FROM x""",
        "hashed_vectors": f"""WITH w AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name || ' ' || p_brand || ' ' || p_type), '[a-z0-9]+')) AS w FROM part), h AS (SELECT p_partkey, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM w),
v AS (SELECT p_partkey, (h >> 1) % {embed.DIMENSIONS} AS at, sum(CASE WHEN h & 1 = 1 THEN 1 ELSE -1 END) AS v FROM h GROUP BY 1, 2)
SELECT p_partkey, count(*) FILTER (v <> 0) AS n, count(*) FILTER (v > 0) AS up, CASE WHEN count(*) FILTER (v <> 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM v GROUP BY 1""",
        "registry_scan": f"""WITH s(key, name, sid, host, pattern, agency, extra) AS (VALUES {scans}), x AS (SELECT *, 'Opening for nation no. ' || n_nationkey AS title, host || '/' || pattern || n_nationkey AS link FROM s, nation)
SELECT key, replace(lower(sid), ' ', '-') || '-' || substr(md5(sid || '|' || title || '|' || link), 1, 12) AS id, name AS source, title, agency, link, md5(lower(title || ' ' || agency || ' ' || extra)) AS searched FROM x""",
        "portal_scan": "SELECT * FROM (VALUES ('arpa_h', (SELECT count(*) FROM nation)), ('dod_cdmrp', -1::BIGINT)) AS t(key, found)",
        "table_scan": f"""WITH x AS (SELECT n_nationkey, 'Award for ' || n_name AS title, 'https://www.pcori.org/funding-opportunities/announcement/' || n_nationkey AS link FROM nation)
SELECT {key('pcori', 'title', 'link')} AS id, title, link, '2024-05-' || lpad(n_nationkey::VARCHAR, 2, '0') AS close_date, 'PCORI funding opportunity: ' || title || '.' AS synopsis FROM x""",
        "feed_sources": f"""WITH x AS (SELECT 'Opening in ' || r_name AS a, 'https://x.example.org/' || r_regionkey AS u, 'Entry in ' || r_name AS b, 'https://y.example.org/' || r_regionkey AS v FROM region)
SELECT 'nsf_funding' AS key, {key(by['nsf_funding'][2], 'a', 'u')} AS id, a AS title, u AS link, 'about it' AS synopsis FROM x UNION ALL SELECT 'nih_guide', {key(by['nih_guide'][2], 'b', 'v')}, b, v, 'told' FROM x""",
        "api_sources": """SELECT 'main' AS source, 'm' || n_nationkey AS id, n_name AS title, 'A' AS agency, '' AS number, '' AS open_date, 0::BIGINT AS n FROM nation
UNION ALL SELECT 'reporter', 'nih-reporter-' || n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'I1; I2' WHEN n_nationkey % 4 = 1 THEN 'C' ELSE 'NIH' END, '', '', least(2000, 400 * length(n_name)) FROM nation
UNION ALL SELECT 'federal', 'fed-reporter-' || CASE WHEN n_nationkey % 2 = 0 THEN 'P' ELSE 'R' END || n_nationkey, n_name, 'Inst', 'R' || n_nationkey, '2024-01-02', 0 FROM nation""",
        "department_pages": """WITH x AS (SELECT n_nationkey AS k, 'https://x.edu/' || n_nationkey AS url, ['Jane Roe', 'Ann Poe', 'Kim Lee'][n_nationkey % 3 + 1] AS who, ['Max Kay', 'Jane Roe', 'Bob Day'][n_nationkey % 3 + 1] AS other FROM nation)
SELECT url, who || ', MD' AS name, 'Dept ' || k AS department, 'a' || k || '@b.edu' AS email, 'gene|lung cancer' || CASE WHEN k >= 10 THEN '|x' || k ELSE '' END AS keywords, '' AS profile_url FROM x
UNION ALL SELECT url, who || ', MD', 'Dept ' || k, '', 'more' || k, '' FROM x UNION ALL SELECT url, other, 'Dept ' || k, 'c@d.edu', '', 'https://x.edu/p/' || k FROM x""",
        "profile_pages": """SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'interests' WHEN 1 THEN 'keywords' ELSE 'page' END AS strategy, CASE n_nationkey % 3 WHEN 0 THEN 'gene therapy ' || n_nationkey || '|lung cancer' WHEN 1 THEN 'brain ' || n_nationkey || '|bone' ELSE 'cardiac|tissue|cardiac tissue' END AS keywords FROM nation""",
        "page_links": f"""WITH l AS ({links}) SELECT page_id, pos::BIGINT AS pos, regexp_extract(a, '(?is)href="([^"]*)"', 1) AS href, md5(trim(regexp_replace(regexp_replace(regexp_extract(a, '(?is)^<a[^>]*>(.*)</a>$', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))) AS title FROM l""",
        "enrichment": """SELECT p_partkey, array_to_string(list_filter([lower(p_type), lower(p_brand)], lambda x: length(x) > 3), '|') AS article, array_to_string(list_filter(words, lambda x, i: list_position(words, x) = i), '|') AS project, p_type || '|' || p_name AS orcid, CASE WHEN p_size % 2 = 0 THEN p_type || '|' || p_name ELSE '' END AS trial, CASE WHEN p_size % 2 = 0 THEN lower(p_type) || '|' || lower(p_name) ELSE '' END AS europe
FROM (SELECT *, list_filter([lower(p_type), lower(p_brand), 'alpha', 'beta'] || string_split(p_name, ' '), lambda x: length(x) > 3) AS words FROM part)""",
        "paper_fields": """WITH x AS (SELECT p_partkey % 20 AS author, p_type AS field FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey % 20, p_brand FROM part WHERE p_size > 10), c AS (SELECT author, field, count(*) AS n FROM x GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY n DESC, field) AS k FROM c) SELECT author, string_agg(field, '|' ORDER BY k) AS fields FROM r WHERE k <= 3 GROUP BY 1""",
        "union_of_sources": "SELECT 'n' AS source_key, count(n_name) AS named, sum(n_nationkey)::BIGINT AS ids, count(*) AS n FROM nation UNION ALL SELECT 'r', 0, sum(r_regionkey)::BIGINT, count(*) FROM region",
        "seen_set": "WITH x AS (SELECT 'u' || user_id AS id, CASE WHEN bool_or(event_id % 2 = 0) THEN '2024-01-01' ELSE '2024-01-02' END AS first_seen FROM events GROUP BY 1) SELECT * FROM x ORDER BY first_seen DESC, id LIMIT 40",
        "health_table": """WITH r AS (SELECT (user_id % 30)::VARCHAR AS source, ts::DATE::VARCHAR AS day, count(*) FILTER (event_type = 'purchase') AS found FROM events WHERE ts::DATE <= DATE '2024-01-04' GROUP BY 1, 2), h AS (SELECT source, max(day) FILTER (found > 0) AS last_success, sum(found)::BIGINT AS total_found FROM r GROUP BY 1)
SELECT h.source, count(r.day) AS consecutive_zeros, last_success, total_found, count(r.day) >= 3 AS alert FROM h LEFT JOIN r ON r.source = h.source AND (last_success IS NULL OR day > last_success) GROUP BY ALL""",
        "files_of_a_run": PROFILES_SQL + """SELECT * FROM (VALUES ('stats', 'r2,7,2'), ('log', '5'), ('young', (SELECT count(*) FROM f WHERE conv_id % 11 <> 10)::VARCHAR), ('old', 'true'), ('csv', (SELECT count(*) || ',' || max(n_name) FROM nation)), ('tail', '3'), ('first', 'csv'), ('missing', '0')) AS t(what, v)""",
        "stream_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
        "choose_rows": "SELECT n_name FROM nation",
    }
