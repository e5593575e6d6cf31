"""The external sources as rows, and what each kind of source makes of its pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.functions import text as T
from quillmatch.operators.relevance import is_junk_title
from quillmatch.sources import feeds, html

COLUMNS = ("key", "name", "source_id", "kind", "urls", "patterns", "agency", "extra")

# Key, name, id prefix, kind, urls in order of trial, link patterns, agency (empty: the name), words added to the searched text.
SOURCES = (
    ("nih_guide", "NIH Guide", "nih-guide", "feed", ("https://grants.nih.gov/grants/guide/newsfeed/fundingopps.xml",), (), "National Institutes of Health", ""),
    ("nsf_funding", "NSF", "nsf", "feed", ("https://www.nsf.gov/rss/rss_www_funding_pgm_annc_inf.xml", "https://www.nsf.gov/rss/rss_www_funding.xml"), (), "National Science Foundation", ""),
    ("pnd_rfps", "Philanthropy News Digest", "pnd", "feed", ("https://philanthropynewsdigest.org/rfps/feed", "https://philanthropynewsdigest.org/feeds/rfps"), ("/rfps/",), "", ""),
    ("arpa_h", "ARPA-H", "arpa-h", "long", ("https://arpa-h.gov/explore-funding/open-funding-opportunities", "https://arpa-h.gov/research-and-funding"), ("sam.gov", "/programs/", "iso", "solicitation"), "Advanced Research Projects Agency for Health", "biomedical health research"),
    ("dod_cdmrp", "DoD CDMRP", "cdmrp", "plain", ("https://cdmrp.army.mil/funding/prgdefault", "https://www.usamraa.army.mil/Pages/Resources.aspx"), ("funding", "program"), "Department of Defense CDMRP", "military medical research"),
    ("burroughs_wellcome", "Burroughs Wellcome Fund", "bwf", "scan", ("https://www.bwfund.org/funding-opportunities/",), ("bwfund.org/funding-opportunities/", "bwfund.org/grant"), "", "biomedical career award seed grant"),
    ("hhmi", "HHMI", "hhmi", "scan", ("https://www.hhmi.org/programs",), ("hhmi.org/programs/", "hhmi.org/science/"), "Howard Hughes Medical Institute", "biomedical research fellowship investigator"),
    ("aha", "American Heart Association", "aha", "scan", ("https://professional.heart.org/en/research-programs",), ("research-programs/", "funding-opportunities", "heart.org/en/research", "professional.heart.org/en/research"), "American Heart Association", "cardiovascular heart research grant"),
    ("acs", "American Cancer Society", "acs", "scan", ("https://www.cancer.org/research/we-fund-cancer-research/apply-research-grant.html",), ("apply-research-grant", "grant-types", "cancer.org/research/"), "American Cancer Society", "cancer research grant oncology"),
    ("damon_runyon", "Damon Runyon", "damon-runyon", "scan", ("https://www.damonrunyon.org/for-scientists",), ("award", "fellowship", "grant", "for-scientists/"), "Damon Runyon Cancer Research Foundation", "cancer research fellowship"),
    ("alexs_lemonade", "Alex's Lemonade Stand", "alexs-lemonade", "scan", ("https://www.alexslemonade.org/researchers-reviewers/applicants",), ("grant", "award", "researchers-reviewers"), "Alex's Lemonade Stand Foundation", "childhood pediatric cancer research"),
    ("doris_duke", "Doris Duke Foundation", "doris-duke", "scan", ("https://www.dorisduke.org/grants/",), ("dorisduke.org/grants/", "dorisduke.org/programs/"), "Doris Duke Foundation", "biomedical clinical research"),
    ("rwjf", "RWJF", "rwjf", "scan", ("https://www.rwjf.org/en/grants/active-funding-opportunities.html",), ("rwjf.org/en/grants/active-funding", "rwjf.org/en/grants/grant"), "Robert Wood Johnson Foundation", "health equity public health research"),
    ("keck", "W.M. Keck Foundation", "keck", "scan", ("https://www.wmkeck.org/research-application-process/",), ("wmkeck.org/research", "wmkeck.org/socal", "wmkeck.org/our-focus"), "", "science engineering medical research"),
    ("beckman", "Beckman Foundation", "beckman", "scan", ("https://www.beckman-foundation.org/programs/",), ("beckman-foundation.org/programs/", "beckman-foundation.org/award"), "Arnold & Mabel Beckman Foundation", "chemistry biomedical instrumentation"),
    ("march_of_dimes", "March of Dimes", "march-of-dimes", "scan", ("https://www.marchofdimes.org/research",), ("marchofdimes.org/research/", "marchofdimes.org/grants"), "", "maternal infant prematurity birth defects"),
    ("alzheimers_assoc", "Alzheimer's Association", "alz", "scan", ("https://www.alz.org/research/for_researchers",), ("alz.org/research/", "alz.org/grants", "alz.org/professionals", "alz.org/science/"), "", "alzheimer dementia neurodegenerative research"),
    ("aacr", "AACR", "aacr", "scan", ("https://www.aacr.org/professionals/research-funding/",), ("aacr.org/professionals/research-funding/", "aacr.org/grants", "aacr.org/professionals/volunteer"), "American Association for Cancer Research", "cancer research grant fellowship oncology"),
    ("simons", "Simons Foundation", "simons", "scan", ("https://www.simonsfoundation.org/funding-opportunities/",), ("simonsfoundation.org/funding", "simonsfoundation.org/grant"), "", "mathematics neuroscience basic science"),
    ("czi", "CZI", "czi", "scan", ("https://chanzuckerberg.com/science/science-funding/",), ("chanzuckerberg.com/rfa/", "chanzuckerberg.com/science/"), "Chan Zuckerberg Initiative", "biomedical imaging single cell rare disease"),
    ("gates", "Gates Foundation", "gates", "scan", ("https://www.gatesfoundation.org/about/how-we-work/grant-opportunities",), ("gatesfoundation.org/about/how-we-work/grant", "gatesfoundation.org/ideas/", "gatesfoundation.org/about/committed-grants/"), "Bill & Melinda Gates Foundation", "global health infectious disease vaccine"),
    ("wellcome_trust", "Wellcome Trust", "wellcome", "scan", ("https://wellcome.org/grant-funding/schemes",), ("wellcome.org/grant-funding/", "wellcome.org/what-we-do/", "wellcome.org/funding/"), "", "biomedical infectious disease mental health UK"),
    ("koch_foundation", "David H. Koch Foundation", "koch", "scan", ("https://www.kochfoundation.org/apply/",), ("kochfoundation.org/apply", "kochfoundation.org/grant"), "", "cancer research medical science"),
    ("yield_giving", "Yield Giving", "yield-giving", "scan", ("https://yieldgiving.com/",), ("yieldgiving.com/",), "", "philanthropy research education health"),
    ("proposal_central", "ProposalCentral", "proposal-central", "scan", ("https://proposalcentral.com/GrantOpportunities.asp",), ("GrantOpportunity", "proposalcentral.com/"), "", "biomedical research grant"),
    ("science_philanthropy_alliance", "Science Philanthropy Alliance", "spa", "scan", ("https://sciencephilanthropyalliance.org/funding-opportunities/", "https://sciencephilanthropyalliance.org/what-we-do/"), ("sciencephilanthropyalliance.org/", "funding", "opportunity"), "", "basic science research funding"),
    ("pcori", "PCORI", "pcori", "table", ("https://www.pcori.org/funding-opportunities",), ("/funding-opportunities/announcement/",), "PCORI", "PCORI patient-centered outcomes research comparative clinical effectiveness CER"),
    ("stanford_rmg", "Stanford Medicine RMG", "stanford-rmg", "scan", ("https://med.stanford.edu/rmg/funding.html",), ("med.stanford.edu/rmg/", "stanford.edu/funding"), "Stanford Medicine", "clinical translational research funding"),
    ("ucla_dgsom", "UCLA DGSOM", "ucla-dgsom", "scan", ("https://medschool.ucla.edu/research/research-funding",), ("medschool.ucla.edu/research/", "ucla.edu/funding"), "", "clinical biomedical research funding"),
    ("miami_miller", "Miami Miller SOM", "miami-miller", "scan", ("https://med.miami.edu/research/funding-opportunities",), ("med.miami.edu/research/", "miami.edu/funding"), "", "clinical biomedical research funding"),
    ("aamc_grants", "AAMC Grants", "aamc", "scan", ("https://www.aamc.org/learn-network/affinity-groups/group-educational-affairs/grants-medical-educators",), ("aamc.org/learn-network/", "aamc.org/career-development/", "aamc.org/about-us/mission"), "AAMC", "medical education research grant"),
)

# Words of links that call for action, on pages of the kind ``long``.
CALLS = ("learn more", "sign up", "subscribe", "contact")
#: A page of the kind ``long`` with no more visible characters is rendered by script.
LONG = 1000


def sources(spark: SparkSession, include: Sequence[str] = (), exclude: Sequence[str] = (), kinds: Sequence[str] = (), rows: Sequence[tuple] = SOURCES) -> DataFrame:
    """(rank, key, name, source_id, kind, urls, patterns, agency, extra) of the sources to read, in their order."""
    out = spark.createDataFrame([(i, *r[:4], list(r[4]), list(r[5]), *r[6:]) for i, r in enumerate(rows)], "rank int, key string, name string, source_id string, kind string, urls array<string>, patterns array<string>, agency string, extra string")
    for keep, column, values in ((True, "key", include), (False, "key", exclude), (True, "kind", kinds)):
        if values:
            hit = F.col(column).isin(*values)
            out = out.where(hit if keep else ~hit)
    return out


def requests(found: DataFrame) -> list[dict]:
    """A request for each url of the sources, some tens of rows, for ``connectors.fetch``."""
    return [{"source": r.key, "url": u} for r in found.orderBy("rank").collect() for u in r.urls]


def grants_of(rows: DataFrame, synopsis=None) -> DataFrame:
    """Opportunities from rows with title, link, close_date and the source's columns; an empty agency is the source's name."""
    agency = T.first_of(F.col("agency"), F.col("name"))
    about = F.lit("") if synopsis is None else F.substring(synopsis, 1, 2000)
    searched = F.lower(F.array_join(F.filter(F.array(F.col("title"), about, agency, F.col("extra")), lambda x: x != ""), " "))
    return rows.select(
        "key", T.surrogate_key(F.col("source_id"), F.col("title"), F.col("link")).alias("id"), F.col("name").alias("source"), "title", agency.alias("agency"), "link", "close_date", about.alias("synopsis"), searched.alias("searchable_text"),
    )


def first_url(rows: DataFrame) -> DataFrame:
    """Of each source the rows of its first url, by the order of trial, that has any."""
    first = rows.groupBy("key").agg(F.min("nth").alias("nth"))
    return rows.join(first, ["key", "nth"], "left_semi")


def scanned(pages: DataFrame, found: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Opportunities of fetched pages (url, html) of sources of the kinds scan, long and plain.

    All anchors with a pattern of the source in their href and a title of ten characters or more count. The kind scan also drops
    junk, skip words and links to the page itself, and takes a link once; long needs a page with text and drops calls for
    action. The first url of a source that gives something is taken; of plain sources the first that answered.
    """
    urls = found.where(F.col("kind").isin("scan", "long", "plain")).select("*", F.posexplode("urls").alias("nth", "url"))
    here = pages.select("url", "html").where("html is not null").join(urls, "url")
    facts = html.facts(here)
    told = html.links(facts.where((F.col("kind") != "long") | (F.col("visible") > LONG)))
    href, title = F.lower("href"), F.col("title")
    told = told.where(F.exists("patterns", lambda p: F.contains(href, F.lower(p))) & (F.length(title) >= 10))
    skipped = F.exists(T.literal_array(html.SKIP_WORDS), lambda w: F.contains(F.lower(title), w)) | is_junk_title(title) | (F.col("link") == F.col("url"))
    called = F.exists(T.literal_array(CALLS), lambda w: F.contains(F.lower(title), w))
    told = told.where(((F.col("kind") != "scan") | ~skipped) & ((F.col("kind") != "long") | ~called))
    told = told.withColumn("_n", F.expr("row_number() over (partition by url, link order by pos)")).where("kind <> 'scan' or _n = 1").drop("_n")
    answered = first_url(here.where("kind = 'plain'").select("key", "nth").distinct())
    told = first_url(told.where("kind <> 'plain'")).unionByName(told.where("kind = 'plain'").join(answered, ["key", "nth"], "left_semi"))
    out = grants_of(told.withColumn("close_date", F.lit("")))
    return out.join(seen.select("id"), "id", "left_anti") if seen is not None else out


def table_rows(pages: DataFrame, found: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Opportunities of sources of the kind table: the link in a row's first cell, status words taken off, the deadline in the third cell."""
    urls = found.where("kind = 'table'").select("*", F.explode("urls").alias("url"))
    told = html.cells(pages.select("url", "html").join(urls, "url"))
    told = told.where(F.exists("patterns", lambda p: F.contains("href", p)) & (F.length("title") >= 10)).withColumn("title", html.without_status(F.col("title")))
    told = told.where(~is_junk_title(F.col("title"))).withColumn("close_date", F.coalesce(F.get("cells", F.lit(2)), F.lit("")))
    about = F.concat(F.col("name"), F.lit(" funding opportunity: "), F.col("title"), F.lit("."))
    out = grants_of(told, about)
    return out.join(seen.select("id"), "id", "left_anti") if seen is not None else out


def fed(bodies: DataFrame, found: DataFrame, min_title: int = 10) -> DataFrame:
    """Opportunities of feed sources from fetched bodies (url, body): the first url of a source with items is taken."""
    urls = found.where("kind = 'feed'").select("*", F.posexplode("urls").alias("nth", "url"))
    items = feeds.feed_items(bodies.join(urls.select("url").distinct(), "url", "left_semi"), "url", "body", min_title)
    told = first_url(items.join(urls, "url")).withColumn("close_date", F.lit(""))
    return grants_of(told, T.collapse(T.strip_tags(F.col("description"))))


def all_grants(pages: DataFrame, found: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Opportunities of every source from its fetched pages (url, html); a source without pages gives none and hurts no other."""
    out = scanned(pages, found, seen).unionByName(table_rows(pages, found, seen))
    return out.unionByName(fed(pages.withColumnRenamed("html", "body"), found))


def counted(grants: DataFrame, found: DataFrame, answers: DataFrame) -> DataFrame:
    """(key, found) for every source: its number of opportunities, -1 if none of its requests (source, status) was answered."""
    n = grants.groupBy("key").agg(F.count("*").alias("n"))
    ok = answers.where("status = 200").select(F.col("source").alias("key")).distinct().withColumn("ok", F.lit(True))
    return found.select("rank", "key").join(n, "key", "left").join(ok, "key", "left").select("key", F.when(F.col("ok"), F.coalesce("n", F.lit(0))).otherwise(-1).cast("long").alias("found"))
