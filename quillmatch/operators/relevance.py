"""Which opportunities and titles are worth matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions import text as T
from quillmatch.plans import config as C


def relevance(grants: DataFrame, block: Sequence[str] = C.AGENCY_BLOCK, allow: Sequence[str] = C.AGENCY_ALLOW, vocabulary: str = C.VOCABULARY, min_hits: int = 1, word_boundary: bool = False) -> DataFrame:
    """grants with ``is_relevant`` and ``reason``; the first test that decides counts.

    A blocked term in agency or title rejects, even inside a word unless ``word_boundary``; an allowed term in the agency accepts; so
    does a number that begins with 93.; else the text must have enough words of the vocabulary. The reason names
    the first term in list order.
    """
    agency = F.lower(F.trim(F.coalesce("agency", F.lit(""))))
    title = F.lower(F.coalesce("title", F.lit("")))
    text = F.lower(T.first_of(F.col("searchable_text"), F.col("synopsis")))
    if word_boundary:
        hit = F.filter(T.literal_array(block), lambda t: F.exists(F.array(agency, title), lambda c: F.contains(T.padded(T.normalize(c)), T.padded(t))))
    else:
        hit = F.filter(T.literal_array(block), lambda t: F.contains(agency, t) | F.contains(title, t))
    blocked, allowed = F.try_element_at(hit, F.lit(1)), T.first_contained(agency, allow)
    number = T.first_of(F.col("cfda_number"), F.col("number")) if "cfda_number" in grants.columns else F.coalesce("number", F.lit(""))
    hits = F.regexp_count(F.concat(title, F.lit(" "), text), F.lit(rf"(?i)\b({vocabulary})\b"))
    out = grants.withColumn("_b", blocked).withColumn("_a", allowed).withColumn("_n", number)
    out = out.withColumn(
        "reason",
        F.when(F.col("_b").isNotNull(), F.concat(F.lit("blocked: "), F.col("_b")))
        .when(F.col("_a").isNotNull(), F.concat(F.lit("allowed: "), F.col("_a")))
        .when(F.startswith("_n", F.lit("93.")), F.concat(F.lit("number: "), F.col("_n")))
        .when(hits >= min_hits, F.concat(F.lit("vocabulary: "), hits))
        .otherwise("nothing relevant"),
    )
    return out.withColumn("is_relevant", ~F.col("reason").startswith("blocked") & (F.col("reason") != "nothing relevant")).drop("_a", "_b", "_n")


def is_admin_notice(title: Column, prefixes: Sequence[str] = C.ADMIN_PREFIXES) -> Column:
    t = F.lower(F.trim(title))
    return F.exists(T.literal_array(prefixes), lambda p: F.startswith(t, p))


def is_junk_title(title: Column, exact: Sequence[str] = C.JUNK_EXACT, prefixes: Sequence[str] = C.JUNK_PREFIXES, parts: Sequence[str] = C.JUNK_PARTS) -> Column:
    """Titles of navigation and headings: listed ones, and up to four words in capitals."""
    t = F.lower(F.trim(title))
    capitals = (title == F.upper(title)) & (title != F.lower(title)) & (F.size(F.split(F.trim(title), r"\s+")) <= 4)
    return t.isin(*exact) | F.exists(T.literal_array(prefixes), lambda p: F.startswith(t, p)) | F.exists(T.literal_array(parts), lambda p: F.contains(t, p)) | capitals


def screened(grants: DataFrame, **options) -> DataFrame:
    """Opportunities that are relevant and no notices."""
    return relevance(grants, **options).where(F.col("is_relevant") & ~is_admin_notice(F.col("title")))


def screening_counts(grants: DataFrame, **options) -> DataFrame:
    """One row: all, irrelevant and skipped; notices count as both skipped_admin and skipped_irrelevant."""
    r = relevance(grants, **options).withColumn("admin", is_admin_notice(F.col("title")))
    return r.agg(
        F.count("*").alias("n_grants"),
        F.count_if(~F.col("is_relevant") | F.col("admin")).alias("skipped_irrelevant"),
        F.count_if(F.col("is_relevant") & F.col("admin")).alias("skipped_admin"),
    )


# Names of the project reporters as sources, and a part of their links.
REPORTERS = ("NIH RePORTER", "Federal RePORTER")
REPORTER_LINK = "reporter.nih.gov/project-details"


def from_reporter() -> Column:
    """If a row came from the project reporters, by the start of its id, by its source's name or by its link."""
    i, s, u = (F.coalesce(c, F.lit("")) for c in ("grant_id", "source", "grant_link"))
    return i.startswith("nih-reporter-") | i.startswith("fed-reporter-") | s.isin(*REPORTERS) | u.contains(REPORTER_LINK)


def purged(matches: DataFrame, unwanted: Column) -> DataFrame:
    """matches without the unwanted rows; null counts as wanted."""
    return matches.where(~F.coalesce(unwanted, F.lit(False)))


def recount(matches: DataFrame) -> DataFrame:
    return matches.agg(
        F.count("*").alias("total"),
        F.count_distinct("grant_id").alias("grants"),
        F.count_distinct("faculty_name").alias("faculty"),
        F.count_if(F.col("match_type").isin("keyword", "both")).alias("keyword"),
        F.count_if(F.col("match_type").isin("semantic", "both")).alias("semantic"),
    )
