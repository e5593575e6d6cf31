"""A run's diagnostic report as JSON and Markdown, one row for each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions.ship import kept
from quillmatch.operators import diagnostics as D

MOST_KEYWORDS, MOST_PROFILES, MOST_TITLES = 30, 20, 10


def _list(rows: DataFrame, key: str, name: str, most: int | None = None) -> DataFrame:
    """One row with an array of (key, n), the largest first, from a frame (key, n)."""
    few = rows.orderBy(F.desc("n"), key).limit(most) if most else rows
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col(key).cast("string").alias("name"))))
    return few.agg(F.transform(ordered, lambda x: F.struct(x["name"].alias("name"), (-x["less"]).alias("n"))).alias(name))


def _told(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x["name"], F.lit(": "), x["n"])), "\n")


def report(matches: DataFrame, run_date: str, warnings: list[str] = (), semantic: float = 0.72, confidence: float = 0.65) -> DataFrame:
    """(run_date, report, markdown): overview, warnings on settings, quality, distributions, keywords and action items.

    Each part is aggregated to one row by itself; the parts are then joined as single rows. Lists are top-k lists. What is told of profiles and
    of opportunities comes from their counts, which are written once.
    """
    stats = matches.agg(*_spread("similarity_score", "similarity"), *_spread("confidence_score", "confidence"))
    per, grants = kept(D.per_profile(matches)), kept(D.per_grant(matches))
    overview, broken = D.overview_of(per, grants), D.violations(matches, semantic, confidence)
    odd = grants.where(D.suspicious(F.col("grant_title"))).groupBy(F.concat_ws(": ", "grant_id", "grant_title").alias("name")).agg(F.sum("n").alias("n"))
    parts = [
        stats, overview, broken, per.agg(F.coalesce(F.max("n"), F.lit(0)).alias("top_faculty")),
        _list(grants.groupBy(F.coalesce("grant_agency", F.lit("Unknown")).alias("name")).agg(F.sum("n").alias("n")), "name", "by_source", MOST_PROFILES),
        _list(D.profiles_by_count(per), "bucket", "matches_per_faculty"),
        _list(per, "name", "top_profiles", MOST_PROFILES),
        _list(D.keyword_frequency(matches, most=MOST_KEYWORDS), "keyword", "top_keywords"),
        _list(odd, "name", "suspicious_titles", MOST_TITLES),
    ]
    row = matches.sparkSession.range(1).select(F.lit(run_date).alias("run_date"), F.array(*map(F.lit, warnings)).cast("array<string>").alias("warnings"))
    for p in parts:
        row = row.join(F.broadcast(p), how="cross")  # one row each
    items = D.action_items(row.select("total_matches", "suspicious", "below_semantic", "below_confidence", "top_faculty")).agg(F.sort_array(F.collect_list("item")).alias("action_items"))
    row = row.join(F.broadcast(items), how="cross")
    whole = [
        F.struct("total_matches", "unique_faculty", "unique_grants").alias("overview"), "warnings", "similarity", "confidence",
        F.struct("below_semantic", "below_confidence").alias("violations"), "suspicious", "suspicious_titles", "by_source", "matches_per_faculty", "top_profiles", "top_keywords", "action_items",
    ]
    heads = (("Matches by source", _told(F.col("by_source"))), ("Matches for each profile", _told(F.col("matches_per_faculty"))), ("Profiles with most matches", _told(F.col("top_profiles"))), ("Keywords", _told(F.col("top_keywords"))), ("Suspicious titles", _told(F.col("suspicious_titles"))), ("Action items", F.array_join(F.transform("action_items", lambda x: F.concat(F.lit("- "), x)), "\n")))
    top = F.concat(F.lit("# Run of "), F.col("run_date"), F.lit("\n\nMatches: "), "total_matches", F.lit(", profiles: "), "unique_faculty", F.lit(", opportunities: "), "unique_grants")
    markdown = F.concat_ws("\n\n", top, *(F.concat(F.lit(f"## {h}\n\n"), t) for h, t in heads))
    return row.select("run_date", F.to_json(F.struct("run_date", *whole)).alias("report"), markdown.alias("markdown"))


def _spread(column: str, name: str) -> list[Column]:
    c = F.col(column).cast("double")
    return [F.struct(F.min(c).alias("min"), F.max(c).alias("max"), F.round(F.avg(c), 4).alias("mean")).alias(name)]


def write_report(rows: DataFrame, path: str) -> None:
    """A run's report replaces that of its own date alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").json(path)
