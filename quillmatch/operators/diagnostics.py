"""Diagnostics of runs: statistics of matches and metrics of text logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions import text as T

HISTOGRAM = (20, 25, 30, 35, 40, 45, 50, 60, 70, 80)
NAVIGATION = r"(?i)\b(home|menu|navigation|search results|page \d|login|sign in|about us|contact)\b"


def confidence_histogram(matches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Matches at or above each bound before any filter, and the mean."""
    c = F.col("confidence_score")
    return matches.groupBy(*by).agg(*(F.count_if(c >= x).alias(f"ge_{x}") for x in HISTOGRAM), F.round(F.avg(c), 1).alias("mean"))


def run_totals(matches: DataFrame, raw: DataFrame) -> DataFrame:
    """One row: matches by type, before filters and suppressed, matched opportunities, mean and high confidence."""
    t, c = F.col("match_type"), F.col("confidence_score")
    now = matches.agg(
        F.count("*").alias("total"),
        F.count_if(t.isin("keyword", "both")).alias("keyword"),
        F.count_if(t.isin("semantic", "both")).alias("semantic"),
        F.count_if(t == "both").alias("both"),
        F.count_distinct("grant_id").alias("matched_grants"),
        F.round(F.avg(c), 1).alias("avg_confidence"),
        F.count_if(c >= 60).alias("high_confidence"),
    )
    return now.join(F.broadcast(raw.agg(F.count("*").alias("raw"))), how="cross").withColumn("suppressed", F.col("raw") - F.col("total"))  # one row each


def breakdown_by_source(grants: DataFrame) -> DataFrame:
    """Distinct opportunities of each source; the agency stands in for a missing source."""
    return grants.select("id", T.first_of(F.col("source"), F.col("agency")).alias("source")).distinct().groupBy("source").agg(F.count("*").alias("n"))


def position_stats(df: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """count, min, max, mean and the values at positions n/4, n/2 and 3n/4 of the sorted values, without interpolation.

    Equal values are counted first, so what is ranked is no longer than the values are many; nulls are left out.
    """
    keys = list(by)
    counts = df.select(*keys, value.alias("v")).where("v is not null").groupBy(*keys, "v").agg(F.count("*").alias("c"))
    part = f"partition by {', '.join(keys)}" if keys else ""
    ranked = counts.withColumn("upto", F.expr(f"sum(c) over ({part} order by v)")).withColumn("n", F.expr(f"sum(c) over ({part})"))

    def at(k: str) -> Column:
        return F.min(F.when(F.col("upto") > F.expr(f"{k} div 4"), F.col("v")))

    return ranked.groupBy(*keys).agg(
        F.max("n").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"), (F.sum(F.col("v") * F.col("c")) / F.max("n")).alias("mean"),
        at("n").alias("p25"), at("2 * n").alias("p50"), at("3 * n").alias("p75"),
    )


def matches_per_faculty(matches: DataFrame) -> DataFrame:
    """Number of profiles by their number of matches, in steps of five."""
    return profiles_by_count(per_profile(matches))


def per_profile(matches: DataFrame) -> DataFrame:
    return matches.groupBy(F.col("faculty_name").alias("name")).agg(F.count("*").alias("n"))


def per_grant(matches: DataFrame) -> DataFrame:
    """Matches of each opportunity with its title and agency, which then are looked at once and not for each match."""
    return matches.groupBy("grant_id", "grant_title", "grant_agency").agg(F.count("*").alias("n"))


def profiles_by_count(per: DataFrame) -> DataFrame:
    """``matches_per_faculty`` of ``per_profile``."""
    low = (F.floor(F.col("n") / 5) * 5).cast("long")
    return per.groupBy(F.concat(low, F.lit("-"), low + 4).alias("bucket")).agg(F.count("*").alias("n"))


def keyword_frequency(rows: DataFrame, column: str = "matched_keywords", most: int = 30) -> DataFrame:
    """Most frequent keywords of lists, or of strings parted by commas."""
    c = F.col(column)
    items = c if "array" in dict(rows.dtypes)[column] else F.filter(F.transform(F.split(c, ","), lambda k: F.trim(k)), lambda k: k != "")
    return rows.select(F.explode(items).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(most)


def suspicious(title: Column) -> Column:
    """If a title looks like navigation."""
    return F.rlike(title, F.lit(NAVIGATION))


def violations(matches: DataFrame, semantic: float = 0.72, confidence: float = 0.65) -> DataFrame:
    """Matches below the expected bounds; keyword matches have similarity 0, and bounds of another scale find nothing."""
    return matches.agg(F.count_if(F.col("similarity_score") < semantic).alias("below_semantic"), F.count_if(F.col("confidence_score") < confidence).alias("below_confidence"))


def overview(matches: DataFrame) -> DataFrame:
    return overview_of(per_profile(matches), per_grant(matches))


def overview_of(profiles: DataFrame, grants: DataFrame) -> DataFrame:
    """``overview`` of ``per_profile`` and ``per_grant``."""
    n = F.col("n")
    g = grants.agg(F.coalesce(F.sum(n), F.lit(0)).alias("total_matches"), F.count_distinct("grant_id").alias("unique_grants"), F.coalesce(F.sum(F.when(suspicious(F.col("grant_title")), n)), F.lit(0)).alias("suspicious"))
    one = g.join(F.broadcast(profiles.agg(F.count("name").alias("unique_faculty"))), how="cross")  # one row each
    return one.select("total_matches", "unique_faculty", "unique_grants", "suspicious")


def stale_embeddings(faculty: DataFrame, version: int) -> DataFrame:
    return faculty.agg(F.count_if(F.col("embedding").isNull() | (F.coalesce("embedding_version", F.lit(0)) != version)).alias("stale"), F.count("*").alias("total"))


# How a run's log says its numbers.
METRICS = {
    "total_faculty_processed": r"(?i)Processing (\d+) faculty",
    "total_grants_scraped": r"(?i)Scraped (\d+) grants?",
    "total_matches_raw": r"(?i)(\d+) raw matches?",
    "total_matches_after_filter": r"(?i)(\d+) matches? after filter",
}


def log_metrics(lines: DataFrame, metrics: dict[str, str] = METRICS) -> DataFrame:
    """(metric, value): the last line's value of each metric. lines has line_no and value."""
    one = [F.struct(F.lit(k).alias("metric"), F.regexp_extract("value", r, 1).alias("v")) for k, r in metrics.items()]
    found = lines.select("line_no", F.inline(F.array(*one))).where("v <> ''")
    return found.groupBy("metric").agg(F.max_by("v", "line_no").cast("long").alias("value"))


def drop_reasons(lines: DataFrame) -> DataFrame:
    """What lines give as reasons for drops; a line that tells of a threshold counts as below_threshold too."""
    told = F.trim(F.regexp_extract("value", r"(?i)dropped.*?:\s+(.+)", 1))
    reasons = F.array(F.when(told != "", told), F.when(F.rlike("value", F.lit(r"(?i)below.*?threshold")), F.lit("below_threshold")))
    return lines.select(F.explode(reasons).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def error_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.rlike("value", F.lit("(?i)(error|exception|failed)")))


def filter_logs(lines: DataFrame, level: str = "all", module: str = "all", search: str = "", most: int = 200) -> DataFrame:
    """The last lines of a module with a substring; level errors takes errors and warnings."""
    out = lines
    if level == "errors":
        out = out.where(F.contains("value", F.lit("[ERROR]")) | F.contains("value", F.lit("[WARNING]")))
    if module != "all":
        out = out.where(F.contains("value", F.lit(f"] {module}:")))
    if search:
        out = out.where(F.contains(F.lower("value"), F.lit(search.lower())))
    return out.orderBy(F.desc("line_no")).limit(most)


def log_modules(lines: DataFrame) -> DataFrame:
    return lines.select(F.regexp_extract("value", r"\[\w+\]\s+([\w.]+):", 1).alias("module")).where("module <> ''").distinct()


def pass_status(lines: DataFrame, passes: int = 7) -> DataFrame:
    """(pass, status) by the last line that has ``Pass k/`` or ``Pass k:``; unknown if none has."""
    v = F.lower("value")
    hit = lines.select("line_no", F.regexp_extract("value", r"Pass (\d+)[/:]", 1).try_cast("int").alias("pass"), v.alias("v")).where("pass is not null")
    status = F.when(F.contains("v", F.lit("complete")) | F.contains("v", F.lit("✓")), "complete").when(F.contains("v", F.lit("error")) | F.contains("v", F.lit("failed")), "error").when(F.contains("v", F.lit("skipping")), "skipped").otherwise("running")
    last = hit.groupBy("pass").agg(F.max_by(status, "line_no").alias("status"))
    every = lines.sparkSession.range(1, passes + 1).select(F.col("id").cast("int").alias("pass"))
    return every.join(last, "pass", "left").select("pass", F.coalesce("status", F.lit("unknown")).alias("status"))


def probe_summary(probes: DataFrame) -> DataFrame:
    """Counts of source probes (status, links, visible) by outcome: fine, no links, rendered by script, failed."""
    outcome = F.when(F.coalesce("status", F.lit(0)) != 200, "failed").when(F.col("links") > 0, "fine").when(F.col("visible") < 500, "script").otherwise("no links")
    return probes.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def choose_rows(db: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of the database, or those of the run log if the database has none."""
    return log if db.isEmpty() else db


def action_items(stats: DataFrame) -> DataFrame:
    """(area, item) by rules over one row of ``overview``, ``violations`` and ``top_faculty``; one row if there is nothing to do."""
    rules = [
        ("VOLUME", "unusually many matches", F.col("total_matches") > 500),
        ("VOLUME", "no matches", F.col("total_matches") == 0),
        ("FILTER", "matches below the semantic threshold", F.col("below_semantic") > 0),
        ("FILTER", "matches below the confidence threshold", F.col("below_confidence") > 0),
        ("SCRAPER", "navigation titles", F.col("suspicious") > 0),
        ("QUALITY", "one profile has over 50 matches", F.col("top_faculty") > 50),
    ]
    found = F.filter(F.array(*(F.when(hit, F.struct(F.lit(s).alias("area"), F.lit(t).alias("item"))) for s, t, hit in rules)), lambda x: x.isNotNull())
    clean = F.array(F.struct(F.lit("").alias("area"), F.lit("no action items").alias("item")))
    return stats.select(F.inline(F.when(F.size(found) > 0, found).otherwise(clean)))


def config_drift(have: dict, semantic: float = 0.72, confidence: float = 0.65) -> list[str]:
    """Settings of a run below what is expected, or filters that are off; a missing setting is no drift."""
    out = [k for k, least in (("semantic_threshold", semantic), ("min_confidence", confidence)) if have.get(k) is not None and have[k] < least]
    return out + [k for k in ("use_idf", "relevance_filter", "active_only") if have.get(k) is False]
