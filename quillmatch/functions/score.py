"""Scores, buckets, money and dates as column expressions. Dates are compared with a given day, never with the clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def confidence(kind: Column, idf_sum: Column, title_hits: Column, raw_length: Column, text_length: Column, similarity: Column) -> Column:
    """0 to 99, halves rounded to even.

    Keywords: capped idf sum over 20, plus up to 0.15 for the title and 0.10 for density. Semantic: 0.85 of the similarity. Both:
    1.15 of the better of the two.
    """
    one = F.lit(1.0)
    kw = F.least(F.least(idf_sum / 20, one) + F.least(0.05 * title_hits, F.lit(0.15)) + F.least(5.0 * raw_length / F.greatest(text_length, F.lit(1)), F.lit(0.10)), one)
    combined = F.when(kind == "both", F.greatest(kw, similarity) * 1.15).when(kind == "keyword", kw).otherwise(similarity * 0.85)
    return F.least(F.rint(combined * 100), F.lit(99.0)).cast("int")


def legacy_confidence(stored: Column, score: Column) -> Column:
    return F.coalesce(stored, F.least(score * 8, F.lit(99)))


def display_confidence(kind: Column, stored: Column, similarity: Column) -> Column:
    """Per cent as shown: half and half for both, the similarity for semantic, else the stored score."""
    sim = F.coalesce(similarity, F.lit(0.0))
    return F.rint(F.when(kind == "both", (stored / 100 * 0.5 + sim * 0.5) * 100).when(kind == "semantic", sim * 100).otherwise(stored.cast("double"))).cast("int")


def banded(value: Column, bands: Sequence[tuple[float, str]], other: str) -> Column:
    """The name of the first band whose upper bound is above the value; null for null."""
    out = F.lit(other)
    for bound, name in reversed(bands):
        out = F.when(value < bound, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)


def colour(conf: Column, good: int = 60, fair: int = 35) -> Column:
    return F.when(conf >= good, "high").when(conf >= fair, "medium").otherwise("low")


def floor_to(value: Column, step: int) -> Column:
    return (F.floor(value / step) * step).cast("long")


def money(c: Column) -> Column:
    """Whole dollars from text like ``$1,000``; null if it is no number."""
    return F.regexp_replace(c, "[$,]", "").try_cast("bigint")


def money_label(c: Column) -> Column:
    """Millions with one decimal, else thousands; halves rounded to even, as the sum's own digits say and not those of a quotient."""
    v = money(c)
    millions = F.replace(F.format_number(F.rint(v / 100_000) / 10, 1), F.lit(","), F.lit(""))
    return F.when(v >= 1_000_000, F.concat(F.lit("$"), millions, F.lit("M"))).when(v > 0, F.concat(F.lit("$"), F.rint(v / 1000).cast("long").cast("string"), F.lit("K")))


AWARD_BANDS = ((100_000, "<100K"), (500_000, "100K-500K"), (1_000_000, "500K-1M"), (5_000_000, "1M-5M"))
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "MMM dd, yyyy")


def close_date(c: Column) -> Column:
    """A date in any of the formats, or with a time after an ISO date."""
    tries = [F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in DATE_FORMATS]
    return F.coalesce(iso_date(c), *tries)


def iso_date(c: Column) -> Column:
    return F.to_date(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")))


def days_left(c: Column, as_of: str) -> Column:
    return F.datediff(iso_date(c), F.lit(as_of).cast("date"))


def urgency(days: Column) -> Column:
    return F.when(days.isNull(), "none").when(days < 0, "closed").when(days <= 7, "critical").when(days <= 21, "warning").otherwise("ok")


def list_urgency(days: Column) -> Column:
    return F.when(days < 0, "overdue").when(days < 14, "soon").otherwise("ok")


def mail_deadline(days: Column) -> Column:
    return F.when(days.isNull(), "unknown").when(days < 0, "closed").when(days == 0, "today").when(days <= 7, "week").when(days <= 30, "month").otherwise("later")


def time_ago(at: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(at)
    n = F.when(s < 60, s).when(s < 3600, F.floor(s / 60)).when(s < 86400, F.floor(s / 3600)).otherwise(F.floor(s / 86400)).cast("long")
    return F.concat(n.cast("string"), F.when(s < 60, "s").when(s < 3600, "m").when(s < 86400, "h").otherwise("d"), F.lit(" ago"))


def next_run(last: Column, hours: int, now: Column) -> Column:
    s = F.unix_timestamp(last) + hours * 3600 - F.unix_timestamp(now)
    h, m = F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string")
    return F.when(s <= 0, "overdue").when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(m, F.lit("m"))).otherwise(F.concat(h, F.lit("h "), m, F.lit("m")))


def health_score(kw_pct: Column, emb_pct: Column, run_hours: Column, scrape_hours: Column, errors: Column) -> Column:
    """0 to 100 of four parts of 25, by coverage and age, less 15 for more than ten errors; a missing age counts as old."""
    kw = F.when(kw_pct >= 80, 25).when(kw_pct >= 50, 15).otherwise(5)
    emb = F.when(emb_pct >= 90, 25).when(emb_pct >= 50, 15).when(emb_pct > 0, 8).otherwise(0)
    run = F.when(run_hours < 26, 25).when(run_hours < 50, 15).otherwise(0)
    scrape = F.when(scrape_hours < 170, 25).when(scrape_hours < 220, 15).otherwise(0)
    return F.greatest(F.lit(0), kw + emb + run + scrape - F.when(errors > 10, 15).otherwise(0))
