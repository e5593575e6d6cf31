"""Deduplication, seen sets, snapshots and state that outlives a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles in the order of ``pos``, the first of each identity.

    A row with an email is known by it alone: it goes if an earlier row has the email. A row without goes if its name
    was that of an earlier row that stayed or came without email.
    """
    p = profiles.withColumn("_e", F.lower(F.trim(F.coalesce("email", F.lit("")))))
    with_email = p.where("_e <> ''").withColumn("_n", F.expr("row_number() over (partition by _e order by pos)")).where("_n = 1").drop("_n")
    without = p.where("_e = ''").withColumn("_n", F.expr("row_number() over (partition by name order by pos)")).where("_n = 1").drop("_n")
    first = with_email.groupBy("name").agg(F.min("pos").alias("_first"))
    without = without.join(first, "name", "left").where("_first is null or _first > pos").drop("_first")
    return with_email.unionByName(without.select(with_email.columns)).drop("_e")


def snapshot(previous: DataFrame, current: DataFrame, at: str) -> DataFrame:
    """current, active, and the rows of previous that current has neither by name nor by a given email, inactive since then or before."""
    gone = previous.join(current.select("name").distinct(), "name", "left_anti")
    mails = current.where("email is not null and email <> ''").select("email").distinct()
    gone = gone.join(mails, "email", "left_anti")
    since = F.coalesce("inactive_since", F.lit(at)) if "inactive_since" in previous.columns else F.lit(at)
    return current.withColumn("inactive", F.lit(False)).withColumn("inactive_since", F.lit(None).cast("string")).unionByName(gone.withColumn("inactive_since", since).withColumn("inactive", F.lit(True)), allowMissingColumns=True)


def active(profiles: DataFrame) -> DataFrame:
    return profiles.where(~F.coalesce("inactive", F.lit(False)))


def unseen(items: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    return items.join(seen.select(key), key, "left_anti")


def seen_after(seen: DataFrame, items: DataFrame, at: str, most: int, key: str = "id") -> DataFrame:
    """(id, first_seen) of ids seen so far and those of all items, the newest ``most``; equal times go by id."""
    new = items.select(key).distinct().withColumn("first_seen", F.lit(at))
    return seen.select(key, "first_seen").unionByName(new).groupBy(key).agg(F.min("first_seen").alias("first_seen")).orderBy(F.desc("first_seen"), key).limit(most)


def source_health(counts: DataFrame) -> DataFrame:
    """(source, consecutive_zeros, last_success, total_found, alert) from (source, run, found) of all runs.

    Runs with an error, found below 0, change nothing. Zeros count since the last run that found something; three make an alert.
    """
    good = counts.where("found >= 0")
    per = good.groupBy("source").agg(F.max(F.when(F.col("found") > 0, F.col("run"))).alias("last_success"), F.sum("found").alias("total_found"))
    zeros = good.join(per.select("source", "last_success"), "source").where("last_success is null or run > last_success").groupBy("source").agg(F.count("*").alias("consecutive_zeros"))
    out = per.join(zeros, "source", "left").withColumn("consecutive_zeros", F.coalesce("consecutive_zeros", F.lit(0)).cast("long"))
    return out.select("source", "consecutive_zeros", "last_success", "total_found", (F.col("consecutive_zeros") >= 3).alias("alert"))


def choose_candidate(candidates: DataFrame, who: str = "profile") -> DataFrame:
    """For each profile the first candidate whose name and affiliation agree, else the first whose name does."""
    ok = candidates.where("name_ok")
    return ok.groupBy(who).agg(F.min_by("candidate", F.struct(~F.col("affiliation_ok"), "pos")).alias("candidate"))
