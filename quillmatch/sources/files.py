"""What a run reads and writes: histories, statistics, logs, caches and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.operators.identity import active


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def settle(spark: SparkSession, path: str) -> bool:
    """If a table is there; one that a run left half replaced is put in place first."""
    jvm = spark._jvm.org.apache.hadoop.fs
    at, new, old = (jvm.Path(f"{path}{x}") for x in ("", ".new", ".old"))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        for other in (new, old) if exists(spark, f"{path}.new/_SUCCESS") else (old,):
            if fs.exists(other):
                return fs.rename(other, at)
    return fs.exists(at)


def read_or_empty(spark: SparkSession, path: str, schema, kind: str = "parquet") -> DataFrame:
    """A table, or an empty one of the schema if the path is not there."""
    if not settle(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return reader.json(path, multiLine=True) if kind == "json" else getattr(reader, kind)(path)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def replace(df: DataFrame, path: str) -> None:
    """Overwrites a table that df may be made from: it is written beside it, then both are renamed, and the old one goes last.

    If the run ends between, ``settle`` puts the whole new table in place when it is next read.
    """
    spark = df.sparkSession
    settle(spark, path)
    df.write.mode("overwrite").parquet(f"{path}.new")
    jvm = spark._jvm.org.apache.hadoop.fs
    at, new, old = (jvm.Path(f"{path}{x}") for x in ("", ".new", ".old"))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    for a, b in ((at, old), (new, at)):
        if fs.exists(a) and not fs.rename(a, b):
            raise OSError(f"{a} could not be renamed")
    fs.delete(old, True)


def prepend_history(new: DataFrame, path: str, most: int = 5000) -> None:
    """Puts rows before the history, newest first by ``pos``, and keeps the first so many."""
    spark = new.sparkSession
    old = read_or_empty(spark, path, new.withColumn("gen", F.lit(0).cast("long")).schema)
    rows = new.withColumn("gen", F.lit(0).cast("long")).unionByName(old.withColumn("gen", F.col("gen") + 1))
    replace(rows.orderBy("gen", "pos").limit(most), path)


def upsert_stats(stats: DataFrame, path: str) -> None:
    """One row; columns that the new row lacks, or has as null, keep their value."""
    spark = stats.sparkSession
    if settle(spark, path):
        old = spark.read.parquet(path)
        both = stats.withColumn("_n", F.lit(1)).unionByName(old.withColumn("_n", F.lit(0)), allowMissingColumns=True)
        stats = both.agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_n")).otherwise(-1)).alias(c) for c in both.columns if c != "_n"))
    replace(stats, path)


def write_run_log(log: DataFrame, path: str) -> None:
    """JSON by ``run_date``; a run replaces the log of its own date alone."""
    log.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").json(path)


def append_matches(matches: DataFrame, path: str) -> bool:
    """Appends the narrow form of matches by day, for reads of one day; nothing is written if there are none."""
    if matches.isEmpty():
        return False
    rows = matches.select(
        F.coalesce(F.nullif("faculty_email", F.lit("")), F.col("faculty_name")).alias("faculty_id"), "faculty_name", "grant_id", "grant_title",
        F.col("similarity_score").alias("semantic_score"), F.col("confidence_score").cast("double").alias("confidence_score"), F.concat_ws(",", "matched_keywords").alias("matched_keywords"), "match_type",
        F.col("timestamp").alias("created_at"), F.to_date(F.substring("timestamp", 1, 10)).alias("day"),
    )
    rows.write.mode("append").partitionBy("day").parquet(path)
    return True


def matches_of_day(spark: SparkSession, path: str, day: str) -> DataFrame:
    """Rows of a day; other days' files are not read."""
    return spark.read.parquet(path).where(F.col("day") == F.lit(day).cast("date"))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def log_tail(spark: SparkSession, path: str, lines: int) -> DataFrame:
    """(line_no, value) of the last lines of a text log, numbered by file and place."""
    text = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    return text.orderBy(F.desc("line_no")).limit(lines).orderBy("line_no").select("line_no", "value")


def fresh_profiles(spark: SparkSession, path: str, now: str, hours: int = 168) -> DataFrame | None:
    """Active profiles of the cache, or None if it is missing, of another form, or older than so many hours."""
    if not settle(spark, path):
        return None
    cache = spark.read.parquet(path)
    if not {"name", "keywords", "scraped_at"} <= set(cache.columns):
        return None
    age = cache.agg(((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max(F.to_timestamp("scraped_at")))) / 3600).alias("h")).first()["h"]
    if age is None or age >= hours:
        return None
    return active(cache) if "inactive" in cache.columns else cache


HEALTH = "source string, consecutive_zeros long, last_success string, total_found long"


def update_health(counts: DataFrame, path: str, at: str) -> DataFrame:
    """The health table after a run's counts (source, found): zeros since the last success, its time, all found, alert at three.

    A run with an error, found below 0, changes nothing; sources that a run leaves out keep their state.
    """
    old = read_or_empty(counts.sparkSession, path, HEALTH)
    new = counts.where("found >= 0").groupBy("source").agg(F.sum("found").alias("found"))
    both = old.join(new, "source", "full_outer")
    won, ran = F.coalesce(F.col("found") > 0, F.lit(False)), F.col("found").isNotNull()
    zeros = F.when(won, 0).otherwise(F.coalesce("consecutive_zeros", F.lit(0)) + ran.cast("int")).cast("long")
    total = F.coalesce("total_found", F.lit(0)) + F.coalesce("found", F.lit(0))
    replace(both.select("source", zeros.alias("consecutive_zeros"), F.when(won, F.lit(at)).otherwise(F.col("last_success")).alias("last_success"), total.cast("long").alias("total_found")), path)
    return counts.sparkSession.read.parquet(path).withColumn("alert", F.col("consecutive_zeros") >= 3)
