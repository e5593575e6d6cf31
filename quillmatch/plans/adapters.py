"""The driver's tables as opportunities and profiles, and the match table of a run over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.functions import text as T
from quillmatch.functions.ship import kept
from quillmatch.operators import matching
from quillmatch.plans.config import Config

AS_OF = "2024-01-30"
QUERY_CONFIG = Config(semantic_threshold=0.25, min_confidence=15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One opportunity for each document; dates, sums and numbers follow from the id."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        i.alias("pos"),
        F.concat(F.lit("doc-"), i).alias("id"),
        "source",
        F.col("source").alias("agency"),
        F.substring("text", 1, 80).alias("title"),
        F.when(i % 10 == 0, F.concat(F.lit("93."), i)).otherwise(F.concat(F.lit("N-"), i)).alias("number"),
        F.substring("text", 1, 2000).alias("synopsis"),
        F.lower("text").alias("searchable_text"),
        F.when(i % 6 == 0, "").otherwise(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 150).cast("int")), "yyyy-MM-dd")).alias("close_date"),
        F.when(i % 7 == 0, "N/A").otherwise(F.concat(F.lit("$"), (i * 7919 % 9000) * 1000)).alias("award_ceiling"),
        F.concat(F.lit("https://grants.example.org/"), i).alias("link"),
        F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 30).cast("int")), "yyyy-MM-dd"), F.lit("T10:00:00")).alias("timestamp"),
        i.alias("doc_id"),
    )


def profile_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, kw, at) of the distinct words of four or more characters that a conversation's user says."""
    said = table(spark, sf_dir, "conversations").where("role = 'user'")
    words = said.select("conv_id", "turn", F.posexplode(F.split(T.normalize(F.col("text")), " +")).alias("i", "kw"))
    return words.where(F.length("kw") >= 4).groupBy("conv_id", "kw").agg(F.min(F.struct("turn", "i")).alias("at"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile for each conversation with a user; its embedding is the vector of the same id."""
    c = F.col("conv_id")
    kw = profile_keywords(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "kw"))), lambda x: x["kw"]).alias("keywords"))
    who = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id").distinct()
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conv_id"), "embedding")
    sources = F.when(c % 3 == 0, T.literal_array(["Profile page (3)", "PubMed(12)"])).when(c % 3 == 1, T.literal_array(["PubMed (7)"])).otherwise(F.array().cast("array<string>"))
    return (
        who.join(kw, "conv_id", "left")
        .join(vec, "conv_id", "left")
        .select(
            c.alias("pos"),
            F.concat(F.lit("fac-"), c).alias("name"),
            F.concat(F.lit("dept-"), c % 7).alias("department"),
            F.when(c % 4 == 0, "").otherwise(F.concat(F.lit("fac"), c, F.lit("@example.org"))).alias("email"),
            F.concat(F.lit("https://people.example.org/"), c).alias("url"),
            F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
            sources.alias("keyword_sources"),
            "embedding",
            F.when(c % 5 == 0, 4).otherwise(5).alias("embedding_version"),
            (c % 11 == 10).alias("inactive"),
        )
    )


def grant_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding) of each opportunity, from vectors that no profile has."""
    n = table(spark, sf_dir, "conversations").select("conv_id").distinct().agg(F.count("*").alias("n_conv"))
    m = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n_vec"))
    docs = table(spark, sf_dir, "documents").select("doc_id").join(F.broadcast(n.join(m)), how="cross")  # one row
    ids = docs.select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"), (F.col("n_conv") + F.col("doc_id") % (F.col("n_vec") - F.col("n_conv"))).alias("vec_id"))
    return ids.join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id").select("id", "embedding")


def run_matches(spark: SparkSession, sf_dir: str, config: Config = QUERY_CONFIG) -> DataFrame:
    """A whole run: the match table, newest first by ``pos``."""
    return matching.match_table(grants(spark, sf_dir), profiles(spark, sf_dir), grant_vectors(spark, sf_dir), config)


_kept: dict[tuple, DataFrame] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells if the tables that a run reads have changed: lengths and times of their files."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    out = [spark.sparkContext.applicationId]
    for name in ("documents", "conversations", "embeddings"):
        at = hadoop.Path(f"{sf_dir}/{name}.parquet")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        out += [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)]
    return tuple(out)


def match_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches of a run with a row for each opportunity, written to the shared folder once for a session and a state of its tables."""
    key = _state(spark, sf_dir)
    if key not in _kept:
        for old in [k for k in _kept if k[0] != key[0]]:
            del _kept[old]
        _kept[key] = kept(matching.match_lists(grants(spark, sf_dir), profiles(spark, sf_dir), grant_vectors(spark, sf_dir), QUERY_CONFIG))
    return _kept[key]


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match table of a run, which views read: the rows of ``match_lists``."""
    return matching.match_rows(match_lists(spark, sf_dir))
