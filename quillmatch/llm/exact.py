"""5. Exact deduplication against a persistent digest index."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.common import BLANKS, Scratch, same_row, table, unused, without_rows

BUCKETS = 64
#: Parts in which a whole table is brought in, long texts first.
PARTS = 2


def digest(text: Column) -> Column:
    """SHA-256 of the text without white space; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANKS, ""), 256)


class DigestIndex:
    """A table (text_sha256, keep_id, batch) with a row for each text seen so far, bucketed and sorted by digest.

    New digests meet it in a sort-merge anti-join for which the index is not shuffled. A batch is a partition of the table, which is
    written over when the batch comes again; so bringing in a batch twice is the same as once. ``path`` keeps the
    files of an index in a place that outlives the session's catalog; without it they are in the warehouse. ``id_type`` is the
    type of ids. An index keeps its number of buckets.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int = BUCKETS, id_type: str = "BIGINT"):
        self.spark, self.name, self.buckets = spark, name, buckets
        at = f" LOCATION '{path}'" if path else ""
        if path:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (text_sha256 STRING, keep_id {id_type}, batch STRING) USING parquet PARTITIONED BY (batch) CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS{at}")
        if path:
            spark.sql(f"MSCK REPAIR TABLE {name}")

    def table(self, without: str | None = None) -> DataFrame:
        """All rows, or those of other batches."""
        rows = self.spark.table(self.name)
        return rows if without is None else rows.where(F.col("batch") != without)

    def unseen(self, new: DataFrame, batch: str | None = None) -> DataFrame:
        """Rows of new, one for each digest, whose digest is not in the index, as far as other batches made it."""
        return new.join(self.table(batch).select("text_sha256").hint("merge"), "text_sha256", "left_anti")

    def put(self, fresh: DataFrame, batch: str) -> None:
        """Makes (text_sha256, keep_id) the rows of the batch; each bucket is written by one task, so a batch has one file for a bucket."""
        if not re.fullmatch(r"[0-9A-Za-z_-]+", batch):
            raise ValueError("a batch is named by letters, digits, _ and -")
        view = f"fresh_{uuid.uuid4().hex}"
        fresh.select("text_sha256", "keep_id").repartition(self.buckets, "text_sha256").createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = '{batch}') SELECT text_sha256, keep_id FROM {view}")
        self.spark.catalog.dropTempView(view)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digested(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, _row_hash, size, text_sha256) of every row."""
    return docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("_row_hash"), F.coalesce(F.length(text), F.lit(0)).alias("size"), digest(F.col(text)).alias("text_sha256"))


def brought_in(rows: DataFrame, index: DigestIndex, batch: str, scratch: Scratch) -> DataFrame:
    """(text_sha256, n, keep_id, keep_hash, fresh) of the digests of ``digested`` rows, which then are the index's batch.

    The rows are reduced to one for each digest, with partial aggregation, before they meet the index; so a text with a third of
    all rows is one row there. The result is written before the index is.
    """
    best = F.min(F.struct((-F.col("size")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "_row_hash")).alias("best")
    groups = rows.groupBy("text_sha256").agg(best, F.count("*").alias("n")).select("text_sha256", "n", F.col("best.id").alias("keep_id"), F.col("best._row_hash").alias("keep_hash"))
    groups = scratch.keep(groups, f"groups-{batch}")
    known = index.table(batch).select("text_sha256", F.col("keep_id").alias("had_id"))
    fresh = index.unseen(groups, batch).withColumn("fresh", F.lit(True))
    old = groups.join(known.hint("merge"), "text_sha256").select("text_sha256", "n", F.col("had_id").alias("keep_id"), F.lit(None).cast("long").alias("keep_hash"), F.lit(False).alias("fresh"))
    told = scratch.keep(fresh.unionByName(old), f"told-{batch}")
    index.put(told.where("fresh"), batch)
    return told


def told_to_rows(rows: DataFrame, told: DataFrame, doc_id: str) -> DataFrame:
    """What each row is told, by a join of two written tables, whose hot keys adaptive execution splits."""
    kept = F.col("fresh") & F.col("id").eqNullSafe(F.col("keep_id")) & F.col("_row_hash").eqNullSafe(F.col("keep_hash"))
    return rows.join(told, "text_sha256").select(F.col("id").alias(doc_id), "_row_hash", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, _row_hash, keep_id, group_size, kept, text_sha256) for every row of docs, a batch which then is in the index.

    Texts are equal if they are the same without white space. Of equal texts that are new to the index, the row with
    the most code points, then the smallest id (null last), then the smallest hash of the raw text stays. Texts that
    other batches put into the index are all dropped, and keep_id is the id that the index has. group_size counts the
    batch's rows. The same batch again gives the same result, so a run that failed after this can be done anew.

    Null texts are equal to the empty text. Whole texts are compared, whatever their length. Rows repeated whole are one
    document and are told alike. An empty table gives an empty result and an empty batch. Other columns are ignored,
    whatever their names. Ids are of the index's type.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(digested(docs, doc_id, text), "rows")
    return told_to_rows(rows, brought_in(rows, index, batch, scratch), doc_id)


def deduplicate_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", index: DigestIndex | None = None, batch: str = "table", parts: int = PARTS) -> DataFrame:
    """As ``deduplicate``, for a whole table in one go: its parts are brought in one after the other, long texts first.

    So the text that stays of a group is in the index before shorter ones come, which the anti-join then drops; texts of one
    length are in one part. Where the parts are cut changes no result. group_size counts the rows of the table. ``batch`` names
    the table's parts in the index; what they had there goes first. Without an index there is one for this run.
    """
    spark = docs.sparkSession
    own = index or DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", id_type=docs.schema[doc_id].dataType.simpleString())
    scratch = Scratch(spark)
    rows = scratch.keep(digested(docs, doc_id, text), "rows")
    steps = [(i + 1) / parts for i in range(parts - 1)]
    cuts = sorted(set(rows.agg(F.percentile_approx("size", steps)).first()[0] or ()), reverse=True) if steps else []
    if index:
        for i in range(parts):
            own.put(rows.select("text_sha256", F.col("id").alias("keep_id")).where("false"), f"{batch}-{i}")
    told, above = None, None
    for i, cut in enumerate([*cuts, None]):
        part = rows if cut is None else rows.where(F.col("size") >= cut)
        part = part if above is None else part.where(F.col("size") < above)
        found = brought_in(part, own, f"{batch}-{i}", scratch)
        told, above = found if told is None else told.unionByName(found), cut
    fresh = F.max(F.when(F.col("fresh"), F.col("keep_hash"))).alias("keep_hash")
    told = told.groupBy("text_sha256").agg(F.sum("n").alias("n"), F.max("keep_id").alias("keep_id"), fresh, F.max("fresh").alias("fresh"))
    told = scratch.keep(told, "told")
    if index is None:
        own.drop()
    return told_to_rows(rows, told, doc_id)


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", index: DigestIndex | None = None, batch: str = "table") -> DataFrame:
    """docs with the rows that stay, rows repeated whole once, and all their columns, whatever their names."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(deduplicate_table(docs, doc_id, text, index, batch), "found")
    dropped = scratch.keep(found.where("not kept").select(doc_id, "_row_hash"), "dropped")
    again = scratch.keep(found.where("kept").groupBy(doc_id, "_row_hash").count().where("count > 1").select(doc_id, "_row_hash"), "again")
    if again.isEmpty():
        return without_rows(docs, dropped, scratch, doc_id, text)
    name = unused(docs.columns, "_row_hash")
    keyed, few = docs.withColumn(name, F.xxhash64(text)), again.withColumnRenamed("_row_hash", name)
    twice = keyed.join(few, same_row(keyed, few, [doc_id, name]), "left_semi").dropDuplicates([doc_id, name]).drop(name)
    return without_rows(docs, scratch.keep(dropped.unionByName(again), "all"), scratch, doc_id, text).unionByName(twice)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_table(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
