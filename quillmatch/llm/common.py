"""What the corpus operators share: the word pattern, the scratch folder, row keys and Bloom filters.

Words are runs of characters other than the six ASCII white-space characters, so ``bytes.split()`` on UTF-8 finds
them too.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.functions import ship as _ship
from quillmatch.functions.ship import shared_dir

__all__ = ["BLANKS", "WORD", "Bloom", "Scratch", "same_row", "shared_dir", "ship", "table", "unused", "with_row_hash", "without_rows", "word_count"]

#: Rows and bytes of an Arrow batch, if the session has Spark's defaults: texts may be long, and workers share an executor's memory.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}

BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, and makes their batches small."""
    _ship.ship(spark)
    for name, (default, less) in BATCHES.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, less)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables as Parquet in the shared folder, which survive the loss of executors.

    A table read from here also has known size: Spark broadcasts it if it is under
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it, with both sides of the join open to skew splitting,
    if it is not.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/quillmatch-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """df, written and read again; in at most so many files, if its size is known to be small."""
        df = df.coalesce(files) if files else df
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more; all of them without a name."""
        for name in names or ("",):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null. Each word with the blanks after it becomes one character."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), WORD + r"[\x20\x09-\x0D]*", "w")), F.lit(0)).cast("long")


def unused(columns: Sequence[str], name: str) -> str:
    """The name, with underscores before it if a column has it already, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def same_row(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    on = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        on = on & a[k].eqNullSafe(b[k])
    return on


def with_row_hash(docs: DataFrame, name: str = "_row_hash", text: str = "text") -> DataFrame:
    """Adds a hash of the text, which with the id tells rows apart even if ids repeat."""
    return docs.withColumn(name, F.xxhash64(F.col(text)))


class Bloom:
    """A blocked Bloom filter of hashes: a table (block, bits) of 64-bit blocks, which is broadcast.

    A key sets KEY_BITS bits of one block. KEYS keys are meant for a block, and there are at most MOST_BLOCKS blocks, some 50 MB in
    memory, however many keys there are: beyond KEYS * MOST_BLOCKS of them more rows pass that have no key. A row
    that has one always passes.
    """

    BLOCK_BITS, KEY_BITS, KEYS, MOST_BLOCKS = 64, 4, 6, 1 << 20

    def __init__(self, hashes: DataFrame, n: int, scratch: Scratch, name: str = "bloom"):
        """hashes has one column of 64-bit hashes, n of them, which may repeat."""
        self.blocks = min(self.MOST_BLOCKS, max(1, n // self.KEYS))
        key = F.col(hashes.columns[0])
        self.table = scratch.keep(hashes.groupBy(self.block_of(key).alias("block")).agg(F.bit_or(self.mask_of(key)).alias("bits")), name)

    def block_of(self, key: Column) -> Column:
        return F.pmod(key, F.lit(self.blocks).cast("long"))

    def mask_of(self, key: Column) -> Column:
        """The bits that a key sets in its block."""
        again = F.xxhash64(key)
        out = F.lit(0).cast("long")
        for i in range(self.KEY_BITS):
            bit = F.pmod(F.call_function("shiftright", again, F.lit(6 * i)), F.lit(self.BLOCK_BITS).cast("long")).cast("int")
            out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
        return out

    def passed(self, rows: DataFrame, key: Column, outside: bool = False) -> DataFrame:
        """The rows whose key may be in the filter, or those, ``outside``, whose key surely is not; no row moves."""
        f = self.table.select(F.col("block").alias(unused(rows.columns, "_block")), F.col("bits").alias(unused(rows.columns, "_bits")))
        block, bits = (f[c] for c in f.columns)
        mask = self.mask_of(key)
        return rows.join(F.broadcast(f), (self.block_of(key) == block) & (mask.bitwiseAND(bits) == mask), "left_anti" if outside else "left_semi")


def without_rows(docs: DataFrame, dropped: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose (id, ``_row_hash``) are in dropped, a written table with just these two columns.

    Rows that a Bloom filter of dropped lets pass, these and a few others, meet dropped in a join; all others stay where they are
    read, so their texts are not shuffled. The join is one of shuffles at every size.
    """
    dropped = dropped.select(F.col(doc_id).alias("_id"), F.col("_row_hash").alias("_hash"))
    bloom = Bloom(dropped.select(F.xxhash64("_id", "_hash")), dropped.count(), scratch, f"bloom-{uuid.uuid4().hex}")
    row_hash = F.xxhash64(docs[text])
    key = F.xxhash64(docs[doc_id], row_hash)
    maybe = bloom.passed(docs, key)
    found = maybe.join(dropped.hint("merge"), maybe[doc_id].eqNullSafe(dropped["_id"]) & F.xxhash64(maybe[text]).eqNullSafe(dropped["_hash"]), "left_anti")
    return bloom.passed(docs, key, outside=True).unionByName(found)
