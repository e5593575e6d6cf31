"""1. SimHash near-duplicate groups, by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.common import Scratch, ship, table, with_row_hash
from quillmatch.llm.components import connected_components
from quillmatch.llm.near import first_of_each

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 2
BLOCK = 1 << 16


def simhash(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit fingerprint of a text as a signed long; 0 for a text without words.

    A shingle is ``words`` consecutive words, lower-cased in ASCII and joined by spaces; a shorter text is one
    shingle. Bit i is 1 if it is set in over half of the shingles' hashes. Memory does not grow with the text
    beyond its words: bits are counted in blocks.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    k = min(words, len(parts))
    n = len(parts) - k + 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[k - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, row hash, fp) of every row; null texts count as empty."""
    ship(docs.sparkSession)
    rows = with_row_hash(docs.select(doc_id, text), text=text).select(doc_id, "_row_hash", text)
    schema = rows.drop(text).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [simhash(t.as_py(), words) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], names=[doc_id, "_row_hash", "fp"])

    return rows.mapInArrow(run, schema)


def ball(fp, bits: int = 64):
    """The fingerprint and its neighbours at one differing bit: a ball of half the linking radius."""
    return F.concat(F.array(fp), F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that connect all pairs at ``radius`` 2 or fewer differing bits.

    Two fingerprints differ in at most two bits if and only if their balls of radius one meet. Every fingerprint
    emits its 65 variants; rows are dealt out by variant. A variant has at most 65 distinct fingerprints, so no
    bucket is large. In a bucket each fingerprint is linked to the smallest, which all others there also reach, so
    no bucket is expanded into pairs; repeated links go, and the distance of each is checked.
    """
    if radius != 2:
        raise ValueError("the ball of half the radius is built for a radius of 2")
    met = distinct.select("fp", F.explode(ball(F.col("fp"))).alias("variant"))
    met = met.withColumn("low", F.expr("min(fp) over (partition by variant)")).where("fp <> low")
    return met.select(F.col("fp").alias("u"), F.col("low").alias("v")).distinct().where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``near_duplicates`` with the component's root, a fingerprint that is never null."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    prints = scratch.keep(fingerprints(docs, doc_id, text, words), "prints")
    least = scratch.keep(prints.groupBy("fp").agg(F.min(doc_id).alias("least")), "distinct")
    nodes = scratch.keep(connected_components(links(least.select("fp"), radius), scratch), "nodes")
    low = least.join(nodes, least["fp"] == nodes["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    low = scratch.keep(low, "rooted")
    of_root = scratch.keep(low.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    of_print = scratch.keep(low.join(of_root, "root").select("fp", "component_id", "root"), "classes")
    return prints.join(of_print, "fp").select(doc_id, "_row_hash", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(id, ``_row_hash``, fp, component_id) for every row; component_id is the smallest id reachable by links.

    Copies share a fingerprint and are counted as one node, so a large group of copies adds no links. Texts without
    words share fingerprint zero and are linked like any other. Repeated rows give repeated rows. A null id is
    ignored in the minimum, so a group of null ids only has a null component_id. Whole texts are hashed, whatever their length.
    Empty tables give empty results. Other columns are ignored, whatever their names.
    """
    return grouped(docs, doc_id, text, words, radius).drop("root")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the smallest id, null last, then row hash.

    Rows that are equal in id and text are one document here and stay together; exact deduplication comes before. Null texts
    count as empty; an empty table stays empty; all columns stay, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(grouped(docs, doc_id, text).select(doc_id, "_row_hash", "root"), "found")
    return first_of_each(docs, found, scratch, doc_id, text)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
