"""Near-duplicate documents by exact similarity of their shingles; MinHash bands only propose the pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.common import Bloom, Scratch, ship, with_row_hash, without_rows
from quillmatch.llm.components import more_linked

SEED = 42
SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Two texts of similarity s share a band's key with s ** ROWS, so at 0.8 all BANDS miss a pair with 0.0002.
BANDS, ROWS = 16, 4
#: Rounds in which buckets are stars, before texts that are still apart are compared by their rarest shingles; rows of a file.
STAR_ROUNDS, ROWS_OF_FILE = 3, 50_000
BLOCK = 1 << 11
#: Bytes of words that are hashed at once.
PART_BYTES = 1 << 16

_random = np.random.default_rng(SEED)
FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
MIXERS = _random.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP, SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


#: A number for each byte, by which a text is a polynomial modulo 2 ** 64; powers of its variable and of the inverse of that.
LETTERS = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd number and of its inverse, modulo 2 ** 64."""
    size = max(PART_BYTES, 1 << n.bit_length())
    if size not in _POWERS:
        x = int(STEP)
        _POWERS.clear()
        _POWERS[size] = tuple(np.cumprod(np.append(np.uint64(1), np.full(size - 1, y, np.uint64))) for y in (x, pow(x, -1, 1 << 64)))
    return _POWERS[size]


def scrambled(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(32))) * SALT
    x = (x ^ (x >> np.uint64(29))) * STEP
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles, which are as ``simhash`` has them; none without words.

    The hash of a shingle is that of its polynomial, which is a difference of two sums over the text's bytes; so all shingles are
    hashed at once, in parts of the text.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    k = min(words, len(parts))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes + 1) // PART_BYTES)) + 1
    found = []
    for first, after in zip([0, *cuts.tolist()], [*cuts.tolist(), len(parts)], strict=True):
        after = min(after + k - 1, len(parts))  # the shingles that start here
        if after - first < k:
            continue
        letters = LETTERS[np.frombuffer(b" ".join(parts[first:after]), np.uint8)]
        up, down = powers(len(letters))
        sums = np.append(np.uint64(0), np.cumsum(letters * up[: len(letters)]))
        ends = np.cumsum(sizes[first:after] + 1) - 1
        starts = np.append(0, ends[: after - first - k] + 1)
        found.append(scrambled((sums[ends[k - 1 :]] - sums[starts]) * down[starts]))
    return np.unique(np.concatenate(found))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band, from ROWS minima, each over all shingles in an order of its own."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(low, (hashes[at : at + BLOCK] * FACTORS).min(axis=1), out=low)
    keys = (scrambled(low).reshape(BANDS, ROWS) * MIXERS).sum(axis=1, dtype=np.uint64)
    return scrambled(keys + np.arange(BANDS, dtype=np.uint64) * STEP).view(np.int64)


def signatures(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(id, _row_hash, node, n, bands) of every row; node is a hash of the set of n shingles, so copies are one node."""
    ship(docs.sparkSession)
    rows = with_row_hash(docs.select(doc_id, text), text=text).select(doc_id, "_row_hash", text)
    schema = rows.drop(text).select("*", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("n"), F.array(F.lit(0).cast("long")).alias("bands")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, bands = [], [], []
            for t in b.column(2):
                s = shingles(t.as_py(), words)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                sizes.append(len(s))
                bands.append(band_keys(s))
            columns = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=[doc_id, "_row_hash", "node", "n", "bands"])

    return rows.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, scratch: Scratch, doc_id: str, text: str, words: int) -> DataFrame:
    """(node, shingles) for wanted (id, _row_hash, node), a written table with a row for each node; other texts stay where they are."""
    wanted = wanted.select(F.col(doc_id).alias("_id"), F.col("_row_hash").alias("_hash"), "node")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    bloom = Bloom(wanted.select(F.xxhash64("_id", "_hash")), wanted.count(), scratch, "bloom-wanted")
    maybe = bloom.passed(rows, F.xxhash64(rows["id"], F.xxhash64(rows["text"])))
    rows = maybe.join(wanted.hint("merge"), maybe["id"].eqNullSafe(wanted["_id"]) & F.xxhash64(maybe["text"]).eqNullSafe(wanted["_hash"])).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                sets = [shingles(t.as_py(), words).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return rows.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have the similarity, exactly."""
    a, b = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "u").join(b, "v").where(both / (F.size("a") + F.size("b") - both) >= similarity).select("u", "v")


def rare_shingle_pairs(sets: DataFrame, apart: DataFrame, similarity: float, scratch: Scratch, files: int) -> DataFrame:
    """Pairs (u, v) of nodes of apart (node, root), of different roots, among which all pairs of that similarity are.

    With a text's shingles in order of rarity, two texts of similarity s share one among the first n - ceil(s * n) + 1 of each, and
    after it enough are left in both. So texts meet by these shingles alone, and one with many shingles of its own meets
    none. Where a shingle has several roots, only pairs with a text outside the largest are made, so texts that are linked
    already are not paired. What is joined by shingle is written first, so a shingle of many texts is a skewed join of two tables.
    """
    rows = sets.join(apart.select("node"), "node").select("node", F.explode("shingles").alias("s"))
    rows = rows.join(rows.groupBy("s").agg(F.count("*").cast("int").alias("c")), "s")
    ordered = rows.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("x")).withColumn("n", F.size("x")).join(apart, "node")
    first = F.slice("x", F.lit(1), (F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).cast("int"))
    rare = ordered.select("node", "root", "n", F.posexplode(first).alias("at", "x")).where("x.c > 1").select("node", "root", "n", "at", "x.s")
    rare = scratch.keep(rare, "rare", files)
    large = rare.groupBy("s", "root").agg(F.count("*").alias("c")).groupBy("s").agg(F.max_by("root", F.struct("c", "root")).alias("large"), F.count("*").alias("roots")).where("roots > 1").select("s", "large")
    here = scratch.keep(rare.join(scratch.keep(large, "large", files), "s"), "here", files)
    other = here.select("s", F.col("node").alias("v"), F.col("root").alias("rv"), F.col("n").alias("nv"), F.col("at").alias("av"), "large").drop("large")
    met = here.where("root <> large").join(other, "s").where("root <> rv and (rv = large or node < v)")
    left = F.least(F.col("n") - F.col("at"), F.col("nv") - F.col("av")) * (1 + similarity) >= similarity * (F.col("n") + F.col("nv")) - 1e-6
    return met.where(left & close("n", "nv", similarity)).select(F.col("node").alias("u"), "v").distinct()


def close(a: str, b: str, similarity: float):
    """If sets of these sizes may have the similarity."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-6


def roots(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, grouped: DataFrame | None = None) -> DataFrame:
    """(id, _row_hash, root) for every row: rows have one root if a chain of similar texts links them.

    Texts of one set of shingles are one node. Nodes meet in buckets, one for each band. In a round each node is compared with
    one node of each of its buckets, of those linked to most there, unless both are linked already; so a large group of near
    copies costs a few comparisons for each and is soon one. Nodes that still share a bucket with one that is not linked to them are
    then compared by their rarest shingles, which finds all pairs among them. So every similar pair that shares a bucket is
    linked, no bucket is cut, and no group is paired within itself.

    Rows of one group in grouped (id, _row_hash, root), as fingerprints link them, are linked from the start, so chains lead through both kinds of links.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.keep(signatures(docs, doc_id, text, words), "prints")
    nodes = prints.groupBy("node").agg(F.min_by(F.struct("n", "bands"), "_row_hash").alias("x")).select("node", "x.n", F.explode("x.bands").alias("key"))
    nodes = scratch.keep(nodes, "keys")
    shared = nodes.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    buckets = scratch.keep(nodes.join(shared, "key"), "buckets")
    files = 8 + buckets.count() // ROWS_OF_FILE
    met = buckets.select("node").distinct()
    wanted = prints.join(met, "node").groupBy("node").agg(F.min(F.struct(doc_id, "_row_hash")).alias("x")).select(F.col(f"x.{doc_id}").alias(doc_id), "x._row_hash", "node")
    sets = scratch.keep(shingle_sets(docs, scratch.keep(wanted, "wanted", files), scratch, doc_id, text, words), "sets")
    scratch.drop("keys")
    linked = None
    state = buckets.withColumn("root", F.col("node"))
    if grouped is not None:
        known = grouped.select(F.col(doc_id).alias("_id"), F.col("_row_hash").alias("_hash"), F.col("root").alias("_group")).distinct()
        both = prints.join(known, prints[doc_id].eqNullSafe(known["_id"]) & prints["_row_hash"].eqNullSafe(known["_hash"])).select("node", "_group")
        both = scratch.keep(both, "grouped")
        low = scratch.keep(both.groupBy("_group").agg(F.min("node").alias("v"), F.max("node").alias("high")).where("v <> high").select("_group", "v"), "groups")
        given = scratch.keep(both.join(low, "_group").where("node <> v").select(F.col("node").alias("u"), "v").distinct(), "given")
        if not given.isEmpty():
            linked = scratch.keep(more_linked(None, given, scratch, "edges-given"), "linked-given", files)
            state = scratch.keep(buckets.join(linked, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")), "state-given", files)

    def link(pairs: DataFrame, name: str) -> bool:
        """Compares the pairs and links the similar ones; if there were any."""
        nonlocal linked
        found = scratch.keep(similar(pairs, sets, similarity), f"links-{name}", files)
        if found.isEmpty():
            return False
        linked = scratch.keep(more_linked(linked, found, scratch, f"edges-{name}"), f"linked-{name}", files)
        return True

    for i in range(STAR_ROUNDS):
        own = state.groupBy("key", "root").agg(F.count("*").alias("c"), F.min_by(F.struct("node", "n"), F.xxhash64("node", "key", F.lit(i))).alias("x"))
        star = own.groupBy("key").agg(F.max_by(F.struct("root", "x"), F.struct("c", F.xxhash64("root", "key"))).alias("x"), F.count("*").alias("roots")).where("roots > 1")
        star = star.select("key", F.col("x.x.node").alias("v"), F.col("x.x.n").alias("nv"), F.col("x.root").alias("rv"))
        pairs = state.join(star, "key").where((F.col("root") != F.col("rv")) & close("n", "nv", similarity)).select(F.col("node").alias("u"), "v").distinct()
        if not link(pairs, f"star-{i}"):
            break
        joined = buckets.join(linked, "node", "left")
        state = scratch.keep(joined.select("key", "node", "n", F.coalesce("root", "node").alias("root")), f"state-{i}", files)
    mixed = state.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    apart = scratch.keep(state.join(mixed, "key").select("node", "root").distinct(), "apart", files)
    if not apart.isEmpty():
        link(rare_shingle_pairs(sets, apart, similarity, scratch, files), "rare")
    if linked is None:
        return prints.select(doc_id, "_row_hash", F.col("node").alias("root"))
    return prints.join(linked, "node", "left").select(doc_id, "_row_hash", F.coalesce("root", "node").alias("root"))


def first_of_each(docs: DataFrame, found: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the first row of each root in found (id, _row_hash, root): by id, null last, then by row hash."""
    order = F.struct(F.col(doc_id).isNull().alias("no_id"), doc_id, "_row_hash")
    found = found.withColumn("order", order)
    first = scratch.keep(found.groupBy("root").agg(F.min("order").alias("first")), "first")
    dropped = found.join(first, "root").where(~F.col("order").eqNullSafe(F.col("first"))).select(doc_id, "_row_hash")
    return without_rows(docs, scratch.keep(dropped, "dropped"), scratch, doc_id, text)


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, grouped: DataFrame | None = None) -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the smallest id, null last, then row hash. grouped is as for ``roots``.

    Rows that are equal in id and text are one document here and stay together; exact deduplication comes before. Null texts
    count as empty, and texts without words are near duplicates of each other. Whole texts are compared, whatever their length. An
    empty table stays empty; all columns stay, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(roots(docs, doc_id, text, words, similarity, grouped), "found")
    return first_of_each(docs, found, scratch, doc_id, text)
