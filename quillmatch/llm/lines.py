"""6. Line deduplication by overlapping three-line windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.common import BLANKS, Bloom, Scratch, ship, table, unused, with_row_hash

WINDOW = 3
_BLANKS = BLANKS.encode()


def line_windows(text: bytes, k: int = WINDOW) -> tuple[list[bytes], list[int], list[int]]:
    """Digest, first and last line of each window of k consecutive lines with a word; white space at a line's ends is ignored."""
    at, lines = [], []
    for i, line in enumerate(text.split(b"\n")):
        if line := line.strip(_BLANKS):
            at.append(i)
            lines.append(line)
    n = max(0, len(lines) - k + 1)
    return [xxhash.xxh3_128_digest(b"\n".join(lines[i : i + k])) for i in range(n)], at[:n], at[k - 1 :] if n else []


def without_lines(text: bytes, spans: Sequence[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the lines of spans (first, last), which may overlap, and how many went."""
    lines = text.split(b"\n")
    kept, at, gone = [], 0, 0
    for a, b in sorted(spans):
        if a > at:
            kept += lines[at:a]
        gone += max(0, b + 1 - max(a, at))
        at = max(at, b + 1)
    return b"\n".join(kept + lines[at:]), gone


def repeated_spans(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", k: int = WINDOW) -> DataFrame:
    """(id, _row_hash, spans): for each row with lines that repeat earlier ones, the lines to remove as (first, last).

    Windows are equal if their 128-bit digests are. The first occurrence, by id (null first), row hash and line, stays
    whole; each later one goes, but for lines that the first of its own occurrences in the same text covers. Rows that are equal in
    id and text are one document. Occurrences are counted by partial aggregation, and the first of each repeated
    window is joined back to a written table of windows, so a window in a third of all rows is a skewed join, which adaptive
    execution splits. Spans of a row are no more than its lines.
    """
    ship(docs.sparkSession)
    rows = with_row_hash(docs.select(doc_id, text), text=text).select(doc_id, "_row_hash", text)
    kind = rows.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = b.column(0), b.column(1)
            index, digests, firsts, lasts = [], [], [], []
            for i, t in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
                d, f, z = line_windows(t or b"", k)
                index += [i] * len(d)
                digests += d
                firsts += f
                lasts += z
            index = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(index), hashes.take(index), pa.array(digests, pa.binary()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())], names=[doc_id, "_row_hash", "digest", "a", "z"])

    windows = scratch.keep(rows.mapInArrow(run, f"`{doc_id}` {kind}, _row_hash long, digest binary, a int, z int"), "windows")
    first = windows.groupBy("digest").agg(F.min(F.struct(doc_id, "_row_hash", "a", "z")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = windows.join(scratch.keep(first, "first").hint("merge"), "digest")
    here = met[doc_id].eqNullSafe(F.col(f"first.`{doc_id}`")) & F.col("_row_hash").eqNullSafe(F.col("first._row_hash"))
    start = F.when(here, F.greatest("a", F.col("first.z") + 1)).otherwise(F.col("a"))
    later = met.where(~(here & (F.col("a") == F.col("first.a")))).select(doc_id, "_row_hash", start.alias("a"), "z").where("a <= z")
    return later.distinct().groupBy(doc_id, "_row_hash").agg(F.collect_list(F.struct("a", "z")).alias("spans"))


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WINDOW, n_lines: str = "_n_lines", n_removed: str = "_n_removed") -> DataFrame:
    """docs with cleaned texts and two more columns, the number of lines and of those removed; columns of docs of these names go.

    A text of fewer than k lines with words stays as it is, as does one whose lines do not repeat. Null stays null. A text whose
    lines all repeat becomes empty. Whole texts are read, whatever their length; repeated rows are cleaned alike. An
    empty table gives an empty result. Other columns stay, whatever their names.

    Only texts that a Bloom filter of the documents with spans lets pass, these and a few others, are shuffled to meet their spans;
    all others stay where they are read. Spans are about as many as documents with repeats, so they are never broadcast, at any size.
    """
    scratch = Scratch(docs.sparkSession)
    spans = scratch.keep(repeated_spans(docs, scratch, doc_id, text, k).select(F.col(doc_id).alias("_id"), F.col("_row_hash").alias("_hash"), "spans"), "spans")
    bloom = Bloom(spans.select(F.xxhash64("_id", "_hash")), spans.count(), scratch)
    rows = docs.select(*(docs[c] for c in docs.columns if c.lower() not in (n_lines.lower(), n_removed.lower())))
    kept, at = rows.columns, rows.columns.index(text)
    own = unused(kept, "_spans")
    key = F.xxhash64(rows[doc_id], F.xxhash64(rows[text]))
    maybe = bloom.passed(rows, key)
    joined = maybe.join(spans.hint("merge"), maybe[doc_id].eqNullSafe(spans["_id"]) & F.xxhash64(maybe[text]).eqNullSafe(spans["_hash"]), "left").select(*(maybe[c] for c in kept), spans["spans"].alias(own))
    sizes = [F.coalesce(F.regexp_count(F.col(text), F.lit("\n")) + 1, F.lit(0)).cast("long").alias(n_lines), F.lit(0).cast("long").alias(n_removed)]
    plain = bloom.passed(rows, key, outside=True).select(*kept, *sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, gone = [], [], []
            for t, s in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(len(kept)).to_pylist(), strict=True):
                n.append(0 if t is None else t.count(b"\n") + 1)
                t, g = (t, 0) if t is None or not s else without_lines(t, [(x["a"], x["z"]) for x in s])
                texts.append(t)
                gone.append(g)
            columns = [b.column(i) for i in range(len(kept))]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[*kept, n_lines, n_removed])

    return plain.unionByName(joined.mapInArrow(run, plain.schema))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), n_lines="n_lines", n_removed="n_removed")
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
t AS (SELECT doc_id, i, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l),
w AS (SELECT doc_id, i AS a, lead(i, 2) OVER o AS z, line || chr(10) || lead(line) OVER o || chr(10) || lead(line, 2) OVER o AS win
      FROM t WHERE line <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT *, row_number() OVER o AS n, first_value(doc_id) OVER o AS fd, first_value(z) OVER o AS fz FROM w WHERE win IS NOT NULL
      WINDOW o AS (PARTITION BY win ORDER BY doc_id, a)),
g AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN fd = doc_id THEN greatest(a, fz + 1) ELSE a END, z + 1)) AS i FROM f WHERE n > 1),
k AS (SELECT doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text FROM l ANTI JOIN g USING (doc_id, i) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.lines), 0)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS clean_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
"""
