"""8. Token counts by a two-tier lookup on the map side.

For sentencepiece models without normalisation whose pieces have white space at their front only and line feeds nowhere:
then a text falls into pre-tokens that are encoded one by one, and its count is the sum of theirs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.common import Scratch, ship, table

LIMIT = 4096
CACHED = 1_000_000
GROUP_BYTES = 4_000_000
#: How many frequent pre-tokens are broadcast, and their most bytes.
FREQUENT, LONGEST = 50_000, 64
#: Different pre-tokens that a task counts at a time; with more it tells its counts and begins anew.
COUNTED = 500_000
BLANK = "▁"
UNIT = re.compile(rb"\n[^ \n]*| +[^ \n]*")


def pre_tokens(text: bytes) -> list[bytes]:
    """Pre-tokens in order. One that starts with a line feed stands as it is; any other stands for itself after a blank.

    The blank that the encoder puts before a text is counted in; an empty text has none.
    """
    if not text:
        return []
    if b"\xe2\x96\x81" in text:
        text = text.replace(b"\xe2\x96\x81", b" ")
    t = (b" " + text).replace(b"\n", b" \n")
    if b"  " not in t and t[-1:] != b" ":
        return t[1:].split(b" ")
    return [u if u[:1] == b"\n" else u[1:] for u in UNIT.findall(b" " + text)]


class Lengths:
    """A compact hash table of pre-token lengths: open addressing over hashes, with the pre-tokens in one buffer."""

    def __init__(self, lengths: dict[bytes, int]):
        import xxhash

        self.hash = xxhash.xxh64_intdigest
        bits = max(4, (2 * len(lengths)).bit_length())
        self.mask = (1 << bits) - 1
        self.slots = np.zeros(self.mask + 1, np.uint32)
        self.blob = b"".join(lengths)
        self.ends = np.cumsum([0, *map(len, lengths)], dtype=np.uint32)
        self.counts = np.fromiter(lengths.values(), np.uint16, len(lengths))
        for i, word in enumerate(lengths):
            at = self.hash(word) & self.mask
            while self.slots[at]:
                at = (at + 1) & self.mask
            self.slots[at] = i + 1

    def get(self, word: bytes) -> int | None:
        at = self.hash(word) & self.mask
        while i := int(self.slots[at]):
            if self.blob[self.ends[i - 1] : self.ends[i]] == word:
                return int(self.counts[i - 1])
            at = (at + 1) & self.mask
        return None


class Counts:
    """A worker's counter of tokens: its cache, then the broadcast table, then the encoder."""

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.sp.id_to_piece, range(self.sp.vocab_size()))
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces):
            raise ValueError("this vocabulary has pieces that reach over pre-tokens")
        self.known: dict[bytes, int] = {}

    def lengths(self, words: Sequence[bytes]) -> list[int]:
        """Tokens of each pre-token, with the blank that it stands after; without, if it starts with a line feed."""
        found = self.sp.encode([w.decode() for w in words], num_threads=1)
        return [len(ids) - (w[:1] == b"\n") if w else 1 for w, ids in zip(words, found, strict=True)]

    def learn(self, words: set[bytes], frequent: Lengths | None) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHED:
            self.known.clear()
            new = words
        misses = []
        for w in new:
            n = frequent.get(w) if frequent and len(w) <= LONGEST else None
            if n is None:
                misses.append(w)
            else:
                self.known[w] = n
        self.known.update(zip(misses, self.lengths(misses), strict=True))

    def count(self, texts: Sequence[bytes], frequent: Lengths | None = None) -> Iterator[int]:
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size + len(texts[at]) <= GROUP_BYTES):
                group.append(pre_tokens(texts[at]))
                size += len(texts[at])
                at += 1
            self.learn(set().union(*group), frequent)
            for words in group:
                yield sum(map(self.known.__getitem__, words))


_loaded: dict[str, Counts] = {}


def loaded(name: str) -> Counts:
    if name not in _loaded:
        _loaded[name] = Counts(SparkFiles.get(name))
    return _loaded[name]


def model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def frequencies(docs: DataFrame, text: str = "text", counted: int = COUNTED) -> DataFrame:
    """(word, n): how often each pre-token of at most ``LONGEST`` bytes stands in all rows.

    Each task counts the pre-tokens of all its rows and tells its counts when it has more than ``counted`` different ones, and at its end; so no
    row and no count is left out, and what is shuffled is one number for each pre-token of a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def told() -> pa.RecordBatch:
            words = [w for w in seen if len(w) <= LONGEST]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(map(seen.__getitem__, words), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for b in batches:
            for t in b.column(0).cast(pa.binary()):
                seen.update(pre_tokens(t.as_py() or b""))
                if len(seen) > counted:
                    yield told()
        yield told()

    ship(docs.sparkSession)
    return docs.select(F.col(text)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_lengths(docs: DataFrame, text: str, path: str, most: int = FREQUENT) -> Lengths:
    """Lengths of the frequent pre-tokens of all rows, ``most`` at most: a cache filled beforehand, so it changes no count.

    It is broadcast, some MB whatever the size of the table. Of the counts the driver sees how many pre-tokens have each, which
    tells the least count that all fit with; so no more than these come to it. Texts stay where they are read.
    """
    counts = Scratch(docs.sparkSession).keep(frequencies(docs, text), "frequencies")
    least, fit = None, 0
    for n, words in counts.groupBy("n").agg(F.count("*")).orderBy(F.desc("n")).toLocalIterator():
        if (fit := fit + words) > most:
            break
        least = n
    words = [bytes(r.word) for r in counts.where(F.col("n") >= F.lit(least)).select("word").collect()]
    return Lengths(dict(zip(words, loaded_here(path).lengths(words), strict=True)))


def loaded_here(path: str) -> Counts:
    """The driver's encoder."""
    if path not in _loaded:
        _loaded[path] = Counts(path)
    return _loaded[path]


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row, as the sentencepiece library counts, without begin and end.

    Null texts are empty; an empty text has no bytes and no tokens. Whole texts are counted, whatever their length. Repeated rows
    give repeated rows, an empty table an empty result; other columns are ignored, whatever their names. Rows stay where they
    are read: no text and no pre-token to look up is shuffled, only each task's counts, and only the table of frequent pre-tokens is broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or model()
    spark.sparkContext.addFile(path)
    name = Path(path).name
    frequent = spark.sparkContext.broadcast(frequent_lengths(docs, text, path))
    rows = docs.select(doc_id, text)
    kind = rows.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = loaded(name)
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            n = list(counts.count(texts, frequent.value))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[doc_id, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"`{doc_id}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
