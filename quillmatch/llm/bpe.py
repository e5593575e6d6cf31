"""9. BPE encoding and decoding in batched numpy merge rounds.

For vocabularies with word ends: byte-level symbols, the last of a piece with a suffix; text in lower case, white space
dropped between pieces; decoded text is the tokens, parted by spaces, as such a vocabulary has no decoder.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from quillmatch.llm.common import ship, table

#: White space as Unicode has it, which is less than str.isspace() has.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Letters and numbers of Unicode 16, and small letters of Unicode 17, that this Python may not know yet.
LATER = {
    "L": "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 113b7-113b7 113d1-113d1 113d3-113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff-18cff 1e5d0-1e5ed 1e5f0-1e5f0",
    "N": "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa",
}
SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}

CACHED = 200_000
#: Texts are encoded in groups of so many bytes, or one longer text.
GROUP_BYTES = 1_000_000


@cache
def in_class(kind: str) -> str:
    """The characters whose general category starts with kind, as the inside of a character class."""
    spans = [[int(x, 16) for x in span.split("-")] for span in LATER[kind].split()]
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == kind:
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself if it is visible, else the next from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in seen}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(seen))
    return out


class WordBPE:
    """Encodes and decodes as the tokenizers library does with the file's settings and add_special_tokens=False."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max(*vocab.values(), *added.values())
        self.tokens: list[bytes] = [b""] * self.size
        for word, i in (vocab | added).items():
            self.tokens[i] = word.encode()
        self.added = added
        self.specials = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.capitals = re.compile(f"[{''.join(map(chr, SMALL))}]")
        self.pieces = re.compile("\n|" + pattern.replace(r"\s", SPACES).replace(r"\p{L}", in_class("L")).replace(r"\p{N}", in_class("N")))
        signs = byte_symbols()
        self.inner = np.array([vocab[signs[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[signs[b] + suffix] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.none = len(merges)
        self.known: dict[bytes, tuple[bytes, bytes]] = {}
        self.blank = False  # if the cache has words without tokens

    def split(self, text: str) -> list[str]:
        """Pieces in order; a special token is a piece of its own."""
        if self.specials is None or not any(s in text for s in self.added):
            return self.pieces.findall(self.normal(text))
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [*self.pieces.findall(self.normal(text[at : m.start()])), m[0]]
            at = m.end()
        return out + self.pieces.findall(self.normal(text[at:]))

    def normal(self, text: str) -> str:
        """NFC, then lower case of each character by itself: a final capital sigma is no exception."""
        if text.isascii():
            return text.lower()
        text = self.capitals.sub(lambda m: chr(SMALL[ord(m[0])]), unicodedata.normalize("NFC", text))
        return text.replace("Σ", "σ").lower()

    def rank(self, left: np.ndarray, right: np.ndarray, together: np.ndarray) -> np.ndarray:
        """Ranks of pairs, by binary search over the sorted pair keys; those not of one piece have none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & together, self.ranks[at], self.none)

    def merge(self, pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and where each piece ends.

        The symbols of all pieces are one flat array. A round finds the lowest-ranked pair of each piece and merges all its
        occurrences there, from the left; then only pairs beside a merge are looked up anew, and pieces without a pair
        that merges leave the array. A pair that a merge makes has a higher rank than the merge, so merging all
        occurrences in a round is the same as one by one.
        """
        raw = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[flat]
        stops = np.cumsum(lengths) - 1
        symbols[stops] = self.last[flat[stops]]
        owner = np.repeat(np.arange(len(raw)), lengths)
        rank = np.append(self.rank(symbols[:-1], symbols[1:], owner[:-1] == owner[1:]), self.none)
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            count = np.diff(np.append(first, len(symbols)))
            low = np.minimum.reduceat(rank, first)
            going = np.repeat(low < self.none, count)
            if not going.all():
                ready.append((owner[~going], symbols[~going]))
                low = np.repeat(low, count)[going]
                symbols, owner, rank = symbols[going], owner[going], rank[going]
            else:
                low = np.repeat(low, count)
            if not len(symbols):
                break
            where = np.flatnonzero(rank == low)
            runs = np.flatnonzero(np.append(True, np.diff(where) != 1))
            nth = np.arange(len(where)) - np.repeat(runs, np.diff(np.append(runs, len(where))))
            where = where[nth % 2 == 0]  # of pairs that overlap, every second
            symbols[where] = self.merged[rank[where]]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            now = (np.cumsum(keep) - 1)[where]
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            beside = np.concatenate([now, now[now > 0] - 1])
            rank[-1] = self.none
            beside = beside[beside < len(symbols) - 1]
            rank[beside] = self.rank(symbols[beside], symbols[beside + 1], owner[beside] == owner[beside + 1])
        owners = np.concatenate([x[0] for x in ready]) if ready else np.empty(0, np.int64)
        order = np.argsort(owners, kind="stable")
        ids = np.concatenate([x[1] for x in ready])[order] if ready else np.empty(0, np.int64)
        return ids, np.cumsum(np.bincount(owners, minlength=len(raw)))

    def learn(self, words: set[bytes]) -> None:
        """Puts ids and decoded text of words that the worker's cache does not have into it; a full cache is emptied."""
        new = list(words.difference(self.known))
        if len(self.known) + len(new) > CACHED:
            self.known.clear()
            new = list(words)
        pieces = self.split(b"\n".join(new).decode())
        mark = np.fromiter((p == "\n" for p in pieces), bool, len(pieces))
        special = {i: self.added[p] for i, p in enumerate(pieces) if p in self.added} if self.special(pieces) else {}
        ids, ends = self.merge(pieces)
        if special or len(new) > 1:  # a word's end counts as a symbol, and a special token as several
            of = np.repeat(np.arange(len(pieces)), np.diff(np.append(0, ends)))
            keep = ~mark[of]
            for i, token in special.items():
                at = ends[i - 1] if i else 0
                ids[at], keep[at + 1 : ends[i]] = token, False
            ends = np.cumsum(np.bincount(of[keep], minlength=len(pieces)))
            ids = ids[keep]
        stops = [*np.append(0, ends)[np.flatnonzero(mark)].tolist(), len(ids)]
        flat, said = ids.astype("<u4").tobytes(), [self.tokens[i] for i in ids.tolist()]
        at = 0
        for w, stop in zip(new, stops, strict=True) if new else ():
            self.known[w] = (flat[4 * at : 4 * stop], b" ".join(said[at:stop]))
            self.blank |= at == stop
            at = stop

    def special(self, pieces: Sequence[str]) -> bool:
        return not self.added.keys().isdisjoint(pieces)

    def decode(self, ids: Sequence[int]) -> bytes:
        """UTF-8 of the text of ids, special tokens included."""
        return b" ".join([self.tokens[i] for i in ids])

    def encode(self, texts: Sequence[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Of each UTF-8 text the ids, as little-endian unsigned 32-bit integers, and the text that they decode to.

        Nothing reaches over ASCII white space: no piece, special token or composed character. So a text's words are
        looked up in the cache, and only words that are new are split and merged, those of many texts at once.
        """
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size + len(texts[at]) <= GROUP_BYTES):
                group.append(texts[at].split())
                size += len(texts[at])
                at += 1
            self.learn(set().union(*group))
            for words in group:
                ids, said = zip(*map(self.known.__getitem__, words), strict=True) if words else ((), ())
                yield b"".join(ids), b" ".join(filter(None, said) if self.blank else said)


_loaded: dict[str, WordBPE] = {}


def loaded(name: str) -> WordBPE:
    """The worker's encoder, kept between tasks, from the file that Spark sent to this machine."""
    if name not in _loaded:
        _loaded[name] = WordBPE(SparkFiles.get(name))
    return _loaded[name]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, keep: Sequence[str] = (), ids: bool = False) -> DataFrame:
    """(id, columns of ``keep``, n_tokens, [ids], ids_sha256, decoded_sha256) for every row.

    Null and empty texts have no tokens. Whole texts are encoded, whatever their length; rows with the same text have
    the same result, and repeated rows stay repeated. An empty table gives an empty result; columns not in ``keep`` are ignored,
    whatever their names. Rows are encoded where they are read. The vocabulary file is sent to the workers. Each keeps the ids of at most ``CACHED`` distinct pieces
    and encodes the pieces of a batch that it does not know in numpy rounds.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or vocabulary()
    spark.sparkContext.addFile(path)
    name = Path(path).name
    rows = docs.select(doc_id, *keep, text)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text]
    schema = ", ".join([*kinds, "n_tokens long", *(["ids array<int>"] if ids else []), "ids_sha256 string", "decoded_sha256 string"])
    named = [doc_id, *keep, "n_tokens", *(["ids"] if ids else []), "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(name)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                texts = [t or b"" for t in b.column(len(keep) + 1).cast(pa.binary()).to_pylist()]
                n, out, sha, said = [], [], [], []
                for i, d in bpe.encode(texts):
                    n.append(len(i) // 4)
                    sha.append(hashlib.sha256(i).hexdigest())
                    said.append(hashlib.sha256(d).hexdigest())
                    if ids:
                        out.append(np.frombuffer(i, "<i4"))
                columns = [*(b.column(k) for k in range(len(keep) + 1)), pa.array(n, pa.int64())]
                columns += [pa.array(out, pa.list_(pa.int32()))] if ids else []
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sha, pa.string()), pa.array(said, pa.string())], names=named)

    return rows.mapInArrow(run, schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
