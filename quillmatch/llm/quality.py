"""3. Quality rules as a short-circuit cascade, ordered by rejection per cost on a sample."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillmatch.llm.common import BLANKS, ship, table

SYMBOLS = "#*$%&|<>"
WINDOW = 3
MIN_WORDS = 50
MAX_REPEATED = 50
#: Texts of a task on which all rules are tried, one in SAMPLE_STEP until there are so many; they set the order of the rules there.
SAMPLE_ROWS, SAMPLE_STEP = 64, 8
BULLETS = ("-", "*", "•", "‣", "·")
ELLIPSES = ("...", "…")


@dataclass
class Text:
    """A text with the counts that rules share; each is found when first asked for."""

    raw: str
    _found: dict = field(default_factory=dict)

    def _once(self, name: str, make: Callable):
        if name not in self._found:
            self._found[name] = make()
        return self._found[name]

    @property
    def words(self) -> list[bytes]:
        return self._once("words", lambda: self.raw.encode().split())

    @property
    def n_words(self) -> int:
        return len(self.words)

    @property
    def word_chars(self) -> int:
        return self._once("word_chars", lambda: len(self.raw) - sum(map(self.raw.count, BLANKS)))

    @property
    def n_symbols(self) -> int:
        return self._once("n_symbols", lambda: sum(map(self.raw.count, SYMBOLS)))

    @property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return self._once("lines", lambda: [x for x in self.raw.split("\n") if x.strip(BLANKS)])

    @property
    def n_dup_lines(self) -> int:
        return self._once("n_dup_lines", lambda: len(self.lines) - len(set(self.lines)))

    @property
    def n_repeat_words(self) -> int:
        return self._once("n_repeat_words", lambda: repeated_words(self.words))

    def fresh(self) -> Text:
        """The same text with the counts found so far, to which what the copy finds is not added."""
        return Text(self.raw, dict(self._found))


def repeated_words(words: Sequence[bytes], k: int = WINDOW) -> int:
    """Number of words that stand in a window of k words that the text has twice or more."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    key = w[:n]
    for j in range(1, k):
        if j > 1 and len(ids) > 2_000_000:  # three ids no longer fit in 63 bits
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(ids) + w[j : n + j]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for j in range(k):
        covered[j : n + j] |= twice
    return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    """rejects must depend on the text alone."""

    name: str
    rejects: Callable[[Text], bool]


def share(items: Sequence, good: Callable) -> float:
    """Share of items that are good; 0 of none."""
    return sum(map(good, items)) / len(items) if items else 0.0


def lettered(word: bytes) -> bool:
    return word.isalpha() or any(map(str.isalpha, word.decode()))


def most_common(words: Sequence[bytes]) -> int:
    return max(Counter(words).values(), default=0)


#: They look for text that is not prose in any language. The base is what every text is measured by.
BASE = (
    Rule("words", lambda t: t.n_words < MIN_WORDS),
    Rule("repeated", lambda t: 100 * t.n_repeat_words > MAX_REPEATED * t.n_words),
)
#: The cascade: tables and mark-up, shouting, broken encodings, repeated lines, lists, teasers, numbers, one word over and over.
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("exclaims", lambda t: 5 * t.raw.count("!") > t.n_words),
    Rule("broken", lambda t: 10 * t.raw.count("\ufffd") > t.n_words),
    Rule("lines", lambda t: 100 * t.n_dup_lines > 60 * len(t.lines)),
    Rule("bullets", lambda t: share(t.lines, lambda x: x.strip(BLANKS).startswith(BULLETS)) > 0.9),
    Rule("teasers", lambda t: share(t.lines, lambda x: x.strip(BLANKS).endswith(ELLIPSES)) > 0.6),
    Rule("letters", lambda t: t.n_words > 0 and share(t.words, lettered) < 0.5),
    Rule("one_word", lambda t: t.n_words >= 20 and 100 * most_common(t.words) > 40 * t.n_words),
)
#: What a pipeline keeps documents by. A short text may be clean, so only one without words goes for its length, and one sentence that
#: stands there twice is soon half of it.
KEEP = (
    Rule("empty", lambda t: t.n_words == 0),
    Rule("repeated", lambda t: 100 * t.n_repeat_words > (MAX_REPEATED if t.n_words >= MIN_WORDS else 90) * t.n_words),
    *RULES,
)


class Cascade:
    """Rules in the order of rejection per cost on a sample of the texts that it has seen; a text is tried until a rule rejects it.

    One text in ``step`` is part of the sample until that has ``rows`` texts: on these each rule is tried by itself and its time and
    verdict are added up. The order changes the time that a text takes, never its verdict. So each task has the order for
    its own rows, whatever language or source a table is sorted by, and there is no pass over the table before.
    """

    def __init__(self, rules: Sequence[Rule], rows: int = SAMPLE_ROWS, step: int = SAMPLE_STEP):
        self.rules, self.order, self.rows, self.step = list(rules), list(rules), rows, step
        self.seconds, self.rejected = [0.0] * len(rules), [0] * len(rules)
        self.seen = self.sampled = 0

    def failing(self, text: Text) -> str | None:
        """Name of the first rule, in the present order, that rejects the text; those after it are not tried, but on the sample."""
        if self.sampled < self.rows and self.seen % self.step == 0:
            self.measure(text)
        self.seen += 1
        return failing(text, self.order)

    def measure(self, text: Text) -> None:
        for i, rule in enumerate(self.rules):
            own = text.fresh()
            began = time.perf_counter()
            self.rejected[i] += rule.rejects(own)
            self.seconds[i] += time.perf_counter() - began
        self.sampled += 1
        worth = [n / max(s, 1e-9) for n, s in zip(self.rejected, self.seconds, strict=True)]
        cost = {r.name: s for r, s in zip(self.rules, self.seconds, strict=True)}
        self.order = [self.rules[i] for i in sorted(range(len(worth)), key=lambda i: (-worth[i], cost[self.rules[i].name]))]


def failing(text: Text, rules: Sequence[Rule]) -> str | None:
    """Name of the first rule that rejects the text; those after it are not tried."""
    return next((r.name for r in rules if r.rejects(text)), None)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base: Sequence[Rule] = BASE, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, counts of COUNTS, base_failed, kept) for every row.

    The counts are told of every text and are found first. A row that a base rule rejects is not kept; else the cascade of rules
    decides, which may use the counts and tries no rule after one that rejects. Null and empty texts have no words, so the
    default base rejects them. Whole texts are read, whatever their length. Repeated rows give repeated rows, an empty table an
    empty result; other columns are ignored, whatever their names. Rows are judged where they are read.
    """
    ship(docs.sparkSession)
    rows = docs.select(doc_id, text)
    kind = rows.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(rules, sample_rows)
        for b in batches:
            counts, failed, kept = [], [], []
            for t in b.column(1):
                t = Text(t.as_py() or "")
                counts.append([getattr(t, c) for c in COUNTS])
                failed.append(failing(t, base) is not None)
                kept.append(not failed[-1] and cascade.failing(t) is None)
            columns = list(zip(*counts, strict=True)) or [[] for _ in COUNTS]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], names=[doc_id, *COUNTS, "base_failed", "kept"])

    return rows.mapInArrow(run, ", ".join([f"`{doc_id}` {kind}", *(f"{c} long" for c in COUNTS), "base_failed boolean", "kept boolean"]))


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = (*BASE, *RULES), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns, whatever their names; repeated rows stay repeated.

    Each text is tried until a rule rejects it, and no count is found that no rule asks for. Null counts as empty; an empty table stays
    empty. Whole texts are read, whatever their length.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(rules, sample_rows)
        for b in batches:
            at = b.schema.get_field_index(text)
            yield b.filter(pa.array([cascade.failing(Text(t.as_py() or "")) is None for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
tri AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS o(j) GROUP BY doc_id),
top AS (SELECT doc_id, max(n) AS n_top FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM w) GROUP BY ALL) GROUP BY doc_id),
c AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims,
             length(regexp_replace(text, '[^\x{FFFD}]', '', 'g')) AS n_broken, coalesce(n_top, 0) AS n_top, len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_letters,
             len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣·]'))) AS n_bullets, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_teasers
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN top USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words) AND NOT (5 * n_exclaims > n_words) AND NOT (10 * n_broken > n_words) AND NOT (100 * n_dup_lines > 60 * n_lines)
       AND NOT (n_bullets > 0.9 * n_lines) AND NOT (n_teasers > 0.6 * n_lines) AND NOT (n_letters < 0.5 * n_words) AND NOT (100 * n_top > 40 * n_words) AS kept
FROM b
"""
