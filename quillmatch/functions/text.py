"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic in prose, and words that only add noise when they stand alone.
PROSE_STOPS = (
    "with", "that", "this", "from", "have", "been", "they", "their", "which", "will", "also", "more", "than", "when", "some", "into",
    "other", "were", "after", "about", "these", "both", "such", "very", "through", "between", "during", "multiple", "several",
    "currently", "previously", "including", "focused", "focuses", "working", "worked", "studies", "studying", "trained", "training",
    "received", "completed", "joined", "using", "university", "maryland", "school", "medicine", "department", "division", "section",
    "faculty", "professor", "assistant", "associate", "adjunct", "fellow", "instructor", "member", "staff", "board", "certified",
    "interested", "interests", "interest", "area", "areas", "field", "fields", "include", "includes", "included", "focus", "research",
    "laboratory", "lab", "group", "team", "project", "projects", "program", "programs", "study", "approach", "approaches",
)
LONE_NOISE = (
    "also", "thus", "role", "such", "lead", "leads", "novel", "known", "using", "used", "well", "with", "both", "than", "when", "where",
    "which", "have", "been", "they", "their", "from", "that", "this",
)


def normalize(c: Column) -> Column:
    """Lower case; each character outside ``a-z0-9`` and space becomes one space, without collapsing."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " ")


def keyword_key(c: Column) -> Column:
    return F.trim(normalize(c))


def collapse(c: Column) -> Column:
    """White space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def padded(c: Column) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


def has_phrase(text: Column, phrase: Column) -> Column:
    """If a normalised phrase stands in a normalised text at word boundaries. Runs of spaces must agree."""
    return F.contains(padded(text), padded(phrase))


def first_of(*options: Column) -> Column:
    """The first option that is neither null nor empty, else the empty string."""
    return F.coalesce(*(F.nullif(o, F.lit("")) for o in options), F.lit(""))


def literal_array(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def first_contained(c: Column, terms: Sequence[str]) -> Column:
    """The first of the terms, in their order, that is a substring; null if none is."""
    return F.try_element_at(F.filter(literal_array(terms), lambda t: F.contains(c, t)), F.lit(1))


def phrases(c: Column, most: int = 40, stops: Sequence[str] = PROSE_STOPS, noise: Sequence[str] = LONE_NOISE) -> Column:
    """Phrases of one to three words of a prose text, without repeats, shorter phrases first, at most ``most``.

    Words have three or more characters. A lone word has five or more and is in neither stop list; both words of a pair, and two of
    a triple, have four or more and are no stop words.
    """
    stop, lone = literal_array(stops), literal_array([*stops, *noise])
    words = F.filter(F.split(F.lower(F.regexp_replace(c, r"[^a-zA-Z0-9\- ]", " ")), " +"), lambda t: F.length(t) >= 3)

    def telling(t: Column) -> Column:
        return ~F.array_contains(stop, t) & (F.length(t) >= 4)

    def window(k: int, good) -> Column:
        starts = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))
        kept = F.filter(F.transform(starts, lambda i: F.slice(words, i, k)), good)
        return F.transform(kept, lambda w: F.array_join(w, " "))

    one = F.filter(words, lambda t: (F.length(t) >= 5) & ~F.array_contains(lone, t))
    two = window(2, lambda w: F.forall(w, telling))
    three = window(3, lambda w: F.size(F.filter(w, telling)) >= 2)
    return F.slice(F.array_distinct(F.concat(one, two, three)), 1, most)


def listed(c: Column) -> Column:
    """Items parted by ``, ; • |`` of 4 to 119 characters; none unless there are two."""
    items = F.filter(F.transform(F.split(c, "[,;•|]"), lambda p: F.trim(p)), lambda p: (F.length(p) > 3) & (F.length(p) < 120))
    return F.when(F.size(items) >= 2, items).otherwise(F.array().cast("array<string>"))


def keyword_line(c: Column) -> Column:
    """Items of a line that begins with ``Keyword:`` or ``Keywords:``, of three or more characters."""
    items = F.split(F.regexp_replace(c, r"(?i)^keywords?\s*:", ""), "[,;]")
    return F.filter(F.transform(items, lambda p: F.trim(p)), lambda p: F.length(p) > 2)


TITLES = r"(?i),?\s*\b(m\.?d\.?|ph\.?d\.?|m\.?p\.?h\.?|m\.?s\.?|r\.?n\.?|d\.?o\.?|d\.?d\.?s\.?|pharm\.?d\.?|m\.?b\.?b\.?s\.?|facs|facp)(?=\s|,|$)\.?"


def without_titles(c: Column) -> Column:
    """A name without academic titles after a comma; the pattern is anchored at word boundaries, so no name is cut."""
    return collapse(F.regexp_replace(F.regexp_replace(c, r"(?i),\s*[a-z.]{2,7}(\s*,\s*[a-z.]{2,7})*\s*$", ""), TITLES, ""))


def name_parts(c: Column) -> Column:
    """(first, last) of a name without titles."""
    words = F.split(without_titles(c), " +")
    return F.struct(F.element_at(words, 1).alias("first"), F.element_at(words, -1).alias("last"))


def author_query(c: Column) -> Column:
    """``Last F`` for author searches."""
    p = name_parts(c)
    return F.concat(p["last"], F.lit(" "), F.substring(p["first"], 1, 1))


def merged_keywords(old: Column, new: Column) -> Column:
    """old, then those of new that old does not have in any case; new is not deduplicated in itself."""
    old = F.coalesce(old, F.array().cast("array<string>"))
    return F.concat(old, F.filter(new, lambda k: ~F.exists(old, lambda e: F.lower(e) == F.lower(k))))


def merged_sources(old: Column, source: Column) -> Column:
    old = F.coalesce(old, F.array().cast("array<string>"))
    return F.when(F.array_contains(old, source), old).otherwise(F.concat(old, F.array(source)))


def _series(items: Column) -> Column:
    n = F.size(items)
    most = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 1, F.get(items, F.lit(0))).when(n == 2, F.concat(F.get(items, F.lit(0)), F.lit(" and "), F.get(items, F.lit(1)))).otherwise(F.concat(most, F.lit(", and "), F.try_element_at(items, F.lit(-1))))


def profile_sentence(name: Column, department: Column, keywords: Column, most: int = 40) -> Column:
    """A profile as prose for embedding: an opening by name and department, then the first ``most`` keywords.

    The sentences are fixed values, as vectors follow from them.
    """
    name, department = F.coalesce(name, F.lit("")), F.coalesce(department, F.lit(""))
    opening = (
        F.when((name != "") & (department != ""), F.concat(name, F.lit(" is a researcher in "), department, F.lit(".")))
        .when(name != "", F.concat(name, F.lit(" is a biomedical researcher.")))
        .when(department != "", F.concat(F.lit("A researcher in "), department, F.lit(".")))
    )
    items = F.slice(F.coalesce(keywords, F.array().cast("array<string>")), 1, most)
    verb = F.when(F.size(items) == 1, "Their research focuses on ").otherwise("Their research interests include ")
    about = F.when(F.size(items) > 0, F.concat(verb, _series(items), F.lit(".")))
    return F.trim(F.concat_ws(" ", opening, about))


def grant_sentence(title: Column, agency: Column, synopsis: Column, most: int = 400) -> Column:
    """``title. agency. synopsis``, the synopsis cut, without empty parts."""
    parts = F.array(F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(agency, F.lit(""))), F.trim(F.substring(F.coalesce(synopsis, F.lit("")), 1, most)))
    return F.array_join(F.filter(parts, lambda p: p != ""), ". ")


def source_base(c: Column) -> Column:
    """A keyword source without what stands in parentheses."""
    return F.trim(F.element_at(F.split(c, r"\("), 1))


def highlighted(text: Column, keywords: Column, most: int = 15) -> Column:
    """The text with ``<mark>`` around occurrences of the first keywords, whatever the case; longer ones go first."""
    words = F.array_sort(F.slice(keywords, 1, most), lambda a, b: F.length(b) - F.length(a))
    quoted = F.transform(words, lambda k: F.concat(F.lit(r"\Q"), k, F.lit(r"\E")))
    return F.when(F.size(words) > 0, F.regexp_replace(text, F.concat(F.lit("(?i)("), F.array_join(quoted, "|"), F.lit(")")), F.lit("<mark>$1</mark>"))).otherwise(text)


def mined_tokens(c: Column, stops: Sequence[str] = PROSE_STOPS) -> Column:
    """Words of four or more letters, in lower case, without repeats and stop words."""
    stop = literal_array(stops)
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0)), lambda t: ~F.array_contains(stop, t)))


LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})[^\[]*\[(\w+)\]\s+([\w.]+):\s?(.*)$"


def log_fields(c: Column) -> Column:
    """(at, level, module, message) of a log line; null for a line of another form."""
    names = ("at", "level", "module", "message")
    return F.when(F.rlike(c, F.lit(LOG_LINE)), F.struct(*(F.regexp_extract(c, LOG_LINE, i + 1).alias(n) for i, n in enumerate(names))))


def initials(c: Column) -> Column:
    words = F.filter(F.split(c, "[ ,]"), lambda w: w != "")
    return F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1)), "")


def surrogate_key(source: Column, title: Column, url: Column) -> Column:
    """A key for an item without id: the source's name and 12 hex digits of the MD5 of source, title and url."""
    return F.concat(F.replace(F.lower(source), F.lit(" "), F.lit("-")), F.lit("-"), F.substring(F.md5(F.concat_ws("|", source, title, url)), 1, 12))
