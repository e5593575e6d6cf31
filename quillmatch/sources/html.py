"""HTML as rows: stored pages parsed in Arrow batches, on the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmatch.functions import text as T
from quillmatch.functions.ship import ship
from quillmatch.operators.relevance import is_junk_title

# Words in a link's text that tell it leads to no opportunity.
SKIP_WORDS = ("privacy", "contact", "about", "login", "careers", "donate", "news", "blog", "faq", "terms")
BLOCKS = {"p", "div", "li", "ul", "ol", "br", "tr", "td", "th", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "title", "dd", "dt"}
HIDDEN = {"script", "style", "noscript", "template"}


VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class Page(HTMLParser):
    """Anchors, table rows, headings and lines of visible text. An anchor that is not closed ends at the next one."""

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.anchors: list[tuple[str, str]] = []
        self.parts: list[str] = []
        self.hidden, self.open, self.inside = 0, None, []
        #: (tag, parent, first part, last part) of elements; of each anchor the element; of elements that are open their numbers.
        self.elements: list[list] = [["", -1, 0, 0]]
        self.of_anchor: list[int] = []
        self.stack = [0]
        self.feed(html or "")
        self.close()
        self._end_anchor()
        for i in self.stack:
            self.elements[i][3] = len(self.parts)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "a":
            self._end_anchor()
            self.open = dict(attrs).get("href")
        elif tag in BLOCKS:
            self.parts.append("\n")
        if tag not in VOID:
            self.elements.append([tag, self.stack[-1], len(self.parts), len(self.parts)])
            self.stack.append(len(self.elements) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a":
            self._end_anchor()
        at = next((k for k in range(len(self.stack) - 1, 0, -1) if self.elements[self.stack[k]][0] == tag), None)
        if at is not None:
            for i in self.stack[at:]:
                self.elements[i][3] = len(self.parts)
            del self.stack[at:]
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if self.open is not None:
                self.inside.append(data)

    def _end_anchor(self) -> None:
        if self.open is not None:
            self.anchors.append((" ".join("".join(self.inside).split()), self.open))
            self.of_anchor.append(next((i for i in reversed(self.stack) if self.elements[i][0] == "a"), 0))
        self.open, self.inside = None, []

    def text(self, element: int) -> str:
        _, _, a, z = self.elements[element]
        return " ".join("".join(self.parts[a:z]).split())

    def lines(self) -> list[str]:
        return [x for x in (" ".join(line.split()) for line in "".join(self.parts).split("\n")) if x]

    def around(self, anchor: int, levels: int) -> Iterator[str]:
        """Texts of the elements that hold an anchor, from the next one out."""
        i = self.elements[self.of_anchor[anchor]][1]
        while i >= 0 and levels:
            yield self.text(i)
            i, levels = self.elements[i][1], levels - 1

    def first(self, tag: str) -> str:
        return next((self.text(i) for i, e in enumerate(self.elements) if e[0] == tag), "")

    def rows(self) -> list[tuple[list[str], str, str]]:
        """Cells of each table row with a link in its first cell, and that link's text and href."""
        cells: dict[int, list[int]] = {}
        for i, (tag, parent, _, _) in enumerate(self.elements):
            if tag == "td" and self.elements[parent][0] == "tr":
                cells.setdefault(parent, []).append(i)
        found: dict[int, tuple[str, str]] = {}
        for anchor, at in zip(self.anchors, self.of_anchor, strict=True):
            while at > 0:
                row = self.elements[at][1]
                if row in cells and cells[row][0] == at:
                    found.setdefault(row, anchor)
                at = row
        return [([self.text(i) for i in cells[r]], *found[r]) for r in sorted(found)]


def resolved(href: str, base: str | None) -> str:
    try:
        return href if href.startswith("http") else urljoin(base or "", href)
    except ValueError:  # no url at all
        return href


def parsed(pages: DataFrame, html: str, schema: str, rows: Callable[[Page, str | None], Iterator[tuple]], base: str | None = None) -> DataFrame:
    """pages, without html, with the columns of schema for each row that ``rows`` makes of a page; columns of these names give way."""
    spark = pages.sparkSession
    ship(spark)
    made = StructType.fromDDL(schema)
    names = {f.name.lower() for f in made}
    others = [c for c in pages.columns if c != html and c.lower() not in names]
    whole = pages.select(*others, html, *([F.col(base).alias("_base")] if base else []))
    out = StructType([*(whole.schema[c] for c in others), *made])
    types = [f.type for f in _arrow(made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, found = [], []
            bases = b.column(len(others) + 1).to_pylist() if base else [None] * b.num_rows
            for i, (text, at) in enumerate(zip(b.column(len(others)).to_pylist(), bases, strict=True)):
                new = list(rows(Page(text), at))
                index += [i] * len(new)
                found += new
            columns = [pa.array([x[k] for x in found], t) for k, t in enumerate(types)]
            take = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(len(others))), *columns], names=out.fieldNames())

    return whole.mapInArrow(run, out)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def links(pages: DataFrame, html: str = "html", base: str = "url") -> DataFrame:
    """pages, without html, with a row (pos, title, href, link) for each anchor that has an href."""

    def rows(page: Page, at: str | None) -> Iterator[tuple]:
        for i, (title, href) in enumerate(page.anchors):
            yield i, title, href, resolved(href, at)

    return parsed(pages, html, "pos int, title string, href string, link string", rows, base)


def lines(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages, without html, with a row (line_no, line) for each line of visible text."""
    return parsed(pages, html, "line_no int, line string", lambda page, _: enumerate(page.lines()))


def cells(pages: DataFrame, html: str = "html", base: str = "url") -> DataFrame:
    """pages, without html, with a row (cells, title, href, link) for each table row that has a link in its first cell."""

    def rows(page: Page, at: str | None) -> Iterator[tuple]:
        for texts, title, href in page.rows():
            yield texts, title, href, resolved(href, at)

    return parsed(pages, html, "cells array<string>, title string, href string, link string", rows, base)


def facts(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with (visible, h1): the number of visible characters, white space at lines' ends left out, and the first heading."""
    own = pages.withColumn("_html", F.col(html))
    out = parsed(own, "_html", "visible long, h1 string", lambda page, _: [(sum(map(len, page.lines())), page.first("h1"))])
    return out.select(*pages.columns, "visible", "h1")


# How a link to a profile is called, and the degrees after a name.
FULL_PROFILE = re.compile(r"View full profile", re.I)
DEGREES = "PhD|MD|DO|DrPH|DPT|MPH|MS|DSc|MBBS|MBChB|DrMed|MGC|MHS|Dpharm|DDS|BA|BS"
DEGREED = re.compile(rf"([A-Z][a-zA-Z'\-.]+(?:[\s,]+[A-Z][a-zA-Z'\-.]+)*)\s*,\s*(?:{DEGREES})")
EDU_MAIL = re.compile(r"[\w.+-]+@[\w.-]+\.edu")


def profile_links(pages: DataFrame, html: str = "html", base: str = "url", levels: int = 6) -> DataFrame:
    """pages, without html, with (pos, name, email, link) for each link to a full profile with a degreed name around it.

    The name is that of the innermost element that holds one, and the email the first met on the way there.
    """

    def rows(page: Page, at: str | None) -> Iterator[tuple]:
        for i, (title, href) in enumerate(page.anchors):
            if not FULL_PROFILE.search(title):
                continue
            email = ""
            for text in page.around(i, levels):
                mail, name = EDU_MAIL.search(text), DEGREED.search(text)
                email = email or (mail[0] if mail else "")
                if name:
                    yield i, name[0].split(",")[0].strip(), email, resolved(href, at)
                    break

    return parsed(pages, html, "pos int, name string, email string, link string", rows, base)


def scanned(pages: DataFrame, page: str, patterns: Sequence[str], skip: Sequence[str] = SKIP_WORDS, min_title: int = 10, seen: DataFrame | None = None, source: str = "source") -> DataFrame:
    """Opportunities among the anchors of pages (page, source, url, html): a row (page, source, id, title, link).

    An anchor counts if its href has one of the patterns, its text is long enough, has no skip word and is no junk. The first
    anchor of a link on a page counts, then those whose id was seen are left out.
    """
    l = links(pages)
    href, title = F.lower("href"), F.col("title")
    hit = F.exists(T.literal_array(patterns), lambda p: F.contains(href, p))
    skipped = F.exists(T.literal_array(skip), lambda w: F.contains(F.lower(title), w))
    good = l.where(hit & (F.length(title) >= min_title) & (F.col("link") != F.col("url")) & ~skipped & ~is_junk_title(title))
    first = good.withColumn("_n", F.expr(f"row_number() over (partition by `{page}`, link order by pos)")).where("_n = 1")
    out = first.select(page, source, T.surrogate_key(F.col(source), title, F.col("link")).alias("id"), "title", "link")
    return out.join(seen.select("id"), "id", "left_anti") if seen is not None else out


STATUS = ("Open", "Upcoming", "Closed", "Receiving Invited Applications", "Applications Under Review")


def without_status(title: Column) -> Column:
    """A title without the status words before it, taken off one after the other."""
    for s in STATUS:
        title = F.trim(F.regexp_replace(title, rf"^{re.escape(s)}", ""))
    return title


def visible_text(html: Column) -> Column:
    """The text between tags, without what scripts and styles hold, white space collapsed."""
    for tag in ("script", "style", "noscript"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return T.collapse(T.strip_tags(html))


def probe(pages: DataFrame, page: str = "page_id", html: str = "html", patterns: Sequence[str] = ()) -> DataFrame:
    """(page, status, links, hits, visible, script_rendered) of stored pages; under 500 visible characters a page is rendered by script.

    hits is, for each of the patterns, the number of links whose href has it.
    """
    body = F.coalesce(html, F.lit(""))
    visible = F.length(visible_text(body))
    n = F.regexp_count(body, F.lit("(?i)<a [^>]*href"))
    hits = F.array(*(F.regexp_count(body, F.lit(rf"(?i)<a [^>]*href=[\"'][^\"'>]*{re.escape(p)}")) for p in patterns)).cast("array<int>")
    return pages.select(page, F.when(F.col(html).isNotNull(), 200).alias("status"), n.alias("links"), hits.alias("hits"), visible.alias("visible"), (visible < 500).alias("script_rendered"))


def probe_again(first: DataFrame, other: DataFrame, page: str = "page_id") -> DataFrame:
    """Probes of sources; where the first page failed or has no links, that of the other address, if it is there."""
    o = other.select(*(F.col(c).alias(f"_{c}") for c in other.columns))
    worse = (F.coalesce("status", F.lit(0)) != 200) | (F.col("links") == 0)
    use = worse & F.col("_status").isNotNull()
    return first.join(o, first[page] == o[f"_{page}"], "left").select(page, *(F.when(use, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in first.columns if c != page))


# Degrees by which a line is a name, and words by which it is none.
CREDENTIAL = r"\b(PhD|MD|DO|DrPH|DPT|MPH|MS|DSc|DDS|DMD|MBBS|MBChB|DrMed|MGC|MHS|DrPH|Dpharm)\b"
NO_NAME = ("view full", "copyright", "school of medicine", "skip to", "quick links", "search")


def directory(lines: DataFrame, page: str, no_name: Sequence[str] = NO_NAME) -> DataFrame:
    """(page, line_no, name, email, keywords) of a department page's lines (page, line_no, line).

    An email line sets the email; else a line with a degree, shorter than 120 characters, with a first and last name and none of
    the words that are no name, sets the name. A keyword line is a row with the last name and with the email since the row before it.
    """
    mail = F.regexp_extract("line", r"([\w.+-]+@[\w.-]+\.edu)", 1)
    degree = F.rlike("line", F.lit(CREDENTIAL))
    line = F.lower("line")
    named = degree & (F.length("line") < 120) & F.rlike("line", F.lit(r"[A-Z][a-z]+\s+[A-Z][a-z]")) & ~F.exists(T.literal_array(no_name), lambda w: F.contains(line, w))
    is_kw = (mail == "") & ~degree & F.rlike("line", F.lit(r"(?i)^keywords?\s*:"))
    l = lines.withColumn("_m", F.when(mail != "", mail)).withColumn("_name", F.when((mail == "") & named, F.col("line"))).withColumn("_k", is_kw)
    so_far = f"partition by `{page}` order by line_no rows between unbounded preceding and current row"
    l = l.withColumn("name", F.expr(f"last(_name, true) over ({so_far})")).withColumn("_row", (F.col("_k") & F.col("name").isNotNull()).cast("int"))
    l = l.withColumn("_part", F.expr(f"sum(_row) over ({so_far})") - F.col("_row"))
    l = l.withColumn("email", F.expr(f"last(_m, true) over (partition by `{page}`, _part order by line_no rows between unbounded preceding and current row)"))
    return l.where("_row = 1").select(page, "line_no", "name", F.coalesce("email", F.lit("")).alias("email"), T.keyword_line(F.col("line")).alias("keywords"))


def department_profiles(pages: DataFrame, page: str, suffix: str = "", base: str = "url") -> DataFrame:
    """(page, pos, name, department, email, keywords, profile_url) of department pages (page, url, html).

    First the rows of ``directory``, then the profiles that are linked but have no keywords there, by name in any case, each once. The
    department is the first heading without the suffix. A row's profile_url is that of the link with its name before the comma.
    """
    heads = facts(pages.select(page, "html")).select(page, F.trim(F.replace("h1", F.lit(suffix), F.lit(""))).alias("department")) if suffix else facts(pages.select(page, "html")).select(page, F.col("h1").alias("department"))
    told = directory(lines(pages.select(page, "html")), page)
    linked = profile_links(pages.select(*dict.fromkeys((page, base)), "html"), base=base).withColumn("_who", F.lower("name"))
    linked = linked.groupBy(page, "_who").agg(F.min_by(F.struct("pos", "name", "email", "link"), "pos").alias("x")).select(page, "_who", "x.*")
    told = told.withColumn("_who", F.lower(F.trim(F.substring_index("name", ",", 1))))
    mine = told.join(linked.select(page, "_who", F.col("link").alias("profile_url")), [page, "_who"], "left")
    mine = mine.select(page, F.col("line_no").alias("pos"), "name", "email", "keywords", F.coalesce("profile_url", F.lit("")).alias("profile_url"))
    more = linked.join(told.select(page, "_who").distinct(), [page, "_who"], "left_anti")
    more = more.select(page, (F.col("pos") + 1_000_000).alias("pos"), "name", "email", F.array().cast("array<string>").alias("keywords"), F.col("link").alias("profile_url"))
    return mine.unionByName(more).join(heads, page, "left")


# Headings under which interests stand.
HEADING = (
    r"(?i)^\s*(research\s+(interests?|summary|focus|areas?|background|expertise)|areas?\s+of\s+(research|expertise|interest)|"
    r"clinical\s+(interests?|expertise|focus)|laboratory\s+(focus|interests?|overview)|scientific\s+(interests?|focus)|expertise|my\s+research)\s*:?\s*$"
)


def profile_keywords(lines: DataFrame, page: str, most: int = 40) -> DataFrame:
    """(page, strategy, keywords) of a profile page's lines: by a heading of interests, a keyword line, paragraphs, or all text.

    The first strategy that finds something counts: items after a heading like ``Research interests``, the keyword line, phrases of
    paragraphs of over 120 characters, phrases of the page.
    """
    heading = F.rlike("line", F.lit(HEADING))
    l = lines.withColumn("_after", F.expr(f"lag(line) over (partition by `{page}` order by line_no)"))
    after = F.rlike("_after", F.lit(HEADING))
    found = l.groupBy(page).agg(
        F.flatten(F.collect_list(F.when(after, F.when(F.size(T.listed(F.col("line"))) > 0, T.listed(F.col("line"))).otherwise(T.phrases(F.col("line")))))).alias("a"),
        F.flatten(F.collect_list(F.when(F.rlike("line", F.lit(r"(?i)^keywords?\s*:")), T.keyword_line(F.col("line"))))).alias("b"),
        F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.when(F.length("line") > 120, F.struct("line_no", "line")))), lambda x: x["line"])).alias("c"),
        F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.when(~heading, F.struct("line_no", "line")))), lambda x: x["line"])).alias("d"),
    )
    tries = [("interests", F.col("a")), ("keywords", F.col("b")), ("paragraphs", T.phrases(F.col("c"))), ("page", T.phrases(F.col("d")))]
    every = F.array(*(F.struct(F.lit(n).alias("strategy"), F.slice(F.array_distinct(k), 1, most).alias("keywords")) for n, k in tries))
    first = F.try_element_at(F.filter(every, lambda x: F.size(x["keywords"]) > 0), F.lit(1))
    return found.select(page, first["strategy"].alias("strategy"), F.coalesce(first["keywords"], F.array().cast("array<string>")).alias("keywords"))
