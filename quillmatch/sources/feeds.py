"""RSS and Atom feeds from stored text, with native XML functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.functions import text as T


def _items(feeds: DataFrame, tag: str, key: str, xml: str, fields: dict[str, str]) -> DataFrame:
    rows = feeds.select(key, F.posexplode(F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}[\s>].*?</{tag}>"), F.lit(0))).alias("pos", "x"))
    rows = rows.select(key, "pos", *(F.trim(F.xpath_string("x", F.lit(f"{tag}/{path}"))).alias(c) for c, path in fields.items()))
    return rows.where("title <> '' and link <> ''")


def feed_items(feeds: DataFrame, key: str = "url", xml: str = "body", min_title: int = 0) -> DataFrame:
    """(key, pos, title, link, description, pub_date) of each feed; Atom entries where a feed has no RSS items."""
    rss = _items(feeds, "item", key, xml, {"title": "title", "link": "link", "description": "description", "pub_date": "pubDate"})
    no_rss = feeds.join(rss.select(key).distinct(), key, "left_anti")
    atom = _items(no_rss, "entry", key, xml, {"title": "title", "link": "link/@href", "description": "summary"}).withColumn("pub_date", F.lit(""))
    return rss.unionByName(atom).where(F.length("title") >= min_title)


def feed_grants(feeds: DataFrame, source: str, agency: str = "", key: str = "url", xml: str = "body", min_title: int = 10) -> DataFrame:
    """Opportunities of a source's feeds; the synopsis is the description without tags, cut at 2,000 characters."""
    i = feed_items(feeds, key, xml, min_title)
    title, about = F.col("title"), F.substring(T.collapse(T.strip_tags(F.col("description"))), 1, 2000)
    return i.select(
        T.surrogate_key(F.lit(source), title, F.col("link")).alias("id"), F.lit(source).alias("source"), "title", F.lit(agency or source).alias("agency"), "link", about.alias("synopsis"),
        F.col("pub_date").alias("open_date"), F.lower(F.concat_ws(" ", title, about, F.lit(agency or source))).alias("searchable_text"),
    )
