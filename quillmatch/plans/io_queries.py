"""Registered queries of sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.functions import text as T
from quillmatch.functions.ship import shared_dir
from quillmatch.plans.adapters import AS_OF, grants, matches, table
from quillmatch.sources import feeds, files, html, payloads
from quillmatch.streaming import cycle as C


def folder(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quillmatch-{uuid.uuid4().hex}"


def anchors(s, d) -> DataFrame:
    links = html.links(table(s, d, "pages"))
    return links.groupBy("page_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "title", "href"))), lambda x: F.concat(x["title"], F.lit("="), x["href"])), "|")).alias("anchors"))


def scan(s, d):
    return html.scanned(table(s, d, "pages").withColumn("source", F.lit("Pages")), "page_id", ["/"], skip=["xyz"], min_title=6).select("page_id", "id", "title")


def probe(s, d):
    return html.probe(table(s, d, "pages")).select("page_id", F.col("links").cast("long").alias("links"), F.col("visible").cast("long").alias("visible"), "script_rendered")


def payload_grants(s, d):
    """Opportunities through the main API's payload form, payloads of a hundred of a source as the API gives them."""
    i = F.col("doc_id")
    hit = F.struct(i.cast("string").alias("id"), F.when(i % 4 != 0, F.col("title")).alias("title"), F.when(i % 3 == 0, F.col("source")).alias("agency"), F.concat(F.lit("C"), F.col("source")).alias("agencyCode"), F.when(i % 2 == 0, F.substring("title", 1, 20)).alias("synopsis"), F.lit("more").alias("description"))
    bodies = grants(s, d).groupBy("source", F.floor(i / 100).alias("page")).agg(F.to_json(F.struct(F.struct(F.collect_list(hit).alias("oppHits")).alias("data"))).alias("body"))
    return payloads.main_grants(bodies).select("id", "title", "agency", "synopsis", F.md5("searchable_text").alias("searched"))


def feed_items(s, d):
    """A feed for each page, of items with the page's url."""
    x = table(s, d, "pages").select(F.col("page_id"), F.concat(F.lit("<rss><channel><item><title>Opening no. "), F.col("page_id"), F.lit("</title><link>https://x.example.org/"), F.col("page_id"), F.lit("</link><description>&lt;p&gt;about it&lt;/p&gt;</description></item><item><title>no link</title></item></channel></rss>")).alias("body"))
    return feeds.feed_grants(x, "NIH Guide", key="page_id").select("id", "title", "synopsis")


def history(s, d):
    """Two runs put before each other, cut at the history's length."""
    path = folder(s) + "/history"
    m = matches(s, d).select("pos", "grant_id", "faculty_name")
    files.prepend_history(m.where("pos % 2 = 0"), path)
    files.prepend_history(m.where("pos % 2 = 1"), path)
    return s.read.parquet(path).select("gen", "pos", "grant_id", "faculty_name")


def day_of_matches(s, d):
    path = folder(s) + "/matches"
    files.append_matches(matches(s, d), path)
    return files.matches_of_day(s, path, "2024-01-05").select("faculty_id", "grant_id", "matched_keywords")


def _stream(s, d, name: str) -> DataFrame:
    return s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name}*.parquet")


def _into(spark, stream: DataFrame, mode: str = "append") -> str:
    """Batches into a table, each under its own number, so a batch that runs again replaces what it wrote."""
    top = folder(spark)

    def work(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/out/batch={n}")

    C.cycle(stream, work, f"{top}/state", mode=mode).awaitTermination()
    return f"{top}/out"


def stream_once(s, d):
    """The first event of each user and type."""
    e = _stream(s, d, "events").select(F.concat_ws("-", "user_id", "event_type").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return s.read.parquet(_into(s, C.once(e, time="ts", delay="60 days"))).select("id")


def stream_health(s, d):
    e = _stream(s, d, "events")
    runs = e.select((F.col("user_id") % 20).cast("string").alias("source"), F.col("event_id").cast("string").alias("run"), F.when(F.col("event_type") == "error", -1).when(F.col("event_type") == "purchase", 1).otherwise(0).alias("found"))
    runs = runs.withColumn("run", F.lpad("run", 12, "0"))
    return s.read.parquet(_into(s, C.health(runs), "update")).select("source", "consecutive_zeros", "total_found", "alert")


def stream_matches(s, d):
    """Opportunities of a stream, by foreachBatch, against the keywords of profiles: the batch run's pairs."""
    from quillmatch.operators import matching as M
    from quillmatch.plans.adapters import QUERY_CONFIG, profiles

    top = folder(s)
    docs = _stream(s, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"), F.substring("text", 1, 80).alias("title"), F.lower("text").alias("searchable_text"), F.current_timestamp().alias("arrived"))

    def work(batch: DataFrame, n: int) -> None:
        kw = M.KeywordPass(batch, profiles(batch.sparkSession, d), QUERY_CONFIG).scores()
        kw.select("id", "name", "match_score").write.mode("overwrite").parquet(f"{top}/out/batch={n}")

    C.cycle(C.once(docs, time="arrived"), work, f"{top}/state").awaitTermination()
    return s.read.parquet(f"{top}/out").groupBy("name").agg(F.count("*").alias("n"), F.sum("match_score").cast("long").alias("score"))


QUERIES = {
    "html_anchors": anchors,
    "html_scan": scan,
    "source_probe": probe,
    "payload_grants": payload_grants,
    "feed_items": feed_items,
    "history": history,
    "day_of_matches": day_of_matches,
    "stream_once": stream_once,
    "stream_health": stream_health,
    "stream_matches": stream_matches,
}


def oracles() -> dict[str, str]:
    from quillmatch.plans.oracles import GRANTS, PM, PP

    return {
        "source_probe": "SELECT page_id, len(regexp_extract_all(html, '(?i)<a [^>]*href'))::BIGINT AS links, length(v)::BIGINT AS visible, length(v) < 500 AS script_rendered FROM (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?is)<noscript\\b[^>]*>.*?</noscript\\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS v FROM pages)",
        "payload_grants": f"""WITH {GRANTS} SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 4 <> 0 AND title <> '' THEN title ELSE 'Untitled' END AS title, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'C' || source END AS agency,
 CASE WHEN doc_id % 2 = 0 AND title <> '' THEN substr(title, 1, 20) ELSE 'more' END AS synopsis, md5(lower((CASE WHEN doc_id % 4 <> 0 THEN title ELSE 'None' END) || ' ' || (CASE WHEN doc_id % 2 = 0 THEN substr(title, 1, 20) ELSE 'None' END))) AS searched FROM g""",
        "feed_items": "SELECT 'nih-guide-' || substr(md5('NIH Guide|Opening no. ' || page_id || '|https://x.example.org/' || page_id), 1, 12) AS id, 'Opening no. ' || page_id AS title, 'about it' AS synopsis FROM pages",
        "history": PM + """, h AS (SELECT 1 AS gen, pos, grant_id, faculty_name FROM m WHERE pos % 2 = 0 ORDER BY pos LIMIT 5000), n AS (SELECT 0 AS gen, pos, grant_id, faculty_name FROM m WHERE pos % 2 = 1)
SELECT gen::BIGINT AS gen, pos, grant_id, faculty_name FROM (SELECT * FROM h UNION ALL SELECT * FROM n) ORDER BY gen, pos LIMIT 5000""",
        "day_of_matches": PM + "SELECT CASE WHEN substr(faculty_name, 5)::INT % 4 = 0 THEN faculty_name ELSE 'fac' || substr(faculty_name, 5) || '@example.org' END AS faculty_id, grant_id, array_to_string(keywords, ',') AS matched_keywords FROM m WHERE substr(timestamp, 1, 10) = '2024-01-05'",
        "stream_once": "SELECT DISTINCT user_id || '-' || event_type AS id FROM events",
        "stream_health": """WITH r AS (SELECT (user_id % 20)::VARCHAR AS source, event_id AS run, CASE WHEN event_type = 'error' THEN -1 WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS found FROM events),
h AS (SELECT source, max(run) FILTER (found > 0) AS last, sum(found) FILTER (found >= 0) AS total FROM r GROUP BY 1), z AS (SELECT r.source, count(*) AS n FROM r JOIN h ON r.source = h.source WHERE found >= 0 AND (last IS NULL OR run > last) GROUP BY 1)
SELECT h.source, coalesce(z.n, 0)::BIGINT AS consecutive_zeros, coalesce(total, 0)::BIGINT AS total_found, coalesce(z.n, 0) >= 3 AS alert FROM h LEFT JOIN z USING (source)""",
        "stream_matches": PP + "SELECT name, count(*) AS n, sum(score)::BIGINT AS score FROM kwm GROUP BY 1",
    }
