"""4. URL filters: a blocked Bloom filter before an exact hash join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.common import Bloom, Scratch, table, unused

#: (rule, verdict) of host and path together; these are told in the result.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: The listed sites are families of names, each under several endings and with numbered mirrors, as such sites move about.
FAMILIES = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x")
ENDINGS = ("example.com", "example.net", "example.org", "example.info", "com", "net", "org", "info", "biz", "top")
MIRRORS = 5000


def listed_sites(spark: SparkSession, families: Sequence[str] = FAMILIES, endings: Sequence[str] = ENDINGS, mirrors: int = MIRRORS) -> DataFrame:
    """(rule) of canonical URLs of sites: each family under each ending, plain and with a number from 2 to ``mirrors``."""
    family, ending = (F.explode(F.array(*map(F.lit, x))) for x in (families, endings))
    named = spark.range(1, mirrors + 1).withColumn("family", family).withColumn("ending", ending)
    number = F.when(F.col("id") > 1, F.col("id").cast("string")).otherwise(F.lit(""))
    return named.select(F.concat("family", number, F.lit("."), "ending", F.lit("/")).alias("rule"))


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_host(h: Column) -> Column:
    """A host without user, port and dots at its end, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(h), r"(?s)^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")


def canonical_path(p: Column) -> Column:
    """A path with ``/`` at its start, percent-codes decoded where they can be, and runs of ``/`` as one."""
    decoded = F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)
    return F.regexp_replace(F.concat(F.lit("/"), F.when(F.contains(p, F.lit("%")), decoded).otherwise(p)), "/+", "/")


def folder(p: Column) -> Column:
    """A path up to its last ``/``."""
    return F.regexp_extract(p, r"(?s)^(.*/)", 1)


def suffixes(h: Column) -> Column:
    """A host and its parent domains; none of an empty host."""
    labels = F.split(h, r"\.")
    return F.when(h != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def folders(p: Column) -> Column:
    """The folders of a path that begins with ``/``, from ``/`` on."""
    steps = F.split(folder(p), "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")))


def listed_entries(listed: DataFrame) -> DataFrame:
    """(site, key, start) of listed (rule), canonical: the host, the host with the last folder, and all of the path."""
    h = canonical_host(F.substring_index("rule", "/", 1))
    p = canonical_path(F.expr("substring(rule, locate('/', rule))"))
    named = listed.where(F.contains("rule", F.lit("/"))).select(h.alias("site"), p.alias("start")).where("site <> ''")
    return named.select("site", F.concat("site", folder(F.col("start"))).alias("key"), "start").distinct()


def listed_urls(urls: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """(url), once each, of the URLs that are on the list: a listed URL fits its host and subdomains, if the path starts with its.

    Host and path are canonical for this. A URL tries the names of its host and parent domains on a blocked Bloom filter of listed sites and
    URLs, which is broadcast and of bounded size; only for a name that passes are the path's folders tried. What passes, few
    besides true hits, meets the list in an exact hash join of shuffles, open to skew splitting. No row moves before.
    """
    scratch = Scratch(urls.sparkSession)
    entries = scratch.keep(listed_entries(listed), "entries")
    hashes = entries.select(F.xxhash64("site").alias("h")).unionByName(entries.select(F.xxhash64("key").alias("h")))
    bloom = Bloom(hashes, 2 * entries.count(), scratch)
    rows = urls.select(F.col(url).alias("url"))
    rows = rows.withColumn("host", canonical_host(host(F.col("url")))).withColumn("path", canonical_path(path(F.col("url"))))
    rows = rows.withColumn("site", F.explode(suffixes(F.col("host")))).drop("host")
    sites = bloom.passed(rows, F.xxhash64(rows["site"]))
    tried = sites.select("url", "path", F.explode(F.transform(folders(F.col("path")), lambda f: F.concat(F.col("site"), f))).alias("key"))
    passed = bloom.passed(tried, F.xxhash64(tried["key"]))
    hits = passed.join(entries.select("key", "start").hint("shuffle_hash"), "key").where(F.startswith(F.col("path"), F.col("start")))
    return scratch.keep(hits.select("url").distinct(), "hits")


def verdicts(h: Column, p: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, of equal ones the first by code point; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        site, slash, rest = rule.partition("/")
        fits = F.endswith(F.concat(F.lit("."), h), F.lit(f".{site.lower()}")) & F.startswith(p, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def filter_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = RULES, listed: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict) for every row: the verdict of the longest rule that fits, else block if listed, else allow.

    ``rules`` are few and are tried in each row. ``listed`` is a table with a column ``rule`` of any size, or names of URLs like
    ``example.org/folder/``; without it ``listed_sites``. A null url, or one without ``://``, has an empty host and path and
    is allowed. Repeated rows give repeated rows. A long URL tries as many names as its host has parts, and folders only of names
    that are listed. An empty table gives an empty result; other columns are ignored, whatever their names.

    Only the URLs that are on the list are brought back to their rows, by shuffles at every size.
    """
    spark = pages.sparkSession
    if listed is None:
        listed = listed_sites(spark)
    elif not isinstance(listed, DataFrame):
        listed = spark.createDataFrame([(r,) for r in listed], "rule string")
    name = unused([page_id], "_url")
    rows = pages.select(page_id, F.col(url).alias(name))
    h, p = host(F.col(name)), path(F.col(name))
    found = verdicts(h, p, rules)
    hits = listed_urls(rows.where(F.col(name).isNotNull() & (h != "") & found.isNull()), listed, name)
    joined = rows.join(hits.withColumn("listed", F.lit(True)).hint("merge"), rows[name] == hits["url"], "left")
    verdict = F.coalesce(found["verdict"], F.when(F.col("listed"), "block"), F.lit("allow"))
    return joined.select(page_id, h.alias("host"), p.alias("path"), found["rule"].alias("rule"), verdict.alias("verdict"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


OP4_SQL = rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r AS (SELECT page_id, host, path,
      CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
           WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
           WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
           WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule,
      regexp_extract(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', ''), '(^|\.)({"|".join(FAMILIES)})([1-9][0-9]*)?\.({"|".join(x.replace(".", chr(92) + ".") for x in ENDINGS)})$', ['dot', 'family', 'number', 'ending']) AS site FROM p)
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
       ELSE CASE WHEN site['family'] <> '' AND coalesce(try_cast(site['number'] AS INT), 2) BETWEEN 2 AND {MIRRORS} THEN 'block' ELSE 'allow' END END AS verdict
FROM r
"""
