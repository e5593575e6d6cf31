"""Fetching as a Python data source: ``spark.read.format("fetch").option("requests", json)``, a partition for each host."""

from __future__ import annotations

import json
import time
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.error import URLError
from urllib.parse import urlsplit
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillmatch.functions.ship import ship


@dataclass
class Host(InputPartition):
    requests: tuple[str, ...]


class FetchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.requests = json.loads(options["requests"])
        self.delay, self.timeout = float(options.get("delay", 2.0)), float(options.get("timeout", 20))

    def partitions(self) -> list[Host]:
        """A host's requests are one partition, so its delay holds however many executors there are."""
        by = defaultdict(list)
        for r in self.requests:
            by[urlsplit(r["url"]).netloc].append(json.dumps(r))
        return [Host(tuple(v)) for v in by.values()]

    def read(self, partition: Host) -> Iterator[tuple]:
        for i, r in enumerate(map(json.loads, partition.requests)):
            if i:
                time.sleep(self.delay)
            data = json.dumps(r["body"]).encode() if "body" in r else None
            headers = {"User-Agent": "quillmatch"} | ({"Content-Type": "application/json"} if data else {})
            try:
                with urlopen(Request(r["url"], data, headers), timeout=self.timeout) as answer:
                    yield r.get("source", ""), r["url"], answer.status or 200, answer.read().decode("utf-8", "replace"), None
            except (URLError, OSError, ValueError) as e:  # one source's failure is no other's
                yield r.get("source", ""), r["url"], -1, None, str(e)[:500]


class Fetch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fetch"

    def schema(self) -> str:
        return "source string, url string, status int, body string, error string"

    def reader(self, schema) -> FetchReader:
        return FetchReader(self.options)


def fetch(spark: SparkSession, requests: list[dict], delay: float = 2.0) -> DataFrame:
    """(source, url, status, body, error) of each request {url, source, body}; a failed one has status -1."""
    ship(spark)
    spark.dataSource.register(Fetch)
    return spark.read.format("fetch").option("requests", json.dumps(requests)).option("delay", delay).load()


def registry(spark: SparkSession, sources: list[tuple[str, str, str, str]], include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(key, name, url, patterns) of the sources to read; patterns are parted by commas."""
    rows = F.array(*(F.struct(*map(F.lit, s)) for s in sources)).cast("array<struct<key:string,name:string,url:string,patterns:string>>")
    out = spark.range(1).select(F.inline(rows))
    if include:
        out = out.where(F.col("key").isin(*include))
    return out.where(~F.col("key").isin(*exclude)) if exclude else out


def combined(frames: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All sources' opportunities in the order given, and (source_key, n) of each; a source may lack columns."""
    out = None
    for k, f in frames.items():
        f = f.withColumn("source_key", F.lit(k))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out, out.groupBy("source_key").agg(F.count("*").alias("n"))
