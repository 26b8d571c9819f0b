"""A batch data source that fetches web pages.

    spark.dataSource.register(HttpPages)
    spark.read.format("http_pages").option("urls", json.dumps([...])).load()

Every URL is a row: (url, status, html, error). Errors are data. Each partition
fetches its own part of the list with retries and exponential backoff; tests
give a ``file://`` or ``data:`` URL or a fetcher of their own.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class HttpPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return "url string, status int, html string, error string"

    def reader(self, schema) -> DataSourceReader:
        return HttpPagesReader(self.options)


class HttpPagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options.get("urls", "[]"))
        self.attempts = max(1, int(options.get("retries", "3")))
        self.backoff, self.timeout = float(options.get("backoff", "1.0")), float(options.get("timeout", "15"))
        self.size = max(1, int(options.get("urls_per_partition", "50")))

    def partitions(self) -> list[InputPartition]:
        return [_Part(self.urls[a : a + self.size]) for a in range(0, len(self.urls), self.size)] or [_Part([])]

    def read(self, partition: InputPartition):
        for url in partition.urls:
            yield (url, *fetch(url, self.attempts, self.backoff, self.timeout))


def scan(urls: DataFrame, robots: DataFrame, **options) -> DataFrame:
    """Pages of the URLs whose host robots(host, allowed) allows; the others are rows with the error robots_blocked."""
    from tessera.operators.graph import robots_gate

    spark = urls.sparkSession
    spark.dataSource.register(HttpPages)
    gated = robots_gate(urls.select("url").distinct(), robots)
    wanted = [r.url for r in gated.where("allowed").collect()]
    read = spark.read.format("http_pages").option("urls", json.dumps(wanted)).options(**options).load()
    return read.unionByName(gated.where("NOT allowed").select("url", F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("html"), F.lit("robots_blocked").alias("error")))


def fetch(url: str, attempts: int, backoff: float, timeout: float) -> tuple[int | None, str | None, str | None]:
    """(status, text, error) after at most ``attempts`` tries; other faults than network ones fail at once."""
    error = "not tried"
    for n in range(attempts):
        if n:
            time.sleep(backoff * 2 ** (n - 1))
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:
                return getattr(r, "status", None) or 200, r.read().decode("utf-8", "replace"), None
        except urllib.error.HTTPError as e:
            error = f"HTTP {e.code}"
            if e.code < 500 and e.code != 429:
                return e.code, None, error
        except (urllib.error.URLError, TimeoutError) as e:
            error = f"{type(e).__name__}: {e}"
        except ValueError as e:
            return None, None, f"{type(e).__name__}: {e}"
    return None, None, error
