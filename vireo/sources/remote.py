"""Remote catalogue as a Python data source: pages of ids fetched in parallel, with retries.

``spark.read.format("remote_catalog").option("url", "https://host/page?ids={ids}").option("first", 1).option("last", 500).load()``
gives (id, json). A page is one partition; 429 waits as told, server errors wait ``pause`` seconds, five tries at most. With option
``failures`` the ids of a page that couldn't be had are rows without json, so that they can be asked for again; else there are none.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE = 50
TRIES = 5


class Page(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def fetch(url: str, pause: float) -> list[dict] | None:
    """A page's documents; None after the last try or on a client error."""
    for _ in range(TRIES):
        try:
            with urllib.request.urlopen(url, timeout=30) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            if e.code == 429:
                time.sleep(float(e.headers.get("Retry-After") or pause))
            elif e.code >= 500:
                time.sleep(pause)
            else:
                return None
        except OSError:
            time.sleep(pause)
    return None


class CatalogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.pause = options["url"], float(options.get("pause", 5))
        self.first, self.last = int(options["first"]), int(options["last"])
        self.failures = options.get("failures", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [Page(k, min(k + PAGE, self.last + 1)) for k in range(self.first, self.last + 1, PAGE)]

    def read(self, page: Page) -> Iterator[tuple[int, str]]:
        ids = ",".join(map(str, range(page.first, page.last)))
        found = fetch(self.url.replace("{ids}", ids), self.pause)
        if found is None and self.failures:
            yield from ((i, None) for i in range(page.first, page.last))
        for d in found or []:
            yield int(d["id"]), json.dumps(d, ensure_ascii=False)


class RemoteCatalog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "remote_catalog"

    def schema(self) -> str:
        return "id int, json string"

    def reader(self, schema) -> CatalogReader:
        return CatalogReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RemoteCatalog)
