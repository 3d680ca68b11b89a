"""A paged row service as a Spark data source: one partition per block, retries with back-off, a read-through cache and a row-count check."""

from __future__ import annotations

import gzip
import json
import os
import time
import uuid
import urllib.error
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Block(InputPartition):
    def __init__(self, offset: int):
        self.offset = offset


def fetch(url: str, retries: int = 10, pause: float = 3.0, sleep=time.sleep, opener=urllib.request.urlopen) -> dict:
    """JSON of a url. Waits `pause` before each try; after 429 as long as the server says, after 5xx or a broken connection longer each time."""
    for attempt in range(retries):
        sleep(pause)
        try:
            with opener(url) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code == 429:
                sleep(float(e.headers.get("Retry-After", pause * 2**attempt)))
            elif e.code >= 500:
                sleep(pause * 2**attempt)
            else:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            sleep(pause * 2**attempt)
    raise RuntimeError(f"no answer from {url}")


def cached(path: str | None, get) -> dict:
    """What `get` gives, kept as a gzip file under `path` and read from there the next time. A file is written whole and then named, so a
    reader never meets half of one. The folder must be one that all executors share."""
    if path is None:
        return get()
    if os.path.exists(path):
        with gzip.open(path, "rt", encoding="utf-8") as file:
            return json.load(file)
    page = get()
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as file:
        file.write(gzip.compress(json.dumps(page, sort_keys=True).encode(), 9, mtime=0))
    os.replace(own, path)
    return page


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Block]:
        return [Block(int(x)) for x in self.options["offsets"].split(",")]

    def read(self, partition: Block):
        url = self.options["url"].format(offset=partition.offset, length=self.options.get("length", "100"))
        folder = self.options.get("cache")
        page = cached(f"{folder}/offset-{partition.offset:012d}.json.gz" if folder else None, lambda: fetch(url, pause=float(self.options.get("pause", "3"))))
        expected = self.options.get("total")
        if expected is not None and page.get("num_rows_total") not in (None, int(expected)):
            raise ValueError(f"the source has {page['num_rows_total']} rows now, not {expected}")
        for i, row in enumerate(page["rows"]):
            yield (partition.offset + i, json.dumps(row.get("row", row), sort_keys=True))


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("paged_rows").options(url=..., offsets="0,100").load()"""

    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return "row_index long, row string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))
