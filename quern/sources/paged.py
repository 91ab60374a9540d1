"""A paged HTTP source of JSON records, as a Python data source: one request at a time, retries with growing pauses."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetch_json(url: str, attempts: int = 5, pause: float = 1.0, most: float = 60.0, get: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> dict:
    """The JSON object at a URL. After a failure it waits for Retry-After, or twice as long as the last time."""
    for i in range(attempts):
        try:
            with get(url) as answer:
                return json.loads(answer.read())
        except Exception as error:
            if i + 1 == attempts:
                raise
            told = getattr(error, "headers", None)
            after = told.get("Retry-After") if told else None
            sleep(float(after) if after and str(after).isdigit() else min(most, pause * 2**i))
    raise AssertionError


def pages(url: str, parameters: dict[str, str], fetch: Callable[[str], dict], delay: float = 0.0, sleep: Callable = time.sleep) -> Iterator[dict]:
    """The answers to a query and to its continuations, which each answer names under ``continue``."""
    more: dict[str, str] = {}
    while True:
        answer = fetch(f"{url}?{urllib.parse.urlencode({**parameters, **more})}")
        yield answer
        more = answer.get("continue") or {}
        if not more:
            return
        sleep(delay)


class PagedJson(DataSource):
    """Options: url, items (dotted path to the list in an answer), delay, and any ``query.NAME`` for the request."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # a continuation can only be followed in order

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        parameters = {k[6:]: v for k, v in self.options.items() if k.startswith("query.")}
        for answer in pages(self.options["url"], parameters, fetch_json, float(self.options.get("delay", 0))):
            found = answer
            for step in self.options.get("items", "items").split("."):
                found = found.get(step) if isinstance(found, dict) else None
            for item in found or ():
                yield (json.dumps(item, ensure_ascii=False),)
