"""A remote registry as a batch source, read by ranges of keys, with retries.

    spark.dataSource.register(RegistryApi)
    answers = spark.read.format("registry_api").option("base", "https://registry.example").option("doc_type", "passport")...load()

A key is a prefix and a number: ``prefix`` and ``width`` make ``P0000017`` of 17. The numbers from ``low`` up to, not
with, ``high`` are dealt into ``partitions`` ranges, each read by a task of its own, so a lost task asks for its
range again and no other. With the option ``narrow``, and spark.sql.python.filterPushdown.enabled set, filters on the number
(``n``) narrow the ranges before any request is made.

Rows: key, n, http_status (null where no connection came about in ``attempts`` attempts), record (JSON text of an answer
with status 200), attempts. lookup.api_lookup() makes statuses of them. A refusal (any answer of the server but 429 and
5xx) is not asked again; others are, after a pause that doubles.

``base`` is http(s)://host, asked at /v1/verify with ``api_key`` as bearer, or a folder of JSON lines that stands for
the service: objects with key, http_status, record and optionally ``fails``, the number of attempts that break before
it answers; a key that no line has refuses connections. Without ``api_key`` nothing is asked and every answer is 401.
"""

from __future__ import annotations

import glob
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "key string, n long, http_status int, record string, attempts int"
#: Statuses worth another attempt.
AGAIN = (429, 500, 502, 503, 504)


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


def fetch_http(options: dict, key: str) -> tuple[int, str | None]:
    """Status and body of one request; no connection is a ConnectionError."""
    query = urllib.parse.urlencode({"doc_type": options.get("doc_type", ""), "id": key})
    request = urllib.request.Request(f"{options['base'].rstrip('/')}/v1/verify?{query}", headers={"Authorization": f"Bearer {options['api_key']}"})
    try:
        with urllib.request.urlopen(request, timeout=float(options.get("timeout", 5))) as answer:
            return answer.status, answer.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, None
    except (OSError, ValueError) as e:
        raise ConnectionError(str(e)) from e


class Recorded:
    """Answers out of files, for the keys of one range."""

    def __init__(self, folder: str, wanted: set[str]):
        self.answers, self.asked = {}, {}
        for path in glob.glob(f"{re.sub('^file:/+', '/', folder)}/**/*.json", recursive=True):
            with open(path, encoding="utf-8") as lines:
                for line in lines:
                    answer = json.loads(line)
                    if answer["key"] in wanted:
                        self.answers[answer["key"]] = answer

    def __call__(self, options: dict, key: str) -> tuple[int, str | None]:
        answer = self.answers.get(key)
        self.asked[key] = self.asked.get(key, 0) + 1
        if answer is None or answer.get("http_status") is None or self.asked[key] <= answer.get("fails", 0):
            raise ConnectionError(key)
        record = answer.get("record")
        return answer["http_status"], record if record is None or isinstance(record, str) else json.dumps(record)


class RegistryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.low, self.high = int(options.get("low", 0)), int(options.get("high", 0))

    def partitions(self) -> list[InputPartition]:
        n, size = max(1, int(self.options.get("partitions", 8))), max(0, self.high - self.low)
        cuts = [self.low + size * i // n for i in range(n + 1)]
        return [Range(a, b) for a, b in zip(cuts, cuts[1:]) if a < b] or [Range(0, 0)]

    def key(self, n: int) -> str:
        return f"{self.options.get('prefix', '')}{n:0{int(self.options.get('width', 0))}d}"

    def read(self, partition: Range) -> Iterator[tuple]:
        numbers = range(partition.low, partition.high)
        if not self.options.get("api_key"):
            for n in numbers:
                yield self.key(n), n, 401, None, 0
            return
        remote = self.options["base"].startswith(("http://", "https://"))
        fetch = fetch_http if remote else Recorded(self.options["base"], {self.key(n) for n in numbers})
        for n in numbers:
            yield (self.key(n), n, *self.ask(fetch, self.key(n)))

    def ask(self, fetch, key: str) -> tuple[int | None, str | None, int]:
        most, pause = max(1, int(self.options.get("attempts", 3))), float(self.options.get("pause", 0.2))
        status = None
        for attempt in range(1, most + 1):
            try:
                status, body = fetch(self.options, key)
                if status not in AGAIN:
                    return status, body if status == 200 else None, attempt
            except ConnectionError:
                status = None
            if attempt < most:
                time.sleep(pause * 2 ** (attempt - 1))
        return status, None, most


class NarrowingReader(RegistryReader):
    """A reader that narrows its range by filters on the number; sessions must allow filters to go to Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) != ("n",):
                yield f
            elif isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f


class RegistryApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "registry_api"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RegistryReader:
        if "base" not in self.options and self.options.get("api_key"):
            raise ValueError("registry_api needs the option base")
        return (NarrowingReader if self.options.get("narrow", "false").lower() == "true" else RegistryReader)(self.options)
