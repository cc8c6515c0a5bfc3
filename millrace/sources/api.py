"""A paginated HTTP product source as a Python data source: one partition for each category.

    spark.dataSource.register(ProductApi)
    spark.read.format("product_api").option("categories", "milk=Milks,rice=Rices").load("https://host/search")

Requests are tried four times with growing delays. A category of which a page still fails, or that has more than ``max_pages`` pages, is logged and left out as a whole: rows
of some pages would move its watermark past those of the others, which would then never be asked for. So a task holds a category's new rows, page_size * max_pages at most,
until it has all of them. Records come with ``last_modified_t`` above the category's watermark only. A category ends with an empty or
short page. A path that isn't HTTP is a folder of pages ``<category>/<page>.json``, for tests and replays.
"""

from __future__ import annotations

import json
import logging
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

log = logging.getLogger(__name__)
SCHEMA = "barcode string, product_name string, brands string, categories_tags string, quantity string, lang string, last_modified_t bigint, taxonomy_key string, raw_payload string"
TRIES = 4


class Source(Protocol):
    """Anything that fetches raw records newer than the watermarks."""

    def fetch(self, spark: SparkSession, since: dict[str, int]) -> DataFrame: ...


def with_retry(get: Callable[[], object], delay: float = 1.0, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> object:
    """The result of the first call that doesn't raise; waits delay, 2 delay, 4 delay in between."""
    for k in range(tries):
        try:
            return get()
        except Exception:
            if k == tries - 1:
                raise
            sleep(delay * 2**k)


def record(raw: dict, taxonomy_key: str) -> tuple:
    """One row of SCHEMA; missing fields become empty texts or nulls."""
    text = lambda name: str(raw.get(name) or "").strip()
    optional = lambda name: None if raw.get(name) is None else str(raw[name])
    try:
        modified = int(raw.get("last_modified_t") or 0)
    except (TypeError, ValueError):
        modified = 0
    tags = "|".join(map(str, raw.get("categories_tags") or []))
    return text("code"), text("product_name"), optional("brands"), tags, optional("quantity"), optional("lang"), modified, taxonomy_key, json.dumps(raw, sort_keys=True)


class Category(InputPartition):
    def __init__(self, key: str, name: str, since: int):
        self.key, self.name, self.since = key, name, since


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.base = options["path"]
        self.page_size, self.max_pages = int(options.get("page_size", "100")), int(options.get("max_pages", "1000"))
        self.delay = float(options.get("delay_s", "1"))

    def partitions(self) -> list[Category]:
        since = json.loads(self.options.get("since", "{}"))
        pairs = [c.partition("=")[::2] for c in self.options["categories"].split(",")]
        return [Category(key, name or key, int(since.get(key, 0))) for key, name in pairs]

    def page(self, category: Category, number: int) -> list[dict]:
        if self.base.startswith(("http://", "https://")):
            query = urllib.parse.urlencode({"category": category.name, "page": number, "page_size": self.page_size, "json": 1})
            with urllib.request.urlopen(f"{self.base}?{query}", timeout=30) as answer:
                return json.load(answer).get("products", [])
        try:
            with open(f"{self.base}/{category.key}/{number}.json") as file:
                return json.load(file).get("products", [])
        except FileNotFoundError:
            return []

    def read(self, partition: Category) -> Iterator[tuple]:
        rows: list[tuple] = []
        for number in range(1, self.max_pages + 1):
            try:
                products = with_retry(lambda n=number: self.page(partition, n), self.delay)
            except Exception as error:
                log.warning("category %s left out, page %d: %s", partition.key, number, error)
                return
            rows += [row for raw in products if (row := record(raw, partition.key))[6] > partition.since]
            if len(products) < self.page_size:
                yield from rows
                return
        log.warning("category %s left out: more than %d pages", partition.key, self.max_pages)


class ProductApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "product_api"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)


class ProductSource:
    """The Source over ProductApi."""

    def __init__(self, path: str, categories: dict[str, str], **options: str):
        self.path, self.categories, self.options = path, categories, options

    def fetch(self, spark: SparkSession, since: dict[str, int]) -> DataFrame:
        spark.dataSource.register(ProductApi)
        reader = spark.read.format("product_api").option("categories", ",".join(f"{k}={v}" for k, v in self.categories.items())).option("since", json.dumps(since))
        for key, value in self.options.items():
            reader = reader.option(key, value)
        return reader.load(self.path)
