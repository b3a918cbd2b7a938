"""Articles of a MediaWiki API as a Spark data source: `spark.dataSource.register(ArticleSource)`, then `spark.read.format("articles")`."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from larkspur.sources import corpus
from larkspur.sources.shared import new_folder

#: The columns there are. status: ok, missing (no such page, text is null), or, if failures are kept, what the server said last.
COLUMNS = "title string, text string, status string"


class Titles(InputPartition):
    def __init__(self, titles: list[str]):
        self.titles = titles


class ArticleReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = schema.names
        if unknown := set(self.names) - {"title", "text", "status"}:
            raise ValueError(f"no such columns of articles: {', '.join(sorted(unknown))}")
        self.titles = json.loads(options.get("titles", "[]"))
        self.api, self.agent = options.get("api", ""), options.get("agent", "larkspur")
        self.retries, self.timeout = int(options.get("retries", "4")), float(options.get("timeout", "30"))
        self.pause, self.wait = float(options.get("pause", "0")), float(options.get("wait", "5"))
        self.keep = options.get("failures", "raise") == "keep"
        self.parts = max(1, int(options.get("partitions", "8")))
        if not self.api and {"text", "status"} & set(self.names):
            raise ValueError("the option api must name the address of a MediaWiki API")

    def partitions(self) -> list[InputPartition]:
        n = min(self.parts, max(len(self.titles), 1))
        return [Titles(self.titles[k::n]) for k in range(n)]

    def read(self, partition: Titles) -> Iterator[tuple]:
        rows = ({"title": t} for t in partition.titles)
        if {"text", "status"} & set(self.names):
            get = corpus.http_get(self.api, self.agent, self.timeout)
            rows = articles(get, partition.titles, retries=self.retries, pause=self.pause, wait=self.wait, keep=self.keep)
        return (tuple([row[c] for c in self.names]) for row in rows)


class ArticleSource(DataSource):
    """Options: api (address), titles (JSON list), agent, partitions (8; each asks for its titles one by one, so this is how many requests there are at once),
    retries (4), wait (seconds before the first retry that the server doesn't time, 5), pause (seconds between requests, 0), timeout (30), failures (raise, or keep as rows).

    A schema of some of the columns asks for these alone: without text and status no request is made. A task that is lost reads its titles again.
    """

    @classmethod
    def name(cls) -> str:
        return "articles"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArticleReader(schema, dict(self.options))


def articles(get, titles: list[str], *, retries: int = 4, pause: float = 0.0, wait: float = 5.0, keep: bool = False) -> Iterator[dict]:
    """A row (title, text, status) a title, in order. Null and blank titles are missing, without a request."""
    for k, title in enumerate(titles):
        if not (title or "").strip():
            yield {"title": title, "text": None, "status": "missing"}
            continue
        if k and pause:
            time.sleep(pause)
        try:
            text = corpus.fetch_article(get, title, retries=retries, wait=wait)
        except (RuntimeError, OSError, json.JSONDecodeError) as e:
            if not keep:
                raise
            yield {"title": title, "text": None, "status": f"failed: {e}"}
            continue
        yield {"title": title, "text": text, "status": "missing" if text is None else "ok"}


def read_articles(titles: DataFrame, api: str, *, agent: str = "larkspur", at_once: int = 8, retries: int = 4, wait: float = 5.0, pause: float = 0.0, timeout: float = 30.0, failures: str = "raise", folder: str | None = None) -> DataFrame:
    """The same for a table of titles of any size, which never comes to the driver: each distinct title is asked for once, by `at_once` tasks.

    The answers are written to a folder of their own (or `folder`, which must be new) and read from there, so nothing that reads them asks the server again.
    """
    spark, names = titles.sparkSession, ["title", "text", "status"]

    def run(parts: Iterator) -> Iterator:
        import pandas as pd

        get = corpus.http_get(api, agent, timeout)
        for part in parts:
            # Few rows at a time leave the worker, for articles may be long.
            for at in range(0, len(part), 64):
                some = [None if pd.isna(t) else t for t in part["title"].iloc[at : at + 64]]
                yield pd.DataFrame(articles(get, some, retries=retries, pause=pause, wait=wait, keep=failures == "keep"), columns=names)

    folder = folder or new_folder(spark, "articles")
    titles.select(F.col("title").cast("string").alias("title")).distinct().repartition(at_once, "title").mapInPandas(run, COLUMNS).write.parquet(folder)
    return spark.read.schema(COLUMNS).parquet(folder)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArticleSource)
