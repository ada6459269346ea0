"""Sources behind services: one Python data source whose fetcher is a parameter, and the shaping of what they return."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkloom.functions import fixed, text


class Fetched(DataSource):
    """Rows (key, title, text, url) for each of ``keys``, from the pickled function ``fetcher``, in ``parts`` tasks.

    A key whose fetch fails, or gives nothing, has no row. Register with ``spark.dataSource.register(Fetched)``; options are
    made by ``fetched_options``.
    """

    @classmethod
    def name(cls) -> str:
        return "fetched"

    def schema(self) -> str:
        return "key string, title string, text string, url string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.keys = [k for k in options.get("keys", "").split("\n") if k]
        self.fetch = pickle.loads(bytes.fromhex(options["fetcher"]))
        self.parts = max(1, min(int(options.get("parts", "8")), len(self.keys) or 1))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.keys[i :: self.parts]) for i in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for key in partition.value:
            try:
                rows = self.fetch(key)
            except Exception:  # noqa: BLE001  a failed fetch is a missing row
                continue
            for title, body, url in rows or ():
                yield key, title, body, url


def fetched_options(keys: list[str], fetcher: object, parts: int = 8) -> dict[str, str]:
    from pyspark import cloudpickle

    return {"keys": "\n".join(keys), "fetcher": cloudpickle.dumps(fetcher).hex(), "parts": str(parts)}


def pages(fetched: DataFrame, html: str = "html") -> DataFrame:
    """title, text, source ``web``, url of fetched HTML (url, html)."""
    return fetched.select(text.html_title(F.col(html), F.col("url")).alias("title"), text.html_text(F.col(html)).alias("text"), F.lit("web").alias("source"), "url")


def search_results(results: DataFrame) -> DataFrame:
    """Documents of search results (title, link, snippet, page): the snippet where no page was fetched."""
    return results.select("title", F.coalesce(F.nullif(F.trim("page"), F.lit("")), "snippet").alias("text"), F.lit("web").alias("source"), F.col("link").alias("url"))


def posts(listings: DataFrame, column: str = "value") -> DataFrame:
    """Documents of forum listings in JSON: posts with a body, titled, body after a heading."""
    schema = "struct<data: struct<children: array<struct<data: struct<title: string, selftext: string, permalink: string, score: bigint>>>>>"
    rows = listings.select(F.explode(F.from_json(column, schema)["data"]["children"]["data"]).alias("p")).where(F.trim("p.selftext") != "")
    return rows.select("p.title", F.concat(F.lit("# "), "p.title", F.lit("\n\n"), "p.selftext").alias("text"), F.lit("reddit").alias("source"), F.concat(F.lit("https://www.reddit.com"), "p.permalink").alias("url"))


def top_posts(responses: DataFrame) -> DataFrame:
    """title, text, url, score of the posts in responses (status, content_type, body); none of responses that failed or are no JSON."""
    schema = "struct<data: struct<children: array<struct<data: struct<title: string, selftext: string, permalink: string, score: bigint>>>>>"
    fine = responses.where((F.col("status") == 200) & F.contains(F.lower("content_type"), F.lit("json")))
    rows = fine.select(F.explode(F.from_json("body", schema)["data"]["children"]["data"]).alias("p"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(blank("p.title").alias("title"), blank("p.selftext").alias("text"), F.concat(F.lit("https://www.reddit.com"), blank("p.permalink")).alias("url"), F.coalesce("p.score", F.lit(0)).alias("score"))


def repository_names(responses: DataFrame, column: str = "body", most: int = 5) -> DataFrame:
    """repo (``owner/name``) of the first ``most`` items of search responses in JSON."""
    items = F.from_json(column, "struct<items: array<struct<full_name: string>>>")["items"]["full_name"]
    return responses.select(F.explode(F.slice(items, 1, most)).alias("repo")).where("repo is not null")


def repository_files(trees: DataFrame, most: int = 20) -> DataFrame:
    """repo, path of the first ``most`` files of each tree (repo, paths) that have a known suffix and no leading dot."""
    wanted = F.filter("paths", lambda p: p.rlike(r"(?i)\.(py|md|txt|ipynb)$") & ~F.element_at(F.split(p, "/"), -1).startswith(".") & ~p.startswith("."))
    return trees.select("repo", F.explode(F.slice(wanted, 1, most)).alias("path"))


def decoded(contents: DataFrame, column: str = "content") -> DataFrame:
    """Rows with base64 contents (line feeds allowed) as text."""
    return contents.withColumn("text", F.decode(F.unbase64(F.regexp_replace(column, r"\s", "")), "UTF-8"))


def route_url(url: Column) -> Column:
    """(kind, value): the repository's name for addresses on the code host, else the address itself."""
    repo = F.regexp_replace(F.regexp_replace(url, r"^https?://(www\.)?github\.com/", ""), "/+$", "")
    host = F.contains(url, F.lit("github.com"))
    return F.struct(F.when(host, "repo").otherwise("url").alias("kind"), F.when(host, repo).otherwise(url).alias("value"))


def drive_action(mime: Column) -> Column:
    """What to do with a file of a drive by its type: export as text or csv, download, or skip."""
    return (
        F.when(mime == "application/vnd.google-apps.document", "export:text/plain")
        .when(mime == "application/vnd.google-apps.spreadsheet", "export:text/csv")
        .when(mime.isin("application/pdf", "text/plain", "text/markdown"), "download")
        .otherwise("skip")
    )


def topic_rows(web: DataFrame, forum: DataFrame, code: DataFrame, topic: str) -> DataFrame:
    """Documents (title, text, source, url) on a topic: pages up to 8,000 characters, posts that name it up to 4,000, repositories."""
    cut = lambda df, n: df.withColumn("text", F.substring("text", 1, n)).select("title", "text", "source", "url")
    named = forum.where(F.contains(F.lower(F.concat_ws(" ", "title", "text")), F.lit(topic.lower())))
    return cut(web, 8000).unionByName(cut(named, 4000)).unionByName(code.select("title", "text", "source", "url"))


SUFFIXES = fixed.REPO_SUFFIXES
