"""Feeds: RSS 2.0 and Atom documents as item rows, and a polite HTTP source.

Landed XML files are read by Spark's XML source, which splits big files by item. Requests over the
network are a Python data source with one partition per host: requests to a host go one after
another with a pause, a host that keeps failing is left alone, and a refusal is asked again under
the next identity.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewire.functions.dates import published_at
from tidewire.functions.text import distinct_strings, first_http, first_img, full_text, is_http, item_id, link_or_guid, media_url, strip, text_or_empty
from tidewire.operators.snapshot import ITEMS_PER_SOURCE, capped_per_source

#: Pause and patience per host, refusals, retries and their pause, time limit, identities.
HOST_PAUSE, HOST_FAILURES = 0.4, 5
REFUSALS = (403, 406, 429, 503)
RETRIES, RETRY_PAUSE, TIMEOUT = 2, 0.35, 25.0
PROFILES = {
    "browser": {"User-Agent": "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/128.0 Safari/537.36", "Accept": "text/html,*/*;q=0.8"},
    "bot": {"User-Agent": "feed-collector/1.0"},
}

TEXT = "struct<_VALUE:string,_type:string>"
MEDIA = "array<struct<_url:string,_href:string,_type:string,_medium:string>>"
RSS_ITEM = (
    "title string, link string, guid struct<_VALUE:string>, pubDate string, `dc:date` string, published string, category array<string>, "
    f"description string, enclosure {MEDIA}, `media:content` {MEDIA}, `media:thumbnail` {MEDIA}, "
    f"`media:group` struct<`media:content`:{MEDIA},`media:thumbnail`:{MEDIA}>, image struct<_VALUE:string,_url:string,url:string>, "
    "`content:encoded` string, `yandex:full-text` string, `rbc_news:full-text` string, `turbo:content` string, `full-text` string, fulltext string"
)
ATOM_ENTRY = (
    f"title {TEXT}, id string, published string, updated string, summary {TEXT}, content {TEXT}, "
    "link array<struct<_VALUE:string,_rel:string,_href:string>>, category array<struct<_VALUE:string,_term:string,_label:string>>"
)
#: Fields that may carry a whole article, best first.
FULL_TEXT_FIELDS = ("content:encoded", "yandex:full-text", "rbc_news:full-text", "turbo:content", "full-text", "fulltext")

ITEM_COLUMNS = ("id", "sourceId", "title", "url", "publishedAt", "sourceCategories", "image", "description", "fullText", "ord")


def read_xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Items with the file they come from and their place: files by name, rows in file order."""
    rows = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "false").option("mode", "PERMISSIVE").schema(schema).load(path)
    return rows.withColumns({"__file": F.input_file_name(), "__at": F.monotonically_increasing_id()})


def source_of(file: Column) -> Column:
    """The source of a landed file: its folder's source=NAME, else its name without the ending."""
    folder = F.regexp_extract(file, r"/source=([^/]+)/[^/]*$", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_extract(file, r"([^/]+?)\.[A-Za-z]+$", 1))


def media_nodes(column: str) -> Column:
    return F.transform(
        F.coalesce(F.col(column), F.array().cast(MEDIA)),
        lambda m: F.struct(m["_type"].alias("type"), m["_medium"].alias("medium"), F.coalesce(m["_url"], m["_href"]).alias("url")),
    )


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    rows = read_xml(spark, path, "item", RSS_ITEM)
    media = F.concat(*[media_nodes(c) for c in ("enclosure", "`media:content`", "`media:thumbnail`", "`media:group`.`media:content`", "`media:group`.`media:thumbnail`")])
    found = F.filter(F.transform(media, media_url), lambda u: u.isNotNull())
    own = F.coalesce("image.url", "image._url", "image._VALUE")
    pictures = first_http([first_img(F.col(f"`{c}`")) for c in ("description", "content:encoded", "yandex:full-text")])
    return rows.select(
        source_of(F.col("__file")).alias("sourceId"),
        strip("title").alias("title"),
        link_or_guid("link", F.col("guid._VALUE")).alias("url"),
        published_at(F.col("pubDate"), F.col("published"), F.col("`dc:date`")).alias("publishedAt"),
        distinct_strings(F.transform(F.coalesce("category", F.array().cast("array<string>")), strip)).alias("sourceCategories"),
        F.coalesce(F.get(found, F.lit(0)), F.when(is_http(own), own), pictures).alias("image"),
        strip("description").alias("description"),
        full_text([F.col(f"`{c}`") for c in FULL_TEXT_FIELDS]).alias("fullText"),
        "__at",
    )


def atom_items(spark: SparkSession, path: str) -> DataFrame:
    """Entries in the shape of RSS items: alternate link, published or updated, summary or content, term or label."""
    rows = read_xml(spark, path, "entry", ATOM_ENTRY)
    links = F.coalesce("link", F.array().cast("array<struct<_VALUE:string,_rel:string,_href:string>>"))
    by_rel = lambda rel: F.get(F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == rel), F.lit(0))
    alternate, enclosure = by_rel("alternate"), by_rel("enclosure")
    cats = F.transform(F.coalesce("category", F.array().cast("array<struct<_VALUE:string,_term:string,_label:string>>")), lambda c: F.coalesce(c["_term"], c["_label"], c["_VALUE"]))
    description = F.coalesce("summary._VALUE", "content._VALUE")
    return rows.select(
        source_of(F.col("__file")).alias("sourceId"),
        strip("title._VALUE").alias("title"),
        link_or_guid(F.coalesce(alternate["_href"], alternate["_VALUE"]), F.col("id")).alias("url"),
        published_at(F.col("published"), F.col("updated")).alias("publishedAt"),
        distinct_strings(F.transform(cats, strip)).alias("sourceCategories"),
        first_http([enclosure["_href"], first_img(description)]).alias("image"),
        strip(description).alias("description"),
        F.lit("").alias("fullText"),
        "__at",
    )


def feed_items(spark: SparkSession, rss: str | None = None, atom: str | None = None, per_source: int | None = ITEMS_PER_SOURCE) -> DataFrame:
    """Items of landed feeds, at most so many of a source (None: all, and no task sorts a source), with id and ord (place)."""
    parts = [f for f in (rss and rss_items(spark, rss), atom and atom_items(spark, atom)) if f is not None]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1].withColumn("__at", F.col("__at") + (1 << 62)))
    rows = rows.withColumn("id", item_id("url")).withColumnRenamed("__at", "ord")
    return (rows if per_source is None else capped_per_source(rows, per_source)).select(*ITEM_COLUMNS)


# --- HTTP -----------------------------------------------------------------------------------

Get = Callable[[str, dict[str, str], float], tuple[int, str]]


def http_get(url: str, headers: dict[str, str], timeout: float) -> tuple[int, str]:
    """(status, text); a refusal is an answer, anything that never got through raises."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""


def fetch(url: str, headers: dict[str, str], get: Get = http_get, retries: int = RETRIES, pause: float = RETRY_PAUSE) -> tuple[int, str]:
    """One address with retries; the pause grows with every try."""
    for attempt in range(retries + 1):
        try:
            status, text = get(url, headers, TIMEOUT)
            if 200 <= status < 300 or status in REFUSALS or attempt == retries:
                return status, text
        except OSError:
            if attempt == retries:
                raise
        time.sleep(pause * (attempt + 1))
    raise AssertionError


def fetch_host(urls: Sequence[str], get: Get = http_get, pause: float = HOST_PAUSE, retry_pause: float = RETRY_PAUSE) -> Iterator[tuple[str, str, int, str, str]]:
    """(url, profile, status, text, reason) of each page of one host, in turn.

    A refusal or a challenge page goes to the next identity. After five failures in a row the host
    is left alone, and the rest get a reason and no status.
    """
    failures = 0
    for url in urls:
        if failures >= HOST_FAILURES:
            yield url, "", 0, "", "host given up"
            continue
        last = (url, "", 0, "", "no profile")
        for profile, headers in PROFILES.items():
            try:
                status, text = fetch(url, headers, get, retries=1, pause=retry_pause)
            except OSError as e:
                failures += 1
                last = (url, profile, 0, "", f"{type(e).__name__}: {e}"[:60])
                break
            finally:
                time.sleep(pause)
            if status not in REFUSALS and not 200 <= status < 300:
                failures += 1
                last = (url, profile, status, "", f"HTTP {status}")
                break
            if status not in REFUSALS:
                failures = 0
            last = (url, profile, status, text, "" if text else f"HTTP {status}")
            if status not in REFUSALS and "challenge" not in text[:20_000].lower():
                break
        yield last


class HostPartition(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class PoliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.pause = float(options.get("pause", HOST_PAUSE))

    def partitions(self) -> Sequence[InputPartition]:
        by: dict[str, list[str]] = {}
        for u in self.urls:
            by.setdefault(urlsplit(u).hostname or u, []).append(u)
        return [HostPartition(urls) for urls in by.values()] or [HostPartition([])]

    def read(self, partition: HostPartition) -> Iterator[tuple]:
        yield from fetch_host(partition.urls, pause=self.pause)


class PoliteSource(DataSource):
    """spark.read.format("polite_http").option("urls", "https://a/1 https://b/2").load()"""

    @classmethod
    def name(cls) -> str:
        return "polite_http"

    def schema(self) -> str:
        return "url string, profile string, status int, text string, reason string"

    def reader(self, schema) -> PoliteReader:
        return PoliteReader(self.options)


def fetch_pages(pages: DataFrame) -> DataFrame:
    """Pages of a frame (url) fetched politely: rows of one host meet in one task and go in turn."""
    from tidewire.functions.text import host_of

    def run(batches):
        import pandas as pd

        by: dict[str, list[str]] = {}
        for pdf in batches:
            for url in pdf["url"]:
                by.setdefault(urlsplit(url).hostname or url, []).append(url)
        for urls in by.values():
            yield pd.DataFrame(list(fetch_host(urls)), columns=["url", "profile", "status", "text", "reason"])

    hosts = pages.select("url").filter(text_or_empty("url") != "").repartition(host_of("url"))
    return hosts.mapInPandas(run, "url string, profile string, status int, text string, reason string")
