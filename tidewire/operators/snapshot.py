"""The snapshot's life: dedupe, merge with the previous one, prune, choose work, images, index and articles."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import EXCERPT_CHARS, distinct_strings, escape_html, item_id, redact, strip, text_or_empty, trim_excerpt
from tidewire.operators.feed import newest_first, time_key, when

#: Fixed values of the builder.
ITEMS_PER_SOURCE = 120
KEEP_DAYS, KEEP_ITEMS = 7, 4000
PAGES_PER_RUN, TRIES = 400, 3
IMAGE_HOURS, SHARED_IMAGE = 24, 8
SHORT_EXCERPT, FULL_REBUILD_CHARS = 40, 8000
MIN_ARTICLE_CHARS = 120
REBUILT_SOURCE = "habr"


def capped_per_source(items: DataFrame, most: int = ITEMS_PER_SOURCE) -> DataFrame:
    """The first items of each source in feed order; Spark keeps only that many per task before the shuffle."""
    rn = F.row_number().over(Window.partitionBy("sourceId").orderBy("ord"))
    return items.withColumn("__rn", rn).filter(F.col("__rn") <= most).drop("__rn")


def dedupe_by_url(items: DataFrame) -> DataFrame:
    """One row per address: the first row, with all rubrics, the first picture, the longest excerpt (first of equals).

    All parts are aggregates with a map-side combine but the rubrics, of which only distinct ones
    are gathered, each with its first place.
    """
    rows = items.filter(text_or_empty("url") != "")
    rest = [c for c in items.columns if c not in ("url", "ord", "sourceCategories", "image", "excerpt")]
    merged = rows.groupBy("url").agg(
        F.min("ord").alias("ord"),
        F.min_by(F.struct(*rest), "ord").alias("__first"),
        F.min_by("image", F.when(text_or_empty("image") != "", F.col("ord"))).alias("image"),
        F.max_by("excerpt", F.struct(F.length(text_or_empty("excerpt")), F.negative("ord"))).alias("excerpt"),
    )
    tags = rows.select("url", "ord", F.posexplode(F.coalesce("sourceCategories", F.array().cast("array<string>"))).alias("p", "tag"))
    tags = tags.filter("tag <> ''").groupBy("url", "tag").agg(F.min(F.struct("ord", "p")).alias("at"))
    tags = tags.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "tag"))), lambda t: t["tag"]).alias("sourceCategories"))
    out = merged.join(tags, "url", "left").withColumn("sourceCategories", F.coalesce("sourceCategories", F.array().cast("array<string>")))
    return out.withColumn("image", text_or_empty("image")).select("*", "__first.*").drop("__first").select(*items.columns)


def with_articles(previous: DataFrame, articles: DataFrame) -> DataFrame:
    """Previous index rows with the text they were stored with: inline if there is one, else from the articles."""
    a = articles.select(F.col("id").alias("__id"), F.col("contentHtml").alias("__html"), F.col("contentTruncated").alias("__cut"))
    inline = F.col("contentHtml") if "contentHtml" in previous.columns else F.lit(None).cast("string")
    cut = F.col("contentTruncated") if "contentTruncated" in previous.columns else F.lit(None).cast("boolean")
    joined = previous.withColumns({"__own": F.nullif(inline, F.lit("")), "__own_cut": cut}).join(
        a, item_id("url") == F.col("__id"), "left"
    )
    flagged = F.coalesce("hasContent", F.lit(False))
    return joined.withColumns(
        {
            "contentHtml": F.coalesce("__own", F.when(flagged, F.nullif("__html", F.lit("")))),
            "contentTruncated": F.when(F.col("__own").isNotNull(), F.col("__own_cut")).otherwise(F.when(flagged, F.col("__cut"))),
        }
    ).drop("__id", "__html", "__cut", "__own", "__own_cut")


MERGED = (
    "id", "sourceId", "sourceName", "title", "url", "publishedAt", "sourceCategories", "image", "excerpt",
    "contentHtml", "contentTruncated", "contentTries", "ord",
)


def merge_previous(fresh: DataFrame, previous: DataFrame) -> DataFrame:
    """Full outer join by address. Fresh fields win; what they lack comes from the previous row, and a
    fresh excerpt under 40 characters gives way to any stored one. Carried rows come after fresh ones.

    A carried row without stored rubrics keeps null, and is then mapped by address alone.
    """
    f, p = fresh.filter(text_or_empty("url") != "").alias("f"), previous.filter(text_or_empty("url") != "").alias("p")
    both = f.join(p, F.col("f.url") == F.col("p.url"), "full_outer")
    new, old = F.col("f.url").isNotNull(), F.col("p.url").isNotNull()
    empty = lambda c: text_or_empty(c) == ""
    take = lambda name: F.when(new, F.col(f"f.{name}"))
    gives_html = empty("f.contentHtml") & ~empty("p.contentHtml")
    tries = F.when(F.col("p.contentTries") > 0, F.col("p.contentTries"))
    last = fresh.agg(F.max("ord").alias("__last"))
    out = both.join(F.broadcast(last)).select(
        F.when(new, F.col("f.id")).otherwise(item_id("p.url")).alias("id"),
        take("sourceId").otherwise(text_or_empty("p.sourceId")).alias("sourceId"),
        take("sourceName").otherwise(text_or_empty("p.sourceName")).alias("sourceName"),
        take("title").otherwise(text_or_empty("p.title")).alias("title"),
        F.coalesce("f.url", "p.url").alias("url"),
        F.coalesce("f.publishedAt", "p.publishedAt").alias("publishedAt"),
        F.when(new, F.col("f.sourceCategories")).otherwise(distinct_or_null("p.sourceCategories")).alias("sourceCategories"),
        F.when(~empty("f.image"), F.col("f.image")).otherwise(text_or_empty("p.image")).alias("image"),
        F.when(new & ~(old & (F.length(text_or_empty("f.excerpt")) < SHORT_EXCERPT) & F.col("p.excerpt").isNotNull()), text_or_empty("f.excerpt"))
        .otherwise(text_or_empty("p.excerpt"))
        .alias("excerpt"),
        F.when(new & ~gives_html, text_or_empty("f.contentHtml")).otherwise(text_or_empty("p.contentHtml")).alias("contentHtml"),
        F.coalesce(F.when(new & ~gives_html, F.col("f.contentTruncated")).otherwise(F.col("p.contentTruncated")), F.lit(False)).alias("contentTruncated"),
        F.when(new, F.coalesce(tries, F.col("f.contentTries"))).otherwise(tries).alias("contentTries"),
        F.coalesce(F.col("f.ord"), F.coalesce("__last", F.lit(0)) + 1 + F.col("p.ord")).alias("ord"),
    )
    return out.select(*MERGED)


def distinct_or_null(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), distinct_strings(name))


def prune(items: DataFrame, now: datetime | Column, days: int = KEEP_DAYS, most: int = KEEP_ITEMS) -> DataFrame:
    """Newest first; older than the days are out, undated rows stay but sort last; at most so many rows.

    The last place that is kept is found first, by times and places alone: the one task that cuts then gets the kept rows,
    not as many whole rows of every task.
    """
    old = F.col("publishedAt") < when(now) - F.expr(f"interval {days} days")
    kept = items.filter(~F.coalesce(old, F.lit(False)))
    place = F.struct(F.negative(F.unix_micros(time_key())).alias("t"), "ord")
    last = kept.select(place.alias("place")).orderBy("place").limit(most).agg(F.max("place"))
    return kept.filter(place <= last.scalar()).orderBy(*newest_first()).limit(most)


def interleaved(items: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Round-robin over sources: each source's own order is kept; sources go by their first row.

    rn is a row's place in its source, first its source's first place; order by both.
    """
    source = text_or_empty("sourceId")
    firsts = items.groupBy(source.alias("__source")).agg(F.min("place").alias("first"))
    rn = F.row_number().over(Window.partitionBy("__source").orderBy("place"))
    out = items.withColumn("__source", source).withColumn("rn", rn).join(firsts, "__source").drop("__source")
    return out, [F.col("rn"), F.col("first")]


def needs_text(items: DataFrame) -> Column:
    """Rows whose page is worth a request: no text and tries left, or a stored text of the rebuilt source that lost its code."""
    html = F.lower(text_or_empty("contentHtml"))
    can = F.coalesce("contentTries", F.lit(0)) < TRIES
    no_code = ~html.contains("<pre") & ~html.contains("<code")
    rebuild = (F.col("sourceId") == REBUILT_SOURCE) & (no_code | (F.length("contentHtml") < FULL_REBUILD_CHARS))
    return can & ((html == "") | F.coalesce(rebuild, F.lit(False)))


def needs_image(now: datetime | Column) -> Column:
    """Recent rows without picture and text; every such row needs its text too, so this never adds one."""
    recent = F.col("publishedAt") >= when(now) - F.expr(f"interval {IMAGE_HOURS} hours")
    return (text_or_empty("image") == "") & (text_or_empty("contentHtml") == "") & (F.coalesce("contentTries", F.lit(0)) < TRIES) & recent


def page_work(items: DataFrame, most: int = PAGES_PER_RUN) -> DataFrame:
    """The pages to request in this run, shared out fairly between sources: columns of items, rn and first.

    items has place, its newest-first place. A source can take most of the budget at most, so only
    its first `most` rows are ranked.
    """
    work, order = interleaved(items.filter(needs_text(items)))
    return work.filter(F.col("rn") <= most).orderBy(*order).limit(most)


def attempt_outcome(text_chars: Column, html: Column, markers: Column, status: Column) -> Column:
    """What one answer means: accept, next profile (refusal or challenge), empty, or failed."""
    refused = status.isin(403, 406, 429, 503)
    good = (text_or_empty(html) != "") & (text_chars >= MIN_ARTICLE_CHARS)
    return (
        F.when(refused, "next")
        .when(~status.between(200, 299) | status.isNull(), "failed")
        .when(good, "accept")
        .when(F.array_contains(markers, "challenge"), "next")
        .otherwise("empty")
    )


def fetch_statistics(attempts: DataFrame) -> DataFrame:
    """Per source: ok, empty, failed, reasons, profiles and the first samples.

    attempts has sourceId, url, outcome, reason, profile and ord; reasons and profiles are counted
    first, so the maps gather one entry per distinct value.
    """
    by = attempts.groupBy("sourceId").agg(
        F.count_if(F.col("outcome") == "accept").alias("ok"),
        F.count_if(F.col("outcome") == "empty").alias("empty"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.min_by("url", F.when(F.col("outcome") == "empty", F.col("ord"))).alias("empty_sample"),
        F.min_by("url", F.when(F.col("outcome") == "failed", F.col("ord"))).alias("fail_sample"),
    )

    def histogram(column: str, outcome: str, name: str) -> DataFrame:
        seen = attempts.filter((F.col("outcome") == outcome) & F.col(column).isNotNull()).groupBy("sourceId", column).count()
        return seen.groupBy("sourceId").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "count")))).alias(name))

    return by.join(histogram("reason", "failed", "reasons"), "sourceId", "left").join(histogram("profile", "accept", "profiles"), "sourceId", "left")


def deny_images(items: DataFrame, deny: DataFrame) -> DataFrame:
    """Pictures whose address holds a fragment denied for the source are blanked. deny: sourceId, fragment."""
    by = deny.groupBy("sourceId").agg(F.collect_set("fragment").alias("__deny"))
    hit = F.exists("__deny", lambda f: F.contains(F.col("image"), f))
    return items.join(by, "sourceId", "left").withColumn("image", F.when(F.coalesce(hit, F.lit(False)), "").otherwise(F.col("image"))).drop("__deny").select(*items.columns)


def drop_shared_images(items: DataFrame, limit: int = SHARED_IMAGE) -> DataFrame:
    """Pictures that so many items share illustrate none of them. The counts are combined before the shuffle.

    They are dealt anew before the join, so that both sides of it are shuffled and the engine can split a hot picture.
    """
    uses = items.filter("image <> ''").groupBy("image").count().filter(F.col("count") >= limit).select("image", F.lit(True).alias("__shared"))
    out = items.join(uses.hint("rebalance"), "image", "left").withColumn("image", F.when(F.col("__shared"), "").otherwise(F.col("image")))
    return out.drop("__shared").select(*items.columns)


def redact_items(items: DataFrame) -> DataFrame:
    fields = [c for c in ("id", "title", "url", "image", "excerpt", "contentHtml") if c in items.columns]
    return items.withColumns({c: redact(c) for c in fields})


def split_index(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index rows, articles): the index has no texts; a long excerpt without a text becomes an article."""
    excerpt = strip("excerpt")
    html = F.when(text_or_empty("contentHtml") != "", F.col("contentHtml")).when(
        F.length(excerpt) > EXCERPT_CHARS, F.concat(F.lit("<p>"), escape_html(excerpt), F.lit("</p>"))
    )
    rows = redact_items(items).withColumn("__html", html)
    articles = rows.filter("__html is not null").select("id", F.col("__html").alias("contentHtml"), F.coalesce("contentTruncated", F.lit(False)).alias("contentTruncated"))
    index = rows.withColumn("hasContent", F.col("__html").isNotNull()).withColumn("excerpt", trim_excerpt("excerpt"))
    index = index.withColumn("contentTries", F.when(F.col("contentTries") > 0, F.col("contentTries")))
    return index.drop("__html", "contentHtml", "contentTruncated"), articles


def orphan_articles(stored_ids: DataFrame, articles: DataFrame) -> DataFrame:
    return stored_ids.join(articles.select("id"), "id", "left_anti")


def changed_articles(stored: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles that are new or differ from what is stored: only these need to be written."""
    same = ["id", "contentHtml", "contentTruncated"]
    return articles.select(*same).join(stored.select(*same), same, "left_anti")


def first_existing(candidates: Sequence[DataFrame]) -> DataFrame | None:
    """The first frame that has a row: live data, then a committed one, then what is shown already."""
    return next((df for df in candidates if df is not None and not df.isEmpty()), None)
