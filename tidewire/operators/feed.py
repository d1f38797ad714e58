"""Feed queries: filters, order, one card per headline or story, counts.

Item frames have id, title, url, sourceId, sourceName, publishedAt (timestamp), categoryIds,
image, excerpt, hasContent and ord, the item's place in the snapshot, which ends every order so
that ties are stable. "Now" is always a parameter.

Whole-feed positions come from ranges of the order (feed_pages) or are taken after a limit or over keys, so no window
runs over an unpartitioned feed; top rows come from sort and limit, which Spark merges in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import text_or_empty, title_key
from tidewire.operators.order import Ordered
from tidewire.operators.rules import SECTIONS

#: Cards of a batch; hours of the rank's decay; the top block's age, coverage and size;
#: days, items and share of text that mark a source without texts; watchlist size.
BATCH = 12
DECAY_HOURS = 24
TOP_HOURS, TOP_SOURCES, TOP_STORIES = 36, 2, 5
TEXTLESS_DAYS, TEXTLESS_ITEMS, TEXTLESS_SHARE = 3, 5, 0.2
WATCHLIST = 20


def when(ts: datetime | Column) -> Column:
    return ts if isinstance(ts, Column) else F.lit(ts)


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def time_key() -> Column:
    return F.coalesce("publishedAt", F.timestamp_seconds(F.lit(0)))


def newest_first() -> list[Column]:
    return [time_key().desc(), F.col("ord")]


def in_sections(wanted: Sequence[str]) -> Column:
    return F.arrays_overlap("categoryIds", F.array(*map(F.lit, wanted)).cast("array<string>"))


def visible(hidden: Sequence[str]) -> Column:
    """Items of hidden sources are out; items without a source always show."""
    source = text_or_empty("sourceId")
    return (source == "") | ~source.isin(*hidden) if hidden else F.lit(True)


def known_selection(ids: Column) -> Column:
    """Of a saved selection, the sections that still exist."""
    return F.filter(ids, lambda i: F.array_contains(F.array(*map(F.lit, SECTIONS)), i))


def valid_tickers(tickers: Column) -> Column:
    good = F.filter(tickers, lambda t: t.rlike("^[A-Z0-9]{1,12}$"))
    return F.slice(good, F.lit(1), F.lit(WATCHLIST))


def newest_per_title(items: DataFrame) -> DataFrame:
    """The newest item of each headline; items whose headline has no words all stay (ord tells them apart).

    The engine keeps the first row of each key within a task before it shuffles, so that a headline
    that a third of all items carry costs one row per task.
    """
    key = title_key("title")
    keyed = items.withColumns({"__key": key, "__alone": F.when(key == "", F.col("ord"))})
    rank = F.row_number().over(Window.partitionBy("__key", "__alone").orderBy(*newest_first()))
    return keyed.withColumn("__rank", rank).filter("__rank = 1").drop("__key", "__alone", "__rank")


def promote_lead(first: DataFrame, batch: int = BATCH) -> DataFrame:
    """place of each row of a first batch (ordered by rn from 1): its newest illustrated item comes first.

    A batch is a page of rows, so the window over all of them is small.
    """
    lead = F.min(F.when((F.col("image") != "") & (F.col("rn") <= batch), F.col("rn"))).over(Window.partitionBy())
    place = F.when(F.col("rn") == lead, 1).when(F.col("rn") < lead, F.col("rn") + 1).otherwise(F.col("rn"))
    return first.withColumn("place", place)


def page(ordered: DataFrame, order: list[Column], start: int, size: int = BATCH) -> DataFrame:
    """Rows start+1 .. start+size of an order, with rn, for the first pages: the first start+size rows meet in one task.

    Deep pages are read from a feed that is stored in its order (feed_pages).
    """
    top = ordered.orderBy(*order).limit(start + size)
    numbered = top.withColumn("rn", F.row_number().over(Window.orderBy(*order)))
    return numbered.filter(F.col("rn") > start)


def first_page(items: DataFrame, wanted: Sequence[str], hidden: Sequence[str] = (), batch: int = BATCH) -> DataFrame:
    """The front page in time order: filter, one card per headline, newest first, an illustrated lead."""
    shown = newest_per_title(items.filter(in_sections(wanted) & visible(hidden)))
    return promote_lead(page(shown, newest_first(), 0, batch), batch)


# --- counts ---------------------------------------------------------------------------------


def counts(items: DataFrame, hidden: Sequence[str] = ()) -> DataFrame:
    """scope, key, n: visible items by section, all items by source, all visible with a known section; one pass."""
    known = F.array_distinct(F.array_intersect("categoryIds", F.array(*map(F.lit, SECTIONS))))
    entry = lambda scope, key: F.struct(F.lit(scope).alias("scope"), key.alias("key"))
    none = F.array().cast("array<struct<scope:string,key:string>>")
    by_section = F.transform(known, lambda k: entry("section", k))
    entries = F.concat(
        F.when(visible(hidden), by_section).otherwise(none),
        F.when(text_or_empty("sourceId") != "", F.array(entry("source", F.col("sourceId")))).otherwise(none),
        F.when(visible(hidden) & (F.size(known) > 0), F.array(entry("all", F.lit("")))).otherwise(none),
    )
    found = items.select(F.inline(entries), F.lit(1).cast("long").alias("n"))
    zero = items.sparkSession.createDataFrame([("all", "", 0)], "scope string, key string, n long")
    return found.unionByName(zero).groupBy("scope", "key").agg(F.sum("n").alias("n"))


def outlet_totals(items: DataFrame, hidden: Sequence[str] = ()) -> DataFrame:
    outlet = F.coalesce(F.nullif(F.col("sourceId"), F.lit("")), F.nullif(F.col("sourceName"), F.lit("")))
    return items.agg(F.count_distinct(outlet).alias("total"), F.count_distinct(F.when(visible(hidden), outlet)).alias("shown"))


def known_sources(items: DataFrame) -> DataFrame:
    """id and first name of each source, by Russian collation."""
    first = items.filter(text_or_empty("sourceId") != "").groupBy(F.col("sourceId").alias("id")).agg(F.min_by("sourceName", "ord").alias("name"))
    named = first.withColumn("name", F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("id")))
    return named.orderBy(F.collate("name", "ru"), "id")


def textless_sources(items: DataFrame, now: datetime | Column) -> DataFrame:
    """Sources whose recent items hardly ever have a text: sourceId, items, with_text.

    bad_date marks items whose date could not be read: they count, items without a date do not.
    """
    recent = time_key() >= when(now) - F.expr(f"interval {TEXTLESS_DAYS} days")
    if "bad_date" in items.columns:
        recent = recent | F.col("bad_date")
    by = items.filter(recent).groupBy("sourceId").agg(F.count(F.lit(1)).alias("items"), F.count_if("hasContent").alias("with_text"))
    return by.filter((F.col("items") >= TEXTLESS_ITEMS) & (F.col("with_text") / F.col("items") < TEXTLESS_SHARE))


# --- stories in the feed --------------------------------------------------------------------


def valid_stories(raw: DataFrame) -> DataFrame:
    """Stories of a snapshot with defaults; rows without an id or members are dropped. pos is their place."""
    return raw.filter(F.col("id").isNotNull() & F.col("itemIds").isNotNull()).withColumns(
        {
            "title": text_or_empty("title"),
            "sources": F.coalesce(F.col("sources"), F.lit(1)),
            "itemIds": F.filter("itemIds", lambda i: i.isNotNull()),
        }
    )


def story_members(stories: DataFrame) -> DataFrame:
    """story_id, item_id, member (place in the story), pos, sources, story_at; stories may come in that form already,
    where no row should hold all members of one."""
    if "itemIds" not in stories.columns:
        return stories
    return stories.select(
        F.col("id").alias("story_id"), "pos", "sources", F.col("publishedAt").alias("story_at"), F.posexplode("itemIds").alias("member", "item_id")
    )


def story_of_item(stories: DataFrame) -> DataFrame:
    """The last story that names an item: item_id, story_id, sources."""
    m = story_members(stories)
    last = m.groupBy("item_id").agg(F.max_by(F.struct("story_id", "sources"), F.struct("pos", "member")).alias("s"))
    return last.select("item_id", F.col("s.story_id").alias("story_id"), F.col("s.sources").alias("sources"))


def rank_score(sources: Column, published: Column, now: Column) -> Column:
    hours = F.greatest(F.lit(0.0), seconds(now) - F.coalesce(seconds(published), seconds(now))) / 3600
    return sources * F.exp(-hours / DECAY_HOURS)


def ranked_feed(shown: DataFrame, stories: DataFrame, now: datetime | Column) -> DataFrame:
    """One card per story, the story's own headline where it is in the feed; columns of shown plus score.

    A story's place is its newest shown member's; items without a story stand for themselves.
    """
    by_item = story_of_item(stories)
    placed = shown.join(by_item, shown["id"] == by_item["item_id"], "left")
    card = F.struct(F.negative(F.unix_micros(time_key())).alias("t"), "ord")
    lone = placed.filter("story_id is null")
    members = placed.filter("story_id is not null")
    newest = members.groupBy("story_id").agg(F.min_by("ord", card).alias("newest"))
    # The lead must be in the feed; it need not be a member whose last story is this one.
    leads = shown.select(F.col("id").alias("story_id"), F.col("ord").alias("lead")).groupBy("story_id").agg(F.min("lead").alias("lead"))
    chosen = newest.join(leads, "story_id", "left").select(F.coalesce("lead", "newest").alias("ord"))
    cards = placed.join(chosen, "ord", "left_semi").unionByName(lone).dropDuplicates(["ord"])
    score = rank_score(F.coalesce("sources", F.lit(1)), F.col("publishedAt"), when(now))
    return cards.withColumn("score", score).select(*shown.columns, "score")


def ranked_order() -> list[Column]:
    return [F.col("score").desc(), *newest_first()]


def feed_pages(shown: DataFrame, order: list[Column], path: str, batch: int = BATCH) -> tuple[Ordered, DataFrame]:
    """A feed stored in its order, from which Ordered.page reads single pages, and all its rows with place and page (both from 1)."""
    ordered = Ordered.store(shown, order, path)
    return ordered, ordered.numbered().withColumn("page", F.floor((F.col("rn") - 1) / batch) + 1)


def top_stories_block(shown: DataFrame, stories: DataFrame, now: datetime | Column) -> DataFrame:
    """Most covered recent stories with a member in the feed: story_id, lead_id, sources, score, rn.

    Ties come out last-listed first.
    """
    at = when(now)
    fresh = (F.col("sources") >= TOP_SOURCES) & (seconds(at) - F.coalesce(seconds(F.col("story_at")), F.lit(0.0)) <= TOP_HOURS * 3600)
    m = story_members(stories).filter(fresh)
    joined = m.join(shown.select(F.col("id").alias("item_id"), "publishedAt"), "item_id")
    own_sources = story_of_item(stories).select("item_id", F.col("sources").alias("own_sources"))
    scored = joined.join(own_sources, "item_id", "left").withColumn(
        "s", rank_score(F.coalesce("own_sources", F.lit(1)), F.col("publishedAt"), at)
    )
    by = scored.groupBy("story_id", "pos", "sources").agg(
        F.min_by("s", "member").alias("score"),
        F.coalesce(F.max(F.when(F.col("item_id") == F.col("story_id"), F.col("item_id"))), F.min_by("item_id", "member")).alias("lead_id"),
    )
    top = by.orderBy(F.col("score").desc(), F.col("pos").desc()).limit(TOP_STORIES)
    return top.withColumn("rn", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("pos").desc())))


def also_covered_by(stories: DataFrame, items: DataFrame, hidden: Sequence[str] = ()) -> DataFrame:
    """Per item of a story, the first other member of each other outlet: id, outlet, other_id."""
    outlet = F.coalesce(F.nullif(F.col("sourceId"), F.lit("")), text_or_empty("sourceName"))
    lookup = items.filter(visible(hidden)).groupBy("id").agg(F.min_by(outlet, "ord").alias("outlet"))
    every = items.groupBy("id").agg(F.min_by(outlet, "ord").alias("own_outlet"))
    placed = story_of_item(stories).join(every.withColumnRenamed("id", "item_id"), "item_id")
    # One entry per outlet and story first (its first two members are enough to leave one item out).
    m = story_members(stories).join(lookup.withColumnRenamed("id", "item_id"), "item_id")
    rn = F.row_number().over(Window.partitionBy("story_id", "outlet").orderBy("member"))
    two = m.withColumn("rn", rn).filter("rn <= 2").groupBy("story_id", "outlet")
    firsts = two.agg(F.max(F.when(F.col("rn") == 1, F.col("item_id"))).alias("first"), F.max(F.when(F.col("rn") == 2, F.col("item_id"))).alias("second"))
    other = F.when(F.col("first") != F.col("item_id"), F.col("first")).when(F.col("second") != F.col("item_id"), F.col("second"))
    pairs = placed.join(firsts, "story_id").filter(F.col("outlet") != F.col("own_outlet")).withColumn("other_id", other)
    return pairs.filter("other_id is not null").select(F.col("item_id").alias("id"), "outlet", "other_id")
