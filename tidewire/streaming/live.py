"""Incremental refresh: micro-batches of feed items merged into the snapshot.

Items are merged by address with fields from both sides, kept for seven days and 4000 rows. A
snapshot of that size is rebuilt in foreachBatch over the store (start_refresh); a batch that is replayed after a
failure merges the same rows again, which changes nothing, and only one rebuild holds a store at a time. Feeds of any
size keep the merged item of an address as keyed state (merged_items), so that a batch touches its own
addresses only; so do the requests made for an address (page_requests).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.operators.classify import classify, with_section
from tidewire.operators.order import AT, PART, Ordered
from tidewire.operators.snapshot import (
    FULL_REBUILD_CHARS, KEEP_DAYS, REBUILT_SOURCE, SHORT_EXCERPT, TRIES, dedupe_by_url, deny_images, drop_shared_images, merge_previous, prune, split_index,
    with_articles,
)
from tidewire.operators.stories import build_stories, top_stories
from tidewire.sources.feeds import HOST_FAILURES
from tidewire.sources.snapshots import SnapshotStore

#: Seconds between rebuilds and board refreshes, and after a failed refresh.
REBUILD_SECONDS, BOARD_SECONDS, BOARD_RETRY_SECONDS = 180, 300, 60


def previous_items(store: SnapshotStore) -> DataFrame | None:
    """Index rows of the last version with their texts."""
    items, articles = store.read("items"), store.read("articles")
    if items is None:
        return None
    if articles is None:
        articles = items.sparkSession.createDataFrame([], "id string, contentHtml string, contentTruncated boolean")
    return with_articles(items.drop("generated_at"), articles)


def rebuild(store: SnapshotStore, fresh: DataFrame, maps: DataFrame, deny: DataFrame | None, now) -> int:
    """One run of the builder: dedupe, classify, merge, prune, images, split, stories, write. Returns the version."""
    with store.exclusive():
        items = with_section(classify(dedupe_by_url(fresh), maps)).drop("categoryIds")
        previous = previous_items(store)
        if previous is not None:
            items = merge_previous(items, previous)
        # Stored, as the cut reads places first and whole rows then.
        with store.held(with_section(classify(items, maps))) as whole:
            items = prune(whole, now)
            if deny is not None:
                items = deny_images(items, deny)
            # Stored once: index, articles and stories are all made of it.
            with store.held(drop_shared_images(items)) as merged:
                index, articles = split_index(merged)
                # Stories come from the redacted index, so no secret gets into a headline.
                return store.write(index, articles, top_stories(build_stories(index)))


def is_late(now, days: int = KEEP_DAYS) -> Column:
    """Rows that a run at this time would merge and prune at once; undated rows are not late."""
    return F.coalesce(F.col("publishedAt") < F.lit(now) - F.expr(f"interval {days} days"), F.lit(False))


def late_rows(fresh: DataFrame, now, days: int = KEEP_DAYS) -> DataFrame:
    return fresh.filter(is_late(now, days))


def write_once(rows: DataFrame, path: str, batch_id: int) -> None:
    """Rows of a batch under their own folder, which a replayed batch replaces."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def triggered(writer: DataStreamWriter, checkpoint: str, seconds: int | None, timers: bool = False) -> StreamingQuery:
    """seconds=None takes all there is and stops. With timers of processing time that is one batch: the engine would
    otherwise run empty batches for them without end."""
    trigger = ({"once": True} if timers else {"availableNow": True}) if seconds is None else {"processingTime": f"{seconds} seconds"}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def start_split(stream: DataFrame, kept: str, late: str, checkpoint: str, clock: Callable, days: int = KEEP_DAYS, seconds: int | None = REBUILD_SECONDS) -> StreamingQuery:
    """Two sinks: rows that are in time, and late ones. Together they hold every row once, replayed batches too.

    What is late is decided by the event time and the clock of the batch. A replayed batch decides by the time that it was
    first seen at, which is written down before its rows are.
    """

    def route(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = f"{late}-times/batch={batch_id}"
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{marks}/_SUCCESS")
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            spark.createDataFrame([(clock(),)], "at timestamp").coalesce(1).write.mode("overwrite").parquet(marks)
        at = spark.read.schema("at timestamp").parquet(marks).first()["at"]
        write_once(batch.filter(~is_late(at, days)), kept, batch_id)
        write_once(batch.filter(is_late(at, days)), late, batch_id)

    return triggered(stream.writeStream.foreachBatch(route), checkpoint, seconds)


def start_refresh(
    stream: DataFrame, store: SnapshotStore, maps: DataFrame, checkpoint: str, clock: Callable, deny: DataFrame | None = None,
    seconds: int | None = REBUILD_SECONDS, late: str | None = None,
) -> StreamingQuery:
    """The poll-and-merge loop: every trigger merges what has landed. seconds=None takes all there is and stops.

    With a `late` folder the rows that the run prunes at once are written there too, by batch.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            now = clock()
            if late is not None:
                write_once(late_rows(batch, now), late, batch_id)
            rebuild(store, batch, maps, deny, now)

    return triggered(stream.writeStream.foreachBatch(merge), checkpoint, seconds)


# --- keyed state ----------------------------------------------------------------------------

#: The state store that these operators need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = (
    "id string, sourceId string, sourceName string, title string, publishedAt timestamp, sourceCategories array<string>, image string, excerpt string, "
    "contentHtml string, contentTruncated boolean, contentTries int"
)


def keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def first_of_batch(rows: list[dict]) -> dict:
    """The rows of one address in a batch as one: the first, with all rubrics, the first picture, the longest excerpt."""
    rows = sorted(rows, key=lambda r: r["ord"])
    tags = [tag for r in rows for tag in r["sourceCategories"] or [] if tag]
    return rows[0] | {
        "sourceCategories": list(dict.fromkeys(tags)),
        "image": next((r["image"] for r in rows if r["image"]), ""),
        "excerpt": max((r["excerpt"] for r in rows), key=lambda e: len(e or "")),
    }


def merged_item(new: dict, old: dict | None) -> dict:
    """What merge_previous gives for an address: fresh fields win, what they lack comes from the state."""
    out = new | {"image": new["image"] or "", "excerpt": new["excerpt"] or "", "contentHtml": new["contentHtml"] or "", "contentTruncated": bool(new["contentTruncated"])}
    if old is None:
        return out
    if not out["contentHtml"] and old["contentHtml"]:
        out |= {"contentHtml": old["contentHtml"], "contentTruncated": bool(old["contentTruncated"])}
    tries = old["contentTries"]
    return out | {
        "publishedAt": new["publishedAt"] or old["publishedAt"],
        "image": out["image"] or old["image"] or "",
        "excerpt": old["excerpt"] if len(out["excerpt"]) < SHORT_EXCERPT and old["excerpt"] is not None else out["excerpt"],
        "contentTries": tries if tries and tries > 0 else new["contentTries"],
    }


class MergedItems(StatefulProcessor):
    """The merged item of an address, dropped when nothing of it has come for the retention."""

    FIELDS = [f.split(" ")[0] for f in STATE.split(", ")]

    def __init__(self, days: int = KEEP_DAYS):
        self.keep = days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Every call to the handle is a message to the engine, so an address has one state with the time that it is due at;
        # its timer stays as it was set first and is set anew when it rings too early.
        self.handle = handle
        self.item = handle.getValueState("item", f"{STATE}, due long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = first_of_batch([r.asDict() for r in rows])
        state = self.item.get()
        old = dict(zip(self.FIELDS, state[:-1], strict=True)) if state is not None else None
        merged = merged_item(new, old)
        values = [merged[f] for f in self.FIELDS]
        at = timerValues.getCurrentProcessingTimeInMs() + self.keep
        self.item.update((*values, at))
        if state is None:
            self.handle.registerTimer(at)
        yield Row("url", *self.FIELDS)(key[0], *values)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        state = self.item.get()
        if state is not None and state[-1] > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(state[-1])
        else:
            self.item.clear()
        return iter(())

    def close(self) -> None:
        pass


def merged_items(stream: DataFrame, days: int = KEEP_DAYS) -> DataFrame:
    """The merged item of every address of each batch, from a stream of items: state by address, no other address is read.

    Rows without an address are out. Fields come as merge_previous gives them.
    """
    keyed_state(stream.sparkSession)
    columns = [f for f in STATE.split(", ")]
    rows = stream.filter("coalesce(url, '') <> ''").select("url", "ord", *MergedItems.FIELDS)
    return rows.groupBy("url").transformWithState(MergedItems(days), ", ".join(["url string", *columns]), "Update", "ProcessingTime")


class PageRequests(StatefulProcessor):
    """How often the page of an address was asked for without a text; forgotten after the retention."""

    def __init__(self, tries: int, days: int, rebuilt: str, enough: int):
        self.tries, self.keep, self.rebuilt, self.enough = tries, days * 86_400_000, rebuilt, enough

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("tries", "n int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        state = self.count.get()
        n = state[0] if state is not None else 0
        known = n > 0
        for r in sorted(rows, key=lambda r: r.ord):
            asked = n < self.tries
            if asked:
                ends = bool(r.html) and (r.sourceId != self.rebuilt or len(r.html) >= self.enough)
                n = 0 if ends else n + 1
            yield Row(url=key[0], ord=r.ord, asked=asked, contentTries=n or None)
        if n:
            self.count.update((n,))
            if not known:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep)
        elif known:
            self.count.clear()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.count.clear()
        return iter(())

    def close(self) -> None:
        pass


def page_requests(stream: DataFrame, tries: int = TRIES, days: int = KEEP_DAYS, rebuilt: str = REBUILT_SOURCE, enough: int = FULL_REBUILD_CHARS) -> DataFrame:
    """url, ord, asked, contentTries of a stream of pages that runs want (url, ord, sourceId, html; html null where a request brings none).

    A page is asked for until it has a text, at most `tries` times in the retention, however many runs want it.
    """
    keyed_state(stream.sparkSession)
    rows = stream.select("url", "ord", "sourceId", "html")
    return rows.groupBy("url").transformWithState(PageRequests(tries, days, rebuilt, enough), "url string, ord long, asked boolean, contentTries int", "Update", "ProcessingTime")


def breaker_states(attempts: DataFrame) -> DataFrame:
    """host, url, asked per attempt: the circuit breaker over a stream of attempts (host, url, ok, at).

    The state of a host is its number of failures in a row; an answer of any kind resets it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        for pdf in batches:
            rows = []
            for r in pdf.sort_values("at").itertuples():
                asked = failures < HOST_FAILURES
                if asked:
                    failures = 0 if r.ok else failures + 1
                rows.append((key[0], r.url, asked))
            yield pd.DataFrame(rows, columns=["host", "url", "asked"])
        state.update((failures,))

    return attempts.groupBy("host").applyInPandasWithState(
        step, "host string, url string, asked boolean", "failures int", "append", GroupStateTimeout.NoTimeout
    )


def breaker_fold(attempts: DataFrame) -> DataFrame:
    """The same over a finished log of attempts: a host is asked until it has failed that many times in a row.

    A host that is left alone stays so: no further attempt is made that could reset it. Windows run per host, in order of time.
    """
    by_time = Window.partitionBy("host").orderBy("at")
    last = by_time.rowsBetween(1 - HOST_FAILURES, Window.currentRow)
    streak = F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(last) == HOST_FAILURES
    before = F.max("__streak").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    return attempts.withColumn("__streak", streak).select("host", "url", (~F.coalesce(before, F.lit(False))).alias("asked"))


def breaker_over_ranges(attempts: DataFrame, path: str, parts: int | None = None) -> DataFrame:
    """breaker_fold for logs in which one host may have most attempts: no task sees all of a host's.

    Attempts are stored by ranges of host and time. A range counts failures in a row on its own; what its first host
    brings along from the range before (one number a range) is added to those before its first answer. A host's
    breaker opens at the least place where the count is reached.
    """
    ordered = Ordered.store(attempts, [F.col("host"), F.col("at"), F.col("url")], path, parts)
    own = Window.partitionBy(PART, "host").orderBy(AT)
    since = F.coalesce(F.max(F.when(F.col("ok"), F.col(AT))).over(own), F.min(AT).over(own) - 1)
    rows = ordered.rows.withColumns({"row": F.col(AT) - since, "fresh": F.max(F.col("ok").cast("int")).over(own) == 0})
    ends = rows.groupBy(PART).agg(
        F.min_by("host", AT).alias("first"), F.max_by("host", AT).alias("last"), F.max_by("row", AT).alias("tail"), F.max_by("fresh", AT).alias("open")
    )
    carried, brought, before = [], 0, None
    for r in ends.orderBy(PART).collect():  # a row for each range
        brought = brought if before == r["first"] else 0
        carried.append((r[PART], r["first"], brought))
        # A range of one host without an answer adds to what it was brought.
        brought = r["tail"] + (brought if r["open"] and r["first"] == r["last"] else 0)
        before = r["last"]
    spark = attempts.sparkSession
    carry = F.broadcast(spark.createDataFrame(carried, f"{PART} int, __first {dict(attempts.dtypes)['host']}, __carry long"))
    counted = rows.join(carry, PART).withColumn("row", F.col("row") + F.when(F.col("fresh") & (F.col("host") == F.col("__first")), F.col("__carry")).otherwise(0))
    place = F.struct(F.col(PART).alias("part"), F.col(AT).alias("at"))
    opened = counted.filter(F.col("row") >= HOST_FAILURES).groupBy("host").agg(F.min(place).alias("__opened")).hint("rebalance")
    found = ordered.rows.join(opened, "host", "left")
    return found.select("host", "url", F.coalesce(place <= F.col("__opened"), F.lit(True)).alias("asked"))


def retry_counts(tries: DataFrame, rebuilt: str = "habr", enough: int = 8000) -> DataFrame:
    """contentTries after a run: one more per request; a text in hand ends the count, but for the rebuilt source's short ones.

    tries has id, sourceId, contentTries, html (null where the request brought none).
    """
    ends = (F.coalesce("html", F.lit("")) != "") & ((F.col("sourceId") != rebuilt) | (F.length("html") >= enough))
    return tries.withColumn("contentTries", F.when(~ends, F.coalesce("contentTries", F.lit(0)) + 1))


class LastGood:
    """The last good board: a refresh that fails keeps what is shown, and is tried again sooner."""

    def __init__(self, load: Callable[[], DataFrame | None], clock: Callable[[], float], fallback: Callable[[], DataFrame | None] | None = None):
        self.load, self.clock, self.fallback = load, clock, fallback
        self.board: DataFrame | None = None
        self.live, self.at = False, float("-inf")

    def fresh(self) -> bool:
        return self.board is not None and self.clock() - self.at < (BOARD_SECONDS if self.live else BOARD_RETRY_SECONDS)

    def get(self) -> DataFrame | None:
        if self.fresh():
            return self.board
        try:
            board = self.load()
            ok = board is not None and not board.isEmpty()
        except Exception:  # noqa: BLE001  any failed refresh keeps the last board
            board, ok = None, False
        if ok:
            self.board = board
        elif self.board is None and self.fallback:
            self.board = self.fallback()
        self.live, self.at = ok, self.clock()
        return self.board


def fresh_until(at: Column, live: Column) -> Column:
    """Until when a board that was refreshed, or could not be, is not asked for again."""
    return at + F.when(live, F.expr(f"interval {BOARD_SECONDS} seconds")).otherwise(F.expr(f"interval {BOARD_RETRY_SECONDS} seconds"))


def refresh_log(refreshes: DataFrame) -> DataFrame:
    """board, at, shown, live, due of a log of refreshes (board, at, live_version, file_version; null where an answer failed).

    A live answer is shown; a failed one keeps what is shown, and the committed file fills an empty board only.
    due says whether the board's next refresh came after this one had gone stale. Windows run per board.
    """
    by_time = Window.partitionBy("board").orderBy("at")
    before = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shown = F.coalesce(F.last("live_version", True).over(before), F.first("file_version", True).over(before))
    live = F.col("live_version").isNotNull()
    return refreshes.select("board", "at", shown.alias("shown"), live.alias("live"), (F.lead("at").over(by_time) >= fresh_until(F.col("at"), live)).alias("due"))


def unchanged(store: SnapshotStore, seen: int | None) -> bool:
    """Whether a reader that saw a version has nothing new to load."""
    found = store.versions()
    return bool(found) and seen == found[-1]


def single_query(spark: SparkSession, name: str) -> bool:
    """Whether no refresh of this name is running: rebuilds exclude each other."""
    return all(q.name != name for q in spark.streams.active)
