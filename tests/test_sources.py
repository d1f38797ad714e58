import urllib.error
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.operators.classify import source_maps
from tidewire.sources import exchange, feeds
from tidewire.sources.snapshots import SnapshotStore
from tidewire.streaming import live

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:media="http://m" xmlns:content="http://c" xmlns:dc="http://d"><channel><title>t</title>
<item><title><![CDATA[ Хакеры & банк ]]></title><link>https://a.example/news/1</link><guid isPermaLink="false">g1</guid><pubDate>Wed, 09 Sep 2026 12:00:00 GMT</pubDate>
<category>Security</category><category>Security</category><category> Tech </category><description>&lt;p&gt;text &lt;img src="https://a.example/d.png"&gt;&lt;/p&gt;</description>
<enclosure url="https://a.example/a.mp3" type="audio/mpeg"/><media:content url="https://a.example/m.jpg" medium="image"/></item>
<item><title>Second</title><guid>https://a.example/news/2</guid><pubDate>nonsense</pubDate><description>&lt;img src='https://a.example/e.png'&gt;</description><content:encoded>%s</content:encoded></item>
</channel></rss>""" % ("long text " * 60)
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>
<entry><title type="html">Entry</title><id>tag:1</id><updated>2026-09-09T10:00:00Z</updated><link rel="enclosure" href="https://b.example/p.png"/><link href="https://b.example/x/1"/>
<category term="ai"/><category label="World"/><summary>sum</summary></entry></feed>"""


def test_feeds(spark, tmp_path):
    (tmp_path / "rss").mkdir(), (tmp_path / "atom").mkdir()
    (tmp_path / "rss" / "alpha.xml").write_text(RSS)
    (tmp_path / "atom" / "beta.xml").write_text(ATOM)
    rows = {r.title: r for r in feeds.feed_items(spark, str(tmp_path / "rss"), str(tmp_path / "atom")).collect()}
    a, b, c = rows["Хакеры & банк"], rows["Second"], rows["Entry"]
    assert (a.sourceId, a.url, a.image, a.sourceCategories) == ("alpha", "https://a.example/news/1", "https://a.example/m.jpg", ["Security", "Tech"])
    assert a.publishedAt == datetime(2026, 9, 9, 12) and a.fullText == ""
    assert (b.url, b.publishedAt, b.image) == ("https://a.example/news/2", None, "https://a.example/e.png") and b.fullText.startswith("long text")
    assert (c.sourceId, c.url, c.image, c.sourceCategories, c.description) == ("beta", "https://b.example/x/1", "https://b.example/p.png", ["ai", "World"], "sum")


def test_iss_requests():
    path, params = exchange.request("candles", range_name="day", now=datetime(2026, 9, 9))
    assert exchange.iss_url(path, params).endswith("IMOEX/candles.json?iss.meta=off&interval=10&from=2026-09-02&till=2026-09-09")
    path, params = exchange.request("shares")
    assert exchange.iss_url(path, params, "cb").startswith("https://iss.moex.com/iss/engines/stock/markets/shares/boards/TQBR/securities.jsonp?callback=cb&iss.meta=off&iss.only=securities%2Cmarketdata")
    assert exchange.request("future", "BRU6")[0].endswith("/BRU6")


def test_polite_fetch():
    asked = []

    def get(url, headers, timeout):
        asked.append((url, headers["User-Agent"][:7]))
        if url.endswith("ok"):
            return 200, "text"
        if url.endswith("refused"):
            return (403, "") if headers["User-Agent"].startswith("Mozilla") else (200, "bot text")
        if url.endswith("challenge"):
            return 200, "cf challenge-platform"
        raise urllib.error.URLError("down")

    run = lambda urls: [(r[1], r[2], r[3][:8], bool(r[4])) for r in feeds.fetch_host(urls, get, pause=0, retry_pause=0)]
    assert run(["h/ok", "h/refused"]) == [("browser", 200, "text", False), ("bot", 200, "bot text", False)]
    assert run(["h/challenge"])[0][0] == "bot"
    out = run(["h/x"] * 7)
    assert [r[3] for r in out] == [True] * 7 and [r[1] for r in out] == [0] * 7
    assert len([a for a in asked if a[0] == "h/x"]) == 10  # five pages, one retry each, then left alone


def items(spark, rows):
    schema = (
        "id string, sourceId string, sourceName string, title string, url string, publishedAt timestamp, sourceCategories array<string>, image string, "
        "excerpt string, contentHtml string, contentTruncated boolean, contentTries int, ord long"
    )
    return spark.createDataFrame(rows, schema)


def item(n, day, html="", title=None, excerpt="e" * 50):
    from hashlib import sha1

    url = f"https://a.example/x/{n}"
    return (sha1(url.encode()).hexdigest()[:16], "s", "S", title or f"Хакеры взломали сервер {n}", url, datetime(2026, 9, day), ["A"], "", excerpt, html, False, None, n)


def maps(spark):
    return source_maps(spark.createDataFrame([("s", "A", ["tech"], 0)], "sourceId string, key string, ids array<string>, ord int"))


def test_store_and_rebuild(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    assert store.read("items") is None and not live.unchanged(store, None)
    now = datetime(2026, 9, 9)
    assert live.rebuild(store, items(spark, [item(1, 8, "<p>one</p>"), item(2, 8), item(3, 1)]), maps(spark), None, now) == 1
    first = {r.ord: r for r in store.read("items").collect()}
    assert {r.url[-1] for r in first.values()} == {"1", "2"}  # the third is over seven days old
    assert store.article(first[1].id).first().contentHtml == "<p>one</p>"
    # The second run has new fields for 2 and no longer lists 1, which is carried with its text.
    assert live.rebuild(store, items(spark, [item(2, 9, "<p>two</p>", excerpt="short")]), maps(spark), None, now) == 2
    second = {r.url[-1]: r for r in store.read("items").collect()}
    assert set(second) == {"1", "2"} and second["2"].excerpt == "e" * 50
    assert {r.contentHtml for r in store.read("articles").collect()} == {"<p>one</p>", "<p>two</p>"}
    assert live.unchanged(store, 2) and not live.unchanged(store, 1)
    live.rebuild(store, items(spark, [item(2, 9)]), maps(spark), None, now)
    assert store.prune(1) == [1, 2] and store.versions() == [3]


def test_stream_refresh(spark, tmp_path):
    landed = tmp_path / "in"
    rows = items(spark, [item(1, 8), item(2, 8)])
    rows.coalesce(1).write.parquet(str(landed))
    items(spark, [item(2, 9), item(4, 9)]).coalesce(1).write.mode("append").parquet(str(landed))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(landed))
    store = SnapshotStore(spark, str(tmp_path / "store"))
    q = live.start_refresh(stream, store, maps(spark), str(tmp_path / "ck"), lambda: datetime(2026, 9, 9), seconds=None)
    q.awaitTermination(120)
    assert q.exception() is None and len(store.versions()) == 2
    assert {r.url[-1] for r in store.read("items").collect()} == {"1", "2", "4"}
    assert live.single_query(spark, "refresh")


def test_breaker_stream_equals_fold(spark, tmp_path):
    log = [("h", str(i), i % 9 == 8, i) for i in range(12)] + [("g", str(i), i % 3 == 0, i) for i in range(12)]
    rows = spark.createDataFrame(log, "host string, url string, ok boolean, at long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live.breaker_states(stream).writeStream.format("memory").queryName("breaker_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, live.breaker_fold(rows).collect()))
    assert sorted(map(tuple, spark.sql("select * from breaker_out").collect())) == want
    assert sum(not r[2] for r in want) == 7


def test_last_good(spark):
    clock, boards = [0.0], [spark.range(1), None, spark.range(2)]
    board = live.LastGood(lambda: boards.pop(0), lambda: clock[0], lambda: spark.range(9))
    assert board.get().count() == 1 and board.live
    clock[0] = 299
    assert board.get().count() == 1 and len(boards) == 2
    clock[0] = 301
    assert board.get().count() == 1 and not board.live  # the failed refresh keeps the board
    clock[0] = 362
    assert board.get().count() == 2 and board.live
    empty = live.LastGood(lambda: None, lambda: 0.0, lambda: spark.range(9))
    assert empty.get().count() == 9


def test_refresh_log_equals_the_walk(spark):
    import random

    rng = random.Random(3)
    log, want = [], {}
    for board in range(5):
        at, answers = 0, []
        for k in range(40):
            at += rng.choice([20, 59, 60, 61, 200, 299, 300, 400])
            answers.append((at, f"l{k}" if rng.random() < 0.3 else None, f"f{k}" if rng.random() < 0.5 else None))
        log += [(board, datetime.fromtimestamp(t), v, f) for t, v, f in answers]
        frame = lambda v: None if v is None else spark.createDataFrame([(v,)], "v string")
        clock, now = [0], [None, None]
        shown = live.LastGood(lambda: frame(now[0]), lambda: clock[0], lambda: frame(now[1]))  # noqa: B023
        for (t, v, f), following in zip(answers[:6], answers[1:7], strict=True):
            clock[0], now[:] = t, (v, f)
            shown.at = float("-inf")  # every row of the log is a refresh that was made
            board_now = shown.get()
            clock[0] = following[0]
            want[board, t] = (None if board_now is None else board_now.first().v, v is not None, not shown.fresh())
    out = live.refresh_log(spark.createDataFrame(log, "board int, at timestamp, live_version string, file_version string"))
    got = {(r.board, int(r.at.timestamp())): (r.shown, r.live, r.due) for r in out.collect()}
    for key, (version, ok, due) in want.items():
        assert got[key][:2] == (version, ok) and (version is None or got[key][2] == due), key


def test_polite_source_is_registered(spark):
    spark.dataSource.register(feeds.PoliteSource)
    assert spark.read.format("polite_http").load().count() == 0
    assert feeds.fetch_pages(spark.createDataFrame([], "url string")).count() == 0


@pytest.mark.parametrize("ends", [True, False])
def test_retry_counts(spark, ends):
    row = ("habr" if not ends else "rbc", 1, "x" * 10)
    got = live.retry_counts(spark.createDataFrame([row], "sourceId string, contentTries int, html string")).select(F.col("contentTries")).first()[0]
    assert got == (None if ends else 2)
