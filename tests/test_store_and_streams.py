"""The snapshot store's files and lock; keyed state across restarts; the late sink across replays."""

import random
import shutil
import threading
import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewire.operators.snapshot import merge_previous
from tidewire.plans import views
from tidewire.sources import snapshots
from tidewire.sources.snapshots import RebuildRunning, SnapshotStore, bucket_number
from tidewire.streaming import live

T0 = datetime(2026, 9, 9, 12)


# --- store ----------------------------------------------------------------------------------


def articles(spark, rows):
    return spark.createDataFrame([(i, h, False) for i, h in rows.items()], "id string, contentHtml string, contentTruncated boolean")


def files(store):
    return {p.parent.name: sorted(q.name for q in p.parent.glob("*.parquet")) for p in Path(store.articles_path).glob("bucket=*/*.parquet")}


def test_only_changed_buckets_have_new_files(spark, tmp_path):
    store, full = SnapshotStore(spark, str(tmp_path / "s"), buckets=16), SnapshotStore(spark, str(tmp_path / "f"), buckets=16)
    ids = spark.createDataFrame([("x",)], "id string")
    rows = {f"a{i}": f"<p>{i}</p>" for i in range(200)}
    store.write(ids, articles(spark, rows), ids)
    before = files(store)
    assert len(before) == 16
    # One changed, one gone, one new; then nothing; then a bucket loses all its articles.
    touched = {"a5", "a60", "n1"}
    rows = rows | {"a5": "changed", "n1": "new"}
    del rows["a60"]
    store.write(ids, articles(spark, rows), ids)
    after = files(store)
    assert {b for b in after if after[b] != before[b]} == {f"bucket={bucket_number(i, 16)}" for i in touched}
    store.write(ids, articles(spark, rows), ids)
    assert files(store) == after
    rows = {i: h for i, h in rows.items() if bucket_number(i, 16) != 3}
    assert store.write_articles(articles(spark, rows)) == [3] and "bucket=3" not in files(store)
    full.write(ids, articles(spark, rows), ids)
    read = lambda s: sorted(map(tuple, s.read("articles").collect()))
    assert read(store) == read(full) == sorted((i, h, False) for i, h in rows.items())
    assert store.write_articles(articles(spark, {})) and store.read("articles") is None and store.article("a5") is None
    assert store.versions() == [1, 2, 3]


def test_a_lookup_opens_one_file_of_many(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), buckets=16)
    store.write_articles(articles(spark, {f"a{i}": f"<p>{i}</p>" for i in range(500)}))
    found = store.article("a123")
    assert [r.contentHtml for r in found.collect()] == ["<p>123</p>"] and store.article("nope").count() == 0
    plan = found._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaves = plan.collectLeaves()
    metrics = leaves.apply(0).metrics()
    assert metrics.apply("numFiles").value() == 1 and len(files(store)) == 16
    names = [r.id for r in spark.read.parquet(next(str(p) for p in Path(store.articles_path).glob("bucket=5/*.parquet"))).select("id").collect()]
    assert names == sorted(names)


def test_two_writers_never_mix(spark, tmp_path):
    """One version each, or a clear error."""
    results: list = []

    def writer(name):
        store = SnapshotStore(spark, str(tmp_path / "s"), buckets=4)
        rows = {f"a{i}": name for i in range(40)}
        try:
            with store.exclusive():
                time.sleep(0.3)
                results.append((name, store.write(articles(spark, rows).select("id", F.lit(name).alias("by")), articles(spark, rows), articles(spark, rows).limit(1))))
        except RebuildRunning:
            results.append((name, None))

    threads = [threading.Thread(target=writer, args=(n,)) for n in ("one", "two", "three")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    done = {v: n for n, v in results if v}
    store = SnapshotStore(spark, str(tmp_path / "s"), buckets=4)
    assert done and store.versions() == sorted(done) and len(results) == 3
    for v, n in done.items():
        assert {r.by for r in store.read("items", v).collect()} == {n}
    assert {r.contentHtml for r in store.read("articles").collect()} == {done[max(done)]}
    with store.exclusive():
        with store.exclusive():  # the same rebuild may hold it twice
            pass
        with pytest.raises(RebuildRunning), SnapshotStore(spark, store.path).exclusive():
            pass
        with SnapshotStore(spark, store.path).exclusive(lease=-5):  # a lock that is too old
            pass
    with store.exclusive():
        pass
    assert not (tmp_path / "s" / "_rebuilding").exists()


def test_bucket_numbers_agree(spark):
    df = spark.createDataFrame([(f"я{i}",) for i in range(50)], "id string").select("id", snapshots.bucket_of(F.col("id"), 64).alias("b"))
    assert all(r.b == bucket_number(r.id) for r in df.collect())


def test_scratch_needs_a_shared_folder(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        views.scratch(Cluster, "x")


# --- keyed state ----------------------------------------------------------------------------

COLUMNS = "url string, ord long, id string, sourceId string, sourceName string, title string, publishedAt timestamp, sourceCategories array<string>, image string, excerpt string, contentHtml string, contentTruncated boolean, contentTries int"
FIELDS = [c.split(" ")[0] for c in COLUMNS.split(", ")]


def run(spark, operator, landed, out, log):
    stream = spark.readStream.schema(spark.read.parquet(landed).schema).parquet(landed)
    q = live.triggered(operator(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: live.write_once(b, out, n)), log, None, timers=True)
    assert q.awaitTermination(100) and q.exception() is None


@pytest.fixture
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_state_equals_merge_previous_after_each_batch(spark, tmp_path, few_partitions):
    """Three runs, each started anew from the checkpoint."""
    rng = random.Random(4)
    landed, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    previous, seen = None, set()
    for batch in range(3):
        rows = []
        for k in rng.sample(range(12), 7):
            rows.append((
                f"https://a/{k}", len(rows), f"{k}", rng.choice(("s", None)), "S", f"t{batch}", rng.choice((None, T0 + timedelta(hours=batch))), rng.choice((None, [], ["a", "", "a", f"b{batch}"])),
                rng.choice((None, "", f"i{batch}")), rng.choice((None, "", "short", "long enough " * 5)), rng.choice((None, "", f"<p>{batch}</p>")), rng.choice((None, True, False)), rng.choice((None, 0, batch + 1)),
            ))
        fresh = spark.createDataFrame(rows, COLUMNS)
        # What the builder's dedupe gives for lone rows: distinct rubrics, a picture or "".
        tidy = fresh.withColumns({"sourceCategories": F.array_distinct(F.filter(F.coalesce("sourceCategories", F.array().cast("array<string>")), lambda t: t != "")), "image": F.coalesce("image", F.lit(""))})
        empty = spark.createDataFrame([], COLUMNS)
        merged = merge_previous(tidy, empty if previous is None else previous)
        previous = spark.createDataFrame(merged.select(*FIELDS).collect(), COLUMNS)
        fresh.write.mode("append").parquet(landed)
        run(spark, live.merged_items, landed, out, log)
        touched = [r for r in spark.read.parquet(out).collect() if r.batch == batch]
        assert sorted(r.url for r in touched) == sorted(r[0] for r in rows)  # no other address is written
        seen |= {r[0] for r in rows}
        want = {r.url: r.asDict() for r in previous.collect()}
        for r in touched:
            got = r.asDict()
            for f in FIELDS:
                if f not in ("ord", "url"):
                    a, b = got[f], want[r.url][f]
                    assert (a or None) == (b or None) or (f == "contentTries" and not a and not b), (f, r.url, a, b)
    assert len(seen) == len(want)


def test_copies_in_a_batch_are_one_item():
    row = lambda o, **more: dict.fromkeys(FIELDS) | {"ord": o, "sourceCategories": None} | more
    got = live.first_of_batch([row(2, image="b", excerpt="longest", title="two", sourceCategories=["y", "x"]), row(1, excerpt="mid", title="one", sourceCategories=["x", ""])])
    assert (got["title"], got["image"], got["excerpt"], got["sourceCategories"]) == ("one", "b", "longest", ["x", "y"])


def test_a_page_is_asked_for_three_times(spark, tmp_path, few_partitions):
    landed, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for batch in range(5):
        rows = [("never", batch, "s", None), ("second", batch, "s", "text" if batch == 1 else None), ("habr", batch, "habr", "short"), ("once", batch, "s", "text")]
        spark.createDataFrame(rows, "url string, ord long, sourceId string, html string").write.mode("append").parquet(landed)
        run(spark, live.page_requests, landed, out, log)
    asked = {}
    for r in spark.read.parquet(out).orderBy("ord").collect():
        asked.setdefault(r.url, []).append((r.asked, r.contentTries))
    no = [(True, 1), (True, 2), (True, 3), (False, 3), (False, 3)]
    assert asked["never"] == no and asked["habr"] == no and asked["once"] == [(True, None)] * 5
    assert asked["second"] == [(True, 1), (True, None), (True, 1), (True, 2), (True, 3)]


def test_state_goes_after_the_retention(spark, tmp_path, few_partitions):
    landed, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = "url string, ord long, sourceId string, html string"
    operator = lambda stream: live.page_requests(stream, days=0)
    for batch in range(3):
        spark.createDataFrame([("never", batch, "s", None)], schema).write.mode("append").parquet(landed)
        run(spark, operator, landed, out, log)
        spark.createDataFrame([(f"other{batch}", 10 + batch, "s", "x")], schema).write.mode("append").parquet(landed)
        run(spark, operator, landed, out, log)  # timers that are due fire in this batch
    tries = [r.contentTries for r in spark.read.parquet(out).filter("url = 'never'").orderBy("ord").collect()]
    assert tries == [1, 1, 1]


# --- late rows ------------------------------------------------------------------------------


def test_kept_and_late_hold_every_row_once(spark, tmp_path):
    landed, kept, late, log = (str(tmp_path / n) for n in ("in", "kept", "late", "log"))
    clock = [T0]
    when = lambda i: None if i % 10 == 0 else T0 - timedelta(days=i % 14, seconds=i)
    for batch in range(3):
        spark.createDataFrame([(i, when(i)) for i in range(batch * 50, batch * 50 + 50)], "ord long, publishedAt timestamp").write.mode("append").parquet(landed)
        for replay in (False, True):
            stream = spark.readStream.schema("ord long, publishedAt timestamp").parquet(landed)
            live.start_split(stream, kept, late, log, lambda: clock[0], seconds=None).awaitTermination(60)
            rows = [r.ord for path in (kept, late) for r in spark.read.parquet(path).collect()]
            assert sorted(rows) == list(range(batch * 50 + 50))
            if not replay:  # the commit of the batch is lost, and more time has passed: it runs again
                commits = sorted((p for p in Path(log, "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
                commits[-1].unlink()
                Path(log, "commits", f".{commits[-1].name}.crc").unlink(missing_ok=True)
                clock[0] += timedelta(days=2)
    assert {r.ord for r in spark.read.parquet(late).filter("batch = 0").collect()} == {i for i in range(50) if when(i) and when(i) < T0 - timedelta(days=7)}
    shutil.rmtree(log)
