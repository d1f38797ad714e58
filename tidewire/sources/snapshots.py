"""Snapshot storage: index and stories in versions, articles in buckets that are rewritten only where they changed.

A version holds index and stories; it is written whole into a new folder, stories last, whose commit marks it as
complete. Articles lie by bucket of their id, sorted by id, one table for all versions, as an index that is older than an
article still finds it by id. Only buckets with new, changed or orphaned articles are replaced; the others keep their
files. One rebuild runs at a time: it holds a lock file that is created only where there is none.
"""

from __future__ import annotations

import hashlib
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("items", "stories")
BUCKETS = 64
#: Seconds after which the lock of a rebuild that never ended is taken over.
LEASE = 6 * 3600


class RebuildRunning(RuntimeError):
    """Another rebuild holds the store."""


def bucket_of(item_id: Column, buckets: int = BUCKETS) -> Column:
    return (F.conv(F.substring(F.md5(item_id), 1, 4), 16, 10).cast("int") % buckets).cast("int")


def bucket_number(item_id: str, buckets: int = BUCKETS) -> int:
    return int(hashlib.md5(item_id.encode()).hexdigest()[:4], 16) % buckets


def marked(articles: DataFrame) -> DataFrame:
    """Articles with a mark that changes when they do."""
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(articles.columns) if c != "id"]
    return articles.withColumn("mark", F.md5(F.concat_ws("\1", *rest)))


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.articles_path = f"{self.path}/articles-{buckets}"
        self._owner: int | None = None

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def _remove(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def _folders(self, path: str, prefix: str) -> list[int]:
        """Numbers of the folders with a prefix."""
        p, fs = self._at(path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())

    def _create(self, path: str) -> bool:
        """Create a file if there is none, in one step."""
        p, fs = self._at(path)
        fs.mkdirs(p.getParent())
        if fs.getScheme() == "file":
            return bool(self.spark._jvm.java.io.File(p.toUri().getPath()).createNewFile())
        try:
            fs.create(p, False).close()
            return True
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise

    @contextmanager
    def exclusive(self, lease: float = LEASE) -> Iterator[None]:
        """Hold the store for a rebuild; an error if another one does. A lock older than the lease is taken over."""
        if self._owner == threading.get_ident():
            yield
            return
        lock = f"{self.path}/_rebuilding"
        if not self._create(lock):
            p, fs = self._at(lock)
            try:
                stale = fs.getFileStatus(p).getModificationTime() < (time.time() - lease) * 1000
                aside = f"{lock}-{uuid.uuid4().hex}"
                taken = stale and fs.rename(p, self._at(aside)[0])  # of several that see it, one can move it away
            except Py4JJavaError:  # it has gone in the meantime
                taken = True
            if not taken or not self._create(lock):
                raise RebuildRunning(self.path)
            self._remove(aside)
        self._owner = threading.get_ident()
        try:
            yield
        finally:
            self._owner = None
            self._remove(lock)

    def versions(self) -> list[int]:
        """Complete versions, oldest first: those whose last table was committed."""
        return [v for v in self._folders(self.path, "v") if self._exists(f"{self.path}/v{v}/{TABLES[-1]}/_SUCCESS")]

    @contextmanager
    def held(self, rows: DataFrame) -> Iterator[DataFrame]:
        """Rows stored beside the versions for as long as a rebuild reads them more than once."""
        path = f"{self.path}/_run-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        try:
            yield self.spark.read.schema(rows.schema).parquet(path)
        finally:
            self._remove(path)

    def changed_buckets(self, articles: DataFrame) -> list[int]:
        """Buckets with an article that is new, other than stored, or stored and no longer there. Ids and marks are compared, no texts."""
        now = marked(articles).select("id", "mark")
        if not self._exists(self.articles_path):
            differ = now
        else:
            then = self.spark.read.parquet(self.articles_path).select("id", F.col("mark").alias("old"))
            differ = now.join(then, "id", "full_outer").filter(~F.col("mark").eqNullSafe(F.col("old")))
        return sorted(r[0] for r in differ.select(bucket_of(F.col("id"), self.buckets)).distinct().collect())

    def write_articles(self, articles: DataFrame) -> list[int]:
        """Replace the buckets that changed by what is in articles; returns their numbers."""
        changed = self.changed_buckets(articles)
        if not changed:
            return []
        rows = marked(articles).withColumn("bucket", bucket_of(F.col("id"), self.buckets)).filter(F.col("bucket").isin(changed))
        filled = {r[0] for r in rows.select("bucket").distinct().collect()}
        if filled:
            placed = rows.repartition(len(filled), "bucket").sortWithinPartitions("bucket", "id")
            writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket")
            writer.option("parquet.bloom.filter.enabled#id", "true").parquet(self.articles_path)
        for b in set(changed) - filled:  # nothing left in it
            self._remove(f"{self.articles_path}/bucket={b}")
        return changed

    def write(self, items: DataFrame, articles: DataFrame, stories: DataFrame) -> int:
        """A new version. stories goes last: its commit marks the version as complete."""
        with self.exclusive():
            version = max([0, *self._folders(self.path, "v")]) + 1
            self.write_articles(articles)
            for name, df in zip(TABLES, (items, stories), strict=True):
                df.withColumn("generated_at", F.lit(time.time())).write.mode("overwrite").parquet(f"{self.path}/v{version}/{name}")
            return version

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """A table of a version, the newest by default, or the articles; None if there is none."""
        if table == "articles":
            if not self._folders(self.articles_path, "bucket="):
                return None
            return self.spark.read.parquet(self.articles_path).drop("mark", "bucket")
        found = self.versions()
        if not found:
            return None
        return self.spark.read.parquet(f"{self.path}/v{version or found[-1]}/{table}")

    def article(self, item_id: str) -> DataFrame | None:
        """Point lookup: one bucket's files, of which the id's range and bloom filter skip row groups."""
        if not self._folders(self.articles_path, "bucket="):
            return None
        rows = self.spark.read.parquet(self.articles_path)
        return rows.filter((F.col("bucket") == bucket_number(item_id, self.buckets)) & (F.col("id") == item_id)).drop("mark", "bucket")

    def prune(self, keep: int = 2) -> list[int]:
        """Old versions go; the newest ones stay for readers that still hold them."""
        old = self.versions()[:-keep]
        for v in old:
            self._remove(f"{self.path}/v{v}")
        return old
