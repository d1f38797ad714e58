"""What the operators of this subpackage share: scratch tables, Arrow batches, word hashes."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch: a Python worker holds one batch and its output.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset, a session in one process gets a folder
    of its own; on a cluster that would be seen by one machine only, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewire-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Scratch folders by the step that made them, innermost last.
_STEPS: list[list[str]] = []


def removed(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one; it goes when its step ends, at the latest when the driver does."""
    path = f"{scratch_dir(spark)}/tidewire/{uuid.uuid4().hex}/{label}"
    atexit.register(removed, spark, path)
    if _STEPS:
        _STEPS[-1].append(path)
    return path


def finished(spark: SparkSession, step: Callable[[], DataFrame], label: str) -> DataFrame:
    """The rows of a step, stored; the scratch tables that it made on the way are deleted then."""
    _STEPS.append([])
    try:
        rows = step()
    finally:
        made = _STEPS.pop()
    out = stored(rows, label)
    for path in made:
        removed(spark, path)
    return out


def discard(df: DataFrame) -> None:
    """Delete a stored table whose rows are in its successor."""
    if path := getattr(df, "scratch", None):
        removed(df.sparkSession, path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for own columns beside all columns of a frame: the wanted ones, longer where they are taken."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def files_for(rows: int, per_file: int = 100_000) -> int:
    """Files of a scratch table: in proportion to its rows, so that small tables do not come in crumbs."""
    return max(1, -(-rows // per_file))


def stored(df: DataFrame, label: str, files: int | None = None, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back.

    With `files`, narrow rows are dealt evenly to that many files; every file costs a few calls of
    the store, whatever its size.

    The files survive a lost executor.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, label)
    if files:
        df = df.repartition(files)
    with cleaned_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.scratch = path
    return out


def checkpointed(df: DataFrame, files: int = 1) -> DataFrame:
    """Cut the lineage of narrow rows by a checkpoint in the shared folder, in so many files.

    For steps of a loop: a checkpoint costs the store far fewer calls than a table does. It goes with the
    scratch of its step.
    """
    spark = df.sparkSession
    base = scratch_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    before = checkpoints(spark)
    with cleaned_shuffles(spark):
        out = df.repartition(files).checkpoint()
    if _STEPS:
        _STEPS[-1] += [f"{path}/x" for path in checkpoints(spark) - before]
    return out


def checkpoints(spark: SparkSession) -> set[str]:
    """Folders of this driver's checkpoints."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get())
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().toString() for s in fs.listStatus(folder)} if fs.exists(folder) else set()


@contextmanager
def cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries inside go when each query ends; their rows are in the store by then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def apart(groups: DataFrame) -> DataFrame:
    """Aggregated rows, dealt anew before they are joined to what they were made of.

    As they come out of the aggregation they stand by their key already, and a join on it would take all
    rows of a hot key in one task. With a shuffle of its own on each side the engine can split such a key.
    """
    return groups.hint("rebalance")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch brings to a Python worker; long texts make rows large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


class Memo(dict):
    """A dict that fills itself by a function and stays bounded, in entries and in bytes.

    When it is full it becomes the old generation, from which what is asked for again comes back. Keys over
    LONGEST_KEY characters are not kept: a text without spaces is one key, and hardly comes twice.
    """

    LONGEST_KEY = 64

    def __init__(self, make: Callable, most: int = 200_000, most_bytes: int = 96 << 20):
        super().__init__()
        self.make, self.most, self.most_bytes, self.bytes, self.old = make, most, most_bytes, 0, {}

    def __missing__(self, key):
        if len(key) > self.LONGEST_KEY:
            return self.make(key)
        value = self.old[key] if key in self.old else self.make(key)
        if len(self) >= self.most or self.bytes >= self.most_bytes:
            self.old = dict(self)
            self.clear()
            self.bytes = 0
        self[key] = value
        self.bytes += held(key) + held(value) + 100
        return value

    def forget(self) -> None:
        self.clear()
        self.bytes, self.old = 0, {}


def held(x: object) -> int:
    """Bytes of a key or value, members of a tuple too."""
    return sys.getsizeof(x) + (sum(map(sys.getsizeof, x)) if isinstance(x, tuple) else 0)


#: What a worker keeps between tasks, by purpose, and the purpose that it served last.
_KEPT: dict[str, list[Callable[[], None]]] = {}
_PURPOSE = [""]


def kept_for(purpose: str, forget: Callable[[], None]) -> None:
    _KEPT.setdefault(purpose, []).append(forget)


def serving(purpose: str) -> None:
    """Say what a worker works on now; what it kept for anything else goes, as stages of a pipeline share workers."""
    if _PURPOSE[0] != purpose:
        for other, forgets in _KEPT.items():
            if other != purpose:
                for forget in forgets:
                    forget()
        _PURPOSE[0] = purpose


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


#: Hashes of words already seen by this worker.
WORD_HASHES = Memo(word_hash)
kept_for("words", WORD_HASHES.forget)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words. bytes.split() parts words at ASCII white space, as [^\\x20\\x09-\\x0D]+ does."""
    serving("words")
    return np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))


def wide_hash(word: bytes) -> int:
    return xxhash.xxh3_128_intdigest(word)


#: 128-bit hashes of words already seen by this worker.
WIDE_HASHES = Memo(wide_hash, 100_000)
kept_for("words", WIDE_HASHES.forget)


def wide_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two 64-bit halves of the words' 128-bit hashes."""
    every = list(map(WIDE_HASHES.__getitem__, words))
    low, high = (1 << 64) - 1, 64
    return np.array([h & low for h in every], np.uint64), np.array([h >> high for h in every], np.uint64)


_MULTIPLIER, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive words; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _MULTIPLIER
        out += hashes[j : j + n]
        out ^= out >> _SHIFT
    out *= _MULTIPLIER
    return out ^ (out >> np.uint64(32))
