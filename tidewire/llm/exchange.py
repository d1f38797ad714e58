"""Which hashes occur elsewhere? A compact exchange for that question.

Hashes of documents are gathered in chunks, so that a row of the shuffle holds some hundreds of
32-bit remainders of one bucket instead of one hash. A hash that repeats inside its chunk is
settled there and sent once at most, so that a hash that a third of all documents share costs a
bucket one entry per chunk. Buckets grow in number with the input and keep their size, and so does
the chance that two different hashes meet in one remainder; such meetings only add candidates,
which the callers confirm.

A chunk holds 2 million hashes at most, whatever the input. Beyond GROUP buckets (some 27 GB of text)
a chunk's share of a bucket would be too small to be worth a row, so hashes go in two steps: chunks
are dealt to groups of buckets, and the rows of a group, gathered to chunks again, to its buckets;
answers come back the same way. A group's share of a chunk is some 500 hashes at 100 TB.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import small_batches, stored

#: Hashes that a bucket holds about, that a chunk gathers at least and at most, and that its share of a
#: bucket should have; buckets that one step serves.
BUCKET_HASHES, CHUNK_HASHES, MOST_HASHES, SHARE = 1_000_000, 1 << 16, 1 << 21, 512
GROUP = MOST_HASHES // SHARE
#: Tasks that share the rows of a group in the second step: about a gigabyte each.
SLICES = GROUP * BUCKET_HASHES * 12 >> 30
#: Documents that a chunk holds at most: their numbers have 16 bits.
MOST_DOCUMENTS = 60_000
#: Stands for a null id where ids are compared: it comes after all others.
LAST_ID = (1 << 63) - 1

KEYS = "id0 long, nul boolean, th long"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id0, nul, th, body: the key by which results find back to rows.

    Rows that share an id and a text share a key and get the same result.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{id_col} must be a whole number")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id0"),
        F.col(id_col).isNull().alias("nul"),
        F.xxhash64(body).alias("th"),
        body.alias("body"),
    )


def bucket_count(docs: DataFrame, bytes_per_hash: float = 6.5) -> int:
    """Buckets for a frame with a body column, from its total size."""
    total = docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    return max(8, int(total / bytes_per_hash / BUCKET_HASHES) + 1)


def chunk_size(buckets: int) -> int:
    """So many that a bucket's share of a chunk has some hundreds, within what a task should hold."""
    return max(CHUNK_HASHES, min(SHARE * buckets, MOST_HASHES))


class Chunk:
    """Documents gathered until there are enough hashes."""

    def __init__(self) -> None:
        self.keys: list[tuple] = []
        self.arrays: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, key: tuple, *arrays: np.ndarray) -> None:
        self.keys.append(key)
        self.arrays.append(arrays)
        self.size += len(arrays[0])

    def flat(self) -> tuple[np.ndarray, ...]:
        """Document numbers, then each of the arrays, over all documents."""
        lengths = [len(a[0]) for a in self.arrays]
        owner = np.repeat(np.arange(len(lengths), dtype=np.uint16), lengths)
        return owner, *(np.concatenate(c) for c in zip(*self.arrays, strict=True))


#: A chunk's questions: for buckets and the buckets of a group (1: none), data by bucket or group, then
#: what the chunk itself knows.
Settle = Callable[[Chunk, int, int], tuple[list[tuple[int, bytes]], object]]


def deal_out(
    rows: DataFrame, gather: Callable[[dict], tuple], settle: Settle, buckets: int, group: int = 1, remember: Callable[[dict], tuple] = lambda _: ()
) -> DataFrame:
    """chunk, bucket, data. gather gives arrays of a row, remember what else its key holds.

    With groups, bucket is a group's number. Numbers from that of all buckets on carry the chunks' own knowledge.
    """
    small_batches(rows.sparkSession)
    names, places = rows.columns, -(-buckets // group)
    most = chunk_size(buckets)

    def emit(chunk: Chunk, number: int) -> pa.RecordBatch:
        parts, own = settle(chunk, buckets, group)
        parts.append((places + number % places, pickle.dumps((chunk.keys, own), protocol=5)))
        return pa.RecordBatch.from_arrays(
            [pa.array([number] * len(parts), pa.int64()), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())],
            names=["chunk", "bucket", "data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        chunk = Chunk()
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                arrays = gather(row)
                chunk.add((row["id0"], row["nul"], row["th"], len(arrays[0]), *remember(row)), *arrays)
                if chunk.size >= most or len(chunk.keys) >= MOST_DOCUMENTS:
                    yield emit(chunk, number)
                    number += 1
                    chunk = Chunk()
        if chunk.keys:
            yield emit(chunk, number)

    return rows.mapInArrow(run, "chunk long, bucket int, data binary")


def bucket_of(hashes: np.ndarray, buckets: int, group: int = 1) -> np.ndarray:
    """Bucket, or group of buckets, of 64-bit hashes, by their upper half."""
    return (((hashes >> np.uint64(32)) % np.uint64(buckets)) // np.uint64(group)).astype(np.int32)


def parted(bucket: np.ndarray) -> tuple[np.ndarray, dict[int, slice]]:
    """(order by bucket, place of each bucket that occurs in it)."""
    order = np.argsort(bucket, kind="stable")
    values, first = np.unique(bucket[order], return_index=True)
    ends = [*first[1:].tolist(), len(bucket)] if len(first) else []
    return order, {b: slice(i, j) for b, i, j in zip(values.tolist(), first.tolist(), ends, strict=True)}


NOTHING = slice(0, 0)


def settle_hits(chunk: Chunk, buckets: int, group: int = 1) -> tuple[list[tuple[int, bytes]], object]:
    """For arrays (hashes, positions, is indexed): which indexed entries have their hash anywhere else.

    For hashes alone, all are indexed and have no positions. Entries that meet inside the chunk
    are settled; the chunk sends every hash once, with its owner only if it is an indexed entry
    that still needs an answer. Buckets get 32-bit remainders, groups whole hashes.
    """
    owner, hashes, *rest = chunk.flat()
    position, indexed = rest if rest else (np.empty((len(hashes), 0), np.uint32), np.ones(len(hashes), bool))
    values, first, inverse, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    met = count[inverse] >= 2
    asks = indexed & ~met
    width = np.uint32 if group == 1 else np.uint64
    silent, asked = values[(count >= 2) | ~indexed[first]], hashes[asks]
    p_order, p_at = parted(bucket_of(silent, buckets, group))
    x_order, x_at = parted(bucket_of(asked, buckets, group))
    p_rest, x_rest = silent[p_order].astype(width), asked[x_order].astype(width)
    x_owner, x_position = owner[asks][x_order], position[asks][x_order]
    out = []
    for b in sorted({*p_at, *x_at}):
        p, x = p_at.get(b, NOTHING), x_at.get(b, NOTHING)
        head = np.array([p.stop - p.start, x.stop - x.start], np.uint64)
        out.append((b, b"".join(a.tobytes() for a in (head, p_rest[p], x_rest[x], x_owner[x], x_position[x]))))
    here = indexed & met
    return out, (owner[here], position[here])


def read_hits(data: bytes, width: type = np.uint32) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n_p, n_x = np.frombuffer(data, np.uint64, 2).tolist()
    size, at = np.dtype(width).itemsize, 16
    p = np.frombuffer(data, width, n_p, at)
    x = np.frombuffer(data, width, n_x, at + size * n_p)
    at += size * (n_p + n_x)
    owner = np.frombuffer(data, np.uint16, n_x, at)
    position = np.frombuffer(data, np.uint32, -1, at + 2 * n_x) if len(data) > at + 2 * n_x else np.zeros(n_x, np.uint32)
    return p, x, owner, position


ANSWERS = "chunk long, own boolean, data binary"


def answers(rows: list[tuple[int, bool, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.table({"chunk": pa.array(cols[0], pa.int64()), "own": pa.array(cols[1], pa.bool_()), "data": pa.array(cols[2], pa.binary())})


def answer_buckets(dealt: DataFrame, buckets: int, answer: Callable[[list[bytes]], list[object | None]]) -> DataFrame:
    """chunk, own, data: for each chunk, a bucket's answer (if any) and the chunk's own knowledge."""

    def run(table: pa.Table) -> pa.Table:
        chunks, data = table.column("chunk").to_pylist(), table.column("data").to_pylist()
        if table.column("bucket")[0].as_py() >= buckets:
            return answers([(c, True, d) for c, d in zip(chunks, data, strict=True)])
        found = answer(data)
        return answers([(c, False, pickle.dumps(f, protocol=5)) for c, f in zip(chunks, found, strict=True) if f is not None])

    return dealt.groupBy("bucket").applyInArrow(run, ANSWERS)


def answer_hits(data: list[bytes]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """(owners, positions) of the entries of each chunk whose hash came from anywhere else too."""
    parts = [read_hits(d) for d in data]
    every = np.sort(np.concatenate([a for p in parts for a in p[:2]]))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out: list = []
    for _, x, owner, position in parts:
        hit = np.zeros(len(x), bool)
        if len(twice) and len(x):
            at = np.searchsorted(twice, x)
            hit = twice[np.minimum(at, len(twice) - 1)] == x
        out.append((owner[hit], position[hit]) if hit.any() else None)
    return out


KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def each_document(answered: DataFrame, conclude: Callable[[tuple, np.ndarray], tuple | None], schema: str) -> DataFrame:
    """A row per document with what its chunk and all buckets found.

    conclude(key, positions) gives the row of a document, or None for no row.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]
    types = [KINDS[c.strip().split()[1]] for c in schema.split(",")]

    def run(table: pa.Table) -> pa.Table:
        keys: list[tuple] = []
        owners, positions = [], []
        for own, data in zip(table.column("own").to_pylist(), table.column("data").to_pylist(), strict=True):
            found = pickle.loads(data)
            if own:
                keys, found = found
            owners.append(found[0])
            positions.append(found[1] if found[1].ndim == 1 else np.zeros(len(found[0]), np.uint32))
        owner, position = np.concatenate(owners), np.concatenate(positions)
        order = np.argsort(owner, kind="stable")
        owner, position = owner[order], position[order]
        bounds = np.searchsorted(owner, np.arange(len(keys) + 1))
        rows = [r for i, key in enumerate(keys) if (r := conclude(key, position[bounds[i] : bounds[i + 1]])) is not None]
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, types, strict=True)})

    return answered.groupBy("chunk").applyInArrow(run, schema)


def by_document(answered: DataFrame, conclude: Callable[[tuple, np.ndarray], tuple | None], columns: str) -> DataFrame:
    """The key's columns of each document and the given ones: conclude gives these, or None for no row."""
    return each_document(answered, lambda key, at: None if (row := conclude(key, at)) is None else (*key[:3], *row), f"{KEYS}, {columns}")


@dataclass
class Question:
    """What an exchange asks: how chunks settle and buckets answer, and the same for the rows of groups.

    A group's row is a document of the second step: gather and remember read it, conclude turns the
    answers of its chunks into rows of ANSWERS for the chunk that it came from.
    """

    settle: Settle
    answer: Callable[[list[bytes]], list[object | None]]
    gather: Callable[[dict], tuple]
    remember: Callable[[dict], tuple]
    settle_again: Settle
    answer_again: Callable[[list[bytes]], list[object | None]]
    conclude: Callable[[DataFrame], DataFrame]


def exchanged(rows: DataFrame, gather: Callable[[dict], tuple], ask: Question, buckets: int) -> DataFrame:
    """ANSWERS of all chunks of the rows, in one step or, with more than GROUP buckets, in two."""
    if buckets <= GROUP:
        return answer_buckets(deal_out(rows, gather, ask.settle, buckets), buckets, ask.answer)
    groups = -(-buckets // GROUP)
    dealt = stored(deal_out(rows, gather, ask.settle, buckets, GROUP), "dealt")
    own = dealt.filter(F.col("bucket") >= groups).select("chunk", F.lit(True).alias("own"), "data")
    # Rows of one group stand together, so that a chunk of the second step has large shares of few buckets.
    slice_ = F.pmod(F.xxhash64("chunk"), F.lit(SLICES))
    together = dealt.filter(F.col("bucket") < groups).repartition(groups * SLICES, "bucket", slice_).sortWithinPartitions("bucket")
    again = together.select(F.col("chunk").alias("id0"), F.lit(False).alias("nul"), F.col("bucket").cast("long").alias("th"), "data")
    asked = deal_out(again, ask.gather, ask.settle_again, buckets, remember=ask.remember)
    return own.unionByName(ask.conclude(answer_buckets(asked, buckets, ask.answer_again)))


def gather_hits(row: dict) -> tuple[np.ndarray, ...]:
    p, x, _, _ = read_hits(row["data"], np.uint64)
    hashes = np.concatenate([p, x])
    return hashes, np.arange(len(hashes), dtype=np.uint32), np.arange(len(hashes)) >= len(p)


def remember_hits(row: dict) -> tuple:
    p, _, owner, position = read_hits(row["data"], np.uint64)
    return len(p), owner, position


def conclude_hits(answered: DataFrame) -> DataFrame:
    def conclude(key: tuple, at: np.ndarray) -> tuple | None:
        _, owner, position = key[4:]
        x = at.astype(np.int64) - key[4]
        return (key[0], False, pickle.dumps((owner[x], position[x]), protocol=5)) if len(x) else None

    return each_document(answered, conclude, ANSWERS)


HITS = Question(settle_hits, answer_hits, gather_hits, remember_hits, settle_hits, answer_hits, conclude_hits)
