"""Substring dedup by fixed-block anchors.

Reference blocks are the non-overlapping blocks of ten words of every document; every rolling
ten-word window of every document probes them. A repeat of 20 words or more holds a whole block of
each of its copies, and each such block is hit by a window of the other copies. So only windows of
20 words whose own blocks were all hit can be repeats. Around the hits these windows are compared
by 128-bit hashes of their words; the smallest (id, start) of equal windows stays, all others are marked, and
overlapping marks join to maximal exact repeats.

Defined results: a null text has no words; very long texts are read whole; rows without an id come
after all others; rows that share an id count as one document, and the same place of equal rows is
not an earlier one; texts with fewer words than a window lose nothing. Only the two named columns are
read, whatever others there are. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import files_for, map_batches, rolling, stored, wide_hashes, word_hashes
from tidewire.llm.exchange import (
    ANSWERS,
    HITS,
    Chunk,
    Question,
    bucket_count,
    bucket_of,
    by_document,
    each_document,
    exchanged,
    keyed,
    parted,
)


def words_of(text: str | None) -> list[bytes]:
    """Words as runs without ASCII white space, unchanged."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def anchors(text: str, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of rolling windows of a block's length, their places, is a reference block)."""
    h = rolling(word_hashes(words_of(text)), block)
    at = np.arange(len(h), dtype=np.uint32)
    return h, at, at % block == 0


def candidates(hits: np.ndarray, n_words: int, window: int, block: int) -> np.ndarray:
    """Starts of windows all of whose own whole blocks were hit."""
    n = n_words - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    hit = np.zeros(n_words // block + 2, bool)
    hit[hits // block] = True
    starts = np.arange(n)
    first = -(-starts // block)  # the first block that starts in the window
    last = (starts + window) // block - 1  # the last one that ends in it
    bad = np.concatenate([[0], np.cumsum(~hit)])
    return starts[bad[last + 1] - bad[first] == 0]


def ranked(hashes: tuple[np.ndarray, ...], ids: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by hashes, id, place; is a later occurrence, in that order)."""
    order = np.lexsort((position, ids, *hashes))
    i, p = ids[order], position[order]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for h in hashes:
        h = h[order]
        new[1:] |= h[1:] != h[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else np.empty(0, np.int64)
    return order, (i != i[first]) | (p != p[first])


#: A window as buckets and groups get it: 128 bits of its words, its document's id, place and number in the
#: chunk. In a second step the number is a group's row, and nth the window's number there.
RECORD = np.dtype([("h", "<u8"), ("g", "<u8"), ("id", "<i8"), ("position", "<u4"), ("owner", "<u2")])
AGAIN = np.dtype([*RECORD.descr, ("nth", "<u4")])


def settle_windows(chunk: Chunk, buckets: int, group: int = 1) -> tuple[list[tuple[int, bytes]], object]:
    """For arrays (hashes, second hashes, places) or records: later occurrences inside the chunk are settled; first ones are sent."""
    owner, hashes, second, position, *rest = chunk.flat()
    ids, nth = rest if rest else (np.array([k[0] for k in chunk.keys], np.int64)[owner], position)
    order, later = ranked((second, hashes), ids, position)
    sent, marked = order[~later], order[later]
    place, at = parted(bucket_of(hashes[sent], buckets, group))
    sent = sent[place]
    rows = np.empty(len(sent), AGAIN if rest else RECORD)
    for name, values in (("h", hashes), ("g", second), ("id", ids), ("position", position), ("owner", owner), *([("nth", nth)] if rest else [])):
        rows[name] = values[sent]
    return [(b, rows[where].tobytes()) for b, where in at.items()], (owner[marked], nth[marked])


def answer_windows(data: list[bytes], kind: np.dtype = RECORD) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """(owners, places or numbers) of the windows of each chunk that are not the first of their kind."""
    rows = np.frombuffer(b"".join(data), kind)
    later = np.zeros(len(rows), bool)
    order, marks = ranked((rows["g"], rows["h"]), rows["id"], rows["position"])
    later[order] = marks
    out: list = []
    at = 0
    for d in data:
        n = len(d) // kind.itemsize
        own, mark = rows[at : at + n], later[at : at + n]
        out.append((own["owner"][mark], own["position" if kind == RECORD else "nth"][mark]) if mark.any() else None)
        at += n
    return out


def gather_windows(row: dict) -> tuple[np.ndarray, ...]:
    r = np.frombuffer(row["data"], RECORD)
    return r["h"], r["g"], r["position"], r["id"], np.arange(len(r), dtype=np.uint32)


def conclude_windows(answered: DataFrame) -> DataFrame:
    def conclude(key: tuple, nth: np.ndarray) -> tuple | None:
        r = np.frombuffer(key[4], RECORD)[nth]
        return (key[0], False, pickle.dumps((r["owner"], r["position"]), protocol=5)) if len(r) else None

    return each_document(answered, conclude, ANSWERS)


WINDOWS = Question(
    settle_windows, answer_windows, gather_windows, lambda row: (row["data"],), settle_windows, partial(answer_windows, kind=AGAIN), conclude_windows
)


def runs(position: np.ndarray) -> np.ndarray:
    """Sorted distinct places as (first, number) of consecutive ones."""
    p = np.unique(position.astype(np.int64))
    if not len(p):
        return np.empty((0, 2), np.uint32)
    breaks = np.flatnonzero(np.diff(p) > 1) + 1
    first = np.concatenate([[0], breaks])
    stop = np.concatenate([breaks, [len(p)]])
    return np.stack([p[first], stop - first], axis=1).astype(np.uint32)


def repeats(docs: DataFrame, window: int, block: int) -> DataFrame:
    """Key and runs (pairs of unsigned 32-bit numbers) of the windows that occurred earlier; docs is keyed()."""
    if 2 * block > window + 1:
        raise ValueError("a window must hold a whole block of any alignment")
    key = ["id0", "nul", "th"]
    buckets, files = bucket_count(docs), files_for(docs.count())
    found = by_document(
        exchanged(docs, lambda r: anchors(r["body"], block), HITS, buckets),
        lambda _, position: (np.unique(position).tobytes(),) if len(position) else None,
        "hits binary",
    )
    hits = stored(found, "anchor-hits", files)
    merged = hits.groupBy(*key).agg(F.collect_set("hits").alias("hits"))

    def windows(row: dict) -> tuple[np.ndarray, ...]:
        words = words_of(row["body"])
        hit = np.frombuffer(b"".join(row["hits"]), np.uint32)
        starts = candidates(hit, len(words), window, block)
        if not len(starts):
            return np.empty(0, np.uint64), np.empty(0, np.uint64), starts.astype(np.uint32)
        low, high = wide_hashes(words)
        return rolling(low, window)[starts], rolling(high, window)[starts], starts.astype(np.uint32)

    later = by_document(
        exchanged(docs.join(merged, key), windows, WINDOWS, buckets),
        lambda _, position: (runs(position).tobytes(),) if len(position) else None,
        "runs binary",
    )
    return stored(later, "repeats", files)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, block: int = 10, with_text: bool = False
) -> DataFrame:
    """One row per document: n_words, n_removed, kept_sha256 and, on request, the kept text."""
    rows = keyed(docs, id_col, text_col)
    found = repeats(rows, window, block).groupBy("id0", "nul", "th").agg(F.collect_set("runs").alias("runs"))
    both = rows.join(found, ["id0", "nul", "th"], "left").select("id0", "nul", "body", "runs")
    names = ["id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, n, gone, sha, kept = [], [], [], [], []
        for id0, nul, body, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = words_of(body)
            keep = words
            if marks:
                cover = np.zeros(len(words) + 1, np.int32)
                for first, number in np.frombuffer(b"".join(marks), np.uint32).reshape(-1, 2).astype(np.int64):
                    cover[first] += 1
                    cover[min(first + number - 1 + window, len(words))] -= 1
                stays = np.cumsum(cover[:-1]) == 0
                keep = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
            text = b" ".join(keep)
            ids.append(None if nul else id0)
            n.append(len(words))
            gone.append(len(words) - len(keep))
            sha.append(hashlib.sha256(text).hexdigest())
            kept.append(text)
        arrays = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
        if with_text:
            arrays.append(pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string()))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return map_batches(both, run, schema).withColumnRenamed("id", id_col)
