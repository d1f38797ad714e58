"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces. Pieces are dealt at random to shards of bounded size; each shard
is packed by several islands. A chromosome is a set of bins. Crossover injects whole well-filled
bins of one parent into the other, bins of the other that hold an injected piece are dissolved,
and the displaced pieces are put back by best fit, longest first. After each epoch the best
chromosome of an island moves to the next one. A shard stops when it reaches its lower bound.
Bins that stay badly filled are dissolved, and their pieces are dealt anew in a further round, so
that a shard's remainder is not lost.

Defined results: a null text is empty, i.e. one piece of one token; a very long text is encoded whole and
cut; pieces of equal length are packed in any order; repeated rows are packed each; a null id is passed
on; an empty table gives no rows. Only the two named columns are read, whatever others there are.
"""

from __future__ import annotations

import base64
import json
import random
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tidewire.llm.common import checkpointed, files_for, kept_for, serving, small_batches, stored

#: Split pattern of the byte-level vocabulary (a fixed value of the tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What the library's own pre-tokenizer of this pattern is called in its file, and the model's plain settings.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN_BPE = {"type": "BPE", "dropout": None, "byte_fallback": False, "ignore_merges": False, "continuing_subword_prefix": None, "end_of_word_suffix": None}


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable bytes for themselves, others from 256 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


def same_encoding(library: Tokenizer, file: dict, ranks: dict[bytes, int]) -> bool:
    """Whether merging by rank gives the ids that the library's merges give.

    Both part a text by one pattern and then merge the pair of the least rank again and again. The library takes
    the pairs of its list only, the rank encoder any pair that makes a token. These are the same if ranks follow the
    list, every token has one merge, and every token's own bytes are merged to it: then the only two neighbours
    that make a token, when no pair of lower rank is left in it, are its merge's.
    """
    model, letters = file["model"], byte_letters()
    if file["normalizer"] is not None or any(model.get(k) != v for k, v in PLAIN_BPE.items()) or any(file["pre_tokenizer"].get(k) != v for k, v in BYTE_LEVEL.items()):
        return False
    added = {t["content"] for t in file["added_tokens"]}
    vocabulary = {token: i for token, i in model["vocab"].items() if token not in added}
    if {bytes(map(letters.__getitem__, token)): i for token, i in vocabulary.items()} != ranks:
        return False
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(set(made)) or len(made) + 256 != len(vocabulary):
        return False
    alone = Tokenizer.from_str(library.to_str())
    alone.pre_tokenizer = pre_tokenizers.Sequence([])
    tokens = list(vocabulary)
    return all(e.ids == [vocabulary[t]] for t, e in zip(tokens, alone.encode_batch_fast(tokens, add_special_tokens=False), strict=True))


class ByteBpe:
    """Token ids as the tokenizers library gives them for a byte-level BPE file.

    The rank file holds the same vocabulary for a faster encoder. It is used if same_encoding shows that it
    gives the same ids; what it refuses (its pattern runs out of stack on very long white space) the library encodes.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None):
        self.library = Tokenizer.from_file(json_path)
        self.fast = None
        if ranks_path:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks_path, "rb"))}
            file = json.load(open(json_path))
            if same_encoding(self.library, file, ranks):
                special = {t["content"]: t["id"] for t in file["added_tokens"]}
                self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def plain(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
            except ValueError:
                pass
        return np.array(self.plain(text), "<u4")


@cache
def tokenizer(json_path: str, ranks_path: str | None) -> ByteBpe:
    """One tokenizer per worker and file."""
    return ByteBpe(json_path, ranks_path)


kept_for("tokens", tokenizer.cache_clear)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n - capacity * ((n - 1) // capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def mixed(n: int) -> int:
    """A bijection of 64-bit numbers that looks random: distinct numbers for distinct rows."""
    m = (1 << 64) - 1
    n = (n + 0x9E3779B97F4A7C15) & m
    n = ((n ^ (n >> 30)) * 0xBF58476D1CE4E5B9) & m
    n = ((n ^ (n >> 27)) * 0x94D049BB133111EB) & m
    n ^= n >> 31
    return n - (1 << 64) if n >> 63 else n


def token_pieces(
    docs: DataFrame, json_path: str, ranks_path: str | None, capacity: int, end_id: int, id_col: str, text_col: str
) -> DataFrame:
    """A row per piece: row (a distinct number), id, piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serving("tokens")
        t = tokenizer(json_path, ranks_path)
        nth = TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4")
        for batch in batches:
            doc, cols = [], ([], [], [], [], [])
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate([t.encode(text or ""), end])
                for k, (start, size) in enumerate(cut(len(ids), capacity)):
                    doc.append(i)
                    for c, v in zip(cols, (mixed(nth), k, start, size, zlib.crc32(ids[start : start + size].tobytes())), strict=True):
                        c.append(v)
                    nth += 1
            if doc:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                arrays = [pa.array(c, t_) for c, t_ in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [arrays[0], batch.column(0).take(pa.array(doc)), *arrays[1:]],
                    names=["row", "id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as body").mapInArrow(
        run, f"row long, id {kind}, piece int, start long, length long, ids_crc32 long"
    )


class Bin(list):
    """Items of a bin with the sum of their sizes."""

    __slots__ = ("fill",)

    def __init__(self, items: Iterable[int], fill: int):
        super().__init__(items)
        self.fill = fill


Bins = list[Bin]
fill_of = attrgetter("fill")


class Packer:
    """A grouping genetic algorithm for one shard: items by number."""

    def __init__(self, sizes: list[int], capacity: int, seed: int):
        self.sizes, self.capacity, self.random = sizes, capacity, random.Random(seed)
        self.bound = -(-sum(sizes) // capacity)

    def known(self, bins: list[list[int]]) -> Bins:
        return [Bin(b, sum(map(self.sizes.__getitem__, b))) for b in bins]

    def best_fit(self, items: list[int], bins: Bins) -> Bins:
        """Bins with the items added, in the order given: each into the bin with the least room that holds it."""
        sizes, capacity = self.sizes, self.capacity
        by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        mask = 0
        for i, b in enumerate(bins):
            room = capacity - b.fill
            if room:
                by_room[room].append(i)
                mask |= 1 << room
        own = set()
        for item in items:
            size = sizes[item]
            above = mask >> size
            if above:
                room = size + (above & -above).bit_length() - 1
                at = by_room[room].pop()
                if not by_room[room]:
                    mask &= ~(1 << room)
                if at not in own:  # bins are shared between chromosomes
                    bins[at] = Bin(bins[at], bins[at].fill)
                    own.add(at)
                bins[at].append(item)
                bins[at].fill += size
            else:
                room, at = capacity, len(bins)
                bins.append(Bin((item,), size))
                own.add(at)
            left = room - size
            if left:
                by_room[left].append(at)
                mask |= 1 << left
        return bins

    def falling(self, items: list[int], noise: float = 0.0) -> list[int]:
        if noise:
            return sorted(items, key=lambda i: -self.sizes[i] * (1 + noise * self.random.random()))
        return sorted(items, key=self.sizes.__getitem__, reverse=True)

    def cost(self, bins: Bins) -> tuple[int, float]:
        """Fewer bins first, then bins filled more unevenly: room gathered in few bins can be emptied."""
        return len(bins), -sum(f * f for f in map(fill_of, bins)) / self.capacity**2

    def cross(self, one: Bins, two: Bins) -> Bins:
        """Whole bins of one go into two, fuller ones likelier; two's bins that hold their pieces are dissolved."""
        take = self.random.randint(1, max(1, len(one) // 3))
        # The least of random numbers weighted by room: a full bin is drawn before one with much room.
        scale = self.capacity / 16
        drawn = sorted(range(len(one)), key=lambda i: self.random.random() * (1 + (self.capacity - one[i].fill) / scale))
        injected = [one[i] for i in drawn[:take]]
        taken = {i for b in injected for i in b}
        kept, displaced = list(injected), []
        for b in two:
            if taken.isdisjoint(b):
                kept.append(b)
            else:
                displaced += [i for i in b if i not in taken]
        return self.placed(kept, displaced)

    def mutate(self, bins: Bins) -> Bins:
        """The worst-filled bins and a few others are dissolved."""
        order = sorted(range(len(bins)), key=lambda i: bins[i].fill)
        gone = {*order[: self.random.randint(1, 3)], *self.random.sample(range(len(bins)), min(len(bins), self.random.randint(2, 6)))}
        kept = [b for i, b in enumerate(bins) if i not in gone]
        return self.placed(kept, [i for g in gone for i in bins[g]])

    def placed(self, kept: Bins, displaced: list[int]) -> Bins:
        """Displaced pieces first change places with one or two smaller ones that fill a bin worse; the rest goes by best fit."""
        bins = list(kept)
        free = sorted(displaced, key=self.sizes.__getitem__)
        lengths = [self.sizes[i] for i in free]
        unfilled = [i for i, b in enumerate(bins) if b.fill < self.capacity]
        self.random.shuffle(unfilled)
        for at in unfilled:
            if not free:
                break
            room = self.capacity - bins[at].fill
            b = bins[at]
            small = b if len(b) <= 12 else self.random.sample(b, 12)
            groups = [(self.sizes[i], (i,)) for i in small]
            groups += [(self.sizes[i] + self.sizes[j], (i, j)) for n, i in enumerate(small) for j in small[:n]]
            best, change = 0, None
            for size, out in groups:
                # The largest displaced piece that fits in their place; it must fill more.
                k = bisect_right(lengths, size + room) - 1
                if k >= 0 and lengths[k] - size > best:
                    best, change = lengths[k] - size, (k, out)
                    if best == room:
                        break
            if change:
                k, out = change
                bins[at] = Bin((*(i for i in b if i not in out), free[k]), b.fill + best)
                del free[k], lengths[k]
                for i in out:
                    k = bisect_right(lengths, self.sizes[i])
                    free.insert(k, i)
                    lengths.insert(k, self.sizes[i])
        return self.best_fit(self.falling(free, 0.1), bins)

    def evolve(self, elites: list[list[list[int]]], generations: int, population: int) -> Bins:
        """The best bins found; the population starts with best fit of falling sizes, also of noisy ones."""
        everything = list(range(len(self.sizes)))
        people = [*map(self.known, elites), self.best_fit(self.falling(everything), [])]
        while len(people) < population and min(map(len, people)) > self.bound:
            people.append(self.best_fit(self.falling(everything, 0.3), []))
        people = sorted(((self.cost(b), b) for b in people), key=lambda p: p[0])
        for _ in range(generations):
            if people[0][0][0] <= self.bound:
                break
            pick = lambda: people[min(self.random.randrange(len(people)), self.random.randrange(len(people)))][1]
            born = [self.mutate(self.cross(pick(), pick())) for _ in range(max(1, population // 2))]
            people = sorted([*people, *((self.cost(b), b) for b in born)], key=lambda p: p[0])
            # Twins go: a population of one solution has nothing to cross.
            people = [p for n, p in enumerate(people) if not n or p[0] != people[n - 1][0]][:population]
        return people[0][1]


def as_bins(assignment: bytes) -> list[list[int]]:
    a = np.frombuffer(assignment, "<i4")
    out: list[list[int]] = [[] for _ in range(int(a.max()) + 1)] if len(a) else []
    for i, b in enumerate(a.tolist()):
        out[b].append(i)
    return out


def as_bytes(bins: Bins, n: int) -> bytes:
    a = np.empty(n, "<i4")
    for k, b in enumerate(bins):
        a[b] = k
    return a.tobytes()


STATE = "shard long, island int, sizes binary, elite binary, migrant binary, n_bins int, bound int"


def epoch(state: DataFrame, capacity: int, generations: int, population: int, nth: int) -> DataFrame:
    """Every island evolves on its own, from its elite and the migrant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.frombuffer(r["sizes"], "<i4").tolist()
                p = Packer(sizes, capacity, mixed(r["shard"] * 64 + r["island"] + (nth << 50)))
                bins = p.evolve([as_bins(r[k]) for k in ("elite", "migrant") if r[k] is not None], generations, population)
                r |= {"elite": as_bytes(bins, len(sizes)), "migrant": None, "n_bins": len(bins), "bound": p.bound}
                yield pa.RecordBatch.from_pylist([r], schema=batch.schema)

    return state.mapInArrow(run, STATE)


def pack_round(
    items: DataFrame, nth: int, capacity: int, shard_items: int, islands: int, epochs: int, generations: int, population: int
) -> DataFrame:
    """row, shard, bin, place (in the bin) and room (of the bin) of every item (row, length)."""
    spark = items.sparkSession
    rows = items.count()
    shards, files = max(1, -(-rows // shard_items)), files_for(rows)
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(nth)), F.lit(shards)))
    shard = checkpointed(dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("row", "length"))).alias("items")), files)
    small_batches(spark)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = np.array(sizes, "<i4").tobytes()
                rows = [{"shard": number, "island": i, "sizes": raw, "elite": None, "migrant": None, "n_bins": 0, "bound": 0} for i in range(islands)]
                yield pa.RecordBatch.from_pylist(rows, schema=STATE_SCHEMA)

    tasks = min(max(shards * islands, 1), max(spark.sparkContext.defaultParallelism * 3, shards // 8))
    state = shard.select("shard", F.col("items.length").alias("sizes")).mapInArrow(begin, STATE)
    state = checkpointed(epoch(state.repartition(tasks, "shard", "island"), capacity, generations, population, nth * 100), files)
    for e in range(1, epochs):
        best = state.groupBy("shard").agg(F.min("n_bins").alias("least"))
        open_ = state.join(best, "shard").filter("least > bound").drop("least")
        if open_.isEmpty():
            break
        movers = open_.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("migrant"))
        moved = open_.drop("migrant").join(movers, ["shard", "island"]).select(*[f.name for f in STATE_SCHEMA])
        done = state.join(best, "shard").filter("least <= bound").drop("least")
        state = checkpointed(done.unionByName(epoch(moved.repartition(tasks, "shard", "island"), capacity, generations, population, nth * 100 + e)), files)
    winner = state.groupBy("shard").agg(F.min_by("elite", F.struct("n_bins", "island")).alias("elite"))

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, rows, lengths, elite in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bins = as_bins(elite)
                out: tuple[list, ...] = ([], [], [], [], [])
                for k, b in enumerate(bins):
                    at = 0
                    room = capacity - sum(lengths[i] for i in b)
                    for i in b:
                        for c, v in zip(out, (rows[i], number, k, at, room), strict=True):
                            c.append(v)
                        at += lengths[i]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["row", "shard", "bin", "place", "room"])

    both = shard.join(winner, "shard").select("shard", F.col("items.row").alias("rows"), F.col("items.length").alias("lengths"), "elite")
    return checkpointed(both.select("shard", "rows", "lengths", "elite").mapInArrow(end, "row long, shard long, bin int, place long, room long"), files)


STATE_SCHEMA = pa.schema(
    [("shard", pa.int64()), ("island", pa.int32()), ("sizes", pa.binary()), ("elite", pa.binary()), ("migrant", pa.binary()), ("n_bins", pa.int32()), ("bound", pa.int32())]
)


def pack(
    docs: DataFrame,
    json_path: str,
    ranks_path: str | None = None,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_items: int = 4096,
    rounds: int = 3,
    slack: int = 16,
    islands: int = 3,
    epochs: int = 3,
    generations: int = 10,
    population: int = 8,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A piece as long as a sequence is one by itself and needs no search. A bin with at most `slack` free
    tokens is final; in every round but the last, pieces of other bins are dealt anew. sequence_id is
    made of round, shard and bin.
    """
    pieces = stored(token_pieces(docs, json_path, ranks_path, capacity, end_id, id_col, text_col), "pieces", files_for(docs.count()))
    whole, shorter = pieces.filter(F.col("length") == capacity), pieces.filter(F.col("length") < capacity)
    items, placed = shorter.select("row", F.col("length").cast("int").alias("length")), None
    for nth in range(rounds):
        packed = pack_round(items, nth, capacity, shard_items, islands, epochs, generations, population)
        last = nth == rounds - 1
        final = packed if last else packed.filter(F.col("room") <= slack)
        number = F.lit(nth << 60) + F.col("shard") * (1 << 24) + F.col("bin")
        final = final.select("row", number.alias("sequence_id"), F.col("place").alias("offset"))
        placed = final if placed is None else placed.unionByName(final)
        if last:
            break
        left = packed.filter(F.col("room") > slack).select("row")
        items = checkpointed(items.join(left, "row"), files_for(left.count()))
        if items.isEmpty():
            break
    alone = whole.withColumns({"sequence_id": F.lit(rounds << 60) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return shorter.join(placed, "row").select(*columns).unionByName(alone.select(*columns))
