"""Cross-tokenizer alignment: where two tokenizers' tokens of one text end together, and which tokens meet.

A is a byte-level BPE on a space and the text, B a SentencePiece model on the text, which adds that space
itself; strings of special tokens are plain text to both. The ends of the tokens are marked in two packed
bitsets over the bytes of a stretch of documents. AND gives the shared cuts, which part the tokens into
groups; OR gives the ends of all pieces that lie in one token of each side, and such a piece is a link. Ranks
by popcount turn a byte place into a token number on either side, so that groups and links expand
without a walk over tokens.

How often a pair of ids is linked in the corpus is counted in two steps. A stretch counts its own distinct
pairs; grouped sums of these are the corpus counts, and the highest of a B id is a window over its at most
|A| partners. Each stretch then gets the counts of its own pairs by one join, in which a pair that every
stretch has costs one row a stretch, and is put together with its documents, which carry numbers of
pairs with multiplicities. No group is larger than one stretch (4 MB of text or one document).

Defined results: a null or empty text has no tokens; neither has one whose tokens' bytes, on either side, are
not those of a space and the text (a text with U+2581, which B reads as a space). Such rows get zeros and an
empty digest. Very long texts are aligned whole, as a stretch of their own; repeated rows count each; a null id
is passed on; an empty table gives no rows. Only the two named columns are read, whatever others there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewire.llm.common import apart, kept_for, serving, small_batches, stored
from tidewire.llm.packing import byte_letters, tokenizer

#: Bytes of text of one stretch, whose documents share bitsets and a list of pairs; and tokens expanded at a time.
STRETCH, BLOCK = 4 << 20, 1 << 20


class Bits:
    """A packed bitset with ranks and selection."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.bitwise_count(words).cumsum(dtype=np.int64)])

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(size + 128 >> 6 << 6, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view(np.uint64))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def __len__(self) -> int:
        return int(self.before[-1])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many marks lie before each place."""
        word = places >> 6
        below = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def has(self, places: np.ndarray) -> np.ndarray:
        return (self.words[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def select(self, low: int = 0, high: int | None = None) -> np.ndarray:
        """The marked places from one word-aligned place on, in order."""
        first, last = low >> 6, len(self.words) if high is None else (high >> 6) + 1
        found = np.flatnonzero(np.unpackbits(self.words[first:last].view(np.uint8), bitorder="little")) + (first << 6)
        return found[(found >= low) & (found <= high)] if high is not None else found[found >= low]


class Tokenizers:
    """The two encoders of a worker, and the bytes of their tokens."""

    def __init__(self, a_file: str, a_ranks: str | None, b_file: str):
        self.a = tokenizer(a_file, a_ranks)
        letters, vocabulary = byte_letters(), self.a.library.get_vocab(with_added_tokens=True)
        self.a_raw = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_raw[i] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        n = self.b.get_piece_size()
        self.b_raw = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(n)))]
        self.a_size, self.b_size = (np.array(list(map(len, raw)), np.int64) for raw in (self.a_raw, self.b_raw))
        self.render = Digits(max(len(self.a_raw), n))

    @cached_property
    def library(self) -> Tokenizer:
        """A library of its own, for what the rank encoder refuses: the shared one of the packing reads special tokens."""
        own = Tokenizer.from_str(self.a.library.to_str())
        own.encode_special_tokens = True
        return own

    def a_ids(self, text: str) -> list[int]:
        if self.a.fast:
            try:
                return self.a.fast.encode(text, disallowed_special=())  # encode_ordinary panics where this raises
            except ValueError:  # its pattern runs out of stack on very long white space
                pass
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[int], int]]:
        """Of each text the ids of both sides and the bytes they cover; none where they do not give it back."""
        for text, b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1), strict=True):
            spaced = " " + text if text else ""
            a, raw = self.a_ids(spaced), spaced.encode()
            same = raw and b"".join(map(self.a_raw.__getitem__, a)) == raw and b"".join(map(self.b_raw.__getitem__, b)) == raw
            yield (a, b, len(raw)) if same else ([], [], 0)


class Digits:
    """Decimal numbers followed by one of three marks, written for many ids at once."""

    MARKS = ",|;"

    def __init__(self, most: int):
        made = [f"{i}{mark}".encode() for mark in self.MARKS for i in range(most)]
        self.most, self.width = most, np.array(list(map(len, made)), np.int64)
        self.chars = np.zeros((len(made), int(self.width.max())), np.uint8)
        for i, m in enumerate(made):
            self.chars[i, : len(m)] = np.frombuffer(m, np.uint8)
        self.keep = np.arange(self.chars.shape[1]) < self.width[:, None]

    def write(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all characters, where each number starts)"""
        return self.chars[codes][self.keep[codes]], np.concatenate([[0], self.width[codes].cumsum()])


@cache
def tokenizers_of(a_file: str, a_ranks: str | None, b_file: str) -> Tokenizers:
    return Tokenizers(a_file, a_ranks, b_file)


kept_for("alignment", tokenizers_of.cache_clear)


@dataclass
class Stretch:
    """Aligned documents: ids of both sides end to end, and bitsets of where they end over all bytes."""

    t: Tokenizers
    a: np.ndarray
    b: np.ndarray
    ends: np.ndarray  # of documents, in bytes

    def __post_init__(self) -> None:
        size = int(self.ends[-1]) if len(self.ends) else 0
        self.a_ends, self.b_ends = self.t.a_size[self.a].cumsum(), self.t.b_size[self.b].cumsum()
        self.in_a, self.in_b = Bits.of(self.a_ends, size), Bits.of(self.b_ends, size)
        self.shared, self.pieces = self.in_a & self.in_b, self.in_a | self.in_b
        self.cuts = self.shared.select()

    def per_document(self, bits: Bits) -> np.ndarray:
        """Marks in each document."""
        return np.diff(bits.rank(self.ends + 1), prepend=0)

    def token_cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of either side up to each shared cut."""
        return self.in_a.rank(self.cuts + 1), self.in_b.rank(self.cuts + 1)

    def blocks(self) -> Iterator[tuple[int, int]]:
        """(first, last) byte of stretches of whole groups with about BLOCK tokens."""
        step, low = max(1, BLOCK // max(1, -(-len(self.pieces) // max(1, len(self.cuts))))), 0
        for i in range(0, len(self.cuts), step):
            high = int(self.cuts[min(i + step, len(self.cuts)) - 1])
            yield low, high
            low = high

    def group_text(self) -> list[str]:
        """sha256 of each document's groups, `a1,a2|b1;a3|b2,b3`; "" without tokens."""
        hashes = [hashlib.sha256() for _ in self.ends]
        for low, high in self.blocks():
            i0, i1 = self.in_a.rank(np.array([low + 1, high + 1]))
            j0, j1 = self.in_b.rank(np.array([low + 1, high + 1]))
            a_ends, b_ends = self.a_ends[i0:i1], self.b_ends[j0:j1]
            # The cut before an A token's group, and the cut that ends a B token's.
            number = self.shared.rank(a_ends)
            opened = np.where(number > 0, self.cuts[number - 1], 0)
            closed = self.cuts[self.shared.rank(b_ends)]
            codes = np.empty(i1 - i0 + j1 - j0, np.int64)
            last_a, last_b = self.shared.has(a_ends), self.shared.has(b_ends)
            most = self.t.render.most
            before = self.in_b.rank(opened + 1) - j0
            codes[np.arange(i1 - i0) + np.where(opened > 0, before, 0)] = self.a[i0:i1] + most * last_a
            codes[np.arange(j1 - j0) + self.in_a.rank(closed + 1) - i0] = self.b[j0:j1] + 2 * most * last_b
            text, starts = self.t.render.write(codes)
            # Characters by document: its first and last token in this block.
            d0, d1 = np.searchsorted(self.ends, [low, high], side="right")
            d1 = min(d1 + 1, len(self.ends))
            until = np.clip(self.ends[d0:d1], low, high)
            token = self.in_a.rank(until + 1) - i0 + self.in_b.rank(until + 1) - j0
            at = 0
            for d, n, end in zip(range(d0, d1), starts[token].tolist(), self.ends[d0:d1].tolist(), strict=True):
                done = end <= high
                hashes[d].update(text[at : n - 1 if done and n > at else n].tobytes())
                at = n
        empty = np.diff(self.ends, prepend=0) == 0
        return ["" if none else h.hexdigest() for h, none in zip(hashes, empty.tolist(), strict=True)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of the stretch (a * |B| + b, ascending) with their links; and (document, number of pair,
        links) of each distinct pair of a document, by document."""
        keys, docs, times = [], [], []
        for low, high in self.blocks():
            ends = self.pieces.select(low + 1, high)
            key = self.a[self.in_a.rank(ends)] * len(self.t.b_raw) + self.b[self.in_b.rank(ends)]
            doc = np.searchsorted(self.ends, ends, side="left")
            order = np.lexsort((key, doc))
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(doc) != 0)])) if len(key) else np.empty(0, np.int64)
            keys.append(key[first])
            docs.append(doc[first])
            times.append(np.diff(first, append=len(key)))
        if not keys:
            none = np.empty(0, np.int64)
            return none, none, none, none, none
        key, doc, n = (np.concatenate(x) for x in (keys, docs, times))
        pairs, number = np.unique(key, return_inverse=True)
        return pairs, np.bincount(number, n, len(pairs)).astype(np.int64), doc, number, n


def stretches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows (id, body) with at most STRETCH bytes of text, or one longer."""
    sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)]
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > STRETCH:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def aligned(t: Tokenizers, texts: list[str | None]) -> tuple[Stretch, np.ndarray, np.ndarray]:
    """The stretch of some texts, and the tokens that each has on either side."""
    a, b, sizes, n_a, n_b = [], [], [], [], []
    for x, y, size in t.encode(texts):
        a.append(np.array(x, np.int64))
        b.append(np.array(y, np.int64))
        sizes.append(size)
        n_a.append(len(x))
        n_b.append(len(y))
    joined = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return Stretch(t, joined(a), joined(b), np.array(sizes, np.int64).cumsum()), np.array(n_a, np.int64), np.array(n_b, np.int64)


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sizes.cumsum()]), pa.int32()), pa.array(values, kind))


def two_columns(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")), docs.schema[id_col].dataType.simpleString()


def token_groups(docs: DataFrame, a_file: str, b_file: str, a_ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ids of both sides, and how many tokens of each side lie before the end of each group. No shuffle."""
    rows, kind = two_columns(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serving("alignment")
        t = tokenizers_of(a_file, a_ranks, b_file)
        for batch in batches:
            for part in stretches(batch):
                s, n_a, n_b = aligned(t, part.column(1).to_pylist())
                groups = s.per_document(s.shared)
                before = lambda n: np.repeat(n.cumsum() - n, groups)  # noqa: B023, E731
                a_cuts, b_cuts = s.token_cuts()
                arrays = [lists(s.a, n_a, pa.int32()), lists(s.b, n_b, pa.int32()), lists(a_cuts - before(n_a), groups, pa.int32()), lists(b_cuts - before(n_b), groups, pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["id", "a_ids", "b_ids", "a_cuts", "b_cuts"])

    out = rows.mapInArrow(run, f"id {kind}, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>")
    return out.withColumnRenamed("id", id_col)


STATS = ("n_a", "n_b", "n_groups", "n_links")


def stretch_rows(docs: DataFrame, a_file: str, b_file: str, a_ranks: str | None, id_col: str, text_col: str) -> DataFrame:
    """Two sorts of rows: documents with numbers of pairs of their stretch, and stretches (pairs not null) with the pairs."""
    rows, kind = two_columns(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serving("alignment")
        t = tokenizers_of(a_file, a_ranks, b_file)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in stretches(batch):
                s, n_a, n_b = aligned(t, part.column(1).to_pylist())
                n = part.num_rows
                keys, counts, doc, at, times = s.links()
                sizes = np.bincount(doc, minlength=n).astype(np.int64)
                last = lambda array: pa.concat_arrays([array, pa.nulls(1, array.type)])
                pairs = pa.StructArray.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["key", "n"])
                pairs = pa.ListArray.from_arrays(pa.array([None] * n + [0, len(keys)], pa.int32()), pairs)
                arrays = [pa.array(x, pa.int64()) for x in (n_a, n_b, s.per_document(s.shared), s.per_document(s.pieces))]
                arrays += [pa.array(s.group_text(), pa.string()), lists(at, sizes, pa.int32()), lists(times, sizes, pa.int32())]
                names = ["stretch", "id", *STATS, "groups_sha256", "at", "times", "pairs"]
                yield pa.RecordBatch.from_arrays([pa.array([number] * (n + 1), pa.int64()), *map(last, (part.column(0), *arrays)), pairs], names=names)
                number += 1

    stats = ", ".join(f"{c} long" for c in STATS)
    schema = f"stretch long, id {kind}, {stats}, groups_sha256 string, at array<int>, times array<int>, pairs array<struct<key: long, n: long>>"
    return rows.mapInArrow(run, schema)


def stretch_pairs(made: DataFrame) -> DataFrame:
    """stretch, at, key, n: the distinct pairs of each stretch."""
    return made.filter("pairs is not null").select("stretch", F.posexplode("pairs").alias("at", "p")).select("stretch", "at", "p.key", "p.n")


def pair_counts(pairs: DataFrame, b_size: int) -> DataFrame:
    """key, links, best: corpus-wide links of every pair of ids, and whether no A id has more with its B id."""
    total = pairs.groupBy("key").agg(F.sum("n").alias("links"))
    highest = F.max("links").over(Window.partitionBy(F.col("key") % b_size))
    return total.select("key", "links", (F.col("links") == highest).alias("best"))


def align(docs: DataFrame, a_file: str, b_file: str, a_ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: tokens, groups and links, how its links stand in the corpus, and the digest of its groups."""
    kind = docs.schema[id_col].dataType.simpleString()
    made = stored(stretch_rows(docs, a_file, b_file, a_ranks, id_col, text_col), "alignment", codec="zstd")
    pairs = stretch_pairs(made)
    b_size = sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size()
    answers = pairs.select(F.col("stretch").alias("of"), "at", "key").join(apart(pair_counts(pairs, b_size)), "key").select("of", "at", "links", "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.column("at").to_numpy()
        links, best = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        links[at], best[at] = right.column("links").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        sums = ([], [])
        for own, times in zip(left.column("at").chunks, left.column("times").chunks, strict=True):
            number, n = own.flatten().to_numpy(), times.flatten().to_numpy()
            doc = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())
            for out, values in zip(sums, (best, links), strict=True):
                whole = np.concatenate([[0], (values[number] * n.astype(np.int64)).cumsum()])
                edges = np.concatenate([[0], np.bincount(doc, minlength=len(own)).cumsum()])
                out.append(np.diff(whole[edges]))
        n_best, count_sum = (pa.array(np.concatenate(x) if x else [], pa.int64()) for x in sums)
        return pa.table([left.column("id"), *(left.column(c) for c in STATS), n_best, count_sum, left.column("groups_sha256")], names=["id", *STATS, "n_best", "count_sum", "groups_sha256"])

    rows = made.filter("pairs is null").drop("pairs")
    schema = f"id {kind}, {', '.join(f'{c} long' for c in STATS)}, n_best long, count_sum long, groups_sha256 string"
    out = rows.groupBy("stretch").cogroup(answers.groupBy("of")).applyInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
