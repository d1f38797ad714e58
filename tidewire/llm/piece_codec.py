"""SentencePiece BPE encoding by backtracking over longest matches, and decoding.

The vocabulary is read from a sentencepiece model; the library's encoder is not used. A segment
is a run of word marks with the characters after it. If no piece has a mark after another
character (checked on load), segments are encoded apart and each distinct one once per worker;
otherwise the whole text is one segment.

Encoding a segment: Aho-Corasick over the reversed pieces gives the longest piece that starts at
each place. From the left, the longest piece is taken, then shorter ones, as long as it is
compatible with its left neighbour, i.e. merging their joined characters from scratch gives just
these two pieces. A place from which nothing fits is marked in a bitfield and never tried again.
Greedy merging has the property that a sequence in which all neighbours are compatible is the
merge result, so the first that reaches the end is it. Characters without a piece become the
byte pieces of their UTF-8 and part the segment.

Defined results: a null text is empty and gets the begin and end ids; very long texts are encoded whole;
repeated rows give repeated results; a null id is passed on; an empty table gives no rows. Only the two
named columns are read, whatever others there are.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tidewire.llm.common import Memo, kept_for, map_batches, serving

MARK = "▁"


class PieceCodec:
    """Encoder and decoder for one model file."""

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = {}
        plain = {}
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain[piece] = i
        self.score = {p: sp.get_score(i) for p, i in plain.items()}
        self.id_of = plain
        self.splits = not any(p.find(MARK, len(p) - len(p.lstrip(MARK))) >= 0 for p in plain)
        # Only pieces that merging makes from their own characters can ever be in a result.
        self.reach = {p: i for p, i in plain.items() if len(p) == 1 or self.merge(p) == [p]}
        self.longest = max(map(len, self.reach))
        shorter: dict[str, str | None] = {}
        for p in self.reach:
            shorter[p] = next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.reach), None)
        self.shorter = shorter
        self.machine = ahocorasick.Automaton()
        for p in self.reach:
            self.machine.add_word(p[::-1], p)
        self.machine.make_automaton()
        self.compatible = Memo(lambda pair: self.merge(pair[0] + pair[1]) == [*pair], 200_000)
        self.word = Memo(lambda word: self.encode_segment(MARK + word), 300_000)
        self.segment = Memo(self.encode_segment, 50_000)
        self.raw = [b""] * n
        for p, i in plain.items():
            self.raw[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte_ids.items():
            self.raw[i] = bytes([b])
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.byte_ids.values())] = True

    def merge(self, text: str) -> list[str]:
        """Plain merging: of all neighbours that join to a piece, the best score first, leftmost of equals."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def longest_at(self, text: str) -> list[str | None]:
        """The longest piece that starts at each place."""
        n = len(text)
        out: list[str | None] = [None] * n
        last = n - 1
        for end, piece in self.machine.iter(text[::-1]):  # of one end, the longest comes first
            if out[last - end] is None:
                out[last - end] = piece
        return out

    def backtrack(self, text: str, longest: list[str | None]) -> list[str]:
        """Pieces of a text all of whose characters are pieces."""
        if longest[0] == text:
            return [text]
        n, compatible, shorter = len(text), self.compatible, self.shorter
        failed = bytearray(n + 1)
        done: list[str] = []
        at, piece = 0, longest[0]
        left = None
        while True:
            while piece is not None:
                if not failed[at + len(piece)] and (left is None or compatible[left, piece]):
                    break
                piece = shorter[piece]
            if piece is not None:
                done.append(piece)
                at += len(piece)
                if at == n:
                    return done
                left, piece = piece, longest[at]
            else:  # nothing fits here after this neighbour: take it back and try a shorter one
                if not done:
                    raise ValueError("no compatible sequence")
                failed[at] = 1
                at -= len(left)
                piece = shorter[done.pop()]
                left = done[-1] if done else None

    def encode_segment(self, text: str) -> tuple[bytes, bytes]:
        """(ids as little-endian unsigned 32-bit integers, the bytes that these ids decode to)."""
        longest = self.longest_at(text)
        ids: list[int] = []
        start, n = 0, len(text)
        reach = self.reach
        if None not in longest:
            ids = [reach[p] for p in self.backtrack(text, longest)]
            return struct.pack(f"<{len(ids)}I", *ids), b"".join([self.raw[i] for i in ids])
        for i in range(n + 1):
            if i < n and longest[i] is not None:
                continue
            if start < i:
                run = text[start:i]
                own = longest if (start, i) == (0, n) else self.longest_at(run)
                ids += [reach[p] for p in self.backtrack(run, own)]
            if i < n:
                if self.byte_ids:
                    ids += [self.byte_ids[b] for b in text[i].encode("utf-8", "surrogatepass")]
                else:
                    ids.append(self.unk)
            start = i + 1
        return np.array(ids, "<u4").tobytes(), b"".join([self.raw[i] for i in ids])

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """(ids, decoded bytes with the leading mark's space) of a text."""
        if not text:
            return b"", b""
        if not self.splits:
            return self.encode_segment(MARK + text.replace(" ", MARK))
        parts = text.replace(MARK, " ").split(" ") if MARK in text else text.split(" ")
        if "" in parts:
            parts = re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))
            found = [self.segment[p] for p in parts]
        else:
            found = list(map(self.word.__getitem__, parts))
        return b"".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def ids(self, text: str) -> list[int]:
        """All ids, with begin and end."""
        return [self.bos, *np.frombuffer(self.encode(text)[0], "<u4").tolist(), self.eos]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, the first space dropped, byte pieces read as UTF-8."""
        return self.text_of(b"".join([self.raw[i] for i in ids]))

    @staticmethod
    def text_of(raw: bytes) -> str:
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@cache
def codec(model_file: str) -> PieceCodec:
    """One codec per worker and model."""
    return PieceCodec(model_file)


kept_for("pieces", codec.cache_clear)


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: number of ids, digests of the ids and of the decoded text. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        serving("pieces")
        c = codec(model_file)
        first, last = np.array([c.bos], "<u4").tobytes(), np.array([c.eos], "<u4").tobytes()
        n, ids_sha, text_sha = [], [], []
        for text in batch.column(1).to_pylist():
            ids, raw = c.encode(text or "")
            n.append(len(ids) // 4 + 2)
            ids_sha.append(hashlib.sha256(first + ids + last).hexdigest())
            text_sha.append(hashlib.sha256(c.text_of(raw).encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
            names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    out = map_batches(
        docs.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as body"),
        run,
        f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
    return out.withColumnRenamed("id", id_col)
