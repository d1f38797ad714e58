"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

Trees are trained here on a bounded sample of labelled documents (histogram splits, logistic
loss) with monotonic constraints on chosen features: a child's values are kept on the right side
of its sibling's by splitting their range at the middle. A forest is flattened into numpy node
arrays; scoring moves all rows of a batch one level down at a time.

Defined results: a null or blank text has no words and fails the base rules; very long texts are read
whole; a score of exactly 0.5 is kept; repeated rows give repeated results; a null id is passed on; an
empty table gives no rows. Only the two named columns are read, whatever others there are. With no
usable labels (none, or of one class) the model keeps all that passes the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import map_batches, rolling, small_batches, word_hashes

#: Fixed base rules: least words, and most per cent of words in repeated three-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(c for c in range(256) if c not in SYMBOLS)
_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACES = b" \t\n\r\x0b\x0c"
_UPPER = bytes(range(65, 91))
_NOT_UPPER = bytes(c for c in range(256) if c not in _UPPER)
_DIGIT = b"0123456789"
_NOT_DIGIT = bytes(c for c in range(256) if c not in _DIGIT)

#: Features and their constraints: -1, the score may only fall as the feature grows; 0, free.
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbol_rate": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_rate": 0,
    "digit_rate": 0,
    "distinct_share": 0,
    "mean_line_words": 0,
    "top_word_share": 0,
    "non_ascii_rate": 0,
    "stop_end_rate": 0,
}


def repeated_words(hashes: np.ndarray, k: int = WINDOW) -> int:
    """Words in k-word windows that are found twice or more, the first finding included."""
    r = rolling(hashes, k)
    if len(r) < 2:
        return 0
    order = np.argsort(r, kind="stable")
    s = r[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(r), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes) + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + k, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """((n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), features)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    solid = raw.translate(None, _SPACES)
    chars = len(solid.translate(None, _CONTINUATION))
    symbols = len(raw.translate(None, _NOT_SYMBOL))
    lines, dup, filled = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip(_SPACES):
            filled += 1
            if line in lines:
                dup += 1
            else:
                lines.add(line)
    if not n:
        return (0, 0, symbols, dup, 0), [0.0] * len(FEATURES)
    hashes = word_hashes(words)
    repeat = repeated_words(hashes)
    counts = np.unique(hashes, return_counts=True)[1]
    size = max(len(solid), 1)
    features = [
        float(np.log1p(n)),
        chars / n,
        symbols / size,
        dup / max(filled, 1),
        repeat / n,
        len(solid.translate(None, _NOT_UPPER)) / size,
        len(solid.translate(None, _NOT_DIGIT)) / size,
        len(counts) / n,
        n / max(filled, 1),
        int(counts.max()) / n,
        (len(solid) - chars) / size,
        (raw.count(b".") + raw.count(b"!") + raw.count(b"?")) / n,
    ]
    return (n, chars, symbols, dup, repeat), features


def fails_base(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


@dataclass
class Forest:
    """Node arrays of all trees, one after another. feature -1 marks a leaf; left and right are absolute."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(x) or not len(self.roots):
            return out
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            go = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(f < 0, at, go)
        return out + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def train_forest(
    x: np.ndarray,
    y: np.ndarray,
    monotone: list[int],
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.15,
    bins: int = 32,
    ridge: float = 1.0,
    min_rows: int = 10,
    weight: np.ndarray | None = None,
) -> Forest:
    """Newton boosting with histogram splits; y is 0 or 1; monotone has -1, 0 or 1 for each feature; rows may have weights."""
    n, m = x.shape if x.ndim == 2 else (0, len(monotone))
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    weight = np.ones(n) if weight is None else weight
    share = np.average(y, weights=weight) if n else 1.0
    base = float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1 - 1e-3)))
    if n and 0 < share < 1:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)
        score = np.full(n, base)

        def leaf(g: float, h: float, low: float, high: float) -> float:
            return float(np.clip(-g / (h + ridge), low, high))

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
            at = len(nodes)
            sum_g, sum_h = g[rows].sum(), h[rows].sum()
            own = leaf(sum_g, sum_h, low, high)
            nodes.append([-1, 0.0, at, at, own * rate])
            if level == depth or len(rows) < 2 * min_rows:
                score[rows] += own * rate
                return at
            gain = lambda a, b, v: -(a * v + 0.5 * (b + ridge) * v * v)
            best = (1e-9, -1, -1, 0.0, 0.0)
            for j in range(m):
                if not len(edges[j]):
                    continue
                k = len(edges[j]) + 1
                hg = np.bincount(binned[rows, j], g[rows], k).cumsum()[:-1]
                hh = np.bincount(binned[rows, j], h[rows], k).cumsum()[:-1]
                hn = np.bincount(binned[rows, j], minlength=k).cumsum()[:-1]
                vl = np.clip(-hg / (hh + ridge), low, high)
                vr = np.clip(-(sum_g - hg) / (sum_h - hh + ridge), low, high)
                ok = (hn >= min_rows) & (len(rows) - hn >= min_rows)
                if monotone[j]:
                    ok &= (vr - vl) * monotone[j] >= 0
                total = np.where(ok, gain(hg, hh, vl) + gain(sum_g - hg, sum_h - hh, vr) - gain(sum_g, sum_h, own), -1)
                c = int(total.argmax())
                if total[c] > best[0]:
                    best = (float(total[c]), j, c, float(vl[c]), float(vr[c]))
            if best[1] < 0:
                score[rows] += own * rate
                return at
            _, j, c, vl_, vr_ = best
            middle = (vl_ + vr_) / 2
            lows, highs = (low, low), (high, high)
            if monotone[j] > 0:
                lows, highs = (low, middle), (middle, high)
            elif monotone[j] < 0:
                lows, highs = (middle, low), (high, middle)
            goes = binned[rows, j] <= c
            left = grow(rows[goes], g, h, level + 1, lows[0], highs[0])
            right = grow(rows[~goes], g, h, level + 1, lows[1], highs[1])
            nodes[at] = [j, float(edges[j][c]), left, right, 0.0]
            return at

        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            roots.append(grow(np.arange(n), weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6), 0, -4.0, 4.0))
    cols = list(zip(*nodes, strict=True)) if nodes else [(), (), (), (), ()]
    return Forest(
        np.array(cols[0], np.int32), np.array(cols[1], float), np.array(cols[2], np.int32), np.array(cols[3], np.int32),
        np.array(cols[4], float), np.array(roots, np.int32), depth, base,
    )


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text", where=None, only: int | None = None
) -> DataFrame:
    """At most so many rows (body, y), one for each labelled id, picked by a hash of the id: a bounded, stable sample.

    The ids are picked from the labels alone; what is broadcast is at most that many ids. An id with both labels
    has label 1. Of rows with one id the text with the smallest hash is taken: the hash is found by an aggregation of
    numbers, and a task passes on the text of an id once, so that an id of many rows is never gathered.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    one = (known if where is None else known.filter(where)).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    ids = F.broadcast((one if only is None else one.filter(F.col("y") == only)).orderBy(F.xxhash64("__id"), "__id").limit(most))
    bodies = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("body")).withColumn("__hash", F.xxhash64("body"))
    chosen = F.broadcast(bodies.join(ids, "__id").groupBy("__id", "y").agg(F.min("__hash").alias("__hash")))
    rows = bodies.join(chosen, ["__id", "__hash"]).select("__id", "y", "body")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            new = [not (i in seen or seen.add(i)) for i in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(new, pa.bool_()))

    small_batches(docs.sparkSession)
    kind = rows.schema["__id"].dataType.simpleString()
    found = rows.mapInArrow(once, f"__id {kind}, y int, body string").groupBy("__id", "y").agg(F.min("body").alias("body"))
    return found.select("body", "y")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 4000) -> Forest:
    """A forest for the probability of label 1, from a sample of at most `most` labelled ids.

    Statistics are made where the texts are; only numbers come to the driver, sorted so that
    the forest does not depend on the order of partitions.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [statistics(t)[1] for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = sorted((r["x"], r["y"]) for r in map_batches(labelled_sample(docs, labels, label, most), run, "x array<double>, y int").collect())
    x = np.array([r[0] for r in rows], float).reshape(-1, len(FEATURES))
    return train_forest(x, np.array([r[1] for r in rows], float), list(FEATURES.values()))


def rate(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per document: statistics, base verdict, score, kept. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [statistics(t) for t in batch.column(1).to_pylist()]
        stats = np.array([f[0] for f in found], np.int64).reshape(-1, 5)
        score = forest.probability(np.array([f[1] for f in found], float).reshape(-1, len(FEATURES)))
        failed = (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MAX_REPEAT_PERCENT * stats[:, 0])
        arrays = [batch.column(0), *(pa.array(stats[:, i]) for i in range(5)), pa.array(failed), pa.array(~failed & (score >= least)), pa.array(score)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    out = map_batches(
        docs.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as body"),
        run,
        f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double",
    )
    return out.withColumnRenamed("id", id_col)
