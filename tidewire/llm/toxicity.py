"""Toxicity: a lexicon trie intersected with Levenshtein automata, and context-window scores.

The lexicon (words and stems with their weights) is learned from a bounded sample of labelled
documents; so are the boosted trees that turn a document's hits into a probability. A word is run
through the product of trie and automaton: a state is the set of (trie node, edits so far), made
when first reached and kept, so that misspelled terms cost one table lookup per character. A hit
is weighed by the window around it: quotation marks and reporting words speak for quotation,
second-person words for abuse.

Defined results: a null text is empty; empty texts get a score too; very long texts and tokens are read
whole; of matches with equal edits the first entry counts; repeated rows give repeated results; a row
without an id counts as held out; an empty table gives no rows. score_documents reads its two columns
only; keep_clean returns every column, whatever their names.
Without labels of both classes the lexicon is empty and the score is the share of label 1.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import Memo, files_for, kept_for, map_batches, serving, stored
from tidewire.llm.quality_rules import Forest, labelled_sample, train_forest

#: Fixed values. Characters stripped from a word's ends, look-alikes of letters, quotation marks,
#: words of reporting and of address in English, French, German and Spanish.
EDGES = " \t\n\r\x0b\x0c.,;:!?…\"'`´“”„«»‹›‘’()[]{}<>|#$%&*_-–—/\\=+~^"
LOOKALIKE = str.maketrans("013457@$", "oieastas")
QUOTE_OPEN, QUOTE_CLOSE = "\"“„«‹‘", "\"”“»›’"
REPORTING = frozenset("said says say called calls quote quoted quotes wrote writes word words term dit appelé mot sagte nannte wort dijo llamó palabra".split())
ADDRESS = frozenset("you your you're u ur yourself tu toi vous du dich ihr sie usted tú eres".split())
#: Words on each side of a hit that its context score looks at.
WINDOW = 10
QUOTED, ADDRESSED = 0.3, 1.5
STEM_SIZES = (4, 5, 6, 7)


@dataclass
class Entry:
    """A lexicon entry: a whole word or, as a stem, every word that starts with it."""

    term: str
    stem: bool
    weight: float
    toxic_rate: float
    clean_rate: float
    edits: int


@dataclass
class Lexicon:
    """The trie of the entries and the states of its product with the Levenshtein automata."""

    entries: list[Entry]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[list[int]] = field(default_factory=lambda: [[]])

    def __post_init__(self) -> None:
        self.most = []  # edits that some entry below a node still allows
        for i, e in enumerate(self.entries):
            at = 0
            for c in e.term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                at = self.children[at][c]
            self.ends[at].append(i)
        self.most = [0] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):  # children come after their parents
            own = [self.entries[i].edits for i in self.ends[node]]
            self.most[node] = max([*own, *(self.most[k] for k in self.children[node].values())], default=0)
        self.start()

    def start(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[int, int] | None] = []
        self.stems: list[int | None] = []
        self.state(frozenset())  # 0: no entry can match any more
        self.first = self.state(self.closed({0: 0}))

    def __getstate__(self) -> dict:
        return {"entries": self.entries}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["entries"])

    def closed(self, least: dict[int, int]) -> frozenset:
        """With the nodes reached by leaving out lexicon characters; the fewest edits of each node."""
        todo = list(least.items())
        while todo:
            node, edits = todo.pop()
            if least.get(node, 99) < edits:
                continue
            for child in self.children[node].values():
                if edits + 1 <= self.most[child] and least.get(child, 99) > edits + 1:
                    least[child] = edits + 1
                    todo.append((child, edits + 1))
        return frozenset(least.items())

    def state(self, pairs: frozenset) -> int:
        if pairs not in self.states:
            self.states[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.moves.append({})
            best = [
                (edits, i)
                for node, edits in pairs
                for i in self.ends[node]
                if edits <= self.entries[i].edits
            ]
            self.found.append(min(best) if best else None)
            stems = [i for node, edits in pairs if edits == 0 for i in self.ends[node] if self.entries[i].stem]
            self.stems.append(min(stems) if stems else None)
        return self.states[pairs]

    def move(self, state: int, c: str) -> int:
        least: dict[int, int] = {}
        for node, edits in self.sets[state]:
            for key, child in self.children[node].items():
                cost = edits + (key != c)
                if cost <= (self.most[child] if cost else 99) and least.get(child, 99) > cost:
                    least[child] = cost
            if edits + 1 <= self.most[node] and least.get(node, 99) > edits + 1:  # c is too much
                least[node] = edits + 1
        out = self.moves[state][c] = self.state(self.closed(least))
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, entry) of the best match of a word: fewest edits, then first entry; stems match exactly."""
        if len(self.sets) > 50_000:
            self.start()
        at, stem = self.first, None
        moves, stems = self.moves, self.stems
        for c in word:
            to = moves[at].get(c)
            if to is None:
                to = self.move(at, c)
            if not to:
                return None if stem is None else (0, stem)
            at = to
            if stems[at] is not None:
                stem = stems[at]
        best = self.found[at]
        if stem is not None and (best is None or best[0] > 0):
            return 0, stem
        return best


def bare(token: str) -> str:
    return token.strip(EDGES)


def runs_of(word: str) -> list[str]:
    """The words that punctuation joins to one token; none if nothing parts it. Look-alikes and accents count as letters."""
    if word.isalnum():
        return []
    runs = "".join(c if c.isalnum() or c in "@$" or unicodedata.category(c)[0] == "M" else " " for c in word).split()
    return [r for r in map(bare, runs) if len(r) >= 3] if len(runs) > 1 else []


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def count_terms(texts: list[str | None], labels: list[int]) -> Counter:
    """Of words and stems: documents and occurrences by class. Keys (term, is stem), values by place."""
    out: dict[tuple[str, bool], list[int]] = {}
    for text, y in zip(texts, labels, strict=True):
        own: Counter = Counter()
        for token, n in Counter(words_of(text)).items():
            whole = bare(token)
            for w in (whole, *runs_of(whole)):
                if len(w) >= 3:
                    own[w, False] += n
                    for k in STEM_SIZES:
                        if len(w) > k:
                            own[w[:k], True] += n
        side = 0 if y else 1
        for key, n in own.items():
            c = out.setdefault(key, [0, 0, 0, 0])
            c[side] += 1
            c[2 + side] += n
    return out


def evidence(a: int, b: int, n1: int, n0: int) -> float:
    """G statistic of a term's presence in a of n1 toxic and b of n0 clean documents; 0 if it speaks for clean."""
    if not n1 or not n0 or a / n1 <= b / n0:
        return 0.0
    out, total = 0.0, n1 + n0
    for seen, row, n in ((a, a + b, n1), (b, a + b, n0), (n1 - a, total - a - b, n1), (n0 - b, total - a - b, n0)):
        if seen:
            out += 2 * seen * np.log(seen * total / (row * n))
    return float(out)


#: Terms that a lexicon has at most, beside whole words under its stems. A parameter of training: the terms with
#: less evidence than so many others are mostly words that copies of a few toxic texts have by chance.
TERMS = 120


def learn_lexicon(counts: list, n1: int, n0: int, w1: int, w0: int, most: int = TERMS, least: float = 20.0) -> Lexicon:
    """Entries with enough evidence (a G statistic of `least`), best first: at most `most` terms that neither extend nor begin another.

    Stems that do are left out, as they count the same words again. Whole words that do are entries
    too, with their own edits; those under a taken stem need no more than to be commoner in toxic
    texts. A stem's weight speaks for all its words, its rates only for those without an entry.

    counts has (term, stem, toxic documents, clean documents, toxic occurrences, clean occurrences).
    """
    scored = []
    for term, stem, a, b, ta, tb in counts:
        g = evidence(a, b, n1, n0)
        if g > 0 and a >= 4:
            scored.append((-g, len(term) * -1, stem, term, ta, tb))
    scored.sort()
    roots: dict[str, bool] = {}
    for g, _, stem, term, _, _ in scored:
        if -g >= least and len(roots) < most and not any(term.startswith(t) or t.startswith(term) for t in roots):
            roots[term] = bool(stem)
    entries, stems = [], {}
    for g, _, stem, term, ta, tb in scored:
        if roots.get(term) != bool(stem):
            above = not stem and any(term.startswith(t) and (roots[t] or -g >= least) for t in roots)
            if not above and (stem or -g < least or not any(t.startswith(term) for t in roots)):
                continue
        r1, r0 = (ta + 0.5) / (w1 + 1), (tb + 0.5) / (w0 + 1)
        edits = 0 if stem or len(term) < 5 else 1 if len(term) < 9 else 2
        entries.append(Entry(term, bool(stem), float(np.clip(np.log(r1 / r0), 0.1, 8)), r1, r0, edits))
        if stem:
            stems[term] = entries[-1]
    for _, _, stem, term, ta, tb in scored:
        if not stem and any(e.term == term and not e.stem for e in entries):
            for t, e in stems.items():
                if term != t and term.startswith(t):
                    e.toxic_rate -= ta / (w1 + 1)
                    e.clean_rate -= tb / (w0 + 1)
    return Lexicon(entries)


#: Candidates that come to the driver at a time.
PAGE = 2000


def evidence_column(n1: int, n0: int) -> Column:
    """evidence() of the columns a and b."""
    total, a, b = n1 + n0, F.col("a"), F.col("b")
    parts = ((a, a + b, n1), (b, a + b, n0), (n1 - a, total - a - b, n1), (n0 - b, total - a - b, n0))
    part = lambda seen, row, n: F.when(seen > 0, 2 * seen * F.log(seen * total / (row * n))).otherwise(0.0)
    g = sum((part(*p) for p in parts[1:]), part(*parts[0]))
    return F.when(a / max(n1, 1) <= b / max(n0, 1), 0.0).otherwise(g) if n1 and n0 else F.lit(0.0)


def rows_of_lexicon(counted: DataFrame, n1: int, n0: int, most: int, least: float = 20.0) -> list[tuple]:
    """The counts of the terms that learn_lexicon takes of all terms, and of those that extend or begin one of them.

    Candidates are read best first, a page at a time, without what extends or begins a term that is taken
    already, until there are enough or none is left.
    """
    scored = counted.filter("term <> '' and a >= 4").withColumn("g", evidence_column(n1, n0)).filter("g > 0")
    near = lambda roots: F.exists(F.array(*map(F.lit, roots)), lambda r: F.col("term").startswith(r) | r.startswith(F.col("term"))) if roots else F.lit(False)
    roots: list[str] = []
    order = [F.col("g").desc(), F.length("term").desc(), F.col("stem"), F.col("term")]
    while len(roots) < most:
        page = [r["term"] for r in scored.filter((F.col("g") >= least) & ~near(roots)).orderBy(*order).limit(PAGE).select("term").collect()]
        for term in page:
            if len(roots) < most and not any(term.startswith(t) or t.startswith(term) for t in roots):
                roots.append(term)
        if len(page) < PAGE:
            break
    return [tuple(r) for r in scored.filter(near(roots)).select("term", "stem", "a", "b", "ta", "tb").collect()]


FEATURES = {
    "log_words": 0,
    "rate_evidence": 1,  # Poisson log-likelihood ratio of all exact hits
    "exact_weight": 1,
    "window_best": 1,  # the best context-window score
    "hits_per_100": 1,
    "distinct": 1,
    "fuzzy_weight": 1,
    "quoted_share": 0,
}


class Scorer:
    """Hits and features of texts; one per worker and model."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.lookup = Memo(self.look, 300_000)
        self.drift = sum(e.toxic_rate - e.clean_rate for e in lexicon.entries)

    def look(self, token: str) -> tuple[int, ...]:
        """1 + 4 * entry + edits of every hit: of the words inside a token, else of the token as a whole."""
        word = bare(token)
        inside = tuple(c for r in runs_of(word) if (c := self.code(r)))
        return inside or ((c,) if (c := self.code(word)) else ())

    def code(self, word: str) -> int:
        """0 for no hit, else 1 + 4 * entry + edits."""
        if len(word) < 3:
            return 0
        hit = self.lexicon.match(word)
        if hit is None or hit[0]:
            plain = word.translate(LOOKALIKE)
            if plain != word:
                other = self.lexicon.match(plain)
                if other and (hit is None or other[0] + 1 < hit[0]):
                    hit = (max(1, other[0]), other[1])
        return 0 if hit is None else 1 + 4 * hit[1] + hit[0]

    def context(self, tokens: list[str], at: int) -> float:
        """Weight of a hit by its window: quoted or reported, or addressed to someone."""
        low, high = max(0, at - WINDOW), min(len(tokens), at + WINDOW + 1)
        near = tokens[low:high]
        own = at - low
        opened = next((i for i in range(own, -1, -1) if near[i][0] in QUOTE_OPEN or (i < own and near[i][-1] in QUOTE_CLOSE)), None)
        inside = opened is not None and near[opened][0] in QUOTE_OPEN and any(t[-1:] in QUOTE_CLOSE or t.rstrip(".,;:!?")[-1:] in QUOTE_CLOSE for t in near[own:])
        plain = {bare(t) for t in near}
        if inside:
            return QUOTED * (0.5 if plain & REPORTING else 1)
        return ADDRESSED if plain & ADDRESS else 1.0

    def features(self, text: str | None) -> list[float]:
        tokens = words_of(text)
        n = len(tokens)
        codes = list(map(self.lookup.__getitem__, tokens))
        hits = [(i, c) for i, found in enumerate(codes) if found for c in found] if any(codes) else []
        exact = fuzzy = 0.0
        total = quoted = best = 0.0
        seen = set()
        placed = []
        for i, code in hits:
            entry, edits = divmod(code - 1, 4)
            e = self.lexicon.entries[entry]
            around = self.context(tokens, i)
            if edits:
                fuzzy += e.weight / (1 + edits) * around
            else:
                exact += e.weight
                seen.add(entry)
            weight = e.weight / (1 + 2 * edits)
            total += weight
            quoted += weight if around < 1 else 0.0
            placed.append((i, weight * around))
        low, inside = 0, 0.0
        for i, w in placed:
            inside += w
            while placed[low][0] < i - 2 * WINDOW:
                inside -= placed[low][1]
                low += 1
            best = max(best, inside)
        return [
            float(np.log1p(n)),
            float(exact - n * self.drift),
            exact,
            best,
            100.0 * len(placed) / max(n, 20),
            float(len(seen)),
            fuzzy,
            quoted / total if total else 0.0,
        ]


_SCORERS: dict[str, Scorer] = {}
kept_for("toxicity", _SCORERS.clear)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    forest: Forest

    def scorer(self) -> Scorer:
        """The worker's scorer for this lexicon; its words and states stay known from task to task."""
        serving("toxicity")
        key = repr(self.lexicon.entries)
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(self.lexicon)
        return _SCORERS[key]

    def score(self, texts: list[str | None]) -> np.ndarray:
        s = self.scorer()
        return self.forest.probability(np.array([s.features(t) for t in texts], float).reshape(-1, len(FEATURES)))


def held_out(id_col: str) -> Column:
    """Rows whose label is never learned from; rows without an id are among them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 8000, id_col: str = "doc_id", text_col: str = "text", terms: int = TERMS
) -> ToxicityModel:
    """Lexicon (of `terms` terms at most) and forest from at most `most` labelled ids (half of each class at most), none held out.

    The forest's rows are weighted by the share of their class that was taken, so that a score means
    the same whether or not the sample was cut.
    Terms are counted where the texts are and summed by a grouped aggregation; the driver gets the terms of the
    lexicon with their words, however many were candidates, then the features of the sample.
    """
    usable = ~held_out(id_col)
    halves = [labelled_sample(docs, labels, label, most // 2, id_col, text_col, usable, y) for y in (1, 0)]
    sample = stored(halves[0].unionByName(halves[1]).repartition(files_for(most, 500)), "toxicity-sample")
    ids = labels.filter(usable & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = ids.agg(*(F.count(F.when(F.col("y") == y, 1)) for y in (0, 1))).first()
    weights = np.array([n / max(min(n, most // 2), 1) for n in known], float)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, ys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        counts = count_terms(texts, ys)
        rows = [(t, s, *c) for (t, s), c in counts.items()]
        size = [sum(len(words_of(t)) for t, y in zip(texts, ys, strict=True) if bool(y) == side) for side in (True, False)]
        rows.append(("", False, sum(map(bool, ys)), len(ys) - sum(map(bool, ys)), *size))
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), *(pa.array(c, pa.int64()) for c in cols[2:])]
        return pa.RecordBatch.from_arrays(arrays, names=["term", "stem", "a", "b", "ta", "tb"])

    counts = map_batches(sample, count, "term string, stem boolean, a long, b long, ta long, tb long").groupBy("term", "stem").agg(
        *(F.sum(c).alias(c) for c in ("a", "b", "ta", "tb"))
    )
    counted = stored(counts, "toxicity-terms")
    totals = counted.filter("term = ''").select("a", "b", "ta", "tb").first()
    if not totals:
        return ToxicityModel(Lexicon([]), train_forest(np.empty((0, len(FEATURES))), np.empty(0), list(FEATURES.values())))
    lexicon = learn_lexicon(rows_of_lexicon(counted, totals["a"], totals["b"], terms), *totals, most=terms)
    model = ToxicityModel(lexicon, None)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.scorer()
        x = [s.features(t) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    pairs = sorted((r["x"], r["y"]) for r in map_batches(sample, features, "x array<double>, y int").collect())
    x = np.array([p[0] for p in pairs], float).reshape(-1, len(FEATURES))
    y = np.array([bool(p[1]) for p in pairs], int)
    model.forest = train_forest(x, y.astype(float), list(FEATURES.values()), weight=weights[y])
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = model.score(batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
            names=["id", "held_out", "score", "predicted"],
        )

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("body"))
    out = map_batches(rows, run, f"id {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The rows with a score under `most`, all columns as they were. No shuffle."""
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.score(batch.column(at).to_pylist()) < most))

    return map_batches(docs, run, schema)
