"""Language identification of web pages by Bayesian evidence fusion.

The posterior of a page's language joins four pieces of evidence:

* the likelihood of its visible text under byte-trigram models, learned from labelled documents;
* the language its markup declares, by how often pages of a language declare it;
* the suffix of its address, in the same way;
* a prior of its host, smoothed towards its domain, that towards its suffix, that towards all pages.

Declarations, suffixes and priors are sums of the text posteriors over all pages, made by grouped
aggregations; a page's own share is taken out before its prior is looked up, so that it is not
counted twice. Hosts, domains and suffixes are joined as keys, nothing about them is collected.

Defined results: a null html is empty; a page without visible text is decided by the other evidence;
very long pages are read whole, in time in proportion to their length; a null or broken address has
the empty host, domain and suffix; of languages with equal scores the first by name wins; repeated
rows give repeated results; a null id is passed on; an empty table gives no rows. Only the three
named columns are read, whatever others there are. Without labelled documents the language is null.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import apart, map_batches, stored

#: Slots of the trigram tables; weight of a trigram (neighbours overlap); smoothing constants.
SLOTS = 1 << 15
TRIGRAM_WEIGHT = 1 / 3
ALPHA, PRIOR_STRENGTH = 0.5, 5.0
#: Elements whose content is not shown, their ends, tags of a page's root, and the language they declare.
HIDDEN = re.compile(r"(?i)<(script|style|noscript|template)\b")
ENDS = {n: re.compile(rf"(?i)</{n}\s*+>") for n in ("script", "style", "noscript", "template")}
ROOT = re.compile(r"(?i)<html\b[^>]*+")
DECLARED = re.compile(r"(?i)\blang\s*+=\s*+[\"']?\s*+([a-z]{2,3})\b")
#: Numeric references beyond all characters.
ENDLESS = re.compile(r"(?i)&#(?:x[0-9a-f]{8,}|[0-9]{8,});?")


def shown(html: str) -> str:
    """A page without tags, comments and hidden elements, a space for each: one pass forward.

    What has no end is read as a tag alone; that there is no end is looked up once for each kind.
    """
    out, at, endless = [], 0, set()
    while (start := html.find("<", at)) >= 0:
        out.append(html[at:start])
        end = -1
        if html.startswith("<!--", start):
            if "!" not in endless:
                end = html.find("-->", start + 4) + 3
                if end < 3:
                    endless.add("!")
                    end = -1
        elif (m := HIDDEN.match(html, start)) and (name := m[1].lower()) not in endless:
            if closer := ENDS[name].search(html, m.end()):
                end = closer.end()
            else:
                endless.add(name)
        if end < 0 and (end := html.find(">", start) + 1) == 0:
            at = start
            break
        out.append(" ")
        at = end
    return "".join([*out, html[at:]])


def visible(html: str | None) -> str:
    """Text outside tags, comments, scripts and styles, with entities read."""
    return entities.unescape(ENDLESS.sub("\ufffd", shown(html or "")))


def declared(html: str | None) -> str:
    for root in ROOT.finditer(html or ""):
        if m := DECLARED.search(root[0]):
            return m[1].lower()
    return ""


def trigrams(text: str) -> np.ndarray:
    """Slots of the byte trigrams of the lower-cased words, single spaces between them."""
    b = np.frombuffer(" ".join(re.findall(r"[^\W\d_]+", f" {text.lower()} ")).encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    x = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (x >> np.uint32(17)).astype(np.int64)


@dataclass
class TextModel:
    """Log-probabilities of trigram slots by language."""

    languages: list[str]
    log_p: np.ndarray

    def likelihood(self, text: str) -> np.ndarray:
        return TRIGRAM_WEIGHT * self.log_p[:, trigrams(text)].sum(axis=1)

    def posterior(self, text: str) -> np.ndarray:
        x = self.likelihood(text)
        x = np.exp(x - x.max()) if len(x) else x
        return x / x.sum() if len(x) else x


#: Languages that a model has at most: each is a table of SLOTS numbers in every task.
MOST_LANGUAGES = 512


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = 500, most_languages: int = MOST_LANGUAGES) -> TextModel:
    """Trigram models of all labelled languages, from a sample of about `per_language` documents each.

    Documents are drawn by a hash of their id, those without one by a hash of their text. Counts are summed
    by language and slot; the driver gets one packed array a language. More than `most_languages`
    distinct labels are an error: such a column does not name languages.
    """
    spark = docs.sparkSession
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    )
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"{lang_col} has more than {most_languages} labels")
    languages = sorted(sizes)
    if not languages:
        return TextModel([], np.empty((0, SLOTS)))
    shares = spark.createDataFrame([(name, i, min(1.0, per_language / sizes[name])) for i, name in enumerate(languages)], "lang string, who int, share double")
    draw = F.pmod(F.when(F.col("id").isNull(), F.xxhash64("text", F.lit(7))).otherwise(F.xxhash64("id", F.lit(7))), F.lit(1 << 20))
    picked = known.join(F.broadcast(shares), "lang").filter(draw < F.col("share") * (1 << 20)).select("who", "text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[int, np.ndarray] = {}
        for who, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = np.bincount(trigrams(text), minlength=SLOTS)
            found[who] = found[who] + own if who in found else own
        slots = {who: np.flatnonzero(n) for who, n in found.items()}
        who = np.repeat(np.array(list(slots), np.int32), [len(x) for x in slots.values()])
        slot = np.concatenate([*slots.values(), np.empty(0, np.int64)]).astype(np.int32)
        n = np.concatenate([*(found[w][x] for w, x in slots.items()), np.empty(0, np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(who, pa.int32()), pa.array(slot), pa.array(n, pa.int64())], names=["who", "slot", "n"])

    def packed(table: pa.Table) -> pa.Table:
        counts = np.zeros(SLOTS, np.int64)
        counts[table.column("slot").to_numpy()] = table.column("n").to_numpy()
        return pa.table({"who": table.column("who").slice(0, 1), "counts": pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())})

    sums = map_batches(picked, count, "who int, slot int, n long").groupBy("who", "slot").agg(F.sum("n").alias("n"))
    counts = np.full((len(languages), SLOTS), ALPHA)
    for r in sums.groupBy("who").applyInArrow(packed, "who int, counts binary").collect():
        counts[r["who"]] += np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return TextModel(languages, np.log(counts / counts.sum(axis=1, keepdims=True)))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def last_labels(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)


def identify(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, lang, score, text_lang, declared, host."""
    kind = pages.schema[id_col].dataType.simpleString()
    langs, k = model.languages, len(model.languages)
    host = host_of(F.col(url_col))
    rows = pages.select(
        F.col(id_col).alias("id"), host.alias("host"), last_labels(host, 2).alias("domain"), last_labels(host, 1).alias("suffix"), F.col(html_col).cast("string").alias("body")
    )
    if not k:
        return rows.select(
            F.col("id").alias(id_col), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("score"),
            F.lit(None).cast("string").alias("text_lang"), F.lit("").alias("declared"), "host",
        )

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = batch.column(4).to_pylist()
        ll = np.array([model.likelihood(visible(b)) for b in bodies]).reshape(-1, k)
        ll -= ll.max(axis=1, keepdims=True)
        p = np.exp(ll)
        p /= p.sum(axis=1, keepdims=True)
        lists = [pa.array(list(a), pa.list_(pa.float64())) for a in (ll, p)]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array([declared(b) for b in bodies], pa.string()), *lists],
            names=["id", "host", "domain", "suffix", "declared", "ll", "p"],
        )

    seen = stored(
        map_batches(rows, read, f"id {kind}, host string, domain string, suffix string, declared string, ll array<double>, p array<double>"), "page-evidence"
    )

    def sums(by: str) -> DataFrame:
        return apart(seen.groupBy(by).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(k)]).alias(f"by_{by}"), (F.count(F.lit(1)) - 1).alias(f"others_{by}")))

    # Totals over all pages: k numbers, and how many distinct declarations and suffixes there are.
    first = seen.agg(
        *[F.sum(F.col("p")[i]).alias(f"n{i}") for i in range(k)],
        F.count_distinct("declared").alias("declarations"),
        F.count_distinct("suffix").alias("suffixes"),
    ).first()
    total = [first[f"n{i}"] or 0.0 for i in range(k)]
    pages_n = sum(total)
    joined = seen
    for by in ("declared", "suffix", "domain", "host"):
        joined = joined.join(sums(by), by)

    def score(i: Column) -> Column:
        own = F.get("p", i)
        of_language = F.get(F.array(*map(F.lit, total)), i) - own
        # The page itself is left out of every count.
        rest = lambda by: F.greatest(F.get(f"by_{by}", i) - own, F.lit(0.0))
        prior = (of_language + ALPHA) / (pages_n - 1 + ALPHA * k)
        for level in ("suffix", "domain", "host"):
            prior = (rest(level) + PRIOR_STRENGTH * prior) / (F.col(f"others_{level}") + PRIOR_STRENGTH)
        says = (rest("declared") + ALPHA) / (of_language + ALPHA * first["declarations"])
        lies = (rest("suffix") + ALPHA) / (of_language + ALPHA * first["suffixes"])
        # The suffix is part of the prior's chain already, so its likelihood counts by half.
        return F.get("ll", i) + F.log(prior) + F.log(says) + 0.5 * F.log(lies)

    scores = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), score)
    fused = joined.withColumn("s", scores).withColumn("top", F.array_max("s"))
    names = F.array(*map(F.lit, langs))
    return fused.select(
        F.col("id").alias(id_col),
        F.element_at(names, F.array_position("s", F.col("top")).cast("int")).alias("lang"),
        (1 / F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).alias("score"),
        F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("text_lang"),
        "declared",
        "host",
    )
