"""News about companies: patterns of names, and the join of items with them."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import text_or_empty
from tidewire.operators.feed import newest_first, visible
from tidewire.operators.stories import kept

#: Fixed value: items shown about one company.
NEWS = 6

#: How a company is named in the news. END is a case ending before a word's end; names that
#: are parts of other words say which letters must not stand before or after them.
END = "(?:а|у|е|ом|ы|ой|ов|ам|ами|ах)?(?![а-я])"
ALIASES = {
    "GAZP": r"газпром(?!\s*нефт)", "ROSN": "роснефт", "LKOH": "лукойл", "NVTK": "новатэк", "SNGS": "сургутнефтегаз",
    "SNGSP": "сургутнефтегаз", "TATN": "татнефт", "TATNP": "татнефт", "SIBN": r"газпром\s*нефт", "BANE": "башнефт", "BANEP": "башнефт",
    "RNFT": "русснефт", "TRNFP": "транснефт", "SBER": f"сбер(?:банк)?{END}", "SBERP": f"сбер(?:банк)?{END}",
    "VTBR": "(?<![а-я])втб(?![а-я])", "TCSG": "т-банк|тинькофф|т-технолог", "T": "т-банк|тинькофф|т-технолог",
    "MOEX": r"мосбирж|московск\p{L}+ бирж", "BSPB": r"банк\p{L}* санкт-петербург",
    "CBOM": r"(?<![а-я])мкб(?![а-я])|московск\p{L}+ кредитн", "SVCB": "совкомбанк", "RENI": "ренессанс страхован",
    "SFIN": "(?<![а-я])sfi(?![a-z])|эсэфай", "AFKS": "(?<![а-я])афк(?![а-я])|афк «система»|афк система",
    "GMKN": r"норникел|норильск\p{L}+ никел", "NLMK": "(?<![а-я])нлмк(?![а-я])|новолипецк", "CHMF": "северстал",
    "MAGN": r"(?<![а-я])ммк(?![а-я])|магнитогорск\p{L}+ метал", "PLZL": f"(?<![а-я])полюс{END}", "POLY": "polymetal|полиметалл",
    "RUAL": "русал", "ENPG": r"эн\+|en\+", "MTLR": "мечел", "MTLRP": "мечел",
    "TRMK": r"(?<![а-я])тмк(?![а-я])|трубн\p{L}+ металлург", "SELG": "селигдар", "VSMO": "всмпо", "ALRS": "алроса",
    "IRAO": "интер рао", "HYDR": "русгидро", "FEES": "россети", "UPRO": "юнипро", "OGKB": "огк-2", "MSNG": "мосэнерго",
    "TGKA": "тгк-1", "LSNGP": "ленэнерго", "YDEX": "яндекс", "YNDX": "яндекс", "VKCO": "(?<![a-z])vk(?![a-z])|вконтакте",
    "OZON": f"ozon|(?<![а-я])озон{END}", "HHRU": r"hh\.ru|headhunter|хедхантер",
    "POSI": "positive technologies|позитив текнолоджис|(?<![а-я])positive(?![a-z])",
    "ASTR": "группа астр|(?<![а-я])астр(?:а|ы|е|у|ой)(?![а-я])", "DIAS": "диасофт", "SOFL": "софтлайн|softline",
    "WUSH": f"whoosh|(?<![а-я])вуш{END}", "CIAN": f"(?<![а-я])циан{END}", "DATA": "аренадата|arenadata",
    "MGNT": f"(?<![а-я])магнит{END}", "FIVE": "x5|пятёрочк|пятерочк|перекрёст|перекрест", "X5": "x5|пятёрочк|пятерочк|перекрёст|перекрест",
    "LENT": "сеть «лента»|ритейлер лента|«лента»", "FIXP": "fix price", "BELU": "novabev|белуга", "ABRD": "абрау", "GCHE": "черкизово",
    "MVID": r"м\.видео", "OKEY": "о’кей|о'кей|okey", "AQUA": "инарктика", "MTSS": "(?<![а-я])мтс(?![а-я])", "RTKM": "ростелеком",
    "RTKMP": "ростелеком", "MGTSP": "(?<![а-я])мгтс(?![а-я])", "AFLT": "аэрофлот",
    "NMTP": r"(?<![а-я])нмтп(?![а-я])|новороссийск\p{L}+ морск", "FESH": r"fesco|дальневосточн\p{L}+ морск", "FLOT": "совкомфлот",
    "GLTR": "globaltrans|глобалтранс", "PHOR": "фосагро", "AKRN": f"(?<![а-я])акрон{END}", "KAZT": "куйбышевазот", "KAZTP": "куйбышевазот",
    "NKNC": "нижнекамскнефтехим", "NKNCP": "нижнекамскнефтехим", "PIKK": f"(?<![а-я])пик{END}", "LSRG": "(?<![а-я])лср(?![а-я])",
    "SMLT": f"(?<![а-я])самол[её]т{END}", "ETLN": f"(?<![а-я])эталон{END}",
}


#: Lengths of the index's n-grams: a literal stands under one of the largest length that it has. Each is the sum of two others.
SIZES = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32)
#: The filter that texts' grams pass before they are shuffled: bits of a page, pages at most (32 MB), bits for each gram, bits a gram sets.
PAGE_BITS, MOST_PAGES, GRAM_BITS, PROBES = 1 << 19, 512, 32, 3
#: What ends a literal in a pattern: classes, escapes of classes, dots, anchors.
_GROUP = re.compile(r"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\([^()]*\))*\))*\)")
_CLASS = re.compile(r"\[(?:[^\]\\]|\\.)*\]|\\p\{\w+\}|\\[A-Za-z]|(\\.)|[.^$]", re.S)
_PART = re.compile(r"\0[*+?]?(?:\{[^}]*\})?[?+]?|(\\.|[^\0\\])([*?]|\{[^}]*\})|(\\.|[^\0\\])\+|(\\.|[^\0\\])", re.S)


def literals(pattern: str) -> list[str]:
    """For each alternative of a pattern the longest text that its every match holds; groups and classes part texts."""
    plain = _CLASS.sub(lambda m: m[1] or "\0", _GROUP.sub("\0", pattern))
    out = []
    for branch in re.split(r"(?<!\\)\|", plain):
        runs = [""]
        for m in _PART.finditer(branch):
            kept = m[4] or m[3]
            runs[-1] += kept[-1] if kept else ""
            if not m[4]:
                runs.append("")
        out.append(max(runs, key=len))
    return out


def patterns(companies: DataFrame) -> DataFrame:
    """ticker, pattern, anchors: the alias, else the name without brackets and share class, escaped; none under 3 characters.

    Every match of the pattern holds one of the anchors.
    """
    known = [(ticker, alias, literals(alias)) for ticker, alias in ALIASES.items()]
    table = companies.sparkSession.createDataFrame(known, "ticker string, alias string, parts array<string>")
    bare = F.regexp_replace(text_or_empty("name"), r"\s*\(.*?\)\s*", " ")
    bare = F.trim(F.regexp_replace(bare, r"(?iu)[-\s]*(?:ао|ап|прив\.?|обыкн\.?)\s*$", ""))
    named = companies.select("ticker", F.when(F.length(bare) >= 3, bare).alias("bare")).join(F.broadcast(table), "ticker", "left")
    own = F.regexp_replace("bare", r"([.*+?^${}()|\[\]\\])", r"\\$1")
    found = named.select("ticker", F.coalesce("alias", own).alias("pattern"), F.coalesce("parts", F.array("bare")).alias("anchors"))
    return found.filter("pattern is not null")


def mentions(text: Column, pattern: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit("(?iu)"), pattern))


@cache
def folded() -> np.ndarray:
    """For each code point the one that stands for it where case does not count: its capital's small letter."""
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        up = c.upper()
        low = (up if len(up) == 1 else c).lower()
        table[i] = ord(low[0])
    return table


def codes(text: str) -> np.ndarray:
    return folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)


def grams(points: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """By size, numbers of all n-grams up to a size. Different grams can share a number; the whole pattern tells them apart."""
    out = {}
    for n in SIZES[: SIZES.index(most) + 1]:
        m = len(points) - n + 1
        if m <= 0:
            break
        half = 1 << max(n - 1, 1).bit_length() - 1
        both = out[half][:m] * np.uint64(0xD6E8FEB86659FD93) + out[n - half][half : half + m] if n > 1 else points
        mixed = (both + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        out[n] = mixed ^ mixed >> np.uint64(32)
    return out


def size_of(anchor: str) -> int:
    return max(n for n in SIZES if n <= len(anchor))


def page_of(gram: np.ndarray, pages: int) -> np.ndarray:
    """The page of a gram in the filter; pages are a power of two."""
    return (gram >> np.uint64(40) & np.uint64(pages - 1)).astype(np.int64)


def probe_of(gram: np.ndarray, k: int) -> np.ndarray:
    """The k-th bit of a gram in its page."""
    return (gram * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7 + 19 * k) & np.uint64(PAGE_BITS - 1)).astype(np.int64)


def anchor_grams(table: DataFrame) -> DataFrame:
    """ticker, pattern, anchor, size, gram: the longest grams of every anchor. An anchor of no length stands under gram 0, which all texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors = batch.column(2).to_pylist()
            sizes = [size_of(a) if a else 0 for a in anchors]
            found = [np.unique(grams(codes(a), n)[n]) if n else np.zeros(1, np.uint64) for a, n in zip(anchors, sizes, strict=True)]
            counts = [len(f) for f in found]
            at = pa.array(np.repeat(np.arange(len(found)), counts))
            flat = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(np.repeat(sizes, counts), pa.int32()), pa.array(flat)], names=["ticker", "pattern", "anchor", "size", "gram"])

    rows = table.select("ticker", "pattern", F.explode("anchors").alias("anchor")).distinct()
    return rows.mapInArrow(run, "ticker string, pattern string, anchor string, size int, gram long")


def rarest_grams(index: DataFrame) -> DataFrame:
    """ticker, pattern, size, gram: of every anchor the gram that the fewest anchors have."""
    uses = index.groupBy("gram").agg(F.count(F.lit(1)).alias("uses")).hint("rebalance")
    best = index.join(uses, "gram").groupBy("ticker", "pattern", "anchor").agg(F.min(F.struct("uses", "gram", "size")).alias("best"))
    return best.select("ticker", "pattern", F.col("best.size").alias("size"), F.col("best.gram").alias("gram")).distinct()


def filter_of(chosen: DataFrame) -> tuple[list[int], np.ndarray]:
    """The sizes of chosen grams, and the pages of bits that they set: 4 bytes for each, 32 MB at most, come to the driver."""
    facts = chosen.agg(F.count(F.lit(1)), F.sort_array(F.collect_set("size"))).first()
    pages = min(1 << (facts[0] * GRAM_BITS // PAGE_BITS).bit_length(), MOST_PAGES)

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(page_of(own, pages)), batch.column(0)], names=["page", "gram"])

    def run(table: pa.Table) -> pa.Table:
        own = table.column("gram").to_numpy().view(np.uint64)
        bits = np.zeros(PAGE_BITS, bool)
        for k in range(PROBES):
            bits[probe_of(own, k)] = True
        return pa.table({"page": table.column("page").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((pages, PAGE_BITS // 8), np.uint8)
    for r in chosen.select("gram").distinct().mapInArrow(paged, "page long, gram long").groupBy("page").applyInArrow(run, "page long, bits binary").collect():
        out[r["page"]] = np.frombuffer(r["bits"], np.uint8)
    return [n for n in facts[1] if n], out.reshape(-1)


def text_grams(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """row, gram: the distinct grams of each text (columns row and text) that can be among the chosen ones."""
    sizes, bits = filter_of(chosen)
    pages = len(bits) * 8 // PAGE_BITS

    def held(own: np.ndarray) -> np.ndarray:
        for k in range(PROBES):
            at = page_of(own, pages) * PAGE_BITS + probe_of(own, k)
            own = own[(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
        return own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                own = grams(codes(text), sizes[-1]) if sizes else {}
                found.append(np.unique(np.concatenate([held(np.zeros(1, np.uint64)), *(held(own[n]) for n in sizes if n in own)])))
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], names=["row", "gram"])

    kind = items.schema["row"].dataType.simpleString()
    return items.select("row", "text").mapInArrow(run, f"row {kind}, gram long")


def candidates(rows: DataFrame, companies: DataFrame, path: str | None = None) -> DataFrame:
    """row, ticker, pattern: where a text (columns row and text) has a gram of a company. What is chosen for companies is stored under `path`."""
    chosen = rarest_grams(anchor_grams(patterns(companies)))
    if path is not None:
        chosen = kept(chosen, path)
    # Dealt anew, so that a gram that most texts have is split in the join.
    return text_grams(rows, chosen).join(chosen.hint("rebalance"), "gram").select("row", "ticker", "pattern").distinct()


def company_mentions(items: DataFrame, companies: DataFrame, path: str | None = None) -> DataFrame:
    """ticker, ord: every item whose title or excerpt names a company.

    Each pattern has literals one of which every match holds. Of each literal a long n-gram, all of it or nearly
    so, is looked for among the texts' grams by an equi-join; what meets there is tested with the whole pattern. So a text is
    held against the companies that it all but names, and there may be any number of them. ord tells items apart.
    """
    text = F.concat(text_or_empty("title"), F.lit(" "), text_or_empty("excerpt"))
    rows = items.select(F.col("ord").alias("row"), text.alias("text"))
    tested = candidates(rows, companies, path).join(rows, "row").filter(mentions(F.col("text"), F.col("pattern")))
    return tested.select("ticker", F.col("row").alias("ord")).distinct()


def company_news(items: DataFrame, companies: DataFrame, hidden: Sequence[str] = (), most: int = NEWS, path: str | None = None) -> DataFrame:
    """ticker, id, rn: the newest items that name a company. Per company only the newest items of each task travel."""
    shown = items.filter(visible(hidden))
    found = company_mentions(shown, companies, path).join(shown.select("ord", "id", "publishedAt"), "ord")
    rn = F.row_number().over(Window.partitionBy("ticker").orderBy(*newest_first()))
    return found.withColumn("rn", rn).filter(F.col("rn") <= most).select("ticker", "id", "rn")
