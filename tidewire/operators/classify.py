"""Sections of items: from the source's own rubrics and addresses, and from rules over the text.

Everything is Catalyst expressions. The mapping of sources is a dimension table (source, key, ids):
keys that begin with / are first path segments of addresses, other keys are rubrics. A source has
a bounded number of keys, so the table is aggregated to one map per source and joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import SPACE, normalize_rubric, text_or_empty, url_section
from tidewire.operators import rules


NO_STRINGS = "array<string>"


def known_sections(ids: Column) -> Column:
    sections = F.array(*map(F.lit, rules.SECTIONS))
    return F.array_distinct(F.filter(ids, lambda i: F.array_contains(sections, i)))


# --- text rules -----------------------------------------------------------------------------


def joined_text(title: Column, excerpt: Column) -> Column:
    return F.lower(F.concat(text_or_empty(title), F.lit(" "), text_or_empty(excerpt)))


def is_ai(title: Column, both: Column) -> Column:
    """Named in the title, or twice in title and excerpt together (both given lower-cased).

    The abbreviation is matched with its neighbours, so that two of them with one space between count
    once; whether there is any match does not depend on that.
    """
    terms = rules.java(rules.AI_TERMS)
    any_of = f"{terms}|{rules.AI_WORD}"
    counted = F.lit(f"{terms}|{rules.AI_LETTERS}")
    return F.when(~both.rlike(any_of), False).otherwise(title.rlike(any_of) | (F.regexp_count(both, counted) >= 2))


def is_health(t: Column) -> Column:
    return t.rlike(rules.java(rules.HEALTH))


def is_security(t: Column) -> Column:
    return t.rlike(rules.java(rules.SECURITY_STRONG)) | (
        t.rlike(rules.java(rules.SECURITY_WEAK)) & t.rlike(rules.java(rules.DIGITAL_CONTEXT))
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What use makes of a value that is computed once: the engine computes an expression anew for every entry of a lambda that holds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def near_market_context(text: Column, around: int = rules.NEARBY) -> Column:
    """A weak market term with trading context, and nothing that excludes it, in its window.

    Windows are cut literally, so a word cut in two at an edge may match; the term itself is blanked.
    The pieces between matches give the matches' places.
    """
    weak = rules.java(rules.MARKETS_WEAK, anchored=True)
    pieces = lambda t: F.struct(t.alias("t"), F.regexp_extract_all(t, F.lit(f"({weak})"), F.lit(1)).alias("found"), F.split(t, weak, -1).alias("between"))
    return bound(text, lambda t: bound(pieces(t), lambda p: any_window(p["t"], p["found"], p["between"], around)))


def any_window(t: Column, found: Column, between: Column, around: int) -> Column:
    # Start of match i: the lengths of the pieces up to i and of the matches before it.
    starts = F.transform(
        found,
        lambda _, i: F.aggregate(F.slice(between, F.lit(1), i + 1), F.lit(0), lambda a, s: a + F.length(s))
        + F.aggregate(F.slice(found, F.lit(1), i), F.lit(0), lambda a, s: a + F.length(s)),
    )
    windows = F.zip_with(
        starts,
        found,
        lambda at, m: F.concat(
            F.substring(t, F.greatest(at - around, F.lit(0)) + 1, F.least(at, F.lit(around))),
            F.repeat(F.lit(" "), F.length(m)),
            F.substring(t, at + F.length(m) + 1, F.lit(around)),
        ),
    )
    exclude, context = rules.java(rules.MARKETS_EXCLUDE, anchored=True), rules.java(rules.MARKETS_CONTEXT, anchored=True)
    return F.exists(windows, lambda w: ~w.rlike(exclude) & w.rlike(context))


def is_markets(t: Column) -> Column:
    test = lambda terms: t.rlike(rules.java(terms, anchored=True))
    return F.when(test(rules.MARKETS_STRONG), True).when(~test(rules.MARKETS_WEAK) | test(rules.MARKETS_EXCLUDE), False).otherwise(near_market_context(t))


def is_ibs(t: Column) -> Column:
    test = lambda terms: t.rlike(rules.java(terms, anchored=True))
    named = t.contains("ibs") | t.contains("ибс")
    return named & (test(rules.IBS_STRONG) | (test(rules.IBS_WEAK) & test(rules.IBS_CONTEXT))) & ~test(rules.IBS_EXCLUDE)


def sections_of_texts(title: Column, both: Column) -> Column:
    """Sections that the text alone puts an item into, in a fixed order; market news is business news too.

    Title and title with excerpt are given lower-cased.
    """
    tests = (
        (("ai",), is_ai(title, both)),
        (("health",), is_health(both)),
        (("security",), is_security(both)),
        (("markets", "business"), is_markets(both)),
        (("ibs",), is_ibs(both)),
    )
    none = F.array().cast(NO_STRINGS)
    found = F.concat(*[F.when(test, F.array(*map(F.lit, names))).otherwise(none) for names, test in tests])
    named = rules.any_term(
        [*rules.AI_TERMS, *rules.HEALTH, *rules.SECURITY_STRONG, *rules.SECURITY_WEAK],
        [*rules.MARKETS_STRONG, *rules.MARKETS_WEAK, "ibs", "ибс"],
    )
    return F.when(both.rlike(f"{named}|{rules.AI_WORD}"), found).otherwise(none)


def sections_by_text(title: Column, excerpt: Column) -> Column:
    return sections_of_texts(F.lower(text_or_empty(title)), joined_text(title, excerpt))


# --- mapping of sources ---------------------------------------------------------------------


def source_maps(mapping: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """One row per source: rubric map, address map, default ids.

    mapping has sourceId, key, ids and ord (the first of keys that normalise alike wins);
    defaults has sourceId, ids.
    """
    by_url = F.col("key").startswith("/")
    keyed = mapping.select(
        "sourceId",
        F.when(by_url, "url").otherwise("rubric").alias("what"),
        F.when(by_url, F.lower(F.expr("substr(key, 2)"))).otherwise(normalize_rubric("key")).alias("k"),
        "ids",
        F.col("ord").cast("long"),
    )
    if defaults is not None:
        keyed = keyed.unionByName(defaults.select("sourceId", F.lit("default").alias("what"), F.lit("").alias("k"), "ids", F.lit(0).cast("long").alias("ord")))
    firsts = keyed.groupBy("sourceId", "what", "k").agg(F.min_by("ids", "ord").alias("ids"))
    entries = lambda what: F.map_from_entries(F.collect_list(F.when(F.col("what") == what, F.struct("k", "ids"))))
    given = F.coalesce(F.any_value(F.when(F.col("what") == "default", F.col("ids")), True), F.array().cast(NO_STRINGS))
    return firsts.groupBy("sourceId").agg(entries("rubric").alias("rubrics"), entries("url").alias("addresses"), given.alias("defaults"))


def lookup_rubric(rubrics: Column, rubric: Column) -> Column:
    """Ids of a rubric, or of its nearest parent ("A / B / C", "A / B", "A"); null if none is mapped."""
    parts = F.filter(F.split(rubric, f"[{SPACE}]*/[{SPACE}]*"), lambda p: p != "")
    keys = F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda i: normalize_rubric(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), " / ")),
    )
    found = F.filter(F.transform(F.slice(keys, F.lit(1), F.size(parts)), lambda k: F.element_at(rubrics, k)), lambda ids: ids.isNotNull())
    return F.get(found, F.lit(0))


def mapped_ids(maps: dict[str, Column], rubric_list: Column, url: Column) -> Column:
    """Ids of the source's mapping: the address's segment replaces the rubrics if it is a key, even of no ids."""
    none = F.array().cast(NO_STRINGS)
    section = url_section(url)
    by_url = F.when(section != "", F.element_at(maps["addresses"], section))
    by_rubric = F.flatten(F.transform(F.coalesce(rubric_list, none), lambda r: F.coalesce(lookup_rubric(maps["rubrics"], r), none)))
    return known_sections(F.concat(F.coalesce(by_url, by_rubric, none), F.coalesce(maps["defaults"], none)))


MAPS = ("rubrics", "addresses", "defaults")


def judged(items: DataFrame, maps: DataFrame) -> DataFrame:
    """items with __maps (struct of the source's maps), __by_text and categoryIds.

    The sections come out of a generator of one row, which filters on them are not pushed into: they
    are worked out once however many steps look at them.
    """
    dim = maps.select(F.col("sourceId").alias("__s"), F.struct(*MAPS).alias("__maps"))
    joined = items.drop("categoryIds").join(dim, F.col("sourceId") == F.col("__s"), "left").drop("__s")
    from_source = mapped_ids({c: F.col(f"__maps.{c}") for c in MAPS}, F.col("sourceCategories"), F.col("url"))
    found = F.struct(sections_by_text(F.col("title"), F.col("excerpt")).alias("__by_text"), from_source.alias("__mapped"))
    once = joined.select("*", F.inline(F.array(found)))
    return once.withColumn("categoryIds", F.array_distinct(F.concat("__mapped", "__by_text"))).drop("__mapped")


def classify(items: DataFrame, maps: DataFrame) -> DataFrame:
    """items with categoryIds: mapped sections, then those of the text; an item without rubrics of its own
    (null) is mapped by address and default alone. Items with no section stay, with an empty array."""
    return judged(items, maps).drop("__maps", "__by_text")


def with_section(items: DataFrame) -> DataFrame:
    return items.filter(F.size("categoryIds") > 0)


def normalize_items(raw: DataFrame) -> DataFrame:
    """Reader's view of index rows: safe addresses, fallback ids, AI and security sections inferred anew."""
    from tidewire.functions.text import safe_url

    url, published = safe_url("url"), text_or_empty("publishedAt")
    title, excerpt = text_or_empty("title"), text_or_empty("excerpt")
    t, none = joined_text(title, excerpt), F.array().cast(NO_STRINGS)
    named = rules.any_term([*rules.AI_TERMS, *rules.SECURITY_STRONG, *rules.SECURITY_WEAK])
    found = F.concat(
        F.when(is_ai(F.lower(title), t), F.array(F.lit("ai"))).otherwise(none), F.when(is_security(t), F.array(F.lit("security"))).otherwise(none)
    )
    inferred = F.when(t.rlike(f"{named}|{rules.AI_WORD}"), found).otherwise(none)
    return raw.withColumns(
        {
            "id": F.coalesce("id", F.concat(url, F.lit(":"), published)),
            "url": url,
            "image": safe_url("image"),
            "title": title,
            "excerpt": excerpt,
            "sourceName": text_or_empty("sourceName"),
            "sourceId": F.coalesce(F.nullif(F.col("sourceId"), F.lit("")), text_or_empty("sourceName")),
            "publishedAt": published,
            "hasContent": (text_or_empty("contentHtml") != "") | F.coalesce("hasContent", F.lit(False)),
            "categoryIds": F.array_distinct(F.concat(F.coalesce("categoryIds", F.array().cast(NO_STRINGS)), inferred)),
        }
    )


# --- audit ----------------------------------------------------------------------------------


def section_reasons(items: DataFrame, maps: DataFrame) -> DataFrame:
    """id, section, reason for every section of every item: url, rubric, default, text or unknown, in that order."""
    none = F.array().cast(NO_STRINGS)
    rows = judged(items, maps).select("id", "url", "sourceCategories", "__maps", "__by_text", F.explode("categoryIds").alias("section"))
    part = url_section("url")
    by_url = F.array_contains(F.coalesce(F.element_at("__maps.addresses", part), none), F.col("section"))
    hits = F.filter(
        F.coalesce("sourceCategories", none),
        lambda r: F.array_contains(known_sections(F.coalesce(lookup_rubric(F.col("__maps.rubrics"), r), none)), F.col("section")),
    )
    reason = (
        F.when((part != "") & by_url, F.concat(F.lit("url:/"), part))
        .when(F.size(hits) > 0, F.concat(F.lit("rubric:"), F.get(hits, F.lit(0))))
        .when(F.array_contains(F.coalesce("__maps.defaults", none), F.col("section")), "default")
        .when(F.array_contains("__by_text", F.col("section")), "text")
        .otherwise("?")
    )
    return rows.select("id", "section", reason.alias("reason"))


def section_counts(classified: DataFrame) -> DataFrame:
    """section, n for every section, then `none` (items without one) and `total`; one pass, zeros included."""
    none = F.when(F.size("categoryIds") == 0, F.array(F.lit("none"))).otherwise(F.col("categoryIds"))
    found = classified.select(F.explode(F.concat(none, F.array(F.lit("total")))).alias("section"), F.lit(1).cast("long").alias("n"))
    every = classified.sparkSession.createDataFrame([(s, 0) for s in (*rules.SECTIONS, "none", "total")], "section string, n long")
    return found.unionByName(every).groupBy("section").agg(F.sum("n").alias("n"))
