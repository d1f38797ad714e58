"""The driver's tables in the shapes of the operators, as frames and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The mapping of sources used by queries and tests: source, key, ids. A key with / is a first path segment.
MAPPING = [(f"src{i}", key, ids) for i in range(20) for key, ids in (
    ("View", ["world"]),
    ("click", ["tech", "nope"]),
    ("purchase", ["business", "markets"]),
    ("signup / new", ["culture"]),
    *([("/es", ["ru", "world"])] if i % 4 == 0 else []),
    *([("/fr", [])] if i % 5 == 0 else []),
)]
DEFAULTS = [(f"src{i}", ["science"]) for i in range(0, 20, 6)]
DENY = [("src3", "/1"), ("src4", "7.jpg"), ("src0", "/55.")]
WANTED = ("tech", "world", "business")
HIDDEN = ("src1", "src7")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feed_items(spark: SparkSession, sf_dir: str, head: int | None = None) -> DataFrame:
    """Items of a feed: documents with the events of the same number. Title is the first line.

    Fields are made before the join, so that texts are not shuffled for a query that has no use for them; one that
    reads only the beginnings of excerpts says so in `head`.
    """
    docs, events = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    text = F.col("text")
    url = F.concat(F.lit("https://"), "source", F.lit(".example/"), "lang", F.lit("/"), F.substring(F.md5(text), 1, 12))
    cut = F.instr(text, "\n")
    rest = F.substring(text, cut + 1, F.length(text) if head is None else F.lit(head))
    fields = docs.select(
        F.col("doc_id").alias("ord"),
        url.alias("url"),
        F.col("source").alias("sourceId"),
        F.upper("source").alias("sourceName"),
        F.when(cut > 0, F.substring(text, F.lit(1), cut - 1)).otherwise(text).alias("title"),
        F.when(cut > 0, rest).otherwise("").alias("excerpt"),
        F.col("lang"),
        (F.col("n_chars") >= 500).alias("hasContent"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("https://img.example/"), (F.col("doc_id") % 97).cast("string"), F.lit(".jpg"))).alias("image"),
        F.substring(F.sha1(url), 1, 16).alias("id"),
    )
    both = fields.join(events.select(F.col("event_id").alias("ord"), "ts", "event_type"), "ord")
    return both.select(
        "ord", "url", "sourceId", "sourceName", "title", "excerpt", F.col("ts").cast("timestamp").alias("publishedAt"),
        F.array("event_type", F.concat("event_type", F.lit(" / "), "lang")).alias("sourceCategories"), "lang", "hasContent", "image", "id",
    )


def first_per(items: DataFrame, key: str) -> DataFrame:
    """The item with the smallest ord of each key. Items are met by ord, by which they are dealt already, so that they are not shuffled anew."""
    firsts = items.groupBy(key).agg(F.min("ord").alias("ord")).groupBy("ord").agg(F.collect_set(key).alias("__first_of"))
    return items.join(firsts, "ord").filter(F.array_contains("__first_of", F.col(key))).select(*items.columns)


FEED = """feed AS (
  SELECT d.doc_id AS ord, 'https://' || source || '.example/' || lang || '/' || substr(md5(text), 1, 12) AS url,
         substr(sha1('https://' || source || '.example/' || lang || '/' || substr(md5(text), 1, 12)), 1, 16) AS id,
         source AS source_id, upper(source) AS source_name,
         CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS title,
         CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS excerpt,
         e.ts AS published_at, e.event_type, lang, n_chars >= 500 AS has_content,
         CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE 'https://img.example/' || (d.doc_id % 97)::VARCHAR || '.jpg' END AS image
  FROM documents d JOIN events e ON e.event_id = d.doc_id)"""


def mapping(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = [(s, k, ids, i) for i, (s, k, ids) in enumerate(MAPPING)]
    return spark.createDataFrame(rows, "sourceId string, key string, ids array<string>, ord int"), spark.createDataFrame(DEFAULTS, "sourceId string, ids array<string>")


def headlines(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stories that need no clustering, one headline in two outlets or more, and their members by headline.

    The newest member heads a story; pos is its first item's place. A member's rank is its time and
    place, so that no step sorts all items of a headline.
    """
    from tidewire.functions.text import title_key

    rank = F.struct(F.negative(F.unix_micros("publishedAt")).alias("t"), "ord")
    words = items.withColumn("words", title_key("title")).filter("words <> ''")
    # A headline can be a whole text: its digest stands for it wherever rows are shuffled.
    rows = words.select(F.unhex(F.sha2("words", 256)).alias("key"), "words", "id", "ord", "sourceId", "publishedAt", rank.alias("rank"))
    facts = rows.groupBy("key").agg(
        F.count_distinct("sourceId").cast("int").alias("sources"),
        F.max("publishedAt").alias("publishedAt"),
        F.min_by("id", "rank").alias("story_id"),
        F.min("ord").alias("pos"),
        F.min("words").alias("title"),
    )
    # Dealt anew, so that a join to the members shuffles both sides and can split a hot headline.
    return facts.filter("sources >= 2").hint("rebalance"), rows.groupBy("key", F.col("id").alias("item_id")).agg(F.min("rank").alias("member"))


def headline_stories(items: DataFrame) -> DataFrame:
    """Stories as a snapshot lists them, members in an array: for the items that a snapshot keeps."""
    facts, members = headlines(items)
    lists = members.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("member", "item_id"))).alias("m"))
    return facts.join(lists, "key").select(F.col("story_id").alias("id"), "title", "sources", "publishedAt", F.col("m.item_id").alias("itemIds"), "pos")


def headline_members(items: DataFrame) -> DataFrame:
    """The same, a row per member as feed.story_members gives them: for all items."""
    facts, members = headlines(items)
    return facts.join(members, "key").select("story_id", "pos", "sources", F.col("publishedAt").alias("story_at"), "member", "item_id")


KEY = "trim(regexp_replace(replace(lower(title), 'ё', 'е'), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
STORIES = f"""keyed AS (SELECT *, {KEY} AS key FROM feed),
stories AS (
  SELECT first(id ORDER BY published_at DESC, ord) AS story_id, key, count(DISTINCT source_id)::INT AS sources,
         max(published_at) AS story_at, min(ord) AS pos
  FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT source_id) >= 2),
members AS (
  SELECT story_id, sources, story_at, pos, id AS item_id, min(rn) AS member
  FROM (SELECT s.*, k.id, row_number() OVER (PARTITION BY s.key ORDER BY k.published_at DESC, k.ord) AS rn
        FROM stories s JOIN keyed k USING (key)) x
  GROUP BY ALL),
story_of AS (
  SELECT item_id, arg_max(story_id, (pos, member)) AS story_id, arg_max(sources, (pos, member)) AS sources
  FROM members GROUP BY item_id)"""


def board(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(securities, marketdata): parts as shares, their order lines as the day's trading. All cells are text."""
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    money = lambda c: F.col(c).cast("decimal(18,2)")
    securities = part.select(
        F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("SECID"),
        F.col("p_name").alias("SHORTNAME"),
        F.when(F.col("p_partkey") % 11 != 0, F.replace(money("p_retailprice").cast("string"), F.lit("."), F.lit(","))).alias("PREVPRICE"),
        F.when(F.col("p_size") % 3 == 0, (money("p_retailprice") * F.col("p_size") * 1000).cast("string")).otherwise("").alias("ISSUECAPITALIZATION"),
        F.col("p_partkey").alias("ord"),
    )
    trades = lines.groupBy("l_partkey").agg(
        F.sum(money("l_extendedprice")).alias("total"), F.max(money("l_extendedprice")).alias("top"), F.sum("l_linenumber").alias("k"), F.max("l_shipdate").alias("at")
    )
    marketdata = trades.select(
        F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("SECID"),
        F.when(F.col("k") % 7 != 0, F.col("top").cast("string")).alias("LAST"),
        F.when(F.col("l_partkey") % 2 == 0, (F.col("k") % 23 - 11).cast("string")).alias("LASTTOPREVPRICE"),
        F.col("total").cast("string").alias("VALTODAY"),
        F.when(F.col("l_partkey") % 50 == 3, "N").otherwise("").alias("TRADINGSTATUS"),
        F.when(F.col("l_partkey") % 40 == 1, F.date_format("at", "yyyy-MM-dd HH:mm:ss")).alias("SYSTIME"),
        F.col("l_partkey").alias("ord"),
    )
    return securities, marketdata


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("ticker"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_brand")).alias("sector"))


#: Two digits by the exact binary value, halves away from zero: whole numbers of 2^-60 are exact.
CENTS = "(sign({0}) * ((abs({0}) * 1152921504606846976)::HUGEINT * 200 + 1152921504606846976::HUGEINT) // 2305843009213693952::HUGEINT)::DOUBLE / 100"
BOARD = f"""sec AS (
  SELECT 'T' || p_partkey AS secid, p_name AS name, p_partkey AS k,
         CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_retailprice AS DECIMAL(18,2))::DOUBLE END AS prev,
         CASE WHEN p_size % 3 = 0 THEN (CAST(p_retailprice AS DECIMAL(18,2)) * p_size * 1000)::DOUBLE END AS cap,
         CASE WHEN p_partkey % 9 <> 0 THEN p_brand ELSE 'Прочие' END AS sector
  FROM part),
md AS (
  SELECT 'T' || l_partkey AS secid, l_partkey AS ord,
         CASE WHEN sum(l_linenumber) % 7 <> 0 THEN max(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE END AS last,
         CASE WHEN l_partkey % 2 = 0 THEN (sum(l_linenumber) % 23 - 11)::DOUBLE END AS chg,
         sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS turnover
  FROM lineitem GROUP BY l_partkey),
shares AS (
  SELECT secid AS ticker, name, sector, coalesce(last, prev) AS price,
         coalesce({CENTS.format("coalesce(chg, CASE WHEN prev <> 0 THEN (coalesce(last, prev) - prev) / prev * 100 END)")}, 0) AS change,
         turnover, CASE WHEN cap > 0 THEN cap ELSE turnover END AS weight,
         CASE WHEN cap > 0 THEN 'capitalisation' ELSE 'turnover' END AS basis, ord
  FROM md JOIN sec USING (secid) WHERE coalesce(last, prev) IS NOT NULL)"""


# --- pages and feeds made of the driver's texts, so that what must be read from them is known ----

#: Markup around a text's lines. {id} is the document's number.
PAGE_HEAD = '<html><head><title>Page {id}</title><meta name="twitter:image" content="/t.png">'
PAGE_PICTURE = '<meta property="og:image" content="/p/{id}.png">'
PAGE_OPEN = '</head><body><script>var a = "<p>no</p>";</script><style>p{}</style><h1>Head</h1><div class="box">'
PAGE_LINE = ('<p class="x" onclick="y()">', "</p>")
PAGE_END = (
    '<p><a href="https://l.example/{id}" title="t" rel="x" onclick="z">link</a> <a href="javascript:1">bad</a>'
    '<img src="/i.png" alt="a" width="5"><span>in <b>bold</b></span></p></div></body></html>'
)
#: The last paragraph as it is stored, as a reader sees it, and its text.
STORED_END = '<p><a href="https://l.example/{id}">link</a> <a href="javascript:1">bad</a><img src="/i.png" alt="a">in <b>bold</b></p>'
SHOWN_END = (
    '<p><a href="https://l.example/{id}" title="t" rel="noreferrer noopener" target="_blank">link</a> <a target="_blank" rel="noreferrer noopener">bad</a>'
    '<img alt="a" referrerpolicy="no-referrer" loading="lazy">in <b>bold</b></p>'
)
END_TEXT = "link badin bold"
BASE = "https://s.example/d/x"


def with_number(markup: str, number: str) -> str:
    """SQL of markup with a number in it."""
    return "concat(" + ", ".join(f"'{p}'" for p in markup.replace("{id}", "\0{id}\0").split("\0")).replace("'{id}'", f"cast({number} as string)") + ")"


def composed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, page: every document as a page, a paragraph for each line; every third has structured data."""
    from tidewire.functions.html import small_batches
    from tidewire.functions.text import escape_html

    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    number = lambda markup: F.expr(with_number(markup, "doc_id"))
    data = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.array(F.struct(F.col("text").alias("articleBody"))).alias("@graph"))), F.lit("</script>"))
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit(PAGE_LINE[0]), escape_html(x), F.lit(PAGE_LINE[1])))
    parts = [
        number(PAGE_HEAD),
        F.when(F.col("doc_id") % 2 == 0, number(PAGE_PICTURE)).otherwise(""),
        F.when(F.col("doc_id") % 3 == 0, data).otherwise(""),
        F.lit(PAGE_OPEN),
        F.array_join(lines, ""),
        number(PAGE_END),
    ]
    return docs.select("doc_id", "text", F.concat(*parts).alias("page"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one named by spark.checkpoint.dir; it goes with the driver.

    Where that is unset a session in one process uses its warehouse; on a cluster that can be a disk of one machine, so it is an error.
    """
    import atexit
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/tidewire-{uuid.uuid4().hex}/{name}"

    def remove() -> None:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended
            pass

    atexit.register(remove)
    return path


def landed(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """Texts (value), a file for each, under source=NAME folders."""
    path = scratch(spark, name)
    rows.select("source", "value").write.partitionBy("source").option("maxRecordsPerFile", 1).text(path)
    return path


#: Numbers of documents whose items of a source share a feed file.
FEED_FILE = 10_000


def feed_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Paths of landed RSS and Atom files: the feed's items as XML, those of an even number RSS, the others Atom."""
    from tidewire.functions.text import escape_html

    i = feed_items(spark, sf_dir, 200)
    clean = lambda c: escape_html(F.regexp_replace(F.col(c), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\r\\uFFFE\\uFFFF]", " "))
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name.split()[0]}>"))
    stamp = F.concat(F.date_format("publishedAt", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    iso = F.date_format("publishedAt", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    i = i.withColumnRenamed("excerpt", "head").withColumn("title", F.substring("title", 1, 100))
    rss = F.concat(
        tag("title", clean("title")), tag("link", clean("url")), tag("guid", F.col("id")), tag("pubDate", stamp),
        tag("category", F.col("lang")), tag("category", F.col("lang")), tag("category", F.lit(" News ")), tag("description", clean("head")),
        F.when(F.col("image") != "", F.concat(F.lit('<enclosure type="image/png" url="'), F.col("image"), F.lit('"/>'))).otherwise(""),
    )
    atom = F.concat(
        tag("title", clean("title")), tag("id", F.lit("tag:x")), tag("updated", iso), F.lit('<link rel="alternate" href="'), clean("url"), F.lit('"/>'),
        F.lit('<category term="'), F.col("lang"), F.lit('"/>'), tag("summary", clean("head")),
        F.when(F.col("image") != "", F.concat(F.lit('<link rel="enclosure" href="'), F.col("image"), F.lit('"/>'))).otherwise(""),
    )

    def files(kind: int, body: Column, root: str) -> DataFrame:
        """A file of FEED_FILE numbers of a source: files are as many as the rows of a source need, not as its numbers are spread."""
        rows = i.filter(F.col("ord") % 2 == kind).select(F.col("sourceId").alias("source"), F.floor(F.col("ord") / FEED_FILE).alias("part"), F.struct("ord", body.alias("body")).alias("row"))
        by = rows.groupBy("source", "part").agg(F.sort_array(F.collect_list("row")).alias("rows"))
        return by.select("source", F.concat(F.lit(f"<{root}>"), F.array_join("rows.body", "\n"), F.lit(f"</{root}>")).alias("value"))

    return landed(spark, files(0, tag("item", rss), "rss"), "rss"), landed(spark, files(1, tag("entry", atom), "feed"), "atom")
