"""The market board: exchange tables to indices, tiles, movers, quotes, session, series and macro strip.

Exchange rows come as frames of text columns named as the exchange names them (see sources.exchange);
a missing column is a null. securities and marketdata have ord, their row's place.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.dates import session_by_clock
from tidewire.functions.numbers import num, pick, round2
from tidewire.operators.feed import when

#: Fixed values of the board.
INDICES = ("IMOEX", "RTSI", "MOEXBC")
TILES, MOVERS, LIQUID = 40, 5, 30e6
TAPE = 28
OTHER = "Прочие"

#: Sectors and their tickers.
SECTORS = {
    "Нефть и газ": "GAZP ROSN LKOH NVTK SNGS SNGSP TATN TATNP SIBN BANE BANEP RNFT TRNFP",
    "Финансы": "SBER SBERP VTBR TCSG T MOEX BSPB CBOM SVCB RENI SFIN AFKS",
    "Металлы": "GMKN NLMK CHMF MAGN PLZL POLY RUAL ENPG MTLR MTLRP TRMK SELG VSMO ALRS",
    "Энергетика": "IRAO HYDR FEES UPRO OGKB MSNG TGKA LSNGP ROSSETI",
    "Технологии": "YDEX YNDX VKCO OZON HHRU POSI ASTR DIAS SOFL WUSH CIAN DATA",
    "Потребительский": "MGNT FIVE X5 LENT FIXP BELU ABRD GCHE MVID OKEY AQUA",
    "Связь": "MTSS RTKM RTKMP MGTSP",
    "Транспорт": "AFLT NMTP FESH FLOT GLTR",
    "Химия": "PHOR AKRN KAZT KAZTP NKNC NKNCP",
    "Строительство": "PIKK LSRG SMLT ETLN",
}

#: Columns that may hold a value, best first.
PREVIOUS = ("PREVPRICE", "PREVLEGALCLOSEPRICE", "PREVADMITTEDQUOTE")
LAST = ("LAST", "MARKETPRICE", "LCURRENTPRICE", "WAPRICE")
CHANGE = ("LASTTOPREVPRICE", "LASTCHANGEPRCNT")
TURNOVER = ("VALTODAY", "VALTODAY_RUR")
NAME = ("SHORTNAME", "SECNAME", "NAME")
INDEX_VALUE = ("CURRENTVALUE", "LASTVALUE", "CLOSEVALUE")
INDEX_CHANGE = ("LASTCHANGEPRCNT", "LASTCHANGEPRC", "LASTCHANGETOOPENPRC")
MACRO_PREVIOUS = ("PREVPRICE", "PREVSETTLEPRICE", "PREVLEGALCLOSEPRICE", "PREVADMITTEDQUOTE", "PREVVALUE")
MACRO_CHANGE = ("LASTTOPREVPRICE", "LASTCHANGEPRCNT", "LASTCHANGEPRC", "LASTCHANGETOOPENPRC")
CURRENCY_VALUE = ("LAST", "WAPRICE", "MARKETPRICE")
FIXING_VALUE = ("CURRENTVALUE", "LASTVALUE", "CLOSEVALUE", "LAST")
FUTURE_TRADES = ("VALTODAY", "VOLTODAY", "NUMTRADES")


def first_of(df: DataFrame, names: tuple[str, ...], prefix: str = "") -> Column:
    """The first non-empty of the columns that the frame has."""
    found = [F.col(f"`{prefix}{n}`") for n in names if f"{prefix}{n}" in df.columns]
    return pick(*found) if found else F.lit(None).cast("string")


def sector_table(df: DataFrame) -> DataFrame:
    rows = [(t, s) for s, tickers in SECTORS.items() for t in tickers.split()]
    return df.sparkSession.createDataFrame(rows, "ticker string, sector string")


def last_by_id(securities: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per SECID (of each board, where columns tell several apart), the last one, its columns prefixed with s_."""
    keys = [*by, "SECID"]
    rest = [c for c in securities.columns if c not in (*keys, "ord")]
    last = securities.groupBy(*keys).agg(F.max_by(F.struct(*rest), "ord").alias("s"))
    return last.select(*keys, *[F.col(f"s.`{c}`").alias(f"s_{c}") for c in rest])


def share_rows(securities: DataFrame, marketdata: DataFrame, rounded: bool = True, sectors: DataFrame | None = None) -> DataFrame:
    """Every share with a price: ticker, name, sector, price, change, turnover, weight, weightBasis, ord.

    The own list of sectors is small and broadcast; a caller's table is joined as the engine sees fit.
    """
    rows = marketdata.join(last_by_id(securities), "SECID")
    previous = num(first_of(rows, PREVIOUS, "s_"))
    price = F.coalesce(num(first_of(rows, LAST)), previous)
    rows = rows.withColumns({"previous": previous, "price": price}).filter("price is not null")
    computed = F.when(F.col("previous") != 0, (F.col("price") - F.col("previous")) / F.col("previous") * 100)
    change = F.coalesce(num(first_of(rows, CHANGE)), computed)
    turnover = F.coalesce(num(first_of(rows, TURNOVER)), F.lit(0.0))
    capital = num(first_of(rows, ("ISSUECAPITALIZATION",), "s_"))
    by_capital = F.coalesce(capital > 0, F.lit(False))
    table = sectors if sectors is not None else F.broadcast(sector_table(rows))
    return (
        rows.withColumns({"change": change, "turnover": turnover})
        .select(
            F.col("SECID").alias("ticker"),
            F.coalesce(first_of(rows, NAME, "s_"), F.col("SECID")).alias("name"),
            "price",
            F.coalesce(round2("change") if rounded else F.col("change"), F.lit(0.0)).alias("change"),
            "turnover",
            F.when(by_capital, capital).otherwise(F.col("turnover")).alias("weight"),
            F.when(by_capital, "capitalisation").otherwise("turnover").alias("weightBasis"),
            "ord",
        )
        .join(table, "ticker", "left")
        .withColumn("sector", F.coalesce("sector", F.lit(OTHER)))
    )


def tiles(shares: DataFrame, most: int = TILES) -> DataFrame:
    return shares.filter("weight <> 0").orderBy(F.col("weight").desc(), "ord").limit(most)


def tape(shares: DataFrame, most: int = TAPE) -> DataFrame:
    return shares.orderBy(F.col("turnover").desc(), "ord").limit(most)


def movers(shares: DataFrame, most: int = MOVERS, liquid: float = LIQUID) -> DataFrame:
    """kind (up, down, turnover) and rank of the leaders among names that trade."""
    trading = shares.filter(F.col("turnover") >= liquid)
    parts = [
        ("up", trading.filter("change > 0"), F.col("change").desc()),
        ("down", trading.filter("change < 0"), F.col("change").asc()),
        ("turnover", trading, F.col("turnover").desc()),
    ]
    out = None
    for kind, rows, order in parts:
        top = rows.orderBy(order, "ord").limit(most)
        ranked = top.select(
            F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(order, "ord")).alias("rank"), "ticker", "name", "price", "change", "turnover"
        )
        out = ranked if out is None else out.unionByName(ranked)
    return out


def quotes(shares: DataFrame) -> DataFrame:
    """One quote per ticker, of the last row."""
    q = shares.groupBy("ticker").agg(F.max_by(F.struct("name", "price", "change", "turnover"), "ord").alias("q"))
    return q.select("ticker", "q.*")


def quotes_for(tickers: DataFrame, board: DataFrame, shown: DataFrame) -> DataFrame:
    """Quotes of wanted tickers: from the whole board, else from the tiles; unknown ones keep nulls."""
    fallback = shown.groupBy("ticker").agg(F.min_by(F.struct("name", "price", "change", "turnover"), "ord").alias("t"))
    both = tickers.join(board.select("ticker", F.struct("name", "price", "change", "turnover").alias("q")), "ticker", "left").join(fallback, "ticker", "left")
    return both.select("ticker", F.coalesce("q", "t").alias("r"), (F.col("q").isNull() & F.col("t").isNotNull()).alias("from_tiles")).select("ticker", "r.*", "from_tiles")


def index_values(securities: DataFrame, marketdata: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The board's indices in their fixed order: ticker, name, value, change; by names the columns of a board's key."""
    order = marketdata.sparkSession.createDataFrame([(t, i) for i, t in enumerate(INDICES)], "SECID string, place int")
    rows = marketdata.join(F.broadcast(order), "SECID").join(last_by_id(securities, by), [*by, "SECID"], "left")
    out = rows.select(
        *by,
        F.col("SECID").alias("ticker"),
        F.coalesce(first_of(rows, ("SHORTNAME", "NAME"), "s_"), F.col("SECID")).alias("name"),
        num(first_of(rows, INDEX_VALUE)).alias("value"),
        num(first_of(rows, INDEX_CHANGE)).alias("change"),
        "place",
        "ord",
    )
    return out.filter("value is not null").orderBy(*by, "place", "ord").drop("ord")


def session(marketdata: DataFrame, now: datetime | Column) -> DataFrame:
    """status, time, fromExchange: by the first row with a status, else by the calendar."""
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False)) if c in marketdata.columns else F.lit(False)
    value = lambda c: F.col(c) if c in marketdata.columns else F.lit(None).cast("string")
    one = marketdata.agg(
        F.min_by(value("TRADINGSTATUS"), F.when(has("TRADINGSTATUS"), F.col("ord"))).alias("status"),
        F.min_by(value("SYSTIME"), F.when(has("SYSTIME"), F.col("ord"))).alias("time"),
    )
    known = F.when(F.upper("status") == "T", "open").otherwise("closed")
    return one.select(
        F.when(F.col("status").isNotNull(), known).otherwise(session_by_clock(when(now))).alias("status"), "time", F.col("status").isNotNull().alias("fromExchange")
    )


def up_and_down(shares: DataFrame) -> DataFrame:
    return shares.agg(F.count_if(F.col("change") > 0).alias("up"), F.count_if(F.col("change") < 0).alias("down"), F.count(F.lit(1)).alias("total"))


def valid_candles(raw: DataFrame) -> DataFrame:
    """begin, open, close of candles with a begin and a numeric close."""
    rows = raw.select(pick(F.col("begin")).alias("begin"), num(F.col("open")).alias("open"), num(F.col("close")).alias("close"))
    return rows.filter("begin is not null and close is not null")


def series_points(candles: DataFrame, range_name: str) -> DataFrame:
    """t, v of a chart: for a day the rows of the last trading date, else all."""
    if range_name != "day":
        return candles.select(F.col("begin").alias("t"), F.col("close").alias("v"))
    last = candles.agg(F.max("begin").alias("m")).select(F.substring("m", 1, 10).alias("day"))
    return candles.join(F.broadcast(last), F.substring("begin", 1, 10) == F.col("day"), "left_semi").select(F.col("begin").alias("t"), F.col("close").alias("v"))


def series_summary(candles: DataFrame, range_name: str, rounded: bool = True) -> DataFrame:
    """baseline, first, last, min, max, change: one aggregation over the candles, no sort.

    The baseline of a day is the close before it, or its own open; otherwise the first open.
    """
    if range_name == "day":
        last_day = candles.agg(F.max(F.substring("begin", 1, 10)).alias("day"))
        rows = candles.join(F.broadcast(last_day)).withColumn("inside", F.substring("begin", 1, 10) == F.col("day"))
    else:
        rows = candles.withColumn("inside", F.lit(True))
    inside = F.when(F.col("inside"), F.col("begin"))
    before = F.when(~F.col("inside"), F.col("begin"))
    own = F.min_by(F.coalesce("open", "close"), inside)
    one = rows.agg(
        F.coalesce(F.max_by("close", before), own).alias("baseline"),
        F.min_by("close", inside).alias("first"),
        F.max_by("close", inside).alias("last"),
        F.min(F.when(F.col("inside"), F.col("close"))).alias("min"),
        F.max(F.when(F.col("inside"), F.col("close"))).alias("max"),
        F.count_if("inside").alias("points"),
    ).filter("points > 0")
    change = F.when(F.col("baseline") != 0, (F.col("last") - F.col("baseline")) / F.col("baseline") * 100)
    return one.withColumn("raw", change).select(
        F.lit(range_name).alias("range"), "baseline", "first", "last", "min", "max", "points", (round2("raw") if rounded else F.col("raw")).alias("change")
    )


def chart_points(points: DataFrame, width: float = 600.0, height: float = 130.0, pad: float = 4.0) -> DataFrame:
    """x by rank, y by value; a flat line gets a small span. points is one series (t, v): what one chart
    draws, the candles of a day or of a range, so its windows hold one chart."""
    everything = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(Window.orderBy("t")) - 1
    lo, hi, n = F.min("v").over(everything), F.max("v").over(everything), F.count(F.lit(1)).over(everything)
    span = F.when(hi > lo, hi - lo).when(hi != 0, F.abs(hi) * 0.001).otherwise(1.0)
    x = F.lit(pad) + rank / F.greatest(n - 1, F.lit(1)) * (width - 2 * pad)
    y = F.lit(pad) + (1 - (F.col("v") - lo) / span) * (height - 2 * pad)
    return points.select("t", "v", x.alias("x"), y.alias("y"))


#: Fixed values of the macro strip: table, SECID, id, name, unit, value columns, place; of rows with
#: one id the first that has a value stays.
MACRO = (
    ("indices", "RGBI", "RGBI", "Гособлигации RGBI", "", INDEX_VALUE, 0),
    ("currency", "CNYRUB_TOM", "CNY", "Юань", "₽", CURRENCY_VALUE, 1),
    ("fixing", "USDFIX", "USD", "Доллар (фиксинг)", "₽", FIXING_VALUE, 2),
    ("fixing", "EURFIX", "EUR", "Евро (фиксинг)", "₽", FIXING_VALUE, 3),
    ("currency", "USD000UTSTOM", "USD", "Доллар", "₽", CURRENCY_VALUE, 4),
    ("currency", "EUR_RUB__TOM", "EUR", "Евро", "₽", CURRENCY_VALUE, 5),
)
FUTURE = ("BRENT", "Нефть Brent", "$", 6)


def macro_rows(securities: DataFrame, marketdata: DataFrame, values: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """SECID, value, raw change of the first row of each SECID."""
    keys = [*by, "SECID"]
    rest = [c for c in marketdata.columns if c not in (*keys, "ord")]
    firsts = marketdata.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("m"), F.min("ord").alias("ord"))
    rows = firsts.select(*keys, "ord", "m.*").join(last_by_id(securities, by), keys, "left")
    value = num(first_of(rows, values))
    previous = num(first_of(rows, MACRO_PREVIOUS, "s_"))
    computed = F.when(previous != 0, (value - previous) / previous * 100)
    return rows.select(*keys, "ord", value.alias("value"), F.coalesce(num(first_of(rows, MACRO_CHANGE)), computed).alias("raw")).filter("value is not null")


def macro(tables: dict[str, tuple[DataFrame, DataFrame]], futures: list[tuple[DataFrame, DataFrame]] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """id, name, unit, value, change, place. tables maps a name to (securities, marketdata); what is absent is left out.

    by names the columns of a board's key where the tables hold several boards. A table is read once
    for all its values.
    """
    parts = []
    named = lambda rows, own_id, name, unit, place: rows.select(
        *by, F.lit(own_id).alias("id"), F.lit(name).alias("name"), F.lit(unit).alias("unit"), "value", "raw", F.lit(place).alias("place")
    )
    for table in dict.fromkeys(m[0] for m in MACRO):
        wanted = [m for m in MACRO if m[0] == table]
        if table in tables:
            rows = macro_rows(*tables[table], wanted[0][5], by)
            parts += [named(rows.filter(F.col("SECID") == secid), own_id, name, unit, place) for _, secid, own_id, name, unit, _, place in wanted]
    for i, (securities, marketdata) in enumerate(futures):
        rest = [c for c in marketdata.columns if c not in by]
        first = marketdata.groupBy(*by).agg(F.min_by(F.struct(*rest), "ord").alias("m")).select(*by, "m.*")
        trades = num(first_of(first, FUTURE_TRADES)) > 0
        rows = macro_rows(securities, first.filter(trades & (num(first_of(first, ("LAST",))) != 0)), ("LAST",), by)
        own_id, name, unit, place = FUTURE
        parts.append(named(rows, own_id, name, unit, place + i))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    one = every.groupBy(*by, "id").agg(F.min_by(F.struct("name", "unit", "value", "raw", "place"), "place").alias("r")).select(*by, "id", "r.*")
    # A dollar or euro of the currency market stands after the fixings' place either way.
    return one.withColumn("change", round2("raw")).drop("raw").orderBy(*by, "place")


def candles_of(events: DataFrame, ts: str, value: str, width: str) -> DataFrame:
    """Candles from ticks: begin, end, open, close, high, low, n. One aggregation with partial results per task."""
    w = F.window(F.col(ts), width)
    by = events.groupBy(w.alias("w")).agg(
        F.min_by(value, F.struct(ts, value)).alias("open"),
        F.max_by(value, F.struct(ts, value)).alias("close"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.count(F.lit(1)).alias("n"),
    )
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return by.select(stamp(F.col("w.start")).alias("begin"), stamp(F.col("w.end")).alias("end"), "open", "close", "high", "low", "n")
