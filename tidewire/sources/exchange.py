"""Exchange tables: requests, and answers of {columns, data} blocks as frames of text columns."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.dates import RANGES, candle_bounds

#: Addresses of the exchange's tables.
ISS = "https://iss.moex.com/iss"
BOARD = {"iss.meta": "off", "iss.only": "securities,marketdata"}
PATHS = {
    "shares": "/engines/stock/markets/shares/boards/TQBR/securities",
    "indices": "/engines/stock/markets/index/boards/SNDX/securities",
    "candles": "/engines/stock/markets/index/boards/SNDX/securities/IMOEX/candles",
    "currency": "/engines/currency/markets/selt/boards/CETS/securities",
    "fixing": "/engines/currency/markets/index/boards/FIXI/securities",
    "futures": "/engines/futures/markets/forts/securities",
}
CURRENCIES = "CNYRUB_TOM,USD000UTSTOM,EUR_RUB__TOM"


def iss_url(path: str, params: dict[str, object], callback: str | None = None) -> str:
    pairs = {**({"callback": callback} if callback else {}), **params}
    query = "&".join(f"{quote(str(k), safe='')}={quote(str(v), safe='')}" for k, v in pairs.items())
    return f"{ISS}{path}.{'jsonp' if callback else 'json'}?{query}"


def request(kind: str, contract: str | None = None, range_name: str = "day", now: datetime | None = None) -> tuple[str, dict[str, object]]:
    """(path, parameters) of a request."""
    if kind == "future":
        return f"{PATHS['futures']}/{contract}", dict(BOARD)
    if kind == "currency":
        return PATHS["currency"], {**BOARD, "securities": CURRENCIES}
    if kind == "candles":
        from datetime import timedelta

        now = now or datetime.now()
        interval, days = RANGES.get(range_name, RANGES["day"])
        start = now.replace(month=1, day=1) if days is None else now - timedelta(days=days)
        return PATHS["candles"], {"iss.meta": "off", "interval": interval, "from": f"{start:%Y-%m-%d}", "till": f"{now:%Y-%m-%d}"}
    return PATHS[kind], dict(BOARD)


def candles_address(range_name: str, now: Column) -> Column:
    """The address of a candles request, made where the dates are."""
    interval, start, till = candle_bounds(range_name, now)
    head = iss_url(PATHS["candles"], {"iss.meta": "off", "interval": interval})
    return F.concat(F.lit(f"{head}&from="), start, F.lit("&till="), till)


def blocks(answers: DataFrame, block: str) -> DataFrame:
    """Rows of a block of JSON answers (a text column `json`): a map of column name to text, and ord.

    Other columns of the answers, such as a key, go with their rows. A malformed answer, or one
    without the block, gives no rows. Numbers and texts become text.
    """
    others = [c for c in answers.columns if c != "json"]
    schema = f"`{block}` struct<columns:array<string>,data:array<array<string>>>"
    parsed = answers.select(F.from_json("json", f"struct<{schema.replace('` struct', '`:struct')}>").alias("__a"), *others).select(F.col(f"__a.`{block}`").alias("__b"), *others)
    rows = parsed.select(*others, F.col("__b.columns").alias("names"), F.posexplode("__b.data").alias("ord", "row"))
    n = F.least(F.size("names"), F.size("row"))
    return rows.select(*others, "ord", F.map_from_arrays(F.slice("names", F.lit(1), n), F.slice("row", F.lit(1), n)).alias("cells"))


def block_frame(answers: DataFrame, block: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of a block, null where the answer lacks one, and ord."""
    rows = blocks(answers, block)
    return rows.select(*[c for c in rows.columns if c != "cells"], *[F.try_element_at("cells", F.lit(c)).alias(c) for c in columns])


def answer(spark: SparkSession, payload: dict | str) -> DataFrame:
    """One answer as a frame with a json column."""
    text = payload if isinstance(payload, str) else json.dumps(payload, ensure_ascii=False)
    return spark.createDataFrame([(text,)], "json string")
