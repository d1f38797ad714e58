"""Treemap of the board: sector sums in SQL, the greedy layout in one small group per board.

A board has at most 40 tiles, so a layout is one group of bounded size; many boards (a key column)
are laid out in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.market import OTHER, TILES

#: Fixed values of the layout: share under which sectors merge, label sizes, text steps as
#: (name, ticker font, change font), character width and slack, narrow screens, dropping of crumbs.
SMALL_SECTOR = 0.02
LABEL_WIDTH, LABEL_HEIGHT_MIN, SIDE_HEIGHT, SIDE_WIDTH, LABEL = 92, 46, 92, 40, 17
TEXT_STEPS = (("", 13, 12), ("sm", 11, 0), ("micro", 9, 0))
CHAR_EM, SLACK = 0.66, 8
NARROW_WIDTH, NARROW_TILES = 520, 24
PASSES, LEAST_TILES = 4, 12


def sector_sums(tiles: DataFrame, small: float = SMALL_SECTOR) -> DataFrame:
    """sector, value, n: sums of weights; if several sectors are small, they join the rest sector."""
    by = tiles.groupBy("sector").agg(F.sum("weight").alias("value"), F.count(F.lit(1)).alias("n")).filter("value > 0")
    everything = Window.partitionBy(F.lit(1))  # a board has a handful of sectors
    tiny = (F.col("value") / F.sum("value").over(everything) < small) & (F.col("sector") != OTHER)
    marked = by.withColumn("tiny", tiny).withColumn("tiny_n", F.sum(F.col("tiny").cast("int")).over(everything))
    name = F.when(F.col("tiny") & (F.col("tiny_n") > 1), OTHER).otherwise(F.col("sector"))
    return marked.withColumn("sector", name).groupBy("sector").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))


def squarify(values: Sequence[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """Rectangles (x, y, w, h) of falling positive values: rows along the shorter side, as square as they get."""
    out: list[tuple[float, float, float, float]] = []
    left = float(sum(values))
    i = 0
    while i < len(values) and left > 0 and w > 0 and h > 0:
        side, area = min(w, h), w * h
        # Grow the row while its worst side ratio does not get worse.
        total, best, end = 0.0, float("inf"), i
        while end < len(values):
            grown = total + values[end]
            thick = grown / left * area / side
            lengths = [v / grown * side if grown else 0.0 for v in (values[i], values[end])]
            # Within a row the ratio is worst at its largest or its smallest value.
            worst = max((max(thick / a, a / thick) if a and thick else float("inf")) for a in lengths)
            if end > i and worst > best:
                break
            total, best, end = grown, worst, end + 1
        thick = total / left * area / side
        at = y if w >= h else x
        for v in values[i:end]:
            length = v / total * side if total else 0.0
            out.append((x, at, thick, length) if w >= h else (at, y, length, thick))
            at += length
        if w >= h:
            x, w = x + thick, w - thick
        else:
            y, h = y + thick, h - thick
        left -= total
        i = end
    return out


def text_step(w: float, h: float, ticker: str, change: str) -> str:
    """The largest label that fits a tile; an empty name is ticker and change in full size."""
    for name, font, small in TEXT_STEPS:
        chars = len(change) * small if small and len(change) > len(ticker) else len(ticker) * font
        high = font * 1.15 + (small * 1.15 + 5 if small else 6)
        if w >= chars * CHAR_EM + SLACK and h >= high:
            return name
    return "tiny"


def text_step_column(w: Column, h: Column, ticker: Column, change: Column) -> Column:
    """text_step as an expression."""
    out = F.lit("tiny")
    for name, font, small in reversed(TEXT_STEPS):
        chars = F.length(ticker) * font
        if small:
            chars = F.when(F.length(change) > F.length(ticker), F.length(change) * small).otherwise(chars)
        high = font * 1.15 + (small * 1.15 + 5 if small else 6)
        out = F.when((w >= chars * CHAR_EM + SLACK) & (h >= high), name).otherwise(out)
    return out


def change_text(change: float | None) -> str:
    v = change or 0.0
    return ("+" if v > 0 else "−" if v < 0 else "") + f"{abs(v):.2f}".replace(".", ",") + "%"


def lay_out(stocks: list[dict], width: float, height: float) -> list[dict]:
    """Tiles of stocks (ticker, sector, weight, change): absolute boxes, sector boxes and labels."""
    groups: dict[str, list[dict]] = {}
    for s in stocks:
        groups.setdefault(s["sector"] or OTHER, []).append(s)
    weight = lambda s: s["weight"] or 0.0
    sectors = [(name, sum(map(weight, members)), members) for name, members in groups.items()]
    sectors = sorted((s for s in sectors if s[1] > 0), key=lambda s: -s[1])
    total = sum(s[1] for s in sectors)
    tiny = [s for s in sectors if s[1] / total < SMALL_SECTOR and s[0] != OTHER]
    if len(tiny) > 1:
        rest = [s for s in sectors if s[0] == OTHER]
        joined = {s[0] for s in rest + tiny}
        merged = (OTHER, sum(s[1] for s in rest + tiny), [s for s in stocks if (s["sector"] or OTHER) in joined])
        kept = [merged if s[0] == OTHER else s for s in sectors if s not in tiny]
        sectors = sorted(kept if rest else [*kept, merged], key=lambda s: -s[1])
    out = []
    for (name, _, members), (x, y, w, h) in zip(sectors, squarify([s[1] for s in sectors], 0.0, 0.0, width, height), strict=False):
        across = w >= LABEL_WIDTH and h >= LABEL_HEIGHT_MIN
        down = not across and h >= SIDE_HEIGHT and w >= SIDE_WIDTH
        top, side = LABEL * across, LABEL * down
        members = sorted(members, key=lambda s: -weight(s))
        inner = squarify([weight(m) for m in members], side, top, max(w - side, 1), max(h - top, 1))
        for m, (tx, ty, tw, th) in zip(members, inner, strict=False):
            out.append(
                m | {"group": name, "label": "across" if across else "down" if down else "", "gx": x, "gy": y, "gw": w, "gh": h}
                | {"x": tx, "y": ty, "w": tw, "h": th, "fit": text_step(tw, th, m["ticker"] or "", change_text(m["change"]))}
            )
    return out


def fitted(stocks: list[dict], width: float, height: float) -> list[dict]:
    """A layout without unreadable tiles: crumbs go, smallest first (of equal ones the last), and the rest is laid out again."""
    weight = lambda s: s["weight"] or 0.0
    shown = sorted(stocks, key=lambda s: -weight(s))
    if width < NARROW_WIDTH:
        shown = shown[:NARROW_TILES]
    cells = lay_out(shown, width, height)
    for _ in range(PASSES):
        place = {s["ticker"]: i for i, s in enumerate(shown)}
        crumbs = sorted((c for c in cells if c["fit"] == "tiny"), key=lambda s: (weight(s), -place[s["ticker"]]))
        drop = {c["ticker"] for c in crumbs[: max(0, len(shown) - LEAST_TILES)]}
        if not drop:
            break
        shown = [s for s in shown if s["ticker"] not in drop]
        cells = lay_out(shown, width, height)
    return cells


SCHEMA = (
    "board string, ticker string, sector string, weight double, change double, group string, label string, gx double, gy double, "
    "gw double, gh double, x double, y double, w double, h double, fit string"
)


def treemaps(tiles: DataFrame, width: float = 960.0, height: float = 340.0) -> DataFrame:
    """Layout of every board (board, ticker, sector, weight, change, ord); boards hold at most 40 tiles."""
    rn = F.row_number().over(Window.partitionBy("board").orderBy(F.col("weight").desc(), "ord"))
    bounded = tiles.withColumn("rn", rn).filter(F.col("rn") <= TILES).select("board", "ticker", "sector", "weight", "change", "rn")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("rn").drop(columns="rn").to_dict("records")
        names = [c.strip().split()[0] for c in SCHEMA.split(",")]
        return pd.DataFrame(fitted(rows, width, height), columns=names)

    return bounded.groupBy("board").applyInPandas(run, SCHEMA)
