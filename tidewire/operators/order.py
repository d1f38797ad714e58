"""Rows in one order over a whole table: places, pages and running sums without a task that sees all rows.

Rows are dealt to ranges of the order, sorted in their range and stored by it. What a range needs of the ranges before
it (how many rows, what sum) is one number for each, of which there are as many as partitions; these few come to the
driver. A page is read from the ranges that it lies in. Equal keys can be split between ranges, so the order
must tell all rows apart (end it with ord) if places are to be stable.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of the stored rows: the range, and the place in it.
PART, AT = "__part", "__at"


class Ordered:
    """Rows stored by ranges of their order."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    @classmethod
    def store(cls, rows: DataFrame, order: Sequence[Column], path: str, parts: int | None = None) -> Ordered:
        spark = rows.sparkSession
        n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # The engine numbers rows of a task one after another, as they come: in their order, after the sort.
        placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
        split = placed.select("*", F.shiftrightunsigned("__id", 33).cast("int").alias(PART), F.col("__id").bitwiseAND((1 << 33) - 1).alias(AT)).drop("__id")
        split.write.mode("overwrite").partitionBy(PART).parquet(path)
        return cls(spark.read.schema(split.schema).parquet(path))

    def before(self, value: Column) -> list[tuple[int, int, int]]:
        """(range, sum of a whole number in all ranges before, sum in it), in order; one row a range."""
        sums = sorted((r[0], r[1] or 0) for r in self.rows.groupBy(PART).agg(F.sum(value)).collect())
        starts = accumulate((s for _, s in sums), initial=0)
        return [(part, start, own) for (part, own), start in zip(sums, starts, strict=False)]

    def offsets(self, value: Column) -> DataFrame:
        found = [(part, start) for part, start, _ in self.before(value)]
        return F.broadcast(self.rows.sparkSession.createDataFrame(found, f"{PART} int, __start long"))

    def numbered(self, name: str = "rn") -> DataFrame:
        """All rows with their place, from 1."""
        return self.rows.join(self.offsets(F.lit(1)), PART).withColumn(name, F.col("__start") + F.col(AT) + 1).drop(PART, AT, "__start")

    def page(self, start: int, size: int, name: str = "rn") -> DataFrame:
        """Rows start+1 .. start+size with their place; only the ranges that hold them are read."""
        held = [(part, first) for part, first, n in self.before(F.lit(1)) if first < start + size and start < first + n]
        first = F.coalesce(*[F.when(F.col(PART) == part, F.lit(n)) for part, n in held]) if held else F.lit(0)
        rows = self.rows.filter(F.col(PART).isin([part for part, _ in held]) if held else F.lit(False)).withColumn(name, first + F.col(AT) + 1)
        return rows.filter(F.col(name).between(start + 1, start + size)).drop(PART, AT)

    def running(self, value: Column, name: str) -> DataFrame:
        """All rows with the sum of a whole number over them and all rows before."""
        own = F.sum("__value").over(Window.partitionBy(PART).orderBy(AT))
        rows = self.rows.withColumn("__value", value).withColumn("__own", own).join(self.offsets(value), PART)
        return rows.withColumn(name, F.col("__start") + F.col("__own")).drop(PART, AT, "__value", "__own", "__start")
