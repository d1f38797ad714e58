"""Numbers as exchange tables and displays have them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import SPACE


def pick(*names: Column) -> Column:
    """The first value that is neither null nor empty; what it holds is not looked at."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in names])


def num(x: Column) -> Column:
    """A finite number, or null. The first comma is a decimal point; blank text is zero."""
    # The value stands once in the expression: quotes nest several of these.
    s = F.regexp_replace(F.regexp_replace(x.cast("string"), f"^[{SPACE}]+$", "0"), f"^[{SPACE}]+|[{SPACE}]+$", "")
    number = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?(?:[0-9]{1,2}|[12][0-9]{2}))?$"
    return F.regexp_extract(F.regexp_replace(s, "^([^,]*),", "$1."), number, 0).try_cast("double")


def round2(x: Column | str) -> Column:
    """Two digits, halves away from zero on the exact binary value: 1.005 is less than a half.

    Decimal rounding of the engine starts from the shortest text of a number, which differs at ties. The
    fraction of a number from 2^-8 on is a whole number of 2^-60, so whole-number arithmetic is exact;
    smaller numbers round to zero.
    """
    unit = 1 << 60

    def rounded(v: Column) -> Column:
        size = F.abs(v)
        whole = F.floor(size)
        fraction = ((size - whole) * F.lit(float(unit))).cast("long").cast("decimal(20,0)")
        cents = F.call_function("div", fraction * F.lit(200).cast("decimal(3,0)") + F.lit(unit).cast("decimal(20,0)"), F.lit(2 * unit).cast("decimal(20,0)"))
        near = F.signum(v) * (whole * 100 + cents) / 100
        # Numbers from 2^52 on are whole. Zero has no sign.
        return F.when(size >= float(1 << 52), v).when(near == 0, 0.0).otherwise(near)

    # The value stands once in the expression, whatever it is made of.
    return F.get(F.transform(F.array(F.col(x) if isinstance(x, str) else x), rounded), F.lit(0))


#: Sizes of change at which the heat scale steps up.
HEAT_LIMITS = (0.1, 0.5, 1.2, 2.5, 4.0)


def heat_step(change: Column) -> Column:
    size = F.abs(change)
    level = F.lit(1)
    for i, limit in enumerate(HEAT_LIMITS[1:], 2):
        level = F.when(size >= limit, F.lit(i)).otherwise(level)
    side = F.when(change > 0, "u").otherwise("d")
    return F.when(size < HEAT_LIMITS[0], F.lit("zero")).otherwise(F.concat(side, level.cast("string")))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """Russian plural form."""
    a, b = F.abs(n) % 10, F.abs(n) % 100
    return F.when((a == 1) & (b != 11), one).when(a.between(2, 4) & ~b.between(12, 14), few).otherwise(many)


def grouped(x: Column, digits: int) -> Column:
    """A number with non-breaking spaces between thousands and a decimal comma."""
    s = F.format_number(x, digits)
    return F.translate(s, ",.", chr(0xA0) + ",")


def format_money(x: Column) -> Column:
    """Roubles in billions, millions or whole; one digit after the comma at most."""
    short = lambda v: F.regexp_replace(grouped(v, 1), ",0$", "")
    return (
        F.when(F.abs(x) >= 1e9, F.concat(short(x / 1e9), F.lit(" млрд ₽")))
        .when(F.abs(x) >= 1e6, F.concat(short(x / 1e6), F.lit(" млн ₽")))
        .otherwise(F.concat(grouped(F.floor(x + 0.5), 0), F.lit(" ₽")))
    )


def format_change(x: Column) -> Column:
    v = F.coalesce(x, F.lit(0.0))
    sign = F.when(v > 0, "+").when(v < 0, "−").otherwise("")
    return F.concat(sign, F.replace(F.format_string("%.2f", F.abs(v)), F.lit("."), F.lit(",")), F.lit("%"))
