"""Numbers and times as a reader sees them, each also as DuckDB text.

Rounding is half up on the exact value, as it is where the forms come from.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB")
NONE = "—"


def bytes_said(n: Column) -> Column:
    """Bytes in the largest unit up to GB that they fill, one decimal below ten; missing and negative counts are 0 B."""
    n = F.coalesce(n, F.lit(0))
    out = F.lit(None).cast("string")
    for k, unit in reversed(list(enumerate(UNITS))):
        v = n.cast("double") / float(1024**k)
        tenths = F.floor(v * 10 + 0.5)
        whole = F.floor(v + 0.5).cast("string")
        said = whole if k == 0 else F.when(v >= 10, whole).otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")))
        said = F.concat(said, F.lit(f" {unit}"))
        out = said if k == len(UNITS) - 1 else F.when(n < 1024 ** (k + 1), said).otherwise(out)
    return F.when(n <= 0, "0 B").otherwise(out)


def bytes_said_sql(n: str) -> str:
    n = f"coalesce({n}, 0)"
    cases = []
    for k, unit in enumerate(UNITS):
        v = f"({n}::DOUBLE / {float(1024**k)}::DOUBLE)"
        whole, tenths = f"floor({v} + 0.5)::BIGINT::VARCHAR", f"floor({v} * 10 + 0.5)::BIGINT"
        said = whole if k == 0 else f"CASE WHEN {v} >= 10 THEN {whole} ELSE ({tenths} // 10)::VARCHAR || '.' || ({tenths} % 10)::VARCHAR END"
        cases.append(f"({said}) || ' {unit}'" if k == len(UNITS) - 1 else f"WHEN {n} < {1024 ** (k + 1)} THEN ({said}) || ' {unit}'")
    return f"CASE WHEN {n} <= 0 THEN '0 B' {' '.join(cases[:-1])} ELSE {cases[-1]} END"


def number_said(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)


def number_said_sql(n: str) -> str:
    return f"format('{{:,}}', {n})"


def percent_said(share: Column, digits: int = 0) -> Column:
    """A share as a percentage."""
    scaled = F.floor(share * (100 * 10**digits) + 0.5)
    if not digits:
        return F.concat(scaled.cast("string"), F.lit("%"))
    return F.concat(F.floor(scaled / 10**digits).cast("string"), F.lit("."), F.lpad((scaled % 10**digits).cast("string"), digits, "0"), F.lit("%"))


def percent_said_sql(share: str, digits: int = 0) -> str:
    scaled = f"floor({share} * {100 * 10**digits} + 0.5)::BIGINT"
    return f"{scaled}::VARCHAR || '%'" if not digits else f"({scaled} // {10**digits})::VARCHAR || '.' || lpad(({scaled} % {10**digits})::VARCHAR, {digits}, '0') || '%'"


def time_said(ts: Column) -> Column:
    """The time of day."""
    return F.coalesce(F.date_format(ts, "HH:mm:ss"), F.lit(NONE))


def time_said_sql(ts: str) -> str:
    return f"coalesce(strftime({ts}, '%H:%M:%S'), '{NONE}')"


# After these signs a long value may break.
BREAKS = r"([/\\._:@=&?-])"


def breakable(text: Column) -> Column:
    """A text with a zero-width space after each sign at which a word processor may break it."""
    return F.regexp_replace(text, BREAKS, "$1\u200b")


def breakable_sql(text: str) -> str:
    return f"regexp_replace({text}, '{BREAKS}', '\\1\u200b', 'g')"
