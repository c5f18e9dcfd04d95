"""Timestamps out of log lines.

Four forms are tried in turn: Apache with an optional offset, ISO (a zone suffix is ignored), syslog
(without a year; YEAR is taken), and epoch seconds or milliseconds. The first form that occurs
decides. Times without an offset are in the session's time zone, UTC in this library; a date that
doesn't exist gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.rx import Rx

# The year of times without one, the four forms in the order in which they are tried, and months.
YEAR = 2026
APACHE = Rx(r"\[(\d{2})/([A-Za-z]{3})/(\d{4}):(\d{2}):(\d{2}):(\d{2})(?:\s*([+-]\d{4}))?", False)
ISO = Rx(r"(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2}):(\d{2})(?:\.\d+)?", False)
SYSLOG = Rx(r"\b([A-Za-z]{3})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})\b", False)
EPOCH = Rx(r"\b(1[0-9]{9})(\d{3})?\b", False)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _found(text: Column, rx: Rx) -> Column:
    return F.regexp_extract(text, rx.java, 0)


def _month(name: Column) -> Column:
    """Two digits, or null if it is no month."""
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name))
    return F.when(at > 0, F.lpad(at.cast("string"), 2, "0"))


def _stamp(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).try_cast("timestamp")


def _instant(a: Column, i: Column, s: Column, e: Column) -> Column:
    """The instant that the first form found names: Apache, ISO, syslog, epoch."""
    offset = F.trim(F.substring(a, 22, 20))
    minutes = F.when(F.length(offset) == 5, F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1) * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 4, 2).try_cast("int"))).otherwise(0)
    month = _month(F.substring(a, 5, 3))
    apache = _stamp(F.substring(a, 9, 4), "-", month, "-", F.substring(a, 2, 2), " ", F.substring(a, 14, 8)) - F.make_interval(mins=minutes)
    iso = _stamp(F.substring(i, 1, 10), " ", F.substring(i, 12, 8))
    parts = F.split(s, r"\s+")
    when = _month(F.get(parts, F.lit(0)))
    syslog = _stamp(str(YEAR), "-", when, "-", F.lpad(F.get(parts, F.lit(1)), 2, "0"), " ", F.get(parts, F.lit(2)))
    millis = F.when(F.length(e) == 13, e.try_cast("bigint")).otherwise(e.try_cast("bigint") * 1000)
    return F.when((a != "") & month.isNotNull(), apache).when(i != "", iso).when((s != "") & when.isNotNull(), syslog).when(e != "", F.timestamp_millis(millis))


def parse_timestamp(text: Column) -> Column:
    """The instant a text names, or null."""
    return _instant(*(_found(text, rx) for rx in (APACHE, ISO, SYSLOG, EPOCH)))


def with_timestamp(df: DataFrame, text: str, out: str = "ts") -> DataFrame:
    """`df` with the instant that a text column names; each form is looked for once, and only where none before it decides."""
    names = ("apache__", "iso__", "syslog__", "epoch__")
    apache, iso, syslog, epoch = map(F.col, names)
    text_ = F.col(text)
    found = df.withColumn("apache__", _found(text_, APACHE))
    found = found.withColumn("open__", ~((apache != "") & _month(F.substring(apache, 5, 3)).isNotNull()))
    found = found.withColumn("iso__", F.when(F.col("open__"), _found(text_, ISO))).withColumn("open__", F.col("open__") & (iso == ""))
    found = found.withColumn("syslog__", F.when(F.col("open__"), _found(text_, SYSLOG)))
    found = found.withColumn("open__", F.col("open__") & ~((syslog != "") & _month(F.get(F.split(syslog, r"\s+"), F.lit(0))).isNotNull()))
    found = found.withColumn("epoch__", F.when(F.col("open__"), _found(text_, EPOCH)))
    return found.withColumn(out, _instant(apache, iso, syslog, epoch)).drop(*names, "open__")


def parse_timestamp_sql(text: str) -> str:
    """The same for DuckDB."""
    a, i, s, e = (f"regexp_extract({text}, '{rx.re2}')" for rx in (APACHE, ISO, SYSLOG, EPOCH))

    def month(name: str) -> str:
        at = f"list_position({list(MONTHS)}, lower({name}))"
        return f"CASE WHEN {at} > 0 THEN lpad(cast({at} AS STRING), 2, '0') END"

    off = f"trim({a}[22:])"
    minutes = f"CASE WHEN length({off}) = 5 THEN (CASE WHEN {off}[1] = '-' THEN -1 ELSE 1 END) * (cast({off}[2:3] AS INT) * 60 + cast({off}[4:5] AS INT)) ELSE 0 END"
    am, sm = month(f"{a}[5:7]"), month(f"regexp_extract({s}, '^[A-Za-z]+')")
    apache = f"try_cast({a}[9:12] || '-' || ({am}) || '-' || {a}[2:3] || ' ' || {a}[14:21] AS TIMESTAMP) - to_minutes({minutes})"
    iso = f"try_cast({i}[1:10] || ' ' || {i}[12:19] AS TIMESTAMP)"
    day, clock = f"regexp_extract({s}, '\\s(\\d{{1,2}})\\s', 1)", f"regexp_extract({s}, '\\d{{2}}:\\d{{2}}:\\d{{2}}')"
    syslog = f"try_cast('{YEAR}-' || ({sm}) || '-' || lpad({day}, 2, '0') || ' ' || {clock} AS TIMESTAMP)"
    millis = f"CASE WHEN length({e}) = 13 THEN try_cast({e} AS BIGINT) ELSE try_cast({e} AS BIGINT) * 1000 END"
    return f"CASE WHEN {a} <> '' AND ({am}) IS NOT NULL THEN {apache} WHEN {i} <> '' THEN {iso} WHEN {s} <> '' AND ({sm}) IS NOT NULL THEN {syslog} WHEN {e} <> '' THEN make_timestamp(({millis}) * 1000) END"


def said(ts: Column) -> Column:
    """A timestamp as text."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def said_sql(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"
