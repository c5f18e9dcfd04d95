"""Indicators of compromise: extraction and aggregation.

All patterns are evaluated in one projection, whose matches are exploded once; one grouping with
map-side combining aggregates them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.rules.iocs import PATTERNS, PRIVATE, REFERENCE, REFERENCE_OTHER, SEVERITY, STATIC_URL
from tracelake.rx import bit, gate, guard, holds, needed, quoted

#: What every hash holds, whichever its kind.
HEX_RUN = "[a-fA-F0-9]{32}"


def is_private(ip: Column) -> Column:
    """Whether an address is private or reserved."""
    return ip.rlike(PRIVATE.java)


def severity(kind: Column, value: Column) -> Column:
    out = F.when((kind == "ip") & is_private(value), "info")
    for k, s in SEVERITY.items():
        out = out.when(kind == k, s)
    return out.otherwise("low")


def severity_sql(kind: str, value: str) -> str:
    return f"CASE WHEN {kind} = 'ip' AND regexp_matches({value}, {quoted(PRIVATE.re2)}) THEN 'info' " + " ".join(f"WHEN {kind} = '{k}' THEN '{s}'" for k, s in SEVERITY.items()) + " ELSE 'low' END"


def encoded(text: Column) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) as they are."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def encoded_sql(text: str) -> str:
    out = f"url_encode({text})"
    for a, b in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%2A", "*"), ("%27", "''"), ("%28", "("), ("%29", ")")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


def reference_url(kind: Column, value: Column) -> Column:
    """Where an indicator is looked up."""
    base = F.lit(REFERENCE_OTHER)
    for k, url in REFERENCE.items():
        base = F.when(kind == k, url).otherwise(base)
    return F.concat(base, encoded(value))


def reference_sql(kind: str, value: str) -> str:
    return f"(CASE {kind} " + " ".join(f"WHEN '{k}' THEN '{u}'" for k, u in REFERENCE.items()) + f" ELSE '{REFERENCE_OTHER}' END) || {encoded_sql(value)}"


def may_hold(kind: str, rx, text: Column, lower: Column) -> Column:
    """A cheap test that holds wherever a pattern occurs."""
    if kind.startswith("hash-"):
        return text.rlike(HEX_RUN)
    if kind == "domain":  # what a name ends with follows a dot
        return holds(lower, [f".{w}" for w in sorted(needed(rx.text))])
    return guard(lower, (rx,))


#: What a text's matches are.
SHAPE = "array<struct<type:string,value:string,pattern_no:int,at:int>>"


def _matches(no: int, text: Column) -> Column:
    """All matches of a pattern in a text, static URLs left out."""
    kind, rx = PATTERNS[no]
    # An address starts with a digit, which is tried first.
    values = F.regexp_extract_all(text, F.lit(("(?=[0-9])" if kind == "ip" else "") + rx.java), F.lit(0))
    rows = F.transform(values, lambda v, k: F.struct(F.lit(kind).alias("type"), v.alias("value"), F.lit(no).alias("pattern_no"), k.alias("at")))
    return (F.filter(rows, lambda x: ~x["value"].rlike(STATIC_URL.java)) if kind == "url" else rows).cast(SHAPE)


#: The numbers of the patterns that most lines don't match, and those patterns by their bits.
SELDOM = [no for no, (kind, _) in enumerate(PATTERNS) if kind != "ip"]
SELDOM_PATTERNS = [(PATTERNS[no][1],) for no in SELDOM]


def marked(text: Column, bits: Column, first: int = 0) -> Column:
    """As `found`, of a text for which `rx.occurring` has looked for SELDOM_PATTERNS, from bit `first` on: only those that occur are taken out."""
    none = F.array().cast(SHAPE)
    rest = F.concat(*[F.when(bit(bits, first + k), _matches(no, text)).otherwise(none) for k, no in enumerate(SELDOM)])
    some = bits.bitwiseAND(F.lit(((1 << len(SELDOM)) - 1) << first).cast("long")) != 0
    every = [_matches(no, text) for no in range(len(PATTERNS)) if no not in SELDOM]
    return F.when(some, F.concat(*every, rest)).otherwise(F.concat(*every))


def found(text: Column, lower: Column) -> Column:
    """array<struct(type, value, pattern_no, at)> of all matches in a text, static URLs left out."""
    none = F.array().cast(SHAPE)
    each = {kind: F.when(may_hold(kind, rx, text, lower), _matches(no, text)).otherwise(none) for no, (kind, rx) in enumerate(PATTERNS)}
    hashes, rest = [k for k in each if k.startswith("hash-")], [k for k in each if k != "ip" and not k.startswith("hash-")]
    # One test of a text for all kinds that need a literal: most texts hold an address at most.
    ends = {f".{w}" for kind, rx in PATTERNS if kind == "domain" for w in needed(rx.text) or ()}
    some = gate(lower, tuple(rx for kind, rx in PATTERNS if kind in rest and kind != "domain"), *ends)
    found_ = F.concat(*[each[k] for k in rest])
    return F.concat(each["ip"], F.when(text.rlike(HEX_RUN), F.concat(*[each[k] for k in hashes])).otherwise(none), found_ if some is None else F.when(some, found_).otherwise(none))


def ioc_hits(df: DataFrame, text: Column, line: str = "line_number", ts: str | None = "ts") -> DataFrame:
    """(line, ts, type, value, pattern_no, at) of every match; `at` counts the matches of a pattern in its text."""
    when = F.col(ts) if ts else F.lit(None).cast("timestamp")
    rows = df.select(F.col(line).alias("line_number"), when.alias("ts"), text.alias("text__"), F.lower(text).alias("lower__"))
    return rows.select("line_number", "ts", F.explode_outer(found(F.col("text__"), F.col("lower__"))).alias("ioc")).where("ioc is not null").select("line_number", "ts", "ioc.*")


def related(hits: DataFrame) -> DataFrame:
    """(type, key, line_number) of every line that names an indicator, each once; `key` is the indicator in lower case."""
    return hits.select("type", F.lower("value").alias("key"), "line_number").distinct()


def related_sql(hits: str) -> str:
    return f"SELECT DISTINCT type, lower(value) AS key, line_number FROM ({hits})"


def iocs(hits: DataFrame) -> DataFrame:
    """One row an indicator, case ignored: count, first and last time, spelling and severity of the first.

    `first_line`, `first_pattern` and `first_at` order indicators of equal count; `related` has their lines.
    """
    order = F.struct("line_number", "pattern_no", "at")
    out = hits.groupBy("type", F.lower("value").alias("key")).agg(
        F.min_by("value", order).alias("value"),
        F.count("*").alias("count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.min(order).alias("first__"),
        F.count_distinct("line_number").alias("n_lines"),
    )
    out = out.select("type", "value", "count", "first_seen", "last_seen", F.col("first__.line_number").alias("first_line"), F.col("first__.pattern_no").alias("first_pattern"), F.col("first__.at").alias("first_at"), "n_lines")
    return out.withColumn("severity", severity(F.col("type"), F.col("value"))).withColumn("reference", reference_url(F.col("type"), F.col("value")))


def hits_sql(source: str, text: str, line: str = "line_number", ts: str = "ts") -> str:
    """The matches of a DuckDB subquery."""
    parts = [
        f"SELECT {line} AS line_number, {ts} AS ts, '{kind}' AS type, unnest(regexp_extract_all({text}, {quoted(rx.re2)})) AS value, {no} AS pattern_no, generate_subscripts(regexp_extract_all({text}, {quoted(rx.re2)}), 1) AS nth FROM ({source})"
        for no, (kind, rx) in enumerate(PATTERNS)
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE NOT (type = 'url' AND regexp_matches(value, {quoted(STATIC_URL.re2)}))"


def iocs_sql(hits: str) -> str:
    return f"""SELECT type, value, count, first_seen, last_seen, first_line, first_pattern, first_at, n_lines, {severity_sql('type', 'value')} AS severity, {reference_sql('type', 'value')} AS reference FROM (
      SELECT type, arg_min(value, (line_number, pattern_no, nth)) AS value, count(*)::BIGINT AS count, min(ts) AS first_seen, max(ts) AS last_seen, min(line_number) AS first_line, arg_min(pattern_no, (line_number, pattern_no, nth)) AS first_pattern, (arg_min(nth, (line_number, pattern_no, nth)) - 1)::INT AS first_at, count(DISTINCT line_number)::BIGINT AS n_lines
      FROM ({hits}) GROUP BY type, lower(value))"""
