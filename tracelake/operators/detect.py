"""Signature hits, and findings from frequencies.

Every signature is one regular expression over the line, and lines are matched in batches. The signatures
that hit make an array in rule order, which is exploded: a scan and a Generate, no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.rules.signatures import AUTH_FAILURES, ENUMERATION, SIGNATURES
from tracelake.rx import any_of, any_sql, bit, gate, occurring, quoted
from tracelake.session import ship
from tracelake.store import cut

EVIDENCE = 240
AUTH_LEAST, AUTH_HIGH, MISSING_LEAST = 5, 20, 15
FINDINGS = ("line_number", "ts", "category", "rule_no", "severity", "confidence", "evidence", "source_ip")


def truncate(text: Column, most: int) -> Column:
    """A text, or its start and an ellipsis if it is longer than `most`."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def truncate_sql(text: str, most: int) -> str:
    return f"CASE WHEN length({text}) <= {most} THEN {text} ELSE {text}[1:{most - 1}] || '…' END"


def haystack() -> Column:
    """What rules look at: the raw line, or the message of an entry without one."""
    return F.coalesce(F.when(F.col("raw") != "", F.col("raw")), F.col("message"))


def rule_hits(entries: DataFrame) -> DataFrame:
    """A row for each entry and signature that hits it: the entry's columns and the signature's."""
    ship(entries.sparkSession)
    rows = entries.withColumn("bits__", occurring(haystack(), RULES))
    # The outer form keeps Spark from matching the rules once more for whether there are any.
    hits = rows.withColumn("rule_no", F.explode_outer(numbered_rules(F.col("bits__")))).where("rule_no is not null").drop("bits__")
    return with_rules(hits)


#: The patterns of each signature, by its number.
RULES = [s.patterns for s in SIGNATURES]


def numbered_rules(bits: Column, first: int = 0) -> Column:
    """The numbers of the signatures whose bits are set, from bit `first` on; null if there are none."""
    numbers = F.array_compact(F.array(*[F.when(bit(bits, first + no), F.lit(no)) for no in range(len(SIGNATURES))]))
    return F.when(bits.bitwiseAND(F.lit(((1 << len(SIGNATURES)) - 1) << first).cast("long")) != 0, numbers)


def rule_numbers(text: Column, lower: Column) -> Column:
    """The numbers of the signatures that hit a text, in their order; a text without a literal of any of them is passed by with one test."""
    numbers = F.array_compact(F.array(*[F.when(any_of(text, s.patterns, lower), F.lit(no)) for no, s in enumerate(SIGNATURES)]))
    some = gate(lower, tuple(p for s in SIGNATURES for p in s.patterns))
    return numbers if some is None else F.when(some, numbers).otherwise(F.array().cast("array<int>"))


def with_rules(hits: DataFrame) -> DataFrame:
    """`hits` (with rule_no) and the columns of their signatures."""
    rules = F.array(*[F.struct(F.lit(s.code).alias("code"), F.lit(s.severity).alias("severity"), F.lit(s.technique).alias("technique_id"), F.lit(s.name).alias("technique"), F.lit(s.tactic).alias("tactic_id"), F.lit(",".join(s.cves)).alias("cves")) for s in SIGNATURES])
    return hits.withColumn("rule__", F.get(rules, F.col("rule_no"))).select("*", "rule__.*").drop("rule__")


def hits_sql(entries: str) -> str:
    """The same for DuckDB, of a subquery of entries."""
    text = "coalesce(nullif(raw, ''), message)"
    tests = ", ".join(f"CASE WHEN {any_sql(text, s.patterns)} THEN {no} END" for no, s in enumerate(SIGNATURES))
    rules = ", ".join(f"({no}, {quoted(s.code)}, '{s.severity}', '{s.technique}', {quoted(s.name)}, '{s.tactic}', '{','.join(s.cves)}')" for no, s in enumerate(SIGNATURES))
    return f"""SELECT e.*, r.* FROM (SELECT *, unnest(list_filter([{tests}], lambda x: x IS NOT NULL)) AS no FROM ({entries})) e
      JOIN (VALUES {rules}) AS r(rule_no, code, severity, technique_id, technique, tactic_id, cves) ON e.no = r.rule_no"""


def counts() -> list[Column]:
    """Aggregates of a source address: missing (404) requests, and the first line of those and of denied ones (401, 403)."""
    denied, missing = F.col("status_code").isin(401, 403), F.col("status_code") == 404

    def first(c: Column, name: str) -> list[Column]:
        # Numbers and not a struct, for which Spark would sort all lines by their address.
        line = F.when(c, F.col("line_number"))
        return [F.min(line).alias(f"{name}_line"), F.min_by("ts", line).alias(f"{name}_ts")]

    return [*first(denied, "first_denied"), F.count_if(missing).alias("missing"), *first(missing, "first_missing")]


def behaviour(entries: DataFrame) -> DataFrame:
    """Per source address: counts of denied (401, 403) and missing (404) requests, and the first line of each kind.

    One grouping with map-side combining; the rows of an address never meet.
    """
    denied = F.count_if(F.col("status_code").isin(401, 403)).alias("denied")
    return entries.where("source_ip is not null").groupBy("source_ip").agg(denied, *counts())


def _finding(first: str, category: str, no: int, severity: Column, count: str, codes: str) -> Column:
    evidence = F.concat(F.col("source_ip"), F.lit(": "), F.col(count).cast("string"), F.lit(f"× ({codes})"))
    return F.struct(F.col(f"{first}_line").alias("line_number"), F.col(f"{first}_ts").alias("ts"), F.lit(category).alias("category"), F.lit(no).alias("rule_no"), severity.alias("severity"), F.lit("assessment").alias("confidence"), evidence.alias("evidence"), "source_ip")


def frequent(counts: DataFrame) -> DataFrame:
    """Findings of addresses with many denied requests, and of those with many requests for what isn't there."""
    severity = F.when(F.col("denied") >= AUTH_HIGH, "high").otherwise("medium")
    denied = F.when(F.col("denied") >= AUTH_LEAST, _finding("first_denied", AUTH_FAILURES, len(SIGNATURES), severity, "denied", "401/403"))
    missing = F.when(F.col("missing") >= MISSING_LEAST, _finding("first_missing", ENUMERATION, len(SIGNATURES) + 1, F.lit("medium"), "missing", "404"))
    return counts.select(F.explode(F.array_compact(F.array(denied, missing))).alias("f")).select("f.*")


def brute_force(counts: DataFrame) -> DataFrame:
    """Addresses with many denied requests."""
    return frequent(counts).where(F.col("category") == AUTH_FAILURES)


def enumeration(counts: DataFrame) -> DataFrame:
    """Addresses with many requests for what isn't there."""
    return frequent(counts).where(F.col("category") == ENUMERATION)


def findings(hits: DataFrame, counts: DataFrame) -> DataFrame:
    """Findings of signature hits and of counts per address."""
    own = hits.select("line_number", "ts", F.col("code").alias("category"), "rule_no", "severity", F.lit("fact").alias("confidence"), truncate(F.trim(haystack()), EVIDENCE).alias("evidence"), "source_ip")
    return own.unionByName(frequent(counts))


def anomalies(entries: DataFrame) -> DataFrame:
    """All findings of log entries. Lines are parsed and matched once: what both kinds of findings need is written."""
    ship(entries.sparkSession)
    rows = entries.select("line_number", "ts", "source_ip", "status_code", haystack().alias("text__")).withColumn("bits__", occurring(F.col("text__"), RULES))
    seen = cut(rows.select("line_number", "ts", "source_ip", "status_code", numbered_rules(F.col("bits__")).alias("rules"), F.when(F.col("bits__") != 0, truncate(F.trim("text__"), EVIDENCE)).alias("text")), "seen")
    return findings(seen_hits(seen), behaviour(seen))


def seen_hits(seen: DataFrame) -> DataFrame:
    """As `rule_hits`, of lines with the numbers of their signatures (`rules`) and the start of their text: (line_number, ts, source_ip, raw, message) and the signature's columns."""
    rows = seen.where("rules is not null").select("line_number", "ts", "source_ip", F.col("text").alias("raw"), F.lit(None).cast("string").alias("message"), F.explode("rules").alias("rule_no"))
    return with_rules(rows)


def behaviour_sql(entries: str) -> str:
    n = len(SIGNATURES)
    return f"""SELECT * FROM (
      SELECT source_ip, count(*) FILTER (status_code IN (401, 403)) AS n, '{AUTH_FAILURES}' AS category, {n} AS rule_no, '401/403' AS codes, {AUTH_LEAST} AS least,
        arg_min(struct_pack(line_number, ts), line_number) FILTER (status_code IN (401, 403)) AS first FROM ({entries}) WHERE source_ip IS NOT NULL GROUP BY source_ip
      UNION ALL
      SELECT source_ip, count(*) FILTER (status_code = 404), '{ENUMERATION}', {n + 1}, '404', {MISSING_LEAST},
        arg_min(struct_pack(line_number, ts), line_number) FILTER (status_code = 404) FROM ({entries}) WHERE source_ip IS NOT NULL GROUP BY source_ip
    ) WHERE n >= least"""


def anomalies_sql(entries: str) -> str:
    text = "trim(coalesce(nullif(raw, ''), message))"
    return f"""SELECT line_number, ts, code AS category, rule_no, severity, 'fact' AS confidence, {truncate_sql(text, EVIDENCE)} AS evidence, source_ip FROM ({hits_sql(entries)})
      UNION ALL SELECT first.line_number, first.ts, category, rule_no, CASE WHEN category = '{AUTH_FAILURES}' AND n >= {AUTH_HIGH} THEN 'high' ELSE 'medium' END, 'assessment', source_ip || ': ' || n || '× (' || codes || ')', source_ip FROM ({behaviour_sql(entries)})"""
