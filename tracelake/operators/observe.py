"""What a line shows, in one pass: signature hits, vulnerabilities and indicators, and what its source address is counted by.

Analyses use these results several times, so they are written once (`store.cut`), a row a line, and every later
operator starts from the few columns that it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators import detect, iocs, threats, traffic
from tracelake.rules.cves import CVES
from tracelake.rx import bit, occurring
from tracelake.session import ship

_MATCHED = [c for c in CVES if c.patterns]
#: The patterns that lines are matched with, by bit: signatures, vulnerabilities, indicators.
GROUPS = [*detect.RULES, *[c.patterns for c in _MATCHED], *iocs.SELDOM_PATTERNS]
_CVES, _IOCS = len(detect.RULES), len(detect.RULES) + len(_MATCHED)


def observations(entries: DataFrame) -> DataFrame:
    """(line_number, ts, source_ip, status_code, bytes, url, user_agent, text, rules, cves, iocs): a row for each line, with the numbers of
    its signatures, the ids of its vulnerabilities (null if there are none) and its indicators. `text` is what evidence is made of;
    lines without a signature or a vulnerability have none."""
    ship(entries.sparkSession)
    text, bits = F.col("text__"), F.col("bits__")
    own = ("line_number", "ts", "source_ip", "status_code", "bytes", "url", "user_agent")
    rows = entries.select(*own, detect.haystack().alias("text__")).withColumn("bits__", occurring(text, GROUPS))
    ids = F.array_compact(F.array(*[F.when(bit(bits, _CVES + k), F.lit(c.id)) for k, c in enumerate(_MATCHED)]))
    named = bits.bitwiseAND(F.lit(((1 << len(_MATCHED)) - 1) << _CVES).cast("long")) != 0
    said = bits.bitwiseAND(F.lit((1 << _IOCS) - 1).cast("long")) != 0
    return rows.select(*own, F.when(said, detect.truncate(F.trim(text), detect.EVIDENCE)).alias("text"), detect.numbered_rules(bits).alias("rules"), F.when(named, ids).alias("cves"), iocs.marked(text, bits, _IOCS).alias("iocs"))


def hits(observed: DataFrame) -> DataFrame:
    """As `detect.rule_hits`, with the evidence for the raw line."""
    return detect.seen_hits(observed)


def cve_hits(observed: DataFrame) -> DataFrame:
    """As `threats.cve_hits`."""
    return observed.where("cves is not null").select("line_number", threats.evidence_of(F.col("text")).alias("evidence"), F.explode("cves").alias("cve"))


def ioc_hits(observed: DataFrame) -> DataFrame:
    """As `iocs.ioc_hits`."""
    return observed.select("line_number", "ts", F.explode("iocs").alias("ioc")).select("line_number", "ts", "ioc.*")


def sources(rows: DataFrame) -> DataFrame:
    """Counts per source address for traffic and for findings, of entries or of what was observed; lines without an address are in a row of their own."""
    return rows.groupBy("source_ip").agg(*traffic.counts(), *detect.counts())
