"""Log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.time import parse_timestamp, parse_timestamp_sql, said, said_sql
from tracelake.operators import detect, iocs, parse, reason, threats, timeline, traffic
from tracelake.rules import severity
from tracelake.rules.signatures import TACTICS
from tracelake.plans.case import LogCase
from tracelake.sources import testbed
from tracelake.store import cut
from tracelake.streaming import behaviour

ENTRIES = parse.weblog_sql(testbed.access_log("duckdb"))
HITS = detect.hits_sql(ENTRIES)
ANOMALIES = detect.anomalies_sql(ENTRIES)
TECHNIQUES = threats.techniques_sql(HITS)
IOCS = iocs.iocs_sql(iocs.hits_sql(ENTRIES, "coalesce(nullif(raw, ''), message)"))
CVES = threats.cves_sql(ENTRIES, TECHNIQUES, IOCS)
TRAFFIC = traffic.traffic_sql(ENTRIES)
TOOLS = threats.tools_sql(ANOMALIES, "evidence", "line_number NULLS FIRST, rule_no NULLS FIRST, source_ip NULLS FIRST")
STEPS = reason.killchain_sql(TECHNIQUES)
TOPS = reason.tops_sql(TECHNIQUES, CVES, IOCS, TRAFFIC)
COUNTERS = reason.counters_sql(ENTRIES, ANOMALIES, IOCS, TECHNIQUES, CVES, TRAFFIC)


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return parse.weblog(testbed.access_lines(spark, sf))


def case(spark: SparkSession, sf: str) -> LogCase:
    return LogCase(entries(spark, sf))


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return detect.rule_hits(entries(spark, sf))


def found(spark: SparkSession, sf: str) -> DataFrame:
    return detect.anomalies(entries(spark, sf))


def techniques(spark: SparkSession, sf: str) -> DataFrame:
    """Of hits written once: they are grouped, and their first evidences are picked."""
    return threats.techniques(cut(hits(spark, sf).select("line_number", "raw", "message", "rule_no", "severity", "technique_id", "technique", "tactic_id", "cves"), "hits"))


def log_iocs(spark: SparkSession, sf: str) -> DataFrame:
    return iocs.iocs(iocs.ioc_hits(entries(spark, sf), detect.haystack()))


def _dated(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: said(F.col(n)) for n in names})


def _dated_sql(sql: str, *names: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'{said_sql(n)} AS {n}' for n in names)}) FROM ({sql})"


def traffic_score(spark, sf):
    return traffic.traffic_score(entries(spark, sf))


def parse_access_log(spark, sf):
    return _dated(entries(spark, sf), "ts")


def parse_generic_line(spark, sf):
    return _dated(parse.generic(testbed.generic_lines(spark, sf)), "ts")


def parse_csv_log(spark, sf):
    lines = testbed.csv_lines(spark, sf)
    return _dated(parse.csv_entries(lines, testbed.CSV_HEADER.split(",")), "ts")


def detect_format(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", F.substring("text", 1, 4000).alias("head"))
    web = testbed.access_lines(spark, sf).select(F.col("line_number").alias("doc_id"), F.lit("src").alias("source"), F.substring("line", 1, 4000).alias("head"))
    name = F.concat(F.coalesce("source", F.lit("x")), F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("doc_id") % len(_EXTENSIONS) + 1).cast("int")))
    both = docs.unionByName(web).select("doc_id", name.alias("file"), "head")
    return both.groupBy("file", parse.detect_format(F.col("file"), F.col("head")).alias("format")).agg(F.count("*").alias("n"))


_EXTENSIONS = (".csv", ".evtx", ".log", ".txt", ".LOG", "")
_DETECT = f"""SELECT file, format, count(*)::BIGINT AS n FROM (SELECT file, {parse.detect_format_sql('file', 'head')} AS format FROM (
  SELECT coalesce(source, 'x') || {list(_EXTENSIONS)}[doc_id % {len(_EXTENSIONS)} + 1] AS file, head FROM (
    SELECT doc_id, source, text[1:4000] AS head FROM documents UNION ALL SELECT line_number, 'src', line[1:4000] FROM ({testbed.access_log('duckdb')})))) GROUP BY ALL"""


def timestamp_normalize(spark, sf):
    lines = testbed.generic_lines(spark, sf)
    return lines.select("line_number", said(parse_timestamp(F.col("line"))).alias("ts"))


def signature_hits(spark, sf):
    return hits(spark, sf).select("line_number", "code", "severity", "technique_id", "tactic_id", "source_ip")


def signature_hits_pages(spark, sf):
    pages = testbed.spread(spark, sf, "pages").select(F.col("page_id").alias("line_number"), F.coalesce("html", F.lit("")).alias("raw"), F.lit("").alias("message"))
    return detect.rule_hits(pages).select("line_number", "code")


def signature_summary(spark, sf):
    return hits(spark, sf).groupBy("code").agg(F.count("*").alias("hits"), F.min("line_number").alias("first_line"), F.count_distinct("source_ip").alias("sources"))


def behavior_bruteforce(spark, sf):
    return _dated(detect.brute_force(detect.behaviour(entries(spark, sf))), "ts").drop("rule_no")


def behavior_enumeration(spark, sf):
    return _dated(detect.enumeration(detect.behaviour(entries(spark, sf))), "ts").drop("rule_no")


def _behaviour_sql(no: int) -> str:
    return f"SELECT * EXCLUDE (rule_no) FROM ({_dated_sql(ANOMALIES, 'ts')}) WHERE rule_no = {no}"


def anomalies_all(spark, sf):
    return _dated(found(spark, sf), "ts")


def severity_histogram(spark, sf):
    levels = spark.createDataFrame([(s, k) for s, k in severity.RANK.items()], "severity string, rank int")
    return levels.join(found(spark, sf).groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", "rank", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


_HISTOGRAM = f"SELECT severity, rank::INT AS rank, coalesce(n, 0)::BIGINT AS n FROM (VALUES {', '.join(repr(x) for x in severity.RANK.items())}) AS l(severity, rank) LEFT JOIN (SELECT severity, count(*) AS n FROM ({ANOMALIES}) GROUP BY 1) USING (severity)"


def _docs_hits(spark, sf):
    docs = testbed.spread(spark, sf, "documents", "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return iocs.ioc_hits(docs, F.col("text"), "doc_id", None)


_DOC_HITS = iocs.hits_sql("SELECT doc_id, coalesce(text, '') AS text FROM documents", "text", "doc_id", "NULL::TIMESTAMP")
_PAGE_SOURCE = "SELECT page_id, coalesce(url, '') || chr(10) || coalesce(html, '') AS text FROM pages"


def ioc_extract_docs(spark, sf):
    return iocs.iocs(_docs_hits(spark, sf)).drop("first_seen", "last_seen")


def ioc_extract_pages(spark, sf):
    pages = testbed.spread(spark, sf, "pages").select("page_id", F.concat_ws("\n", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))).alias("text"))
    return iocs.iocs(iocs.ioc_hits(pages, F.col("text"), "page_id", None)).drop("first_seen", "last_seen")


def ioc_extract_logs(spark, sf):
    return _dated(log_iocs(spark, sf), "first_seen", "last_seen")


def ioc_by_type(spark, sf):
    return _docs_hits(spark, sf).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct(F.lower("value")).alias("distinct_values"))


def ioc_private_ip(spark, sf):
    own = entries(spark, sf).where("source_ip is not null").groupBy("source_ip").agg(F.count("*").alias("n"))
    return own.select("source_ip", iocs.is_private(F.col("source_ip")).alias("private"), "n")


def ioc_reference_url(spark, sf):
    return ioc_extract_docs(spark, sf).unionByName(ioc_extract_logs(spark, sf).drop("first_seen", "last_seen")).select("type", "value", "reference").distinct()


_REFERENCES = f"SELECT DISTINCT type, value, reference FROM (SELECT type, value, reference FROM ({iocs.iocs_sql(_DOC_HITS)}) UNION ALL SELECT type, value, reference FROM ({IOCS}))"


def technique_map(spark, sf):
    return techniques(spark, sf)


def cve_map(spark, sf):
    return case(spark, sf).cves


def cve_evidence(spark, sf):
    return threats.cve_evidence(threats.cve_hits(entries(spark, sf)))


def ioc_lines(spark, sf):
    return iocs.related(iocs.ioc_hits(entries(spark, sf), detect.haystack()))


def technique_cve_link(spark, sf):
    return threats.cve_links(techniques(spark, sf))


def timeline_events(spark, sf):
    return _dated(timeline.timeline(found(spark, sf)), "ts")


def timeline_phase(spark, sf):
    return found(spark, sf).groupBy(timeline.phase(F.col("category")).alias("phase")).agg(F.count("*").alias("n"), F.min("line_number").alias("first_line"))


def attack_flow_nodes(spark, sf):
    return threats.flow_nodes(techniques(spark, sf))


def attack_flow_edges(spark, sf):
    return threats.flow_edges(attack_flow_nodes(spark, sf))


def killchain_steps(spark, sf):
    return reason.killchain_steps(techniques(spark, sf))


def intrusion_summary(spark, sf):
    return case(spark, sf).intrusion


def actor_attribution(spark, sf):
    return case(spark, sf).attribution


def tools_detected(spark, sf):
    return threats.tools_named(cut(found(spark, sf), "anomalies"), "evidence", ["line_number", "rule_no", "source_ip"])


def report_counters(spark, sf):
    return case(spark, sf).counters


def report_steps(spark, sf):
    return case(spark, sf).report_steps


def report_tops(spark, sf):
    return case(spark, sf).tops


def report_lines(spark, sf):
    return case(spark, sf).report_lines


def overview_tops(spark, sf):
    return case(spark, sf).overview


def overview_kpis(spark, sf):
    return case(spark, sf).kpis


def anomaly_search(spark, sf):
    """Findings of one severity that name a word, case ignored."""
    df = _dated(found(spark, sf), "ts")
    text = F.lower(F.concat_ws(" ", "category", "evidence", "source_ip"))
    return df.where((F.col("severity") == "high") & text.contains("select")).drop("rule_no")


def log_search(spark, sf):
    """The first 60 lines that hold a word: a top-k view."""
    return entries(spark, sf).where(F.lower("raw").contains("admin")).orderBy("line_number").limit(60).select("line_number", "raw")


def kpi_logs(spark, sf):
    return entries(spark, sf).agg(F.count("*").alias("entries"), F.count_distinct("source_ip").alias("sources"), F.round(F.avg(F.col("ts").isNotNull().cast("int")) * 100, 4).alias("dated_percent"), F.sum("bytes").alias("bytes"), F.count_if(F.col("status_code") >= 400).alias("errors"))


_KPI = f"SELECT count(*)::BIGINT AS entries, count(DISTINCT source_ip)::BIGINT AS sources, round(avg((ts IS NOT NULL)::INT) * 100, 4) AS dated_percent, sum(bytes)::BIGINT AS bytes, count(*) FILTER (status_code >= 400)::BIGINT AS errors FROM ({ENTRIES})"


def tactic_table(spark, sf):
    """Hits per tactic in the order of an intrusion, tactics without hits included."""
    order = spark.createDataFrame([(t, n, k) for t, (n, k) in TACTICS.items()], "tactic_id string, tactic string, place int")
    per = hits(spark, sf).groupBy("tactic_id").agg(F.count("*").alias("hits"))
    return order.join(per, "tactic_id", "left").select("tactic_id", "tactic", "place", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


_TACTICS = f"SELECT tactic_id, tactic, place::INT AS place, coalesce(hits, 0)::BIGINT AS hits FROM (VALUES {', '.join(repr((t, n, k)) for t, (n, k) in TACTICS.items())}) AS t(tactic_id, tactic, place) LEFT JOIN (SELECT tactic_id, count(*) AS hits FROM ({HITS}) GROUP BY 1) USING (tactic_id)"

def window_counts(spark, sf):
    """The streaming operator over a finished table: ten-minute counts of each source."""
    return _dated(behaviour.windowed_counts(entries(spark, sf)), "window_start")


_WINDOWS = f"""SELECT {said_sql("time_bucket(INTERVAL '10 minutes', ts)")} AS window_start, source_ip, count(*)::BIGINT AS requests, count(*) FILTER (status_code >= 400)::BIGINT AS errors, count(*) FILTER (status_code IN (401, 403))::BIGINT AS denied,
  count(*) FILTER (status_code = 404)::BIGINT AS missing, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM ({ENTRIES}) WHERE source_ip IS NOT NULL AND ts IS NOT NULL GROUP BY ALL"""

QUERIES = {
    f.__name__: f
    for f in (
        traffic_score, parse_access_log, parse_generic_line, parse_csv_log, detect_format, timestamp_normalize, signature_hits, signature_hits_pages, signature_summary, behavior_bruteforce, behavior_enumeration,
        anomalies_all, severity_histogram, ioc_extract_docs, ioc_extract_pages, ioc_extract_logs, ioc_by_type, ioc_private_ip, ioc_reference_url, technique_map, cve_map, technique_cve_link, timeline_events, timeline_phase,
        attack_flow_nodes, attack_flow_edges, killchain_steps, intrusion_summary, actor_attribution, tools_detected, report_counters, report_steps, report_tops, report_lines, overview_tops, overview_kpis, cve_evidence, ioc_lines, anomaly_search, log_search, kpi_logs, tactic_table, window_counts,
    )
}

_NO_TIMES = "SELECT * EXCLUDE (first_seen, last_seen) FROM"
ORACLE_SQL = {
    "traffic_score": TRAFFIC,
    "parse_access_log": _dated_sql(ENTRIES, "ts"),
    "parse_generic_line": _dated_sql(parse.generic_sql(testbed.generic_log("duckdb")), "ts"),
    "parse_csv_log": _dated_sql(parse.csv_sql(testbed.csv_log("duckdb"), testbed.CSV_HEADER.split(",")), "ts"),
    "detect_format": _DETECT,
    "window_counts": _WINDOWS,
    "timestamp_normalize": f"SELECT line_number, {said_sql(parse_timestamp_sql('line'))} AS ts FROM ({testbed.generic_log('duckdb')})",
    "signature_hits": f"SELECT line_number, code, severity, technique_id, tactic_id, source_ip FROM ({HITS})",
    "signature_hits_pages": "SELECT line_number, code FROM (" + detect.hits_sql("SELECT page_id AS line_number, coalesce(html, '') AS raw, '' AS message FROM pages") + ")",
    "signature_summary": f"SELECT code, count(*)::BIGINT AS hits, min(line_number) AS first_line, count(DISTINCT source_ip)::BIGINT AS sources FROM ({HITS}) GROUP BY 1",
    "behavior_bruteforce": _behaviour_sql(18),
    "behavior_enumeration": _behaviour_sql(19),
    "anomalies_all": _dated_sql(ANOMALIES, "ts"),
    "severity_histogram": _HISTOGRAM,
    "ioc_extract_docs": f"{_NO_TIMES} ({iocs.iocs_sql(_DOC_HITS)})",
    "ioc_extract_pages": f"{_NO_TIMES} ({iocs.iocs_sql(iocs.hits_sql(_PAGE_SOURCE, 'text', 'page_id', 'NULL::TIMESTAMP'))})",
    "ioc_extract_logs": _dated_sql(IOCS, "first_seen", "last_seen"),
    "ioc_by_type": f"SELECT type, count(*)::BIGINT AS n, count(DISTINCT lower(value))::BIGINT AS distinct_values FROM ({_DOC_HITS}) GROUP BY 1",
    "ioc_private_ip": f"SELECT source_ip, regexp_matches(source_ip, '{iocs.PRIVATE.re2}') AS private, count(*)::BIGINT AS n FROM ({ENTRIES}) WHERE source_ip IS NOT NULL GROUP BY ALL",
    "ioc_reference_url": _REFERENCES,
    "technique_map": TECHNIQUES,
    "cve_map": CVES,
    "technique_cve_link": f"SELECT unnest(string_split(cves, ',')) AS cve, technique_id FROM ({TECHNIQUES}) WHERE cves <> ''",
    "timeline_events": _dated_sql(timeline.timeline_sql(ANOMALIES), "ts"),
    "timeline_phase": f"SELECT {timeline.phase_sql('category')} AS phase, count(*)::BIGINT AS n, min(line_number) AS first_line FROM ({ANOMALIES}) GROUP BY 1",
    "attack_flow_nodes": threats.flow_nodes_sql(TECHNIQUES),
    "attack_flow_edges": f"SELECT * FROM (SELECT step, tactic_id AS from_tactic, lead(tactic_id) OVER (ORDER BY step) AS to_tactic FROM ({threats.flow_nodes_sql(TECHNIQUES)})) WHERE to_tactic IS NOT NULL",
    "killchain_steps": STEPS,
    "intrusion_summary": reason.intrusion_sql(STEPS, ANOMALIES, IOCS),
    "report_tops": TOPS,
    "report_lines": reason.report_lines_sql(COUNTERS, TECHNIQUES, TOPS),
    "overview_tops": reason.overview_sql(TRAFFIC, TECHNIQUES, CVES, ANOMALIES, timeline.timeline_sql(ANOMALIES)),
    "overview_kpis": reason.kpis_sql(ENTRIES, TRAFFIC),
    "cve_evidence": threats.cve_evidence_sql(ENTRIES),
    "ioc_lines": iocs.related_sql(iocs.hits_sql(ENTRIES, "coalesce(nullif(raw, ''), message)")),
    "actor_attribution": threats.attribution_sql(TECHNIQUES, TOOLS),
    "tools_detected": TOOLS,
    "report_counters": COUNTERS,
    "report_steps": reason.steps_sql(COUNTERS, CVES),
    "anomaly_search": f"SELECT * EXCLUDE (rule_no) FROM ({_dated_sql(ANOMALIES, 'ts')}) WHERE severity = 'high' AND contains(lower(concat_ws(' ', category, evidence, source_ip)), 'select')",
    "log_search": f"SELECT line_number, raw FROM ({ENTRIES}) WHERE contains(lower(raw), 'admin') ORDER BY line_number LIMIT 60",
    "kpi_logs": _KPI,
    "tactic_table": _TACTICS,
}
