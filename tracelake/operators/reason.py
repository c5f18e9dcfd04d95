"""What the findings add up to: kill-chain steps, the likely intrusion, counters and next steps.

Everything here works on aggregates with a row for each tactic, technique or severity, except the
counts that make them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.time import said, said_sql
from tracelake.operators.threats import tactic_name, tactic_name_sql, tactic_order, tactic_order_sql
from tracelake.rules import severity

#: How an intrusion that starts with a tactic got in.
ENTRY = {
    "TA0001": "exploit of a public service",
    "TA0043": "scanning, then access",
    "TA0006": "guessed or stolen credentials",
    "TA0002": "remote execution",
    "TA0003": "a web shell as a foothold",
}
PROFILE = (("automated scanning", ("TA0043",)), ("hands-on work", ("TA0006", "TA0008")), ("traces removed", ("TA0005",)), ("theft or destruction", ("TA0040", "TA0010")))


def killchain_steps(techniques: DataFrame) -> DataFrame:
    """One step a tactic, in order: names, worst severity, the first evidence."""
    per = techniques.groupBy("tactic_id").agg(
        F.array_join(F.array_sort(F.collect_set("technique")), ", ").alias("title"),
        F.array_join(F.array_sort(F.collect_set("technique_id")), ",").alias("technique_ids"),
        severity.worst(F.col("severity")).alias("severity"),
        F.min_by(F.split_part("evidence", F.lit(" | "), F.lit(1)), "technique_id").alias("evidence"),
    )
    place = F.row_number().over(Window.orderBy(tactic_order(F.col("tactic_id"))))  # a row for each tactic
    return per.select(place.alias("step"), "tactic_id", tactic_name(F.col("tactic_id")).alias("phase"), "title", "technique_ids", "severity", "evidence")


def killchain_sql(techniques: str) -> str:
    return f"""SELECT row_number() OVER (ORDER BY {tactic_order_sql('tactic_id')})::INT AS step, tactic_id, {tactic_name_sql('tactic_id')} AS phase, title, technique_ids, severity, evidence FROM (
      SELECT tactic_id, string_agg(DISTINCT technique, ', ' ORDER BY technique) AS title, string_agg(DISTINCT technique_id, ',' ORDER BY technique_id) AS technique_ids, {severity.worst_sql('severity')} AS severity,
        arg_min(split_part(evidence, ' | ', 1), technique_id) AS evidence FROM ({techniques}) GROUP BY 1)"""


#: A time after all others, for findings without one.
LATE = "9999-12-31 00:00:00"
#: What holds of every reconstruction.
CAVEATS = (
    "The path is put together from indicators in the order of an intrusion: an assessment, not a fact.",
    "Times can be forged, so the true order may differ.",
    "What left no trace in the log or the file table is missing here.",
    "Rules and training data are limited: steps may be false or missed.",
)


def intrusion_summary(steps: DataFrame, anomalies: DataFrame, iocs: DataFrame) -> DataFrame:
    """One row: where it got in, when, from where mostly, the worst step, and the kind of actor.

    The source with most findings (the one seen first among equals), else the first address among the
    indicators.
    """
    entry = F.min_by("tactic_id", F.struct(F.when(F.col("tactic_id") == "TA0001", 0).when(F.col("tactic_id") != "TA0043", 1).otherwise(2), "step"))
    has = lambda ids: F.bool_or(F.col("tactic_id").isin(*ids))
    profile = F.array_join(F.array_compact(F.array(*[F.when(has(ids), F.lit(name)) for name, ids in PROFILE])), ", ")
    hint = F.lit("")
    for t, words in ENTRY.items():
        hint = F.when(F.col("entry_tactic") == t, words).otherwise(hint)
    chain = steps.agg(
        entry.alias("entry_tactic"),
        (has(("TA0043",)) & (entry != "TA0043")).alias("recon_first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "tactic_id"))), lambda x: x["tactic_id"]), " > ").alias("chain"),
        F.min_by("tactic_id", F.struct(-severity.rank(F.col("severity")), "step")).alias("worst_tactic"),
        profile.alias("profile"),
    ).where("entry_tactic is not null")
    first = F.min(F.struct(F.coalesce("ts", F.lit(LATE).cast("timestamp")), "line_number"))
    per = anomalies.groupBy("source_ip").agg(F.count("*").alias("n"), first.alias("first"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    named = F.when(F.col("source_ip").isNotNull(), F.struct(-F.col("n"), "first"))
    span = per.agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min_by("source_ip", named).alias("source"))
    address = iocs.where("type = 'ip'").agg(F.min_by("value", F.struct(-F.col("count"), "first_line", "first_pattern", "first_at")).alias("address"))
    one = chain.join(F.broadcast(span)).join(F.broadcast(address))  # one row each
    return one.select("entry_tactic", hint.alias("entry"), "recon_first", "chain", "worst_tactic", "profile", said(F.col("a")).alias("first_seen"), said(F.col("b")).alias("last_seen"), F.coalesce("source", "address").alias("top_source"))


def intrusion_sql(steps: str, anomalies: str, iocs: str) -> str:
    has = lambda ids: f"bool_or(tactic_id IN ({', '.join(repr(i) for i in ids)}))"
    entry = "arg_min(tactic_id, (CASE WHEN tactic_id = 'TA0001' THEN 0 WHEN tactic_id <> 'TA0043' THEN 1 ELSE 2 END, step))"
    profile = ", ".join(f"CASE WHEN {has(ids)} THEN '{name}' END" for name, ids in PROFILE)
    hint = "CASE entry_tactic " + " ".join(f"WHEN '{t}' THEN '{w}'" for t, w in ENTRY.items()) + " ELSE '' END"
    first = f"min((coalesce(ts, TIMESTAMP '{LATE}'), line_number))"
    return f"""SELECT entry_tactic, {hint} AS entry, recon_first, chain, worst_tactic, profile, {said_sql('a')} AS first_seen, {said_sql('b')} AS last_seen, coalesce(source, address) AS top_source FROM
      (SELECT {entry} AS entry_tactic, {has(('TA0043',))} AND {entry} <> 'TA0043' AS recon_first, string_agg(tactic_id, ' > ' ORDER BY step) AS chain, arg_min(tactic_id, (-({severity.rank_sql('severity')}), step)) AS worst_tactic,
        array_to_string(list_filter([{profile}], lambda x: x IS NOT NULL), ', ') AS profile FROM ({steps})),
      (SELECT min(ts) AS a, max(ts) AS b FROM ({anomalies})), (SELECT arg_min(source_ip, (-n, first)) AS source FROM (SELECT source_ip, count(*) AS n, {first} AS first FROM ({anomalies}) WHERE source_ip IS NOT NULL GROUP BY 1)),
      (SELECT arg_min(value, (-count, first_line, first_pattern, first_at)) AS address FROM ({iocs}) WHERE type = 'ip') WHERE entry_tactic IS NOT NULL"""


def report_counters(n_entries: DataFrame, anomalies: DataFrame, iocs: DataFrame, techniques: DataFrame, cves: DataFrame, traffic: DataFrame) -> DataFrame:
    """One row of the report's numbers; `n_entries` has the column entries in its one row."""
    bad = anomalies.agg(F.count("*").alias("anomalies"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    parts = [bad, iocs.agg(F.count("*").alias("iocs")), techniques.agg(F.count("*").alias("techniques")), cves.agg(F.count("*").alias("cves")), traffic.agg(F.count_if(F.col("class") == "abnormal").alias("abnormal_sources"))]
    out = n_entries
    for p in parts:
        out = out.join(F.broadcast(p))  # one row each
    return out


def counters_sql(entries: str, anomalies: str, iocs: str, techniques: str, cves: str, traffic: str) -> str:
    return f"""SELECT * FROM (SELECT count(*)::BIGINT AS entries FROM ({entries})), (SELECT count(*)::BIGINT AS anomalies, count(*) FILTER (severity = 'critical')::BIGINT AS critical, count(*) FILTER (severity = 'high')::BIGINT AS high FROM ({anomalies})),
      (SELECT count(*)::BIGINT AS iocs FROM ({iocs})), (SELECT count(*)::BIGINT AS techniques FROM ({techniques})), (SELECT count(*)::BIGINT AS cves FROM ({cves})), (SELECT count(*) FILTER (class = 'abnormal')::BIGINT AS abnormal_sources FROM ({traffic}))"""


#: Steps of a report: code, when it is shown, and its priority, as SQL over the counters.
STEPS = (
    ("triage", "true", "CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high' ELSE 'medium' END"),
    ("reconstruct-attack", "techniques > 0", "'high'"),
    ("verify-cves", "cves > 0", "CASE WHEN critical_cves > 0 THEN 'critical' ELSE 'high' END"),
    ("block-iocs", "iocs > 0", "'medium'"),
    ("inspect-sources", "abnormal_sources > 0", "'high'"),
    ("write-up", "true", "'medium'"),
)


def report_steps(counters: DataFrame, cves: DataFrame) -> DataFrame:
    """(step, code, priority) of the steps that apply."""
    worst = cves.agg(F.count_if(F.col("severity") == "critical").alias("critical_cves"))
    rows = F.array(*[F.when(F.expr(when), F.struct(F.lit(k).alias("k"), F.lit(code).alias("code"), F.expr(p).alias("priority"))) for k, (code, when, p) in enumerate(STEPS)])
    kept = counters.join(F.broadcast(worst)).select(F.posexplode(F.array_compact(rows)).alias("at", "s"))
    return kept.select((F.col("at") + 1).alias("step"), "s.code", "s.priority")


def steps_sql(counters: str, cves: str) -> str:
    parts = " UNION ALL ".join(f"SELECT {k} AS k, '{code}' AS code, {p} AS priority FROM c WHERE {when}" for k, (code, when, p) in enumerate(STEPS))
    return f"WITH c AS (SELECT * FROM ({counters}), (SELECT count(*) FILTER (severity = 'critical') AS critical_cves FROM ({cves}))) SELECT row_number() OVER (ORDER BY k)::INT AS step, code, priority FROM ({parts})"


#: What a report names at most of each kind.
TOP_TECHNIQUES, TOP_CVES, TOP_IOCS, TOP_SOURCES = 5, 5, 3, 3


def _top(df: DataFrame, kind: str, n: int, name: str, detail: Column, *order: Column) -> DataFrame:
    """(kind, place, name, detail) of the first n rows."""
    best = df.select(F.col(name).alias("name"), detail.cast("string").alias("detail"), *[o.alias(f"o{k}__") for k, o in enumerate(order)]).orderBy(*[f"o{k}__" for k in range(len(order))]).limit(n)
    place = F.row_number().over(Window.orderBy(*[f"o{k}__" for k in range(len(order))]))  # n rows
    return best.select(F.lit(kind).alias("kind"), place.alias("place"), "name", "detail")


def _top_sql(source: str, kind: str, n: int, name: str, detail: str, *order: str) -> str:
    by = ", ".join(order)
    return f"SELECT '{kind}' AS kind, (row_number() OVER (ORDER BY {by}))::INT AS place, {name} AS name, ({detail})::VARCHAR AS detail FROM ({source}) ORDER BY {by} LIMIT {n}"


def tops(techniques: DataFrame, cves: DataFrame, iocs: DataFrame, traffic: DataFrame) -> DataFrame:
    """What the report names: the worst techniques and vulnerabilities, the commonest indicators, the most abnormal sources."""
    parts = (
        _top(techniques, "technique", TOP_TECHNIQUES, "technique_id", F.col("technique"), -severity.rank(F.col("severity")), F.col("tactic_order"), F.col("technique_id")),
        _top(cves, "cve", TOP_CVES, "cve", F.col("severity"), -F.col("cvss"), F.col("cve")),
        _top(iocs, "ioc", TOP_IOCS, "value", F.col("type"), -F.col("count"), F.col("first_line"), F.col("first_pattern"), F.col("first_at")),
        _top(traffic.where("class = 'abnormal'"), "source", TOP_SOURCES, "source_ip", F.format_string("%.3f", "score"), -F.col("score"), F.col("source_ip")),
    )
    return reduce(DataFrame.unionAll, parts)


def tops_sql(techniques: str, cves: str, iocs: str, traffic: str) -> str:
    parts = (
        _top_sql(techniques, "technique", TOP_TECHNIQUES, "technique_id", "technique", f"-({severity.rank_sql('severity')})", "tactic_order", "technique_id"),
        _top_sql(cves, "cve", TOP_CVES, "cve", "severity", "-cvss", "cve"),
        _top_sql(iocs, "ioc", TOP_IOCS, "value", "type", "-count", "first_line", "first_pattern", "first_at"),
        _top_sql(f"SELECT * FROM ({traffic}) WHERE class = 'abnormal'", "source", TOP_SOURCES, "source_ip", "printf('%.3f', score)", "-score", "source_ip"),
    )
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


#: Lines of a report: kind, when it is there, and its text, as SQL that both engines read; `names_*` are joined tops.
LINES = (
    ("fact", "true", "concat(cast(entries AS STRING), ' entries analysed.')"),
    ("fact", "true", "concat(cast(anomalies AS STRING), ' findings (', cast(critical AS STRING), ' critical, ', cast(high AS STRING), ' high).')"),
    ("fact", "true", "concat(cast(iocs AS STRING), ' indicators.')"),
    ("fact", "true", "concat(cast(techniques AS STRING), ' techniques, ', cast(cves AS STRING), ' vulnerabilities.')"),
    ("fact", "cves > 0", "concat('Vulnerabilities: ', names_cve, '.')"),
    ("assessment", "critical > 0", "'Critical findings: a real compromise is likely.'"),
    ("assessment", "critical = 0 AND high > 0", "'High findings: attacks were probably tried.'"),
    ("assessment", "critical = 0 AND high = 0", "'No grave findings, within what the log shows.'"),
    ("assessment", "abnormal_sources > 0", "concat(cast(abnormal_sources AS STRING), ' abnormal sources, the worst of them ', first_source, '.')"),
    ("assessment", "true", "'Assessments need an analyst to confirm them.'"),
    ("narrative", "true", "concat(cast(anomalies AS STRING), ' findings in ', cast(entries AS STRING), ' entries.')"),
    ("narrative", "techniques > 0", "concat(cast(techniques AS STRING), ' techniques, from ', first_tactic, ' to ', last_tactic, '.')"),
    ("narrative", "critical > 0", "concat(cast(critical AS STRING), ' critical findings call for action at once.')"),
    ("narrative", "critical = 0 AND high > 0", "concat(cast(high AS STRING), ' high findings should be checked first.')"),
    ("narrative", "cves > 0", "concat('Linked vulnerabilities: ', names_cve, '.')"),
    ("narrative", "abnormal_sources > 0", "concat(cast(abnormal_sources AS STRING), ' sources look abnormal.')"),
)


def report_lines(counters: DataFrame, techniques: DataFrame, tops_: DataFrame) -> DataFrame:
    """(place, kind, line): facts, assessments and the narrative of a report, in order."""
    order = F.struct("tactic_order", "technique_id")
    ends = techniques.agg(F.min_by("tactic", order).alias("first_tactic"), F.max_by("tactic", order).alias("last_tactic"))
    named = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "name")))), lambda x: x["name"]), ", ")
    names = tops_.agg(named("cve").alias("names_cve"), F.min_by("name", F.when(F.col("kind") == "source", F.col("place"))).alias("first_source"))
    one = counters.join(F.broadcast(ends)).join(F.broadcast(names))  # one row each
    rows = F.array_compact(F.array(*[F.when(F.expr(when), F.struct(F.lit(kind).alias("kind"), F.expr(text).alias("line"))) for kind, when, text in LINES]))
    return one.select(F.posexplode(rows).alias("at", "x")).select((F.col("at") + 1).alias("place"), "x.kind", "x.line")


def report_lines_sql(counters: str, techniques: str, tops_: str) -> str:
    parts = " UNION ALL ".join(f"SELECT {k} AS k, '{kind}' AS kind, {text} AS line FROM c WHERE {when}" for k, (kind, when, text) in enumerate(LINES))
    return f"""WITH c AS (SELECT * FROM ({counters}), (SELECT arg_min(tactic, (tactic_order, technique_id)) AS first_tactic, arg_max(tactic, (tactic_order, technique_id)) AS last_tactic FROM ({techniques})),
      (SELECT string_agg(CASE WHEN kind = 'cve' THEN name END, ', ' ORDER BY place) AS names_cve, arg_min(CASE WHEN kind = 'source' THEN name END, CASE WHEN kind = 'source' THEN place END) AS first_source FROM ({tops_})))
      SELECT (row_number() OVER (ORDER BY k))::INT AS place, kind, line FROM ({parts})"""


#: Rows of the views of an overview.
OVERVIEW = {"traffic": 6, "techniques": 5, "cves": 5, "categories": 6, "timeline": 7}


def overview(traffic: DataFrame, techniques: DataFrame, cves: DataFrame, anomalies: DataFrame, timeline: DataFrame) -> DataFrame:
    """(kind, place, name, detail) of the first rows of each view."""
    categories = anomalies.groupBy("category").agg(F.count("*").alias("n"))
    parts = (
        _top(traffic, "traffic", OVERVIEW["traffic"], "source_ip", F.format_string("%.3f", "score"), -F.col("score"), F.col("source_ip")),
        _top(techniques, "techniques", OVERVIEW["techniques"], "technique_id", F.col("technique"), F.col("tactic_order"), F.col("technique_id")),
        _top(cves, "cves", OVERVIEW["cves"], "cve", F.col("severity"), -F.col("cvss"), F.col("cve")),
        _top(categories, "categories", OVERVIEW["categories"], "category", F.col("n"), -F.col("n"), F.col("category")),
        _top(timeline, "timeline", OVERVIEW["timeline"], "category", F.col("line_number"), F.col("place")),
    )
    return reduce(DataFrame.unionAll, parts)


def overview_sql(traffic: str, techniques: str, cves: str, anomalies: str, timeline: str) -> str:
    parts = (
        _top_sql(traffic, "traffic", OVERVIEW["traffic"], "source_ip", "printf('%.3f', score)", "-score", "source_ip"),
        _top_sql(techniques, "techniques", OVERVIEW["techniques"], "technique_id", "technique", "tactic_order", "technique_id"),
        _top_sql(cves, "cves", OVERVIEW["cves"], "cve", "severity", "-cvss", "cve"),
        _top_sql(f"SELECT category, count(*) AS n FROM ({anomalies}) GROUP BY 1", "categories", OVERVIEW["categories"], "category", "n", "-n", "category"),
        _top_sql(f"SELECT category, line_number, place AS p FROM ({timeline})", "timeline", OVERVIEW["timeline"], "category", "line_number", "p"),
    )
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


def kpis(sources: DataFrame, traffic: DataFrame) -> DataFrame:
    """One row of a dashboard's numbers, given counts and scores of the sources."""
    own = sources.agg(F.sum("requests").alias("entries"), F.count("source_ip").alias("sources"), F.sum("errors").alias("errors"), F.sum("bytes").alias("bytes"))
    score = traffic.agg(F.count_if(F.col("class") == "abnormal").alias("abnormal"), F.round(F.max("score"), 3).alias("worst_score"))
    return own.join(F.broadcast(score))  # one row each


def kpis_sql(entries: str, traffic: str) -> str:
    return f"""SELECT * FROM (SELECT count(*)::BIGINT AS entries, count(DISTINCT source_ip)::BIGINT AS sources, count(*) FILTER (status_code >= 400)::BIGINT AS errors, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM ({entries})),
      (SELECT count(*) FILTER (class = 'abnormal')::BIGINT AS abnormal, round(max(score), 3) AS worst_score FROM ({traffic}))"""
