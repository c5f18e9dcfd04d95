"""A report in HTML that word processors open: bounded tables of the worst, with the totals."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import format as formats
from tracelake.operators.detect import truncate
from tracelake.operators.reason import CAVEATS
from tracelake.plans.engine import Analysis, Narrator
from tracelake.rules import severity

EVIDENCE, ACTORS, STEPS, CHAIN, SHOWN = 12, 3, 3, 20, 64
STYLE = "body{font-family:sans-serif;font-size:11pt}table{border-collapse:collapse;width:100%}td,th{border:1px solid #ccc;padding:4px 6px;text-align:left}"


def _worst(df: DataFrame, n: int, *order: str) -> list:
    return df.orderBy(severity.rank(F.col("severity")).desc(), *order).limit(n).collect()


def _table(title: str, head: tuple[str, ...], rows: list[tuple]) -> str:
    if not rows:
        return ""
    line = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{escape('' if c is None else str(c))}</{tag}>" for c in cells) + "</tr>"
    return f"<h2>{escape(title)}</h2><table>{line(head, 'th')}{''.join(line(r, 'td') for r in rows)}</table>"


def facts(a: Analysis) -> dict:
    """The numbers a narrator may see: aggregates only, no lines."""
    if a.kind == "log":
        return a["counters"].first().asDict()
    bad = a["findings"].agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    return a["totals"].first().asDict() | bad.first().asDict()


def _listed(title: str, lines: list[str]) -> str:
    return f"<h2>{escape(title)}</h2><ul>{''.join(f'<li>{escape(x)}</li>' for x in lines)}</ul>" if lines else ""


def learned(a: Analysis) -> str | None:
    """What the learning results add up to: a fact of the report."""
    m = a["ml_metrics"].first()
    if not m["rows"]:
        return None
    said = f"[ML] {m['flagged']} of {m['rows']} {'lines' if a.kind == 'log' else 'records'} are risky ({100 * m['contamination']:.1f} %)."
    return said if m["accuracy"] is None else said + f" The classifier's accuracy in cross-validation is {100 * m['accuracy']:.0f} %."


def record_lines(numbers: dict) -> dict[str, list[str]]:
    """Facts, assessments and narrative of file records."""
    grave = numbers["critical"] or numbers["high"]
    return {
        "fact": [f"{numbers['records']} file records analysed.", f"{numbers['findings']} findings ({numbers['critical']} critical, {numbers['high']} high).", f"{numbers['si_before_fn'] + numbers['si_after_change']} records with odd times."],
        "assessment": ["Grave findings: a real compromise is likely." if grave else "No grave findings, within what the table shows.", "Assessments need an analyst to confirm them."],
        "narrative": [f"{numbers['findings']} findings in {numbers['records']} file records."],
    }


def render(a: Analysis, name: str, narrator: Narrator | None = None) -> str:
    """The report of an analysis: a narrative, facts and assessments, the likely intrusion, the worst of each kind, and what to do."""
    numbers = facts(a)
    if a.kind == "log":
        lines = {k: [r["line"] for r in a["report_lines"].orderBy("place").collect() if r["kind"] == k] for k in ("fact", "assessment", "narrative")}
    else:
        lines = record_lines(numbers)
    if learnt := learned(a):
        lines["fact"].append(learnt)
    said = narrator(numbers) if narrator else None
    parts = [f"<h1>Analysis of {escape(name)}</h1>", f"<p>{escape(said or ' '.join(lines['narrative']))}</p>", _listed("Facts", lines["fact"]), _listed("Assessments", lines["assessment"])]
    for r in a["intrusion"].collect():
        where = f", mostly from {r['top_source']}" if r["top_source"] else ""
        parts.append(f"<h2>Likely intrusion (an assessment)</h2><p>{escape(r['entry'] or r['entry_tactic'])}, then {escape(r['chain'])}; {escape(str(r['first_seen']))} to {escape(str(r['last_seen']))}{escape(where)}. Worst: {escape(r['worst_tactic'])}. {escape(r['profile'])}</p>")
        parts.append(_listed("Mind", list(CAVEATS)))
    if a.kind == "log":
        top = a["tops"].withColumn("name", formats.breakable(F.col("name"))).orderBy("kind", "place").collect()
        for kind, title in (("technique", "Techniques"), ("cve", "Vulnerabilities"), ("ioc", "Indicators"), ("source", "Abnormal sources")):
            parts.append(_table(title, ("place", "what", "detail"), [(r["place"], r["name"], r["detail"]) for r in top if r["kind"] == kind]))
        worst = _worst(a["anomalies"].withColumn("shown", formats.breakable(truncate(F.col("evidence"), SHOWN))), EVIDENCE, "ts", "line_number", "rule_no")
        parts.append(_table("Evidence", ("severity", "time", "category", "source", "evidence"), [(r["severity"], r["ts"], r["category"], r["source_ip"], r["shown"]) for r in worst]))
    else:
        worst = _worst(a["findings"], EVIDENCE, "record_number", "rule_no")
        parts.append(_table("Evidence", ("severity", "record", "category", "path"), [(r["severity"], r["record_number"], r["category"], r["path"]) for r in worst]))
    parts.append(_table("Steps of the attack", ("step", "phase", "techniques", "severity"), [(r["step"], r["phase"], r["technique_ids"], r["severity"]) for r in a["steps"].orderBy("step").limit(CHAIN).collect()]))
    parts.append(_table("Groups that work like this (an assessment)", ("group", "score", "confidence", "tools"), [(r["actor"], r["score"], r["confidence"], r["tools"]) for r in a["attribution"].limit(ACTORS).collect()]))
    if a.kind == "log":
        parts.append(_table("What to do first", ("step", "action", "priority"), [(r["step"], r["code"], r["priority"]) for r in a["report_steps"].orderBy("step").limit(STEPS).collect()]))
    return f"﻿<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(name)}</title><style>{STYLE}</style></head><body>{''.join(parts)}</body></html>"


def save(a: Analysis, name: str, path: str, narrator: Narrator | None = None) -> None:
    """Writes the report as one text file under `path`."""
    spark = a["steps"].sparkSession
    spark.createDataFrame([(render(a, name, narrator),)], "value string").coalesce(1).write.mode("overwrite").text(path)
