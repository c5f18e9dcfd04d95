"""One call for a whole analysis: lazy DataFrames over one set of entries or records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import bayes, clusters, detect, features, hybrid, mft, parse, reason, threats
from tracelake.plans.case import LogCase, RecordCase
from tracelake.sources import ingest, testbed
from tracelake.store import cut

#: Characters at the start of a log that its format is told from.
HEAD = 4000


@dataclass
class Analysis:
    """Results by name. A result is planned when it is first asked for, and what several of them share is then written once."""

    kind: str
    makers: dict[str, Callable[[], DataFrame]]
    made: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def __contains__(self, name: str) -> bool:
        return name in self.makers


#: Results of `LogCase` that an analysis of a log has.
LOG_FRAMES = (
    "entries", "anomalies", "iocs", "ioc_lines", "techniques", "cves", "cve_evidence", "traffic", "timeline", "flow_nodes", "flow_edges", "steps", "intrusion", "attribution",
    "counters", "report_steps", "tops", "report_lines", "overview", "kpis",
)


def analyze_logs(entries: DataFrame, corpus: DataFrame | None = None) -> Analysis:
    """All log operators over entries, which are read twice for the rules and once for each learning result that is asked for."""
    case = LogCase(entries)
    spark = entries.sparkSession
    labelled = corpus if corpus is not None else testbed.labelled(spark, "")

    @cache
    def model() -> bayes.Model:
        return bayes.fit(labelled)

    @cache
    def lines() -> DataFrame:
        return cut(entries, "entries")  # what learns from lines reads them several times

    @cache
    def risks() -> DataFrame:
        return cut(hybrid.log_risk(lines(), model()), "risks")

    @cache
    def groups() -> clusters.Clusters | None:
        return clusters.of_logs(lines(), "line_number", "raw", hybrid.log_seed(lines()))

    def text() -> DataFrame:
        return entries.select("line_number", detect.haystack().alias("text"))

    learned = {
        "ml_anomalies": lambda: hybrid.log_anomalies(risks()),
        "ml_classes": lambda: bayes.class_distribution(risks().select("label", "confidence")),
        "ml_clusters": lambda: clusters.log_clusters(groups(), spark),
        "ml_entropy": lambda: hybrid.entropy_flags(text(), "line_number", "text"),
        "ml_metrics": lambda: hybrid.metrics(bayes.cross_validated(labelled), risks(), clusters.silhouette(groups(), spark)),
    }
    return Analysis("log", {n: (lambda n=n: getattr(case, n)) for n in LOG_FRAMES} | learned)


def analyze_mft(records: DataFrame) -> Analysis:
    """All operators over file records; those on findings start from findings written once."""
    case = RecordCase(records)

    def tools() -> DataFrame:
        return threats.tools_named(case.findings.select(F.concat_ws(" ", "category", "path").alias("text")), "text")

    def intrusion() -> DataFrame:
        dated = case.findings.select(F.col("si_created").alias("ts"), F.col("record_number").alias("line_number"), F.lit(None).cast("string").alias("source_ip"))
        none = case.iocs.select(F.lit("filepath").alias("type"), "value", "count", *[F.lit(0).alias(c) for c in ("first_line", "first_pattern", "first_at")])
        return reason.intrusion_summary(case.steps, dated, none)

    spark = records.sparkSession

    @cache
    def risks() -> DataFrame:
        return cut(hybrid.mft_risk(records), "risks")

    @cache
    def groups() -> clusters.Clusters | None:
        rows = cut(features.mft_features(records).select("record_number", "file_name", "ext", *features.MFT_NAMES), "features")
        return clusters.of_records(rows, "record_number", hybrid.mft_seed(rows))

    return Analysis(
        "mft",
        {n: (lambda n=n: getattr(case, n)) for n in ("records", "totals", "findings", "shown", "by_category", "techniques", "iocs", "timeline", "flow_nodes", "flow_edges", "steps")}
        | {
            "intrusion": intrusion,
            "attribution": lambda: threats.attribution(case.techniques, tools()),
            "ml_anomalies": lambda: hybrid.mft_anomalies(risks()),
            "ml_clusters": lambda: clusters.mft_clusters(groups(), spark),
            "ml_metrics": lambda: hybrid.metrics(None, risks(), clusters.silhouette(groups(), spark)),
        },
    )


def analyze(spark: SparkSession, path: str) -> Analysis:
    """The analysis of a file: of file records if its header says so, else of a log."""
    kind, rows, header = ingest.ingest(spark, path)
    if kind == "mft":
        return analyze_mft(mft.records(rows, header))
    if kind == "table":
        return analyze_logs(parse.csv_entries(rows, header))
    first = rows.where(F.col("line_number") <= HEAD).orderBy("line_number").select(F.substring("line", 1, HEAD).alias("line")).take(HEAD)  # each line adds a character at least
    head = "\n".join(r["line"] for r in first)[:HEAD]
    form = spark.range(1).select(parse.detect_format(F.lit(path), F.lit(head)).alias("f")).first()["f"]
    return analyze_logs(parse.weblog(rows) if form == "weblog" else parse.generic(rows, format_=form))


#: Turns the report's numbers into a paragraph, or gives nothing; none is built in.
Narrator = Callable[[dict], str | None]
