"""All operators over one set of log entries or file records, each shared step worked out once.

Entries are parsed once: what lines show and what their source addresses are counted by is written to the
shared folder when it is first asked for, and so are the counts; everything else starts from them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators import detect, iocs, mft, observe, reason, threats, timeline, traffic
from tracelake.store import cut


class LogCase:
    """Results of an analysis of log entries, by name; nothing runs until one is asked for."""

    def __init__(self, entries: DataFrame):
        self.entries = entries

    @cached_property
    def observed(self) -> DataFrame:
        return cut(observe.observations(self.entries), "observed")

    @cached_property
    def sources(self) -> DataFrame:
        return cut(observe.sources(self.observed), "sources")

    @cached_property
    def addresses(self) -> DataFrame:
        return self.sources.where("source_ip is not null")

    @cached_property
    def hits(self) -> DataFrame:
        return observe.hits(self.observed)

    @cached_property
    def anomalies(self) -> DataFrame:
        return detect.findings(self.hits, self.addresses)

    @cached_property
    def techniques(self) -> DataFrame:
        return cut(threats.techniques(self.hits), "techniques")  # a row for each technique

    @cached_property
    def ioc_hits(self) -> DataFrame:
        return observe.ioc_hits(self.observed)

    @cached_property
    def iocs(self) -> DataFrame:
        return iocs.iocs(self.ioc_hits)

    @cached_property
    def ioc_lines(self) -> DataFrame:
        return iocs.related(self.ioc_hits)

    @cached_property
    def cve_evidence(self) -> DataFrame:
        return threats.cve_evidence(observe.cve_hits(self.observed))

    @cached_property
    def cves(self) -> DataFrame:
        return threats.cves(observe.cve_hits(self.observed), self.techniques, self.iocs)

    @cached_property
    def traffic(self) -> DataFrame:
        return traffic.scored(self.addresses)

    @cached_property
    def timeline(self) -> DataFrame:
        return timeline.timeline(self.anomalies)

    @cached_property
    def flow_nodes(self) -> DataFrame:
        return threats.flow_nodes(self.techniques)

    @cached_property
    def flow_edges(self) -> DataFrame:
        return threats.flow_edges(self.flow_nodes)

    @cached_property
    def steps(self) -> DataFrame:
        return reason.killchain_steps(self.techniques)

    @cached_property
    def intrusion(self) -> DataFrame:
        return reason.intrusion_summary(self.steps, self.anomalies, self.iocs)

    @cached_property
    def attribution(self) -> DataFrame:
        return threats.attribution(self.techniques, threats.tools_named(self.anomalies, "evidence", ["line_number", "rule_no", "source_ip"]))

    @cached_property
    def counters(self) -> DataFrame:
        n = self.sources.agg(F.coalesce(F.sum("requests"), F.lit(0)).alias("entries"))
        return reason.report_counters(n, self.anomalies, self.iocs, self.techniques, self.cves, self.traffic)

    @cached_property
    def report_steps(self) -> DataFrame:
        return reason.report_steps(self.counters, self.cves)

    @cached_property
    def tops(self) -> DataFrame:
        return reason.tops(self.techniques, self.cves, self.iocs, self.traffic)

    @cached_property
    def report_lines(self) -> DataFrame:
        return reason.report_lines(self.counters, self.techniques, self.tops)

    @cached_property
    def overview(self) -> DataFrame:
        return reason.overview(self.traffic, self.techniques, self.cves, self.anomalies, self.timeline)

    @cached_property
    def kpis(self) -> DataFrame:
        return reason.kpis(self.sources, self.traffic)


class RecordCase:
    """Results over file records, by name; findings are written once, when they are first asked for."""

    def __init__(self, records_: DataFrame):
        self.records = records_

    @cached_property
    def findings(self) -> DataFrame:
        return cut(mft.findings(self.records), "findings")

    @cached_property
    def techniques(self) -> DataFrame:
        return cut(mft.techniques(self.findings), "techniques")  # a row for each technique

    @property
    def totals(self) -> DataFrame:
        return mft.totals(self.records)

    @property
    def shown(self) -> DataFrame:
        return mft.shown(self.findings)

    @property
    def by_category(self) -> DataFrame:
        return mft.by_category(self.findings)

    @property
    def iocs(self) -> DataFrame:
        return mft.iocs(self.findings)

    @property
    def timeline(self) -> DataFrame:
        return mft.timeline(self.findings)

    @property
    def named(self) -> DataFrame:
        return self.techniques.withColumn("hits", F.col("findings"))

    @property
    def steps(self) -> DataFrame:
        return reason.killchain_steps(self.named)

    @property
    def flow_nodes(self) -> DataFrame:
        return threats.flow_nodes(self.named)

    @property
    def flow_edges(self) -> DataFrame:
        return threats.flow_edges(self.flow_nodes)
