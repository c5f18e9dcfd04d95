"""Queries over file-system records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.time import said, said_sql
from tracelake.operators import clusters, features, hybrid, mft
from tracelake.sources import testbed
from tracelake.store import cut

RECORDS = mft.records_sql(testbed.mft_table("duckdb"), testbed.MFT_HEADER)
FINDINGS = mft.findings_sql(RECORDS)
FEATURES = features.mft_features_sql(RECORDS)


def records(spark: SparkSession, sf: str) -> DataFrame:
    rows = testbed.mft_rows(spark, sf)
    cells = rows.select("row_number", F.array(*[f"c{k}" for k in range(len(testbed.MFT_HEADER))]).alias("cells"))
    return mft.records(cells, list(testbed.MFT_HEADER))


def found(spark: SparkSession, sf: str) -> DataFrame:
    return mft.findings(records(spark, sf))


_SHORT = ("si_created", "si_modified", "fn_created")


def _dated(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: said(F.col(n)) for n in names})


def _dated_sql(sql: str, *names: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'{said_sql(n)} AS {n}' for n in names)}) FROM ({sql})"


def mft_parse(spark, sf):
    return _dated(records(spark, sf), *_SHORT).select("record_number", "active", "record_type", "path", "file_name", "ext", *_SHORT)


def mft_totals(spark, sf):
    return mft.totals(records(spark, sf))


def mft_findings(spark, sf):
    return _dated(found(spark, sf), "si_created", "fn_created")


def mft_shown(spark, sf):
    return mft.shown(found(spark, sf)).select("record_number", "rule_no", "category", "severity", "path")


def mft_search(spark, sf):
    """Findings that name a folder of downloads or temporary files."""
    return mft.search(found(spark, sf), "Temp").select("record_number", "rule_no", "category", "severity", "path")


def mft_by_category(spark, sf):
    return mft.by_category(found(spark, sf))


def mft_techniques(spark, sf):
    return mft.techniques(found(spark, sf))


def mft_iocs(spark, sf):
    return _dated(mft.iocs(found(spark, sf)), "first_seen")


def mft_timeline(spark, sf):
    return _dated(mft.timeline(found(spark, sf)), "si_created")


def mft_features(spark, sf):
    df = features.mft_features(records(spark, sf))
    return df.select("record_number", "path", *[F.round(n, 6).alias(n) for n in features.MFT_NAMES])


def mft_feature_stats(spark, sf):
    df = features.feature_stats(features.mft_features(records(spark, sf)), features.MFT_NAMES)
    return df.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def mft_zscore_reasons(spark, sf):
    return features.odd_features(features.mft_features(records(spark, sf)), features.MFT_NAMES, features.MFT_ODD).select("record_number", "path", "reasons")


#: Weights of the noisy-or of file records; the isolation forest's part is left out here.
WEIGHTS = (("suspicious_loc", 0.66), ("double_ext", 0.7), ("ext_risk", 0.45), ("inactive", 0.44), ("si_fn_delta", 0.6), ("greatest(0, (name_entropy - 0.7) / 0.3)", 0.44))


def noisy_or_mft(spark, sf):
    kept = F.lit(1.0)
    for x, w in WEIGHTS:
        kept = kept * (1 - F.least(F.lit(1.0), F.expr(f"cast({x} AS DOUBLE)") * w))
    return features.mft_features(records(spark, sf)).select("record_number", "path", F.round(1 - kept, 6).alias("risk"))


def mft_ml_anomalies(spark, sf):
    return hybrid.mft_anomalies(hybrid.mft_risk(records(spark, sf)))


def mft_clusters(spark, sf):
    rows = cut(features.mft_features(records(spark, sf)).select("record_number", "file_name", "ext", *features.MFT_NAMES), "features")
    found = clusters.mft_clusters(clusters.of_records(rows, "record_number", hybrid.mft_seed(rows)), spark)
    return found.withColumn("ratio", F.round("ratio", 6))


_KEPT = " * ".join(f"(1 - least(1::DOUBLE, ({x})::DOUBLE * {w}))" for x, w in WEIGHTS)
QUERIES = {f.__name__: f for f in (mft_parse, mft_totals, mft_findings, mft_shown, mft_search, mft_by_category, mft_techniques, mft_iocs, mft_timeline, mft_features, mft_feature_stats, mft_zscore_reasons, noisy_or_mft, mft_ml_anomalies, mft_clusters)}
ORACLE_SQL = {
    "mft_parse": f"SELECT record_number, active, record_type, path, file_name, ext, {', '.join(_SHORT)} FROM ({_dated_sql(RECORDS, *_SHORT)})",
    "mft_totals": mft.totals_sql(RECORDS),
    "mft_findings": _dated_sql(FINDINGS, "si_created", "fn_created"),
    "mft_shown": f"SELECT record_number, rule_no, category, severity, path FROM ({FINDINGS}) ORDER BY {mft.severity.rank_sql('severity')} DESC, record_number, rule_no, path LIMIT {mft.SHOWN}",
    "mft_search": f"SELECT record_number, rule_no, category, severity, path FROM ({mft.search_sql(FINDINGS, 'Temp')})",
    "mft_by_category": f"SELECT category, count(*)::BIGINT AS count, {mft.severity.worst_sql('severity')} AS severity FROM ({FINDINGS}) GROUP BY 1",
    "mft_techniques": mft.techniques_sql(FINDINGS),
    "mft_iocs": _dated_sql(mft.iocs_sql(FINDINGS), "first_seen"),
    "mft_timeline": f"SELECT row_number() OVER (ORDER BY si_created, record_number, rule_no, path)::INT AS place, {said_sql('si_created')} AS si_created, file_name, category, severity, confidence, {mft.truncate_sql('path', 160)} AS path FROM ({FINDINGS}) WHERE si_created IS NOT NULL ORDER BY 1 LIMIT {mft.DATED}",
    "mft_features": f"SELECT record_number, path, {', '.join(f'round({n}, 6) AS {n}' for n in features.MFT_NAMES)} FROM ({FEATURES})",
    "mft_feature_stats": f"SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std FROM ({features.feature_stats_sql(FEATURES, features.MFT_NAMES)})",
    "mft_zscore_reasons": f"SELECT record_number, path, reasons FROM ({features.odd_features_sql(FEATURES, features.MFT_NAMES, features.MFT_ODD)})",
    "mft_ml_anomalies": hybrid.mft_anomalies_sql(RECORDS),
    "mft_clusters": f"SELECT * REPLACE (round(ratio, 6) AS ratio) FROM ({clusters.mft_clusters_sql(FEATURES, 'record_number', hybrid.mft_seed_sql(RECORDS))})",
    "noisy_or_mft": f"SELECT record_number, path, round(1 - {_KEPT}, 6) AS risk FROM ({FEATURES})",
}
