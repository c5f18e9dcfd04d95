"""Queries of the learning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import format as formats
from tracelake.functions import text
from tracelake.operators import bayes, clusters, features, forest, hybrid, parse, strides, terms
from tracelake.queries import logs
from tracelake.sources import testbed
from tracelake.store import cut

CORPUS = testbed.labelled_lines()
LABELLED = testbed.labelled_log("duckdb")
FEATURES = features.log_features_sql(logs.ENTRIES)
DOCS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
PREDICTED = bayes.predict_sql(CORPUS, f"SELECT line_number, raw FROM ({logs.ENTRIES})", "line_number", "raw")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return testbed.spread(spark, sf, "documents", "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return features.log_features(logs.entries(spark, sf))


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    return bayes.predict(logs.entries(spark, sf), bayes.fit(testbed.labelled(spark, sf)), "line_number", "raw")


def shannon_entropy(spark, sf):
    return _docs(spark, sf).select("doc_id", F.round(text.shannon_entropy(F.col("text")), 6).alias("entropy"))


def char_stats(spark, sf):
    stats = text.char_stats(F.col("text"))
    return _docs(spark, sf).select("doc_id", *[(v if n == "len" else F.round(v, 6)).alias(n) for n, v in stats.items()])


def tokenize(spark, sf):
    return text.with_tokens(logs.entries(spark, sf).select("line_number", "raw"), "raw").select("line_number", F.array_join("tokens", " ").alias("tokens"))


#: The driver's documents hold hardly a token of high entropy, so every seventh gets a key of its own at its end.
KEYED = "SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN ' key: ' || to_base64(unhex(sha256(doc_id::VARCHAR))) ELSE '' END AS text FROM documents"


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat(F.lit(" key: "), F.base64(F.unhex(F.sha2(F.col("doc_id").cast("string"), 256))))
    return _docs(spark, sf).withColumn("text", F.concat("text", F.when(F.col("doc_id") % 7 == 0, key).otherwise("")))


def token_labels(spark, sf):
    """How often each sign of attack syntax occurs in the log, as a reader sees it."""
    rows = text.token_rows(logs.entries(spark, sf).select("line_number", "raw"), "raw").where("startswith(token, '§')")
    return rows.groupBy(text.labelled(F.col("token")).alias("sign")).agg(F.count("*").alias("n"))


def format_values(spark, sf):
    """Numbers and times of orders as a reader sees them."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.floor(F.col("o_totalprice") * 1000 * (F.col("o_orderkey") % 1000)).cast("long").alias("n"), ((F.col("o_orderkey") % 1000) / 1000.0).alias("share"), F.col("o_orderdate").cast("timestamp").alias("at"))
    at = F.col("at") + F.make_interval(secs=F.col("o_orderkey") % 86400)
    return rows.select("o_orderkey", formats.bytes_said(F.col("n")).alias("bytes"), formats.number_said(F.col("n")).alias("number"), formats.percent_said(F.col("share")).alias("percent"), formats.percent_said(F.col("share"), 1).alias("percent_1"), formats.time_said(at).alias("time"))


_ORDERS = "SELECT o_orderkey, floor(o_totalprice * 1000 * (o_orderkey % 1000))::BIGINT AS n, ((o_orderkey % 1000) / 1000.0)::DOUBLE AS share, o_orderdate::TIMESTAMP + to_seconds(o_orderkey % 86400) AS moment FROM orders"


def high_entropy_tokens(spark, sf):
    rows = _keyed(spark, sf).select("doc_id", F.explode(text.high_entropy_tokens(F.col("text"))).alias("t"))
    return rows.select("doc_id", "t.token", F.round("t.entropy", 2).alias("entropy"))


def log_features(spark, sf):
    return _features(spark, sf).select("line_number", *[F.round(n, 6).alias(n) for n in features.LOG_NAMES])


def feature_stats(spark, sf):
    df = features.feature_stats(_features(spark, sf), features.LOG_NAMES)
    return df.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def zscore_reasons(spark, sf):
    rows = cut(_features(spark, sf).select("line_number", *features.LOG_NAMES), "features")  # for their means, and for what is far from them
    return features.odd_features(rows, features.LOG_NAMES, features.LOG_ODD).select("line_number", "reasons")


def stride_sample(spark, sf):
    return strides.stride_sample(cut(logs.entries(spark, sf).select("line_number"), "lines"), "line_number", forest.SAMPLE).select("line_number", "place")


def nb_train_counts(spark, sf):
    return bayes.token_counts(testbed.labelled_events(spark, sf))


def nb_predict(spark, sf):
    return predicted(spark, sf).select("line_number", "label", F.round("confidence", 4).alias("confidence"))


def nb_crossval(spark, sf):
    return bayes.cross_validated(testbed.labelled_events(spark, sf))


def nb_accuracy(spark, sf):
    found = bayes.cross_validated(testbed.labelled_events(spark, sf))
    return found.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("predicted")).cast("int")), 6).alias("accuracy"))


def class_distribution(spark, sf):
    return bayes.class_distribution(predicted(spark, sf)).select("label", "count", F.round("ratio", 6).alias("ratio"))


def tfidf_vocab(spark, sf):
    docs = _docs(spark, sf)
    return terms.vocabulary(terms.token_rows(docs, "doc_id", "text"), docs.count()).select("token", "df", F.round("idf", 6).alias("idf"))


def tfidf_weights(spark, sf):
    docs = _docs(spark, sf)
    rows = terms.token_rows(docs, "doc_id", "text")
    return terms.weights(rows, terms.vocabulary(rows, docs.count()), "doc_id").select("doc_id", "token", F.round("weight", 6).alias("weight"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of lines written once: what learns from them reads them several times, mostly without what is parsed of them."""
    return parse.weblog(cut(testbed.access_lines(spark, sf), "lines"))


def iforest_scores(spark, sf):
    rows = cut(_features(spark, sf).select("line_number", "raw", *features.LOG_NAMES), "features")
    found = forest.scored(rows, features.LOG_NAMES, "line_number", hybrid.log_seed(rows))
    return found.select("line_number", F.round("score", 6).alias("score"))


def _clusters(rows: DataFrame, most: int | None = None) -> clusters.Clusters | None:
    return clusters.of_logs(rows, "line_number", "raw", hybrid.log_seed(rows), most)


def kmeans_clusters(spark, sf):
    found = clusters.log_clusters(_clusters(_lines(spark, sf)), spark)
    return found.withColumn("ratio", F.round("ratio", 6))


def kmeans_silhouette(spark, sf):
    return clusters.silhouette(_clusters(_lines(spark, sf)), spark).select(F.round("silhouette", 6).alias("silhouette"))


def ml_metrics(spark, sf):
    rows = _lines(spark, sf)
    crossed = bayes.cross_validated(testbed.labelled_events(spark, sf))
    found = hybrid.metrics(crossed, hybrid.log_risk(rows, bayes.fit(testbed.labelled(spark, sf))), clusters.silhouette(_clusters(rows, clusters.DOCS), spark))
    return found.withColumn("silhouette", F.round("silhouette", 6))


def ml_anomalies(spark, sf):
    return hybrid.log_anomalies(hybrid.log_risk(_lines(spark, sf), bayes.fit(testbed.labelled(spark, sf))))


def entropy_flags(spark, sf):
    return hybrid.entropy_flags(_keyed(spark, sf), "doc_id", "text").select("place", "doc_id", "value", F.round("entropy", 2).alias("entropy"), "note")


QUERIES = {
    f.__name__: f
    for f in (shannon_entropy, char_stats, tokenize, token_labels, format_values, high_entropy_tokens, log_features, feature_stats, zscore_reasons, stride_sample, nb_train_counts, nb_predict, nb_crossval, nb_accuracy, class_distribution, tfidf_vocab, tfidf_weights, iforest_scores, kmeans_clusters, kmeans_silhouette, ml_anomalies, ml_metrics, entropy_flags)
}
_STATS = text.char_stats_sql("text")
_SEED = hybrid.log_seed_sql(logs.ENTRIES)
_SILHOUETTE = clusters.log_silhouette_sql(logs.ENTRIES, "line_number", "raw", _SEED)
#: Of centres that come from a sample, as `ml_metrics` has them.
_SAMPLED_SILHOUETTE = clusters.log_silhouette_sql(logs.ENTRIES, "line_number", "raw", _SEED, clusters.DOCS)
_CROSS = bayes.cross_validated_sql(LABELLED)
ORACLE_SQL = {
    "shannon_entropy": f"SELECT doc_id, round({text.shannon_entropy_sql('text')}, 6) AS entropy FROM ({DOCS})",
    "char_stats": f"SELECT doc_id, {', '.join(f'{v} AS {n}' if n == 'len' else f'round({v}, 6) AS {n}' for n, v in _STATS.items())} FROM ({DOCS})",
    "tokenize": f"SELECT line_number, array_to_string(tokens, ' ') AS tokens FROM ({text.tokens_sql(f'SELECT line_number, raw FROM ({logs.ENTRIES})', 'raw')})",
    "high_entropy_tokens": f"SELECT doc_id, token, round(entropy, 2) AS entropy FROM ({text.high_entropy_sql(KEYED, 'doc_id', 'text')})",
    "log_features": f"SELECT line_number, {', '.join(f'round({n}, 6) AS {n}' for n in features.LOG_NAMES)} FROM ({FEATURES})",
    "feature_stats": f"SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std FROM ({features.feature_stats_sql(FEATURES, features.LOG_NAMES)})",
    "zscore_reasons": f"SELECT line_number, reasons FROM ({features.odd_features_sql(FEATURES, features.LOG_NAMES, features.LOG_ODD)})",
    "stride_sample": f"SELECT line_number, place FROM {strides.stride_sample_sql(f'SELECT line_number FROM ({logs.ENTRIES})', 'line_number', forest.SAMPLE)}",
    "nb_train_counts": bayes.counts_sql(LABELLED),
    "nb_predict": f"SELECT line_number, label, round(confidence, 4) AS confidence FROM ({PREDICTED})",
    "nb_crossval": _CROSS,
    "nb_accuracy": f"SELECT label, count(*)::BIGINT AS n, round(avg((label = predicted)::INT), 6) AS accuracy FROM ({_CROSS}) GROUP BY 1",
    "class_distribution": f"SELECT label, count, round(count / sum(count) OVER (), 6) AS ratio FROM (SELECT CASE WHEN confidence < {bayes.SURE} THEN 'benign' ELSE label END AS label, count(*)::BIGINT AS count FROM ({PREDICTED}) GROUP BY 1)",
    "iforest_scores": f"SELECT line_number, round(score, 6) AS score FROM ({forest.scored_sql(FEATURES, features.LOG_NAMES, strides.stride_sample_sql(FEATURES, 'line_number', forest.SAMPLE), _SEED)})",
    "kmeans_clusters": f"SELECT * REPLACE (round(ratio, 6) AS ratio) FROM ({clusters.log_clusters_sql(logs.ENTRIES, 'line_number', 'raw', _SEED)})",
    "kmeans_silhouette": f"SELECT round(silhouette, 6) AS silhouette FROM ({_SILHOUETTE})",
    "ml_anomalies": hybrid.log_anomalies_sql(logs.ENTRIES, PREDICTED),
    "ml_metrics": f"SELECT * REPLACE (round(silhouette, 6) AS silhouette) FROM ({hybrid.metrics_sql(hybrid.log_risk_sql(logs.ENTRIES, PREDICTED), _SAMPLED_SILHOUETTE, _CROSS)})",
    "entropy_flags": hybrid.entropy_flags_sql(KEYED, "doc_id", "text"),
    "token_labels": f"SELECT {text.labelled_sql('token')} AS sign, count(*)::BIGINT AS n FROM (SELECT unnest(tokens) AS token FROM ({text.tokens_sql(f'SELECT line_number, raw FROM ({logs.ENTRIES})', 'raw')})) WHERE starts_with(token, '§') GROUP BY 1",
    "format_values": f"SELECT o_orderkey, {formats.bytes_said_sql('n')} AS bytes, {formats.number_said_sql('n')} AS number, {formats.percent_said_sql('share')} AS percent, {formats.percent_said_sql('share', 1)} AS percent_1, {formats.time_said_sql('moment')} AS time FROM ({_ORDERS})",
    "tfidf_vocab": f"SELECT token, df, round(idf, 6) AS idf FROM ({terms.vocabulary_sql(DOCS, 'doc_id', 'text')})",
    "tfidf_weights": f"SELECT doc_id, token, round(weight, 6) AS weight FROM ({terms.weights_sql(DOCS, 'doc_id', 'text')})",
}
