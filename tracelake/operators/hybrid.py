"""The hybrid risk of lines: isolation score, attack class and entropy joined by a noisy-or."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.random import seed_from, seed_from_sql
from tracelake.functions.text import high_entropy_sql, high_entropy_tokens
from tracelake.operators import bayes, features, forest
from tracelake.operators.detect import truncate, truncate_sql
from tracelake.operators.strides import stride_sample_sql
from tracelake.session import ship
from tracelake.store import cut

TOP, FLAG = 20, 0.5


def log_seed(rows: DataFrame, key: str = "line_number", text: str = "raw") -> int:
    """A seed of the number of lines, the first and the last."""
    n, first, last = rows.agg(F.count("*"), F.min_by(text, key), F.max_by(text, key)).first()
    return seed_from(n, first or "", last or "")


def mft_seed(rows: DataFrame, key: str = "record_number", name: str = "file_name") -> int:
    """A seed of the number of records and the first one's name."""
    n, first = rows.agg(F.count("*"), F.min_by(name, key)).first()
    return seed_from(n, first or "")


def log_seed_sql(entries: str, key: str = "line_number", text: str = "raw") -> str:
    joined = f"SELECT count(*)::VARCHAR || '|' || coalesce(arg_min({text}, {key}), '') || '|' || coalesce(arg_max({text}, {key}), '') AS said FROM ({entries})"
    return f"(SELECT {seed_from_sql('said')} FROM ({joined}))"


def mft_seed_sql(records: str, key: str = "record_number", name: str = "file_name") -> str:
    return f"(SELECT {seed_from_sql('said')} FROM (SELECT count(*)::VARCHAR || '|' || coalesce(arg_min({name}, {key}), '') AS said FROM ({records})))"


def noisy_or(*parts: Column) -> Column:
    """1 less the product of what each part leaves."""
    left = F.lit(1.0)
    for p in parts:
        left = left * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))
    return 1 - left


def _beyond(x: Column, start: float, width: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - start) / width))


def log_risk(entries: DataFrame, model: bayes.Model) -> DataFrame:
    """(line_number, snippet, features, isolation, label, confidence, risk, reasons) of every entry; what is read of a line is worked out in one pass and written."""
    rows = bayes.classified(features.log_features(entries), model, "line_number", "raw")
    rows = cut(rows.select("line_number", truncate(F.trim("raw"), 160).alias("snippet"), *features.LOG_NAMES, "label", "confidence"), "features")
    seed = log_seed(entries.select("line_number", "raw"))
    rows = forest.scored(features.odd_features(rows, features.LOG_NAMES, features.LOG_ODD), features.LOG_NAMES, "line_number", seed, "isolation")
    attack = F.when(F.col("label") != "benign", F.col("confidence")).otherwise(0.0)
    risk = noisy_or(0.6 * _beyond(F.col("isolation"), 0.5, 0.25), 0.78 * attack, 0.35 * _beyond(F.col("msg_entropy"), 0.58, 0.42))
    named = (F.col("label") != "benign") & (F.col("confidence") >= bayes.SURE)
    why = F.when(named, F.concat_ws(",", F.concat(F.lit("class:"), "label"), F.when(F.col("reasons") != "", F.col("reasons")))).otherwise(F.col("reasons"))
    return rows.withColumn("risk", F.round(risk, RISK_DIGITS)).withColumn("reasons", why)


#: Digits of a risk, so that limits are met alike in any engine.
RISK_DIGITS = 9


def log_anomalies(risks: DataFrame, top: int = TOP) -> DataFrame:
    """The riskiest lines, one for each set of reasons, with how many more share it."""
    risky = risks.where(F.col("risk") >= FLAG)
    key = F.when(F.col("reasons") == "", F.concat(F.lit("line "), F.col("line_number").cast("string"))).otherwise(F.col("reasons"))
    best = F.struct(F.round("risk", 3).alias("score"), (-F.col("line_number")).alias("n"), "snippet", "reasons")
    per = risky.groupBy(key.alias("k")).agg(F.max(best).alias("b"), (F.count("*") - 1).alias("dupes"))
    out = per.select((-F.col("b.n")).alias("line_number"), "b.score", "b.reasons", "b.snippet", "dupes")
    return out.orderBy(F.desc("score"), "line_number").limit(top)


#: Weights of the noisy-or of file records.
MFT_WEIGHTS = (("suspicious_loc", 0.66), ("double_ext", 0.7), ("ext_risk", 0.45), ("inactive", 0.44), ("si_fn_delta", 0.6))


def mft_risk(records: DataFrame) -> DataFrame:
    """(record_number, path, features, isolation, risk, reasons) of every file record."""
    rows = cut(features.mft_features(records).select("record_number", "path", "file_name", *features.MFT_NAMES), "features")
    rows = forest.scored(features.odd_features(rows, features.MFT_NAMES, features.MFT_ODD), features.MFT_NAMES, "record_number", mft_seed(rows), "isolation")
    parts = [F.col(n) * w for n, w in MFT_WEIGHTS]
    return rows.withColumn("risk", F.round(noisy_or(*parts, 0.44 * _beyond(F.col("name_entropy"), 0.7, 0.3), 0.48 * _beyond(F.col("isolation"), 0.5, 0.25)), RISK_DIGITS))


def mft_anomalies(risks: DataFrame, top: int = TOP) -> DataFrame:
    """The riskiest records, one for each set of reasons, with how many more share it."""
    risky = risks.where(F.col("risk") >= FLAG)
    key = F.when(F.col("reasons") == "", F.concat(F.lit("record "), F.col("record_number").cast("string"), F.lit(" "), F.col("path"))).otherwise(F.col("reasons"))
    best = F.struct(F.round("risk", 3).alias("score"), (-F.col("record_number")).alias("n"), truncate(F.col("path"), 160).alias("path"), "reasons")
    per = risky.groupBy(key.alias("k")).agg(F.max(best).alias("b"), (F.count("*") - 1).alias("dupes"))
    return per.select((-F.col("b.n")).alias("record_number"), "b.score", "b.reasons", "b.path", "dupes").orderBy(F.desc("score"), "record_number").limit(top)


def _beyond_sql(x: str, start: float, width: float) -> str:
    return f"least(1::DOUBLE, greatest(0::DOUBLE, ({x} - {start}) / {width}))"


def _noisy_or_sql(*parts: str) -> str:
    left = " * ".join(f"(1 - least(1::DOUBLE, greatest(0::DOUBLE, {p})))" for p in parts)
    return f"round(1 - {left}, {RISK_DIGITS})"


def log_risk_sql(entries: str, classes: str) -> str:
    """The same as `log_risk` for DuckDB, from `classes` (line_number, label, confidence)."""
    rows = features.odd_features_sql(features.log_features_sql(entries), features.LOG_NAMES, features.LOG_ODD)
    scored = forest.scored_sql(rows, features.LOG_NAMES, stride_sample_sql(features.log_features_sql(entries), "line_number", forest.SAMPLE), log_seed_sql(entries))
    risk = _noisy_or_sql(f"0.6 * {_beyond_sql('score', 0.5, 0.25)}", "0.78 * CASE WHEN label <> 'benign' THEN confidence ELSE 0 END", f"0.35 * {_beyond_sql('msg_entropy', 0.58, 0.42)}")
    why = f"CASE WHEN label <> 'benign' AND confidence >= {bayes.SURE} THEN 'class:' || label || CASE WHEN reasons <> '' THEN ',' || reasons ELSE '' END ELSE reasons END"
    return f"SELECT line_number, {truncate_sql('trim(raw)', 160)} AS snippet, {risk} AS risk, {why} AS reasons FROM ({scored}) JOIN ({classes}) USING (line_number)"


def log_anomalies_sql(entries: str, classes: str, top: int = TOP) -> str:
    ranked = f"SELECT *, CASE WHEN reasons = '' THEN 'line ' || line_number ELSE reasons END AS k, round(risk, 3) AS score FROM ({log_risk_sql(entries, classes)}) WHERE risk >= {FLAG}"
    per = f"SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, line_number) AS nth, (count(*) OVER (PARTITION BY k) - 1)::BIGINT AS dupes FROM ({ranked})"
    return f"SELECT line_number, score, reasons, snippet, dupes FROM ({per}) WHERE nth = 1 ORDER BY score DESC, line_number LIMIT {top}"


def mft_risk_sql(records: str) -> str:
    rows = features.odd_features_sql(features.mft_features_sql(records), features.MFT_NAMES, features.MFT_ODD)
    scored = forest.scored_sql(rows, features.MFT_NAMES, stride_sample_sql(features.mft_features_sql(records), "record_number", forest.SAMPLE), mft_seed_sql(records))
    parts = [f"{n} * {w}" for n, w in MFT_WEIGHTS]
    return f"SELECT *, {_noisy_or_sql(*parts, f'0.44 * {_beyond_sql("name_entropy", 0.7, 0.3)}', f'0.48 * {_beyond_sql("score", 0.5, 0.25)}')} AS risk FROM ({scored})"


def mft_anomalies_sql(records: str, top: int = TOP) -> str:
    ranked = f"SELECT record_number, path, reasons, risk, CASE WHEN reasons = '' THEN 'record ' || record_number || ' ' || path ELSE reasons END AS k, round(risk, 3) AS points FROM ({mft_risk_sql(records)}) WHERE risk >= {FLAG}"
    per = f"SELECT *, row_number() OVER (PARTITION BY k ORDER BY points DESC, record_number, path DESC) AS nth, (count(*) OVER (PARTITION BY k) - 1)::BIGINT AS dupes FROM ({ranked})"
    return f"SELECT record_number, points AS score, reasons, {truncate_sql('path', 160)} AS path, dupes FROM ({per}) WHERE nth = 1 ORDER BY score DESC, record_number LIMIT {top}"


ENTROPY_FLAGS, PREFIX, PACKED = 12, 24, 5.0


def _first_of_each(top: int):
    """Of rows (key, at, prefix, entropy, token): the first row of those `top` prefixes of the partition that come first."""

    def run(batches):
        best: dict[str, tuple] = {}
        limit, schema = None, None
        for batch in batches:
            schema = batch.schema
            for key, at, prefix, entropy, token in zip(*(c.to_pylist() for c in batch.columns)):
                place = (key is not None, key, at)
                if limit is not None and place > limit:
                    continue
                if prefix not in best or place < best[prefix][0]:
                    best[prefix] = place, (key, at, prefix, entropy, token)
                    if len(best) > top:
                        del best[max(best, key=lambda p: best[p][0])]
                    limit = max(b[0] for b in best.values()) if len(best) == top else None
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*(b[1] for b in best.values())), schema)], schema=schema)

    return run


def entropy_flags(rows: DataFrame, key: str, text: str, top: int = ENTROPY_FLAGS) -> DataFrame:
    """The first long runs of high entropy by row, one for each start of 24 characters, and what they look like.

    A partition hands on its `top` first ones: of the `top` first of all, each is among those of its own partition.
    """
    ship(rows.sparkSession)
    found = rows.select(key, F.posexplode(F.array_sort(F.transform(high_entropy_tokens(F.col(text)), lambda x: F.struct((-F.round(x["entropy"], 2)).alias("e"), x["token"].alias("token"))))).alias("at", "x"))
    found = found.select(key, "at", F.substring("x.token", 1, PREFIX).alias("prefix"), (-F.col("x.e")).alias("entropy"), F.col("x.token").alias("token"))
    first = found.mapInArrow(_first_of_each(top), found.schema).groupBy("prefix").agg(F.min(F.struct(key, "at", "entropy", "token")).alias("f")).select("f.*")
    note = F.when(F.col("entropy") >= PACKED, "packed").when(F.col("token").rlike(r"^[A-Za-z0-9+/=]+\z"), "base64").otherwise("obfuscated")
    best = first.orderBy(key, "at").limit(top)
    place = F.row_number().over(Window.orderBy(key, "at"))  # `top` rows
    return best.select(place.alias("place"), key, truncate(F.col("token"), 40).alias("value"), "entropy", note.alias("note"))


def metrics(crossed: DataFrame | None, risky: DataFrame, silhouette: DataFrame) -> DataFrame:
    """One row of what the learning results are worth: accuracy of the classifier in cross-validation, trees, rows, flagged rows and their share, silhouette."""
    flagged = risky.agg(F.count("*").alias("rows"), F.count_if(F.col("risk") >= FLAG).alias("flagged"))
    out = flagged.select("rows", "flagged", F.round(F.col("flagged") / F.greatest(F.col("rows"), F.lit(1)), 3).alias("contamination"), F.lit(forest.TREES).alias("trees")).join(F.broadcast(silhouette))  # one row each
    if crossed is None:
        return out.withColumn("accuracy", F.lit(None).cast("double"))
    return out.join(F.broadcast(crossed.agg(F.round(F.avg((F.col("label") == F.col("predicted")).cast("int")), 3).alias("accuracy"))))


def metrics_sql(risks: str, silhouette: str, crossed: str) -> str:
    return f"""SELECT rows, flagged, round(flagged / greatest(rows, 1), 3) AS contamination, {forest.TREES} AS trees, silhouette, accuracy FROM
      (SELECT count(*)::BIGINT AS rows, count_if(risk >= {FLAG})::BIGINT AS flagged FROM ({risks})), ({silhouette}), (SELECT round(avg((label = predicted)::INT), 3) AS accuracy FROM ({crossed}))"""


def entropy_flags_sql(source: str, key: str, text: str, top: int = ENTROPY_FLAGS) -> str:
    """The same as `entropy_flags` for DuckDB."""
    found = f"SELECT {key}, token, round(entropy, 2) AS entropy FROM ({high_entropy_sql(source, key, text)})"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY -entropy, token) AS pos FROM ({found})"
    first = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token[1:{PREFIX}] ORDER BY {key}, pos) AS nth FROM ({ranked})) WHERE nth = 1"
    note = f"CASE WHEN entropy >= {PACKED} THEN 'packed' WHEN regexp_matches(token, '^[A-Za-z0-9+/=]+$') THEN 'base64' ELSE 'obfuscated' END"
    return f"SELECT (row_number() OVER (ORDER BY {key}, pos))::INT AS place, {key}, {truncate_sql('token', 40)} AS value, entropy, {note} AS note FROM (SELECT * FROM ({first}) ORDER BY {key}, pos LIMIT {top})"
