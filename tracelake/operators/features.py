"""Numeric features of log entries and file records, their statistics, and what stands out in a row."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import char_stats, char_stats_sql, measured, shannon_entropy, shannon_entropy_sql
from tracelake.rules import mft
from tracelake.rx import any_of, any_sql
from tracelake.session import ship

LOG_NAMES = ("hour", "url_len", "msg_entropy", "digit_ratio", "special_ratio", "status_class", "bytes_log", "param_count", "ua_entropy", "non_ascii")
MFT_NAMES = ("name_entropy", "name_len", "path_depth", "ext_risk", "inactive", "si_fn_delta", "si_created_hour", "digit_ratio", "suspicious_loc", "double_ext")
LOG_ODD, MFT_ODD, REASONS, FLAT = 1.5, 1.3, 3, 1e-6
NO_HOUR = 12 / 23


def _one(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def _hour(ts: Column) -> Column:
    return F.coalesce(F.hour(ts) / F.lit(23.0), F.lit(NO_HOUR))


_MEASURES = "struct<bits:double,length:bigint,digits:bigint,special:bigint,beyond:bigint,agent_bits:double>"


def _measures(text: pa.Array, agent: pa.Array) -> pa.Array:
    own = measured(text)
    values = [own["entropy"], own["length"], own["digits"], own["special"], own["beyond"], measured(agent)["entropy"]]
    return pa.StructArray.from_arrays([pa.array(v) for v in values], names=["bits", "length", "digits", "special", "beyond", "agent_bits"])


def log_features(entries: DataFrame) -> DataFrame:
    """`entries` with a column for each of LOG_NAMES, 0 to 1; the characters of lines are counted in batches."""
    ship(entries.sparkSession)
    url, ua, status = F.coalesce("url", F.lit("")), F.coalesce("user_agent", F.lit("")), F.coalesce("status_code", F.lit(0))
    msg = F.coalesce(F.when(F.col("raw") != "", F.col("raw")), F.col("message"), F.lit(""))
    m, share = (lambda name: F.col(f"measures__.{name}")), (lambda name: F.col(f"measures__.{name}") / F.greatest(F.col("measures__.length"), F.lit(1)))
    klass = F.when(status >= 500, 1.0).when(status >= 400, 0.75).when(status >= 300, 0.4).when(status >= 200, 0.15).otherwise(0.0)
    values = (
        _hour(F.col("ts")),
        _one(F.length(url) / 200),
        _one(m("bits") / 6),
        share("digits"),
        share("special"),
        klass,
        _one(F.log10(1 + F.coalesce("bytes", F.lit(0))) / 6),
        _one(F.regexp_count(url, F.lit("[?&]")) / 6),
        _one(m("agent_bits") / 6),
        _one(share("beyond")),
    )
    return entries.withColumn("measures__", F.arrow_udf(_measures, _MEASURES)(msg, ua)).withColumns(dict(zip(LOG_NAMES, values))).drop("measures__")


def log_features_sql(entries: str) -> str:
    url, ua, status, msg = "coalesce(url, '')", "coalesce(user_agent, '')", "coalesce(status_code, 0)", "coalesce(nullif(raw, ''), message, '')"
    stats = char_stats_sql(msg)
    values = (
        f"coalesce(hour(ts) / 23::DOUBLE, {NO_HOUR}::DOUBLE)",
        f"least(1::DOUBLE, length({url}) / 200::DOUBLE)",
        f"least(1::DOUBLE, {shannon_entropy_sql(msg)} / 6)",
        stats["digit_ratio"],
        stats["special_ratio"],
        f"(CASE WHEN {status} >= 500 THEN 1.0 WHEN {status} >= 400 THEN 0.75 WHEN {status} >= 300 THEN 0.4 WHEN {status} >= 200 THEN 0.15 ELSE 0.0 END)::DOUBLE",
        "least(1::DOUBLE, log10(1 + coalesce(bytes, 0)) / 6)",
        f"least(1::DOUBLE, len(regexp_extract_all({url}, '[?&]')) / 6::DOUBLE)",
        f"least(1::DOUBLE, {shannon_entropy_sql(ua)} / 6)",
        f"least(1::DOUBLE, length(regexp_replace({msg}, '[\\x00-\\x7f]', '', 'g')) / greatest(length({msg}), 1)::DOUBLE)",
    )
    return f"SELECT *, {', '.join(f'{v} AS {n}' for n, v in zip(LOG_NAMES, values))} FROM ({entries})"


def mft_features(records: DataFrame) -> DataFrame:
    """`records` with a column for each of MFT_NAMES, 0 to 1."""
    name, low = F.coalesce("file_name", F.lit("")), F.lower("path")
    apart = F.abs(F.unix_micros("si_created") - F.unix_micros("fn_created")) / F.lit(1e6)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    values = (
        _one(shannon_entropy(name) / 5),
        _one(F.length(name) / 40),
        _one(F.length(F.regexp_replace("path", r"[^\\/]", "")) / 12),
        flag(F.col("ext").isin(*mft.RISKY)),
        flag(~F.col("active")),
        F.coalesce(_one(F.log10(1 + apart) / 8), F.lit(0.0)),
        _hour(F.col("si_created")),
        char_stats(name)["digit_ratio"],
        flag(any_of(low, tuple(rx for _, rx, _ in mft.SUSPICIOUS))),
        flag(any_of(name, mft.DOUBLE)),
    )
    return records.withColumns(dict(zip(MFT_NAMES, values)))


def mft_features_sql(records: str) -> str:
    name = "coalesce(file_name, '')"
    flag = lambda c: f"(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)::DOUBLE"
    risky = ", ".join(f"'{e}'" for e in mft.RISKY)
    values = (
        f"least(1::DOUBLE, {shannon_entropy_sql(name)} / 5)",
        f"least(1::DOUBLE, length({name}) / 40::DOUBLE)",
        "least(1::DOUBLE, length(regexp_replace(path, '[^\\\\/]', '', 'g')) / 12::DOUBLE)",
        flag(f"ext IN ({risky})"),
        flag("NOT active"),
        "coalesce(least(1::DOUBLE, log10(1 + abs(epoch_us(si_created) - epoch_us(fn_created)) / 1e6::DOUBLE) / 8), 0::DOUBLE)",
        f"coalesce(hour(si_created) / 23::DOUBLE, {NO_HOUR}::DOUBLE)",
        char_stats_sql(name)["digit_ratio"],
        flag(any_sql("lower(path)", tuple(rx for _, rx, _ in mft.SUSPICIOUS))),
        flag(any_sql(name, mft.DOUBLE)),
    )
    return f"SELECT *, {', '.join(f'{v} AS {n}' for n, v in zip(MFT_NAMES, values))} FROM ({records})"


def feature_stats(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(feature, mean, std) with the population's deviation: one pass, a row a feature."""
    both = df.agg(*[F.avg(n).alias(f"{n}__m") for n in names], *[F.stddev_pop(n).alias(f"{n}__s") for n in names])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"{n}__m").alias("mean"), F.col(f"{n}__s").alias("std")) for n in names]))
    return both.select(rows.alias("r")).select("r.*")


def feature_stats_sql(source: str, names: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS feature, avg({n}) AS mean, stddev_pop({n}) AS std FROM ({source})" for n in names)


def odd_features(df: DataFrame, names: tuple[str, ...], odd: float) -> DataFrame:
    """`df` with `reasons`: up to three features farthest from their mean, in deviations, beyond `odd`."""
    stats = df.agg(*[F.avg(n).alias(f"{n}__m") for n in names], *[F.stddev_pop(n).alias(f"{n}__s") for n in names])  # one row
    z = [F.struct((-F.round(F.when(F.col(f"{n}__s") > FLAT, F.abs(F.col(n) - F.col(f"{n}__m")) / F.col(f"{n}__s")).otherwise(0.0), 6)).alias("z"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in enumerate(names)]
    best = F.slice(F.array_sort(F.filter(F.array(*z), lambda x: x["z"] < -odd)), 1, REASONS)
    return df.join(F.broadcast(stats)).withColumn("reasons", F.array_join(F.transform(best, lambda x: x["n"]), ",")).drop(*stats.columns)


def odd_features_sql(source: str, names: tuple[str, ...], odd: float) -> str:
    stats = ", ".join(f"avg({n}) AS {n}__m, stddev_pop({n}) AS {n}__s" for n in names)
    z = ", ".join(f"{{'z': -round(CASE WHEN {n}__s > {FLAT} THEN abs({n} - {n}__m) / {n}__s ELSE 0 END, 6), 'k': {k}, 'n': '{n}'}}" for k, n in enumerate(names))
    return f"SELECT s.*, array_to_string([x.n FOR x IN list_sort(list_filter([{z}], lambda x: x.z < -{odd}))[:{REASONS}]], ',') AS reasons FROM ({source}) s, (SELECT {stats} FROM ({source}))"
