"""TF-IDF over tokens: vocabulary and unit vectors as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.text import token_rows as exploded
from tracelake.functions.text import tokens_sql
from tracelake.store import cut

TERMS, FEW = 200, 8


def token_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf, len) of every text."""
    tokens = exploded(docs.select(key, text), text, key, F.size("tokens").alias("len"))
    return cut(tokens.groupBy(key, "len", "token").agg(F.count("*").alias("tf")), "tokens")  # vocabulary and weights both use it


def vocabulary(rows: DataFrame, n_docs: int, terms: int = TERMS) -> DataFrame:
    """The terms of most texts, two at least unless there are few texts: (token, df, idf)."""
    least = 1 if n_docs < FEW else 2
    df = rows.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    return df.orderBy(F.desc("df"), "token").limit(terms).withColumn("idf", F.log((1 + n_docs) / (1 + F.col("df"))) + 1)


def weights(rows: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, token, weight): unit vectors over the vocabulary, which has `terms` rows at most."""
    met = rows.join(F.broadcast(vocab), "token").withColumn("w", F.col("tf") / F.col("len") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return met.select(key, "token", (F.col("w") / norm).alias("weight"))


def vocabulary_sql(docs: str, key: str, text: str, terms: int = TERMS) -> str:
    rows = f"SELECT {key}, unnest(tokens) AS token FROM ({tokens_sql(f'SELECT {key}, {text} FROM ({docs})', text)})"
    return f"""SELECT token, df, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT token, count(DISTINCT {key})::BIGINT AS df, (SELECT count(*) FROM ({docs})) AS n FROM ({rows}) GROUP BY token)
      WHERE df >= CASE WHEN n < {FEW} THEN 1 ELSE 2 END ORDER BY df DESC, token LIMIT {terms}"""


def weights_sql(docs: str, key: str, text: str, terms: int = TERMS) -> str:
    rows = f"SELECT {key}, len(tokens) AS len, unnest(tokens) AS token FROM ({tokens_sql(f'SELECT {key}, {text} FROM ({docs})', text)})"
    return f"""SELECT {key}, token, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM (
      SELECT {key}, token, count(*) / any_value(len)::DOUBLE * any_value(idf) AS w FROM ({rows}) JOIN ({vocabulary_sql(docs, key, text, terms)}) USING (token) GROUP BY {key}, token)"""
