"""Multinomial naive Bayes over tokens.

Counting is a grouping. A model of up to HELD numbers is a matrix, a row a token and a column a label,
that tasks hold: a line is scored where it is, in batches, as the sum of its tokens' rows, and nothing
of it is moved. A larger model stays a table, which the tokens of the lines join; the sums of a line
then meet again in a shuffle, with its tokens added up on the map side. In cross-validation tasks hold the commonest
tokens of a larger model, and only lines that hold further ones are moved.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tracelake.functions.text import token_rows, tokens_sql, with_tokens
from tracelake.session import ship
from tracelake.store import cut, parallelism

ALPHA, FOLDS, SURE = 1.0, 5, 0.3
DIGITS = 6
#: Numbers of a model that tasks hold; tokens summed up at once.
HELD, BLOCK = 1 << 22, 1 << 16


@dataclass
class Model:
    """Labels in order of first appearance, log priors, and the log likelihood of each token for each label."""

    labels: list[str]
    prior: list[float]
    table: DataFrame  # token, p0, p1, ...
    matrix: tuple[list[str], np.ndarray] | None = field(default=None, repr=False)

    def small(self) -> tuple[list[str], np.ndarray] | None:
        """Tokens and their rows, if tasks can hold them."""
        if self.matrix is None:
            most = HELD // max(1, len(self.labels))
            rows = self.table.limit(most + 1).collect()  # HELD numbers at most
            if len(rows) > most:
                return None
            self.matrix = [r["token"] for r in rows], np.array([r[1:] for r in rows], float).reshape(len(rows), -1)
        return self.matrix


def summed(tokens: pa.Array, words: pa.Array, matrix: np.ndarray, layer: np.ndarray | None = None) -> np.ndarray:
    """For each list of tokens the sum of their rows; with `layer`, which matrix of several each list uses."""
    out = np.zeros((len(tokens), matrix.shape[-1]))
    row, flat = pc.list_parent_indices(tokens).to_numpy(), pc.list_flatten(tokens)
    for k in range(0, len(flat), BLOCK):
        place = pc.fill_null(pc.index_in(flat.slice(k, BLOCK), value_set=words), -1).to_numpy()
        known = place >= 0
        own, place = row[k : k + BLOCK][known], place[known]
        if len(own):
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            values = matrix[place] if layer is None else matrix[layer[own], place]
            out[own[starts]] += np.add.reduceat(values, starts, axis=0)
    return out


def token_counts(docs: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """(label, token, n) over labelled texts."""
    return token_rows(docs, text, label).groupBy(label, "token").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, text: str = "text", label: str = "label", order: str = "doc") -> Model:
    """A model of labelled texts; one row a label comes to the driver."""
    counts = token_counts(docs, text, label)
    sizes = {r[label]: r for r in docs.groupBy(label).agg(F.count("*").alias("n"), F.min(order).alias("first")).collect()}
    labels = sorted(sizes, key=lambda x: sizes[x]["first"])
    totals = {r[label]: r["n"] for r in counts.groupBy(label).agg(F.sum("n").alias("n")).collect()}
    words, n = counts.select("token").distinct().count(), sum(r["n"] for r in sizes.values())
    wide = counts.groupBy("token").pivot(label, labels).agg(F.sum("n"))
    table = wide.select("token", *[F.log((F.coalesce(F.col(f"`{x}`"), F.lit(0)) + ALPHA) / F.lit(totals.get(x, 0) + ALPHA * words)).alias(f"p{k}") for k, x in enumerate(labels)])
    return Model(labels, [math.log(sizes[x]["n"] / n) for x in labels], table)


def _posterior(scores: list[Column], labels: list[str]) -> tuple[Column, Column]:
    """Label and probability of the largest score; the first label wins ties."""
    top = F.greatest(*scores)
    label = F.coalesce(*[F.when(s == top, x) for s, x in zip(scores, labels)])
    total = scores[0] * 0
    for s in scores:
        total = total + F.exp(s - top)
    return label, 1 / total


def _joined(df: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """(key, label, confidence) by a join of the tokens with the model's table, of any size."""
    n = len(model.labels)
    tokens = with_tokens(df.select(key, text), text).select(key, F.explode_outer("tokens").alias("token"))
    met = tokens.join(model.table, "token", "left")
    sums = met.groupBy(key).agg(*[F.round(F.coalesce(F.sum(f"p{k}"), F.lit(0.0)) + model.prior[k], DIGITS).alias(f"s{k}") for k in range(n)])
    label, p = _posterior([F.col(f"s{k}") for k in range(n)], model.labels)
    return sums.select(key, label.alias("label"), p.alias("confidence"))


def classified(df: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """`df` with the label and confidence of every text; tokens outside the vocabulary don't count. `key` names a row."""
    small = model.small()
    if small is None:
        return df.join(_joined(df, model, key, text), key)
    spark = df.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast((pa.array(small[0], pa.string()), small[1]))  # HELD numbers at most

    @F.arrow_udf("array<double>")
    def sums(tokens: pa.Array) -> pa.Array:
        found = summed(tokens, *held.value)
        return pa.FixedSizeListArray.from_arrays(pa.array(found.reshape(-1)), found.shape[1]).cast(pa.list_(pa.float64()))

    scored = with_tokens(df, text, "tokens__").withColumn("sums__", sums("tokens__")).drop("tokens__")
    scores = [F.round(F.get("sums__", F.lit(k)) + p, DIGITS) for k, p in enumerate(model.prior)]
    # As an array, so that a score is worked out once and not for each comparison.
    scored = scored.withColumn("sums__", F.array(*scores))
    label, p = _posterior([F.get("sums__", F.lit(k)) for k in range(len(scores))], model.labels)
    return scored.withColumns({"label": label, "confidence": p}).drop("sums__")


def predict(df: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """(key, label, confidence) of every text."""
    return classified(df.select(key, text), model, key, text).select(key, "label", "confidence")


def class_distribution(predicted: DataFrame) -> DataFrame:
    """(label, count, ratio); unsure predictions count as benign."""
    sure = F.when(F.col("confidence") < SURE, "benign").otherwise(F.col("label"))
    per = predicted.groupBy(sure.alias("label")).agg(F.count("*").alias("count"))
    total = per.agg(F.sum("count").alias("total"))  # one row
    return per.join(F.broadcast(total)).select("label", "count", (F.col("count") / F.col("total")).alias("ratio"))


def _ranked(docs: DataFrame, label: str, order: str) -> DataFrame:
    """`docs`, which lie in ranges of the order, with their partition (part__) and their number within it among those of their label (nth__, from 1).

    Rows pass through in batches and aren't moved: a window over labels would shuffle them, text and all.
    """
    names = [*docs.columns, "part__", "nth__"]
    out = StructType([*docs.schema.fields, StructField("part__", IntegerType()), StructField("nth__", LongType())])

    def run(batches):
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            codes = batch.column(label).dictionary_encode(null_encoding="encode")
            of, values = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
            nth = np.zeros(len(of), np.int64)
            by = np.argsort(of, kind="stable")
            starts = np.searchsorted(of[by], np.arange(len(values) + 1))
            for k, value in enumerate(values):
                n = starts[k + 1] - starts[k]
                nth[by[starts[k] : starts[k + 1]]] = seen[value] + 1 + np.arange(n)
                seen[value] += int(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(of), part), pa.int32()), pa.array(nth)], names)

    return docs.mapInArrow(run, out)


def in_folds(docs: DataFrame, folds: int = FOLDS, label: str = "label", order: str = "doc", text: str | None = None) -> DataFrame:
    """`docs` with `fold`: a label's texts dealt round by their order. With `text`, its tokens (tokens__) come in its place.

    The place of a text among those of its label is that within its range of the order plus the label's
    texts in the ranges before, so a label of most texts isn't sorted in one task. A text is moved once, to
    its range, and written once; its fold is added when it is read.
    """
    ship(docs.sparkSession)
    dealt = docs.repartitionByRange(parallelism(docs.sparkSession), order).sortWithinPartitions(order)
    if text:
        dealt = with_tokens(dealt, text, "tokens__").drop(text)
    held = cut(_ranked(dealt, label, order), "folds")
    sizes = held.groupBy(label, "part__").agg(F.count("*").alias("n__"))  # a row for each label and partition
    before = F.sum("n__").over(Window.partitionBy(label).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col(label).alias("label__"), F.col("part__").alias("of__"), F.coalesce(before, F.lit(0)).alias("before__"))
    ranked = held.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("label__")) & (F.col("part__") == F.col("of__")))
    return ranked.withColumn("fold", ((F.col("nth__") + F.col("before__") - 1) % folds).cast("int")).drop("nth__", "before__", "part__", "label__", "of__")


@dataclass
class Folds:
    """What all models of a cross-validation share; rows of arrays are folds, and columns labels."""

    labels: list[str]
    totals: np.ndarray  # tokens of the other folds
    known: np.ndarray  # different tokens of the other folds
    prior: np.ndarray
    ranks: np.ndarray  # labels by their first text in the other folds

    def odds(self, counts: np.ndarray) -> np.ndarray:
        """(token, fold, label): the log likelihoods, without the fold, of tokens counted in every fold; 0 for a token that the other folds don't hold."""
        left = counts.sum(axis=1, keepdims=True) - counts
        return np.log((left + ALPHA) / (self.totals + ALPHA * self.known[:, None])) * (left.sum(axis=2, keepdims=True) > 0)

    def best(self, sums: np.ndarray, fold: np.ndarray) -> pa.Array:
        """The label of the largest score; of equal scores the label wins that came first among the fold's training texts."""
        scores, order = np.round(sums + self.prior[fold], DIGITS), self.ranks[fold]
        winner = np.take_along_axis(scores, order, axis=1).argmax(axis=1)
        return pa.array([self.labels[k] for k in order[np.arange(len(fold)), winner]], pa.string())


def cross_validated(docs: DataFrame, folds: int = FOLDS, text: str = "text", label: str = "label", order: str = "doc", most: int = HELD) -> DataFrame:
    """(order, label, predicted) of every labelled text by a model without its fold.

    A fold's model is the counts of all texts less the fold's own. The commonest tokens, up to `most` numbers
    in all, are held by the tasks that score texts. Only texts that hold further tokens
    are moved: such a token meets its row of the models, and the sums of these rows meet the text.
    """
    dealt = in_folds(docs.select(order, text, label), folds, label, order, text)
    tokens = dealt.select("fold", label, F.explode("tokens__").alias("token"))
    per = cut(tokens.groupBy("fold", label, "token").agg(F.count("*").alias("n")), "counts")
    sizes = dealt.groupBy("fold", label).agg(F.count("*").alias("n"), F.min(order).alias("first")).collect()  # a row for each label and fold
    labels = sorted({r[label] for r in sizes}, key=lambda x: (x is None, x))
    column, shape = {x: k for k, x in enumerate(labels)}, (folds, len(labels))
    texts, totals = np.zeros(shape), np.zeros(shape)
    first: list[dict] = [{} for _ in range(folds)]
    for r in sizes:
        texts[r["fold"], column[r[label]]] = r["n"]
        for test in range(folds):
            if test != r["fold"]:
                first[test][r[label]] = min(r["first"], first[test].get(r[label], r["first"]))
    for r in per.groupBy("fold", label).agg(F.sum("n").alias("n")).collect():
        totals[r["fold"], column[r[label]]] = r["n"]
    spans = per.groupBy("token").agg(F.min("fold").alias("low"), F.max("fold").alias("high"))
    alone = np.zeros(folds, np.int64)
    words = 0
    for r in spans.groupBy(F.when(F.col("low") == F.col("high"), F.col("low")).alias("only")).agg(F.count("*").alias("n")).collect():  # a row for each fold
        words += r["n"]
        if r["only"] is not None:
            alone[r["only"]] = r["n"]
    rest = texts.sum(axis=0) - texts
    with np.errstate(divide="ignore"):
        prior = np.log(rest / np.maximum(1, rest.sum(axis=1))[:, None])
    ranks = [sorted(range(len(labels)), key=lambda k: (labels[k] not in own, own.get(labels[k], 0))) for own in first]
    shared = Folds(labels, totals.sum(axis=0) - totals, words - alone, prior, np.array(ranks))
    room = most // max(1, folds * len(labels))
    common = per
    if words > room:
        top = per.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(room).select("token")
        common = per.join(F.broadcast(cut(top, "common")), "token")
    found = common.select("fold", label, "token", "n").toArrow()  # `most` numbers at most
    vocabulary = pc.unique(found["token"])
    counts = np.zeros((len(vocabulary), *shape))
    if found.num_rows:
        at = [pc.index_in(found[c], value_set=v).to_numpy() for c, v in (("token", vocabulary), (label, pa.array(labels, pa.string())))]
        counts[at[0], found["fold"].to_numpy(), at[1]] = found["n"].to_numpy()
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((vocabulary, np.ascontiguousarray(shared.odds(counts).transpose(1, 0, 2)), shared))  # `most` numbers

    @F.arrow_udf("string")
    def best(tokens: pa.Array, fold: pa.Array) -> pa.Array:
        words, odds, shared = held.value
        of = fold.to_numpy()
        return shared.best(summed(tokens, words, odds, of), of)

    whole = dealt.select(order, label, best("tokens__", "fold").alias("predicted"))
    if words <= room:
        return whole

    @F.arrow_udf("array<string>")
    def further(tokens: pa.Array) -> pa.Array:
        """The tokens that tasks don't hold."""
        row, flat = pc.list_parent_indices(tokens).to_numpy(), pc.list_flatten(tokens)
        other = pc.invert(pc.is_in(flat, value_set=held.value[0]))
        ends = np.cumsum(np.bincount(row[other.to_numpy(zero_copy_only=False)], minlength=len(tokens)))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), flat.filter(other).cast(pa.string()))

    @F.arrow_udf("array<double>")
    def modelled(cells: pa.Array) -> pa.Array:
        """Of each token its log likelihoods by fold and label, one after the other."""
        shared, out = held.value[2], []
        size = shared.totals.size
        for k in range(0, len(cells), max(1, HELD // size)):
            few = cells.slice(k, max(1, HELD // size))
            flat = pc.list_flatten(few)
            own = np.zeros((len(few), *shared.totals.shape))
            at = pc.index_in(flat.field(1), value_set=pa.array(shared.labels, pa.string())).to_numpy()
            own[pc.list_parent_indices(few).to_numpy(), flat.field(0).to_numpy(), at] = flat.field(2).to_numpy()
            out.append(shared.odds(own).reshape(-1))
        return pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([*out, np.zeros(0)])), size).cast(pa.list_(pa.float64()))

    @F.arrow_udf("string")
    def joined(tokens: pa.Array, fold: pa.Array, more: pa.Array) -> pa.Array:
        words, odds, shared = held.value
        of = fold.to_numpy()
        return shared.best(summed(tokens, words, odds, of) + pc.list_flatten(more).to_numpy().reshape(len(of), -1), of)

    n = len(labels)
    marked = dealt.withColumn("further__", further("tokens__"))
    models = per.join(F.broadcast(spark.createDataFrame(pa.table({"token": vocabulary}), "token string")), "token", "left_anti")
    models = models.groupBy("token").agg(F.collect_list(F.struct("fold", F.col(label).alias("label"), "n")).alias("cells")).select("token", modelled("cells").alias("odds"))  # a cell for each label and fold
    asked = marked.select(order, "fold", F.explode("further__").alias("token"))
    met = asked.join(models, "token").select(order, F.slice("odds", F.col("fold") * n + 1, n).alias("odds"))
    sums = met.groupBy(F.col(order).alias("of__")).agg(F.array(*[F.sum(F.get("odds", F.lit(k))) for k in range(n)]).alias("more__"))
    moved = marked.where(F.size("further__") > 0).join(sums, F.col(order).eqNullSafe(F.col("of__")))
    rest = marked.where(F.size("further__") == 0).select(order, label, best("tokens__", "fold").alias("predicted"))
    return rest.unionByName(moved.select(order, label, joined("tokens__", "fold", "more__").alias("predicted")))


def counts_sql(docs: str) -> str:
    return f"SELECT label, token, count(*)::BIGINT AS n FROM (SELECT label, unnest(tokens) AS token FROM ({tokens_sql(docs, 'text')})) GROUP BY ALL"


def predict_sql(docs: str, source: str, key: str, text: str) -> str:
    return f"""WITH counts AS ({counts_sql(docs)}), sizes AS (SELECT label, count(*) AS size, min(doc) AS first FROM ({docs}) GROUP BY 1), totals AS (SELECT label, sum(n) AS total FROM counts GROUP BY 1),
      facts AS (SELECT *, (SELECT count(DISTINCT token) FROM counts) AS words, ln(size / (SELECT sum(size) FROM sizes)) AS prior FROM sizes JOIN totals USING (label)),
      asked AS (SELECT {key}, token, count(*) AS k FROM (SELECT {key}, unnest(tokens) AS token FROM ({tokens_sql(f'SELECT {key}, {text} FROM ({source})', text)})) WHERE token IN (SELECT token FROM counts) GROUP BY ALL),
      scored AS (SELECT {key}, f.label, first, round(coalesce(sum(k * ln((coalesce(n, 0) + {ALPHA}) / (total + {ALPHA} * words))), 0) + any_value(prior), {DIGITS}) AS s
        FROM (SELECT {key} FROM ({source})) x CROSS JOIN facts f LEFT JOIN asked USING ({key}) LEFT JOIN counts c ON c.label = f.label AND c.token = asked.token GROUP BY ALL)
      SELECT {key}, arg_min(label, (-s, first)) AS label, 1 / sum(exp(s - top)) AS confidence FROM (SELECT *, max(s) OVER (PARTITION BY {key}) AS top FROM scored) GROUP BY {key}"""


def cross_validated_sql(docs: str, folds: int = FOLDS) -> str:
    return f"""WITH dealt AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY doc) - 1) % {folds} AS fold FROM ({docs})), tests AS (SELECT unnest(range({folds})) AS test),
      tokens AS (SELECT doc, fold, label, unnest(tokens) AS token FROM ({tokens_sql('SELECT * FROM dealt', 'text')})),
      counts AS (SELECT test, label, token, count(*) AS n FROM tests JOIN tokens ON fold <> test GROUP BY ALL), totals AS (SELECT test, label, sum(n) AS total FROM counts GROUP BY ALL),
      words AS (SELECT test, count(DISTINCT token) AS words FROM counts GROUP BY ALL), sizes AS (SELECT test, label, count(*) AS size, min(doc) AS first FROM tests JOIN dealt ON fold <> test GROUP BY ALL),
      facts AS (SELECT *, ln(size / sum(size) OVER (PARTITION BY test)) AS prior FROM sizes JOIN totals USING (test, label) JOIN words USING (test)),
      asked AS (SELECT doc, fold AS test, token, count(*) AS k FROM tokens t WHERE EXISTS (SELECT 1 FROM counts c WHERE c.test = t.fold AND c.token = t.token) GROUP BY ALL),
      scored AS (SELECT d.doc, f.label, first, round(coalesce(sum(k * ln((coalesce(n, 0) + {ALPHA}) / (total + {ALPHA} * words))), 0) + any_value(prior), {DIGITS}) AS s
        FROM dealt d JOIN facts f ON f.test = d.fold LEFT JOIN asked USING (doc) LEFT JOIN counts c ON c.test = asked.test AND c.label = f.label AND c.token = asked.token GROUP BY d.doc, f.label, first)
      SELECT doc, label, predicted FROM ({docs}) LEFT JOIN (SELECT doc, arg_min(label, (-s, first)) AS predicted FROM scored GROUP BY doc) USING (doc)"""
