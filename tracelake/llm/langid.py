"""Operator 3: language ID by nearest centroid, with rejection by distance.

A text becomes a normalised TF-IDF vector of hashed byte trigrams (letters only, lower case, whole
text). Training counts document frequencies over every training row and clusters a bounded sample
of each language (PER_LANGUAGE different texts, those of the smallest hashes) into several centroids
by spherical k-means. A text gets the language of the centroid with the largest cosine, which is its
score. It is rejected if it is farther from that centroid than nearly all of the centroid's own
training texts, with a wide margin.

Defined cases: a null or empty text, or one without a letter (str.isalpha), is `und` with score 0
and rejected; rows without a language teach nothing; with no training row every text is `und`, score
0, and only the texts without a letter are rejected; repeated rows count in the frequencies each and
are sampled once, whatever their ids; ties go to the language first in order; texts of any length are
read whole; columns other than the named ones are carried along, and output columns replace input
columns of the same name; an empty table gives an empty table. More than LANGUAGES languages raise,
as the model holds a matrix row for each.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import cut, packed, released, unpacked
from tracelake.session import ship

WIDTH = 4096
#: Training texts of a language that the centroids are fitted on, at most.
PER_LANGUAGE = 500
#: Rows that are handed on for the sample, as a multiple of it, so that the error of the count of different texts leaves enough.
SPARE = 1.5
CENTROIDS, LANGUAGES = 4, 2000
#: A text is rejected below this part of the low percentile of its centroid's own cosines; a text of
#: fewer distinct trigrams than LONG reaches less by nature, by the root of its share of them.
MARGIN, PERCENTILE, LONG = 0.5, 2.0, 200
#: Texts vectorised at once, and characters up to which they are joined.
ROWS = 256

_SEEN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def counts(text: str | None) -> np.ndarray | None:
    """Hashed trigram counts of a whole text, or None if it has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    b = np.frombuffer(b" " + text.lower().encode().translate(_SEEN) + b" ", np.uint8).astype(np.uint32)
    b = b[np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]]
    codes = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return np.bincount(codes >> np.uint32(20), minlength=WIDTH)


@dataclass
class Model:
    """Languages, their centroids (rows of a matrix) and the least cosine of each."""

    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def weighted(self, rows: list[np.ndarray]) -> np.ndarray:
        x = np.log1p(np.array(rows, np.float32)) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        found = [counts(x) for x in texts]
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        rejected = np.array([x is None for x in found], bool)
        full = np.flatnonzero(~rejected)
        if len(self.langs) and len(full):
            like = self.weighted([found[i] for i in full]) @ self.centroids.T
            best = like.argmax(axis=1)
            score[full] = np.clip(like[np.arange(len(full)), best].astype(np.float64), 0, 1)
            distinct = np.array([np.count_nonzero(found[i]) for i in full])
            rejected[full] = score[full] < self.least[best] * np.sqrt(np.minimum(1, distinct / LONG))
            for i, c in zip(full, best):
                lang[i] = self.langs[self.owner[c]]
        return lang, score, rejected


def clustered(x: np.ndarray, k: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of unit rows by spherical k-means from spread starting rows, and each row's centroid."""
    centre = x.mean(axis=0)
    picked = [int((x @ centre).argmax())]
    near = x @ x[picked[0]]
    while len(picked) < min(k, len(x)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    c = x[picked]
    own = (x @ c.T).argmax(axis=1)
    for _ in range(rounds):
        sums = np.array([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        now = (x @ c.T).argmax(axis=1)
        if (now == own).all():
            break
        own = now
    return c, own


_TAUGHT = pa.schema([("lang", pa.string()), ("mark", pa.int64()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])


def _taught(batches):
    """Of rows (lang, text, mark, chosen): the counts of the chosen ones, and a last row (null, rows, null, document frequencies)."""
    seen, rows, marks = np.zeros(WIDTH, np.int64), 0, set()
    for batch in batches:
        out = []
        for lang, text, mark, chosen in zip(*(c.to_pylist() for c in batch.columns)):
            c = counts(text)
            if c is None:
                continue
            at = np.flatnonzero(c)
            seen[at] += 1
            rows += 1
            if chosen and (lang, mark) not in marks:
                marks.add((lang, mark))
                out.append((lang, mark, at.astype(np.int32), c[at]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), _TAUGHT)], schema=_TAUGHT)
    yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((None, rows, None, seen), _TAUGHT)], schema=_TAUGHT)


def train(rows: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> Model:
    """A model of the labelled rows.

    One pass over all of them counts document frequencies, which Spark adds up; the same pass hands on
    the rows whose hash of key and text is small enough for the sample. The driver gets WIDTH counts
    and the sample.
    """
    ship(rows.sparkSession)
    known = rows.where(F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("mark"))
    different = {x: c for x, c in known.groupBy("lang").agg(F.approx_count_distinct("mark")).limit(LANGUAGES + 1).collect()}
    if len(different) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    empty = Model([], np.ones(WIDTH, np.float32), np.zeros((0, WIDTH), np.float32), np.zeros(0, int), np.zeros(0))
    if not different:
        return empty
    part = F.create_map(*[F.lit(x) for l, c in different.items() for x in (l, min(1.0, SPARE * PER_LANGUAGE / max(1, c)) if c > PER_LANGUAGE else 1.0)])
    chosen = F.pmod(F.col("mark"), F.lit(1 << 30)) < part[F.col("lang")] * float(1 << 30)
    found = cut(known.select("lang", "text", "mark", chosen.alias("chosen")).mapInArrow(released(_taught), "lang string, mark long, at array<int>, n array<long>"), "taught")
    total = found.where("lang is null")
    docs = total.agg(F.sum("mark")).first()[0] or 0
    seen = np.zeros(WIDTH)
    for r in total.select(F.posexplode("n").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():  # WIDTH rows
        seen[r["at"]] = r["n"]
    model = Model([], np.log((1 + docs) / (1 + seen)).astype(np.float32) + 1, empty.centroids, empty.owner, empty.least)
    order = F.pmod(F.col("mark"), F.lit(1 << 30)), F.col("mark")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    sample = found.where("lang is not null").dropDuplicates(["lang", "mark"]).withColumn("nth__", nth).where(F.col("nth__") <= PER_LANGUAGE)
    # The rows of one language at a time: PER_LANGUAGE sparse rows come in, and are let go once they are clustered.
    model.langs = sorted(different)
    places = {name: k for k, name in enumerate(model.langs)}
    parts, owner, least = [], [], []
    for name, rows_ in groupby(sample.orderBy("lang", "nth__").toLocalIterator(), key=lambda r: r["lang"]):
        k, taken = places[name], []
        for r in rows_:
            c = np.zeros(WIDTH, np.float32)
            c[r["at"]] = r["n"]
            taken.append(c)
        v = model.weighted(taken)
        c, to = clustered(v, CENTROIDS)
        like = (v * c[to]).sum(axis=1)
        low = np.percentile(like, PERCENTILE)
        parts.append(c)
        owner += [k] * len(c)
        least += [MARGIN * float(low)] * len(c)
    if not parts:
        return empty
    model.centroids, model.owner, model.least = np.concatenate(parts).astype(np.float32), np.array(owner), np.array(least)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score and rejected.

    A pass of its own: as column functions they would run again in a filter on one of them.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)  # languages x centroids x WIDTH floats
    made = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType()}
    kept = [c for c in docs.columns if c.lower() not in made]
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"), packed(kept).alias("own"))

    def predict(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                lang, score, rejected = held.value.predict(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["own", *made])

    found = rows.mapInArrow(released(predict), T.StructType([rows.schema["own"], *[T.StructField(c, t) for c, t in made.items()]]))
    return found.select(*unpacked("own", kept), *made)


def fold(key: Column) -> Column:
    """crc32(key as text) mod 5; rows with remainder 0 are held out."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5
