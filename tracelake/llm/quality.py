"""Operator 5: a quality classifier by co-training of two views.

View one is the text: hashed words (presence, weighted by idf) and shares of character kinds,
standardised over all documents. View two is page metadata, nothing of which is read from the text's
content: source, language, number of characters, and each two of them together. Each view has a
logistic regression. In every round each view that beats the base rate on labelled rows that it hasn't
learned from labels the unlabelled rows that it is surest of (ADDED, in the proportion of the labelled
classes) for the other view, which keeps what it is given if that doesn't worsen its own loss on such
rows. At the end the views' log-odds on rows that they haven't learned from are calibrated together:
slopes are fitted with damped steps and held back by a ridge, and a view that doesn't beat the base
rate has none.

Every text is parsed once for its features, which are written and from which document frequencies,
means, candidates of every round and the labelled sample (LABELLED rows at most, by the hash of the id)
are read; the driver gets sums, and sparse features of the sample and of the surest of all, never texts. A
document is good if its label says so in quality and it isn't toxic.

Defined cases: a null text counts as empty; null metadata is a value of its own; ids with several
labels, or none, count as unlabelled if the labels differ; without labels of both classes every
score is 0.5; repeated rows are scored each, and are candidates once; of equally sure rows those of
the smaller hash are taken; texts of any length are read whole; columns other than the named ones are
carried along whatever their names, and output columns replace input columns of the same name; an
empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut
from tracelake.session import ship

WORDS, STATS, META = 1 << 13, 8, 512
LABELLED, FOLDS = 4000, 4
ROUNDS, SURE, ADDED = 4, 0.95, 400
#: What a standardised share weighs beside a text's words, whose length is one.
SCALE = 0.1
#: The part of the base rate's loss that a view has to gain to count, and what is added to it for few labelled rows (divided by their number), as chance gains some.
SKILL, CHANCE = 0.01, 4
ROWS = 256

_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_KIND = np.array([4 if b >= 128 else 1 if chr(b).isupper() else 2 if chr(b).isdigit() else 3 if chr(b) in "!?#$%&*@^~|<>={}[]\\_" else 0 for b in range(256)])


def text_view(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Of a whole text: the places of its words, and STATS shares."""
    raw = (text or "").encode()
    words = raw.lower().translate(_PLAIN).split()
    different = set(words)
    places = np.unique(np.fromiter((zlib.crc32(w) for w in different), np.uint32, len(different)) % WORDS).astype(np.uint16)
    n = max(1, len(raw))
    b = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(_KIND[b], minlength=5)[1:] / n if len(b) else np.zeros(4)
    shares = np.r_[kinds, len(different) / max(1, len(words)), min(1.0, len(words) / n * 4), min(1.0, n / max(1, len(words)) / 20), min(1.0, len(words) / 1000)]
    return places, shares.astype(np.float32)


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Places of the features of a page beside its text."""
    facts = [("source", source), ("lang", lang), ("length", int(2 * np.log2((n_chars or 0) + 1)))]
    names = [*(f"{a} {x}" for a, x in facts), *(f"{a} {x} {b} {y}" for (a, x), (b, y) in combinations(facts, 2))]
    return np.unique([zlib.crc32(x.encode()) % META for x in names]).astype(np.uint16)


Views = tuple[np.ndarray, np.ndarray, np.ndarray]  # places of words, shares, places of metadata


def parsed(text: str | None, source: str | None, lang: str | None) -> Views:
    return *text_view(text), meta_view(source, lang, len(text or ""))


class Rows:
    """Sparse rows."""

    def __init__(self, at: list[np.ndarray], x: list[np.ndarray], width: int):
        self.n, self.width = len(at), width
        self.at, self.x = np.concatenate([np.empty(0, np.int64), *at]), np.concatenate([np.empty(0), *x])
        self.row = np.repeat(np.arange(self.n), [len(a) for a in at])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.x * w[self.at], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.x * g[self.row], self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fitted(x: Rows, y: np.ndarray, weight: np.ndarray, steps: int = 150, rate: float = 0.1, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression by Adam over all rows at once, classes weighted to balance."""
    balance = np.where(y > 0, 0.5 / max(1e-9, weight[y > 0].sum()), 0.5 / max(1e-9, weight[y == 0].sum())) * weight
    w, m, v = np.zeros(x.width), np.zeros(x.width), np.zeros(x.width)
    for t in range(1, steps + 1):
        g = x.back(balance * (sigmoid(x.times(w)) - y)) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(-np.mean(np.where(y > 0, np.log(p), np.log(1 - p))))


def calibrated(z: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Slopes (not negative) of the columns of z, and an offset, of the log-odds of y.

    Newton steps are halved until the loss goes down, targets are smoothed, and slopes are held back by a
    ridge in units of each column's spread, so that few or separable rows don't drive them off.
    """
    spread = np.maximum(z.std(axis=0), 1e-9)
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y == 0).sum() + 2))
    used = np.ones(z.shape[1], bool)
    while True:
        x = np.c_[z[:, used] / spread[used], np.ones(len(y))]
        held = np.r_[np.full(used.sum(), ridge), 0.0]

        def cost(w: np.ndarray) -> float:
            p = np.clip(sigmoid(x @ w), 1e-9, 1 - 1e-9)
            return float(-np.sum(target * np.log(p) + (1 - target) * np.log(1 - p)) + 0.5 * held @ (w * w))

        w = np.zeros(x.shape[1])
        for _ in range(100):
            p = sigmoid(x @ w)
            g = x.T @ (p - target) + held * w
            h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(held + 1e-9)
            move, step, now = np.linalg.solve(h, g), 1.0, cost(w)
            while step > 1e-6 and cost(w - step * move) > now:
                step /= 2
            w = w - step * move
            if np.abs(step * move).max() < 1e-7:
                break
        if (w[:-1] >= 0).all():
            out = np.zeros(z.shape[1] + 1)
            out[:-1][used], out[-1] = w[:-1] / spread[used], w[-1]
            return out
        used[np.flatnonzero(used)[w[:-1] < 0]] = False


@dataclass
class Model:
    """What standardises the features, the weights of each view, and slopes and offset of both together; no weights if nothing was learned."""

    idf: np.ndarray | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: list[np.ndarray] = field(default_factory=list)
    calibration: np.ndarray | None = None
    added: int = 0
    skills: tuple[float, ...] = ()

    def rows(self, views: list[Views], v: int) -> Rows:
        if v:
            return Rows([r[2].astype(np.int64) for r in views], [np.full(len(r[2]), len(r[2]) ** -0.5) for r in views], META)
        at, x = [], []
        end = WORDS + np.arange(STATS + 1)
        for places, shares, _ in views:
            words = self.idf[places]
            at.append(np.r_[places.astype(np.int64), end])
            x.append(np.r_[words / max(1e-9, np.sqrt(words @ words)), SCALE * np.clip((shares - self.mean) / self.spread, -3, 3), 1.0])
        return Rows(at, x, WORDS + STATS + 1)

    def log_odds(self, views: list[Views]) -> np.ndarray:
        return np.stack([self.rows(views, v).times(self.weights[v]) for v in range(2)], axis=1)

    def score(self, texts: list, sources: list, langs: list) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), 0.5)
        return sigmoid(self.log_odds([parsed(*r) for r in zip(texts, sources, langs)]) @ self.calibration[:-1] + self.calibration[-1])


#: The features of a row, as columns of their bytes.
VIEWS = "words binary, shares binary, meta binary"
_KINDS = (np.uint16, np.float32, np.uint16)


def _columns(views: list[Views]) -> list[pa.Array]:
    return [pa.array([r[k].astype(_KINDS[k]).tobytes() for r in views], pa.binary()) for k in range(3)]


def _views(columns: list[list[bytes]]) -> list[Views]:
    return [tuple(np.frombuffer(x, kind) for x, kind in zip(r, _KINDS)) for r in zip(*columns)]


def _features(batches):
    """Of rows (text, source, lang, key, mark): (key, mark) and the columns VIEWS."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            views = [parsed(*r) for r in zip(*(part.column(c).to_pylist() for c in range(3)))]
            yield pa.RecordBatch.from_arrays([part.column(3), part.column(4), *_columns(views)], ["key", "mark", "words", "shares", "meta"])


def _sums(batches):
    """Of columns VIEWS: (n, seen, sums): rows, rows of each place, sums of the shares and of their squares."""
    n, seen, sums = 0, np.zeros(WORDS, np.int64), np.zeros(2 * STATS)
    for batch in batches:
        for places, shares, _ in _views([c.to_pylist() for c in batch.columns]):
            seen[places] += 1
            sums += np.r_[shares, shares.astype(np.float64) ** 2]
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([seen], pa.list_(pa.int64())), pa.array([sums], pa.list_(pa.float64()))], ["n", "seen", "sums"])


def measured(features: DataFrame) -> Model:
    """A model with document frequencies, and means and spreads of the shares, of all rows."""
    parts = cut(features.select("words", "shares", "meta").mapInArrow(_sums, "n long, seen array<long>, sums array<double>"), "sums")  # a row for each task
    n = parts.agg(F.sum("n")).first()[0] or 0
    seen, sums = np.zeros(WORDS), np.zeros(2 * STATS)
    for column, out in (("seen", seen), ("sums", sums)):
        for r in parts.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():  # WORDS rows at most
            out[r["at"]] = r["x"]
    mean = sums[:STATS] / max(1, n)
    spread = np.sqrt(np.maximum(sums[STATS:] / max(1, n) - mean**2, 0))
    return Model(np.log((1 + n) / (1 + seen)) + 0.1, mean, np.where(spread > 1e-6, spread, 1.0))


def _surest(held, quota: int):
    """Of rows (key, VIEWS): each task's surest ones of both labels by one view."""

    def run(batches):
        model, view, weights, (slope, offset), taken = held.value
        best: list[dict[int, tuple]] = [{}, {}]
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                keys = part.column(0).to_pylist()
                views = _views([c.to_pylist() for c in part.columns[1:]])
                p = sigmoid(slope * model.rows(views, view).times(weights) + offset)
                for good, sure in ((1, p), (0, 1 - p)):
                    for row in np.flatnonzero(sure >= SURE):
                        if keys[row] not in taken:
                            best[good].setdefault(keys[row], (-sure[row], keys[row], views[row]))
                    if len(best[good]) > 2 * quota:
                        best[good] = {x[1]: x for x in sorted(best[good].values(), key=lambda x: x[:2])[:quota]}
        for good in (0, 1):
            rows = sorted(best[good].values(), key=lambda x: x[:2])[:quota]
            for k in range(0, len(rows), ROWS):
                part = rows[k : k + ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([good] * len(part), pa.int32()), pa.array([-x[0] for x in part], pa.float64()), pa.array([x[1] for x in part], pa.int64()), *_columns([x[2] for x in part])],
                    ["good", "sure", "key", "words", "shares", "meta"],
                )

    return run


def surest(free: DataFrame, model: Model, view: int, weights: np.ndarray, calibration: tuple[float, float], taken: set[int], quotas: tuple[int, int]) -> list[tuple[int, int, Views]]:
    """(key, good, views) of the rows of `free` (key, VIEWS) of which a view is surest: quotas[0] bad ones and quotas[1] good ones at most, none of `taken`."""
    held = free.sparkSession.sparkContext.broadcast((model, view, weights, calibration, taken))  # weights, and keys of ROUNDS picks at most
    found = cut(free.select("key", "words", "shares", "meta").mapInArrow(_surest(held, max(quotas)), f"good int, sure double, key long, {VIEWS}"), "surest")
    out = []
    for good in (0, 1):
        rows = found.where(F.col("good") == good).dropDuplicates(["key"]).orderBy(F.col("sure").desc(), "key").limit(quotas[good]).collect()
        out += [(r["key"], good, v) for r, v in zip(rows, _views([[r[c] for r in rows] for c in ("words", "shares", "meta")]))]
    held.unpersist()
    return out


def co_trained(model: Model, known: list[tuple[Views, int]], free: DataFrame) -> Model:
    """Fits both views on labelled rows (views, good), in the order that deals them to folds, and on the unlabelled rows (key, VIEWS)."""
    y = np.array([r[1] for r in known], float)
    fold = np.arange(len(known)) % FOLDS
    if not len(y) or any(min((y[fold != f] > 0).sum(), (y[fold != f] == 0).sum()) == 0 for f in range(FOLDS)):
        return model
    views = [r[0] for r in known]
    given: list[list[tuple]] = [[], []]  # (key, good, views) that each view was given
    base, least = _loss(np.full(len(y), y.mean()), y), SKILL + CHANCE / len(y)

    def fit(v: int, rows: np.ndarray, extra: list[tuple]) -> np.ndarray:
        all_views = [views[k] for k in rows] + [e[2] for e in extra]
        return fitted(model.rows(all_views, v), np.r_[y[rows], [float(e[1]) for e in extra]], np.r_[np.ones(len(rows)), np.full(len(extra), 0.5)])

    def unseen(v: int, extra: list[tuple]) -> np.ndarray:
        """A view's log-odds of the labelled rows, each by weights that haven't learned from it."""
        z = np.zeros(len(y))
        for f in range(FOLDS):
            out = np.flatnonzero(fold == f)
            z[out] = model.rows([views[k] for k in out], v).times(fit(v, np.flatnonzero(fold != f), extra))
        return z

    def judged(z: np.ndarray) -> tuple[float, float, float]:
        """Slope and offset of a view alone, and the loss left."""
        slope, offset = calibrated(z[:, None], y)
        return slope, offset, _loss(sigmoid(slope * z + offset), y)

    z = [unseen(v, []) for v in range(2)]
    own = [judged(x) for x in z]
    share = y.mean()
    quotas = max(1, round(ADDED * (1 - share))), max(1, round(ADDED * share))
    taken: set[int] = set()
    for _ in range(ROUNDS):
        kept = 0
        for v in range(2):
            if 1 - own[v][2] / base < least:
                continue  # what a view doesn't know it can't teach
            found = surest(free, model, v, fit(v, np.arange(len(y)), given[v]), own[v][:2], taken, quotas)
            taken.update(key for key, *_ in found)
            if not found:
                continue
            other = 1 - v
            after = unseen(other, given[other] + found)
            if (better := judged(after))[2] <= own[other][2]:
                given[other] += found
                z[other], own[other] = after, better
                kept += len(found)
        if not kept:
            break
    model.added = len(given[0]) + len(given[1])
    model.weights = [fit(v, np.arange(len(y)), given[v]) for v in range(2)]
    model.skills = tuple(1 - x[2] / base for x in own)
    able = np.array([s >= least for s in model.skills])
    model.calibration = np.zeros(3)
    model.calibration[np.r_[able, True]] = calibrated(np.stack(z, axis=1)[:, able], y)
    return model


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id") -> Model:
    """A model from `labels` (id, quality, toxic) of `docs` (id, text, source, lang)."""
    ship(docs.sparkSession)
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    mark = F.xxhash64(F.col(f"`{id}`").alias("id")).alias("mark")
    marks = labels.where(F.col("quality").isNotNull() & F.col(f"`{id}`").isNotNull()).groupBy(mark).agg(F.min(good).alias("good"), F.max(good).alias("most")).where("good = most").drop("most")
    marks = cut(marks, "marks")
    part = min(1.0, LABELLED / max(1, marks.count()))
    named = [F.col(f"`{c}`").cast("string").alias(c) for c in ("text", "source", "lang")]
    rows = docs.select(*named, F.xxhash64(F.col(f"`{id}`").alias("id"), *named).alias("key"), F.when(F.col(f"`{id}`").isNotNull(), mark).alias("mark"))
    # Labels are of the size of the documents, so the features, which are small, are moved to them, once.
    features = cut(rows.mapInArrow(_features, f"key long, mark long, {VIEWS}").join(marks.hint("merge"), "mark", "left"), "features")
    model = measured(features)
    chosen = features.where(F.col("good").isNotNull() & (F.pmod("mark", F.lit(1 << 30)) < int(part * (1 << 30))))
    rows = chosen.orderBy("mark", "key").limit(LABELLED).collect()
    known = list(zip(_views([[r[c] for r in rows] for c in ("words", "shares", "meta")]), [r["good"] for r in rows]))
    return co_trained(model, known, features.where("good is null"))


def score(docs: DataFrame, model: Model, text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """`docs` with quality_score (0 to 1) and good (score of 0.5 or more), which replace columns of these names."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # WORDS + META weights

    @F.arrow_udf("double")
    def scored(texts: pa.Array, sources: pa.Array, langs: pa.Array) -> pa.Array:
        parts = [held.value.score(*(c.slice(k, ROWS).to_pylist() for c in (texts, sources, langs))) for k in range(0, len(texts), ROWS)]
        return pa.array(np.concatenate([np.empty(0), *parts]))

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("quality_score", "good")]
    found = docs.select(*kept, scored(*[F.col(f"`{c}`").cast("string") for c in (text, source, lang)]).alias("quality_score"))
    return found.withColumn("good", F.col("quality_score") >= 0.5)
