"""Operator 12: spelling variants of words, by asymmetric q-chunks.

Two words that differ by one inserted, deleted or replaced code point share half of a word, shifted by
one place at most: one of the two contributes two disjoint chunks, its halves of floor(length / 2)
code points, and one edit leaves one of them whole; the other contributes all its positional grams of
the lengths that a partner's chunks can have. They meet where gram and chunk are equal and their
places differ by one at most, and the pair is then verified by its edit distance. Each pair is met
from one side only, that of the smaller word's chunks.

A chunk that very many words share (an affix) doesn't bring them together pair by pair: words of a
bucket of over CROWDED chunks and grams are met by the chunk and a half of what is left of the word
besides it, as that rest has the one edit and is chunked in turn.

Words are counted a batch of texts at a time in tasks and summed up in Spark. Forms are followed to
the last by pointer doubling, in as many rounds as the logarithm of the longest chain, which can't
be longer than the logarithm of the largest count.

Defined cases: a null text has no words; a null id counts as empty; texts of any length are read whole,
in stretches cut between words; repeated rows count each; ties go to the smaller word in code-point
order; columns other than the two named are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut, cut_at, drop
from tracelake.session import ship

LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
SLIPS = 97
#: Code points read at once, and different words that a task holds before it hands them on.
STRETCH, HELD = 1 << 20, 1 << 17
#: Chunks times grams of a bucket up to which they are met directly.
CROWDED = 1 << 16

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def slipped(id: str, run: str) -> str:
    """A lower-cased run, with a code point left out in one of SLIPS cases, as the id and the run decide."""
    h = zlib.crc32(f"{id}:{run}".encode())
    if h % SLIPS:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words_of(id: object, text: str | None) -> Counter:
    """How often each word occurs in a whole text."""
    runs: Counter = Counter()
    at, text = 0, text or ""
    while at < len(text):
        end = at + STRETCH
        if end < len(text) and (rest := _RUN.match(text, end)):
            end = rest.end()
        runs.update(_RUN.findall(text, at, end))
        at = end
    name, out = "" if id is None else str(id), Counter()
    lower: Counter = Counter()
    for run, n in runs.items():
        lower[run.lower() if run.isascii() else run.translate(_LOWER)] += n
    for run, n in lower.items():
        out[slipped(name, run)] += n
    return out


def _counted(batches):
    """Of rows (id, text): (word, n) of words long enough; a word may come several times."""
    held: Counter = Counter()

    def out():
        words = [w for w in held if len(w) >= LEAST_LENGTH]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])

    for batch in batches:
        for id, text in zip(batch.column(0), batch.column(1)):
            held.update(words_of(id.as_py(), text.as_py()))
            if len(held) > HELD:
                yield out()
                held.clear()
    yield out()


def vocabulary(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def chunks(words: DataFrame, of: str) -> DataFrame:
    """A row for each of the two halves of column `of`: with the columns of `words`, slot (0, 1), chunk, and rest, the word without it."""
    q = _half(F.length(of))
    halves = [F.struct(F.lit(slot).alias("slot"), F.substring(of, q * slot + 1, q).alias("chunk"), F.concat(F.substring(of, 1, q * slot), F.substring(of, q * (slot + 1) + 1, F.length(of))).alias("rest")) for slot in (0, 1)]
    return words.select("*", F.explode(F.array(*halves)).alias("x")).select(*words.columns, "x.slot", "x.chunk", "x.rest")


def grams(words: DataFrame, of: str) -> DataFrame:
    """A row for each positional gram of column `of` that can be a partner's chunk, as `chunks`: a chunk of slot s starts at s * q, one place off at most."""
    m = F.length(of)
    sizes = F.array_distinct(F.transform(F.array(m - 1, m, m + 1), _half))
    rows = words.select("*", F.explode(F.filter(sizes, lambda q: q > 0)).alias("q"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.length(of) - F.col("q"))).alias("at"))  # every place where such a gram starts
    rows = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("slot")).where(F.abs(F.col("at") - F.col("slot") * F.col("q")) <= 1)
    rest = F.concat(F.substring(of, 1, F.col("at")), F.substring(of, F.col("at") + F.col("q") + 1, F.length(of)))
    return rows.select(*words.columns, "slot", F.substring(of, F.col("at") + 1, F.col("q")).alias("chunk"), rest.alias("rest"))


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (a, b) of the smaller word's chunks with the other's grams that differ by one edit."""
    close = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1)
    return left.join(right, keys).where(close).where(F.levenshtein("a", "b", 1) == 1).select("a", "b")


def near(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b) of every two words (column word) at an edit distance of one, a < b."""
    keys = ["slot", "chunk"]
    left, right = cut(chunks(words.select(F.col("word").alias("a")), "a"), "chunks"), cut(grams(words.select(F.col("word").alias("b")), "b"), "grams")
    sizes = left.groupBy(keys).agg(F.count("*").alias("m")).join(right.groupBy(keys).agg(F.count("*").alias("n")), keys)
    large = cut(sizes.where(F.col("m") * F.col("n") > crowded).select(keys), "crowded")
    met = _met(left.join(large, keys, "left_anti").drop("rest"), right.join(large, keys, "left_anti").drop("rest"), keys)
    if large.take(1):
        again = [side.join(large, keys, "left_semi").withColumnsRenamed({"slot": "slot_1", "chunk": "chunk_1", "rest": "rest_1"}) for side in (left, right)]
        met = met.unionAll(_met(chunks(again[0], "rest_1").drop("rest"), grams(again[1], "rest_1").drop("rest"), ["slot_1", "chunk_1", *keys]))
    return cut(met.distinct(), "near")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the end of each chain of forms. Chains don't run in circles."""
    spark = forms.sparkSession
    now, path = cut_at(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        hop = now.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        following, new_path = cut_at(now.join(hop, now["root"] == hop["via"], "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        drop(spark, path)
        now, path = following.select("word", "root"), new_path
        if not following.where("moved").take(1):
            return now


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word: its near words, the form it varies, and the last of forms.

    A word's form is its near word of largest count, if that is TIMES its own count or more.
    """
    words = cut(vocabulary(docs, id, text), "words")
    pairs = near(words)
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = words.select(F.col("word").alias("b"), F.col("n").alias("m"))
    best = both.join(counts, "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("b").alias("form"))).alias("best"))
    found = words.join(best, "word", "left")
    large = -F.col("best.less") >= TIMES * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("best.form")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n"))
    found = cut(found, "forms")
    roots = followed(found.where("form is not null"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
