"""Operator 4: document fingerprints by a homomorphic multiset hash, with DataFrame functions only.

A paragraph (a line of the text) is hashed to a wide vector, and the fingerprint is the sum of its
paragraphs' vectors, lane by lane modulo powers of two. The order of paragraphs doesn't matter, and
one can be added to or taken from a fingerprint without the rest. A vector has two parts:

* EQUAL lanes of 32 bits from SHA-512 of the whole paragraph, for equality;
* LIKE lanes of 24 bits: for each pair of neighbouring words in the paragraph, however often it has
  the pair, +1 or -1 by a bit of the pair's XXH64. The squared difference of two fingerprints' lanes estimates how many pairs only one of
  them has, from which `likeness` follows.

Defined cases: a null text counts as empty, which is one empty paragraph; equal fingerprints are 1
alike, and texts without a common pair near 0; repeated rows get the same fingerprint.
Texts of any length are read whole; rows of one id, and those without an id, go by text; columns other than
the two named are not read, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import parallelism

EQUAL, LIKE = 16, 64
EQUAL_MOD, LIKE_MOD = 1 << 32, 1 << 24
#: Four 16-bit counters of one long, and the pairs after which they are emptied.
LANES, CHUNK = 0x0001000100010001, 60_000


def _let(value: Column, use) -> Column:
    """use(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(rows: Column, lanes: int, modulo: int) -> Column:
    """Lane by lane sum of an array of vectors."""
    zeros = F.array_repeat(F.lit(0).cast("long"), lanes)
    return F.aggregate(rows, zeros, lambda acc, v: F.zip_with(acc, v, lambda a, b: F.pmod(a + b, F.lit(modulo))))


def _packed(chunk: Column, bit: int) -> Column:
    """How many hashes have bits `bit`, `bit` + 16, + 32 and + 48 set, as four counters of one long."""
    return F.aggregate(chunk, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftright(h, bit).bitwiseAND(F.lit(LANES)))


def _unpacked(packed: Column, at: int) -> Column:
    return F.transform(packed, lambda x: F.shiftright(x, 16 * at).bitwiseAND(F.lit(0xFFFF)))


def _counted(chunk: Column) -> Column:
    return _let(F.array(*[_packed(chunk, bit) for bit in range(16)]), lambda p: F.concat(*[_unpacked(p, at) for at in range(4)]))


def _signs(pairs: Column) -> Column:
    """LIKE lanes of the hashes of word pairs: how many have the lane's bit set, less how many have not."""

    def whole(hashes: Column) -> Column:
        last = F.floor((F.greatest(F.size(hashes), F.lit(1)) - 1) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(hashes, k * CHUNK + 1, F.lit(CHUNK)))
        zeros = F.array_repeat(F.lit(0).cast("long"), LIKE)
        counts = F.aggregate(F.transform(chunks, _counted), zeros, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
        return F.transform(counts, lambda c: F.pmod(2 * c - F.size(hashes), F.lit(LIKE_MOD)))

    return _let(pairs, whole)


def _pairs(paragraph: Column) -> Column:
    """XXH64 of each word with the one after it, the last one alone; each pair once."""
    return F.array_distinct(_let(F.split(paragraph, " "), lambda w: F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.xxhash64(a, b))))


def _digest(paragraph: Column) -> Column:
    """EQUAL lanes of one paragraph."""
    return _let(F.sha2(paragraph, 512), lambda h: F.array(*[F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(EQUAL)]))


def fingerprint(text: Column) -> Column:
    """struct(equal array<long>, like array<long>) of a text."""
    paragraphs = F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")
    equal = _let(paragraphs, lambda ps: _sum(F.transform(ps, _digest), EQUAL, EQUAL_MOD))
    like = _let(paragraphs, lambda ps: _signs(F.flatten(F.transform(ps, _pairs))))
    return F.struct(equal.alias("equal"), like.alias("like"))


def plus(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return F.struct(*[_lanes(a, b, n, m, 1) for n, m in (("equal", EQUAL_MOD), ("like", LIKE_MOD))])


def minus(a: Column, b: Column) -> Column:
    """Fingerprint of `a` with the paragraphs of `b` taken out."""
    return F.struct(*[_lanes(a, b, n, m, -1) for n, m in (("equal", EQUAL_MOD), ("like", LIKE_MOD))])


def _lanes(a: Column, b: Column, name: str, modulo: int, sign: int) -> Column:
    return F.zip_with(a[name], b[name], lambda x, y: F.pmod(x + sign * y, F.lit(modulo))).alias(name)


def written(print_: Column) -> Column:
    """A fingerprint as hex digits."""
    equal = F.transform(print_["equal"], lambda x: F.lpad(F.hex(x), 8, "0"))
    like = F.transform(print_["like"], lambda x: F.lpad(F.hex(x), 6, "0"))
    return F.lower(F.concat(F.array_join(equal, ""), F.array_join(like, "")))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the estimated share of word pairs that two fingerprints have in common."""

    def squares(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)

    def lifted(v: Column) -> Column:
        return F.transform(v["like"], lambda x: F.when(x >= LIKE_MOD // 2, x - LIKE_MOD).otherwise(x).cast("double"))

    apart = squares(F.zip_with(lifted(a), lifted(b), lambda x, y: x - y))
    both = squares(lifted(a)) + squares(lifted(b))
    return F.when(a["equal"] == b["equal"], 1.0).when(both == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - apart / both))


def with_following(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, print, next_text, next_print): each row with the row after it by descending id, the first after the last.

    Ids are cut into runs by their quantiles, so that each run is ordered on its own; the head of
    the run that follows is dealt to a run as a guest, from which its last row reads. Equal ids go
    by text, null ids come last. Texts move once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    runs = 3 * parallelism(spark)
    edges = rows.agg(F.percentile_approx("id", [k / runs for k in range(1, runs)], 100 * runs).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    # The run is the number of edges up to the id; null ids are run -1.
    run = F.when(F.col("id").isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<long>"), lambda e: e <= F.col("id"))))
    dealt = rows.withColumn("run", run)
    heads = dealt.groupBy("run").agg(F.max("id").alias("id")).orderBy(F.col("run").desc()).collect()  # a row for each run
    own = dealt.withColumn("guest", F.lit(0))
    if not heads:
        return own.select("id", "text", fingerprint(F.col("text")).alias("print"), F.col("text").alias("next_text"), fingerprint(F.col("text")).alias("next_print"))
    host = {heads[(k + 1) % len(heads)]["run"]: heads[k]["run"] for k in range(len(heads))}
    named = [(h["id"], host[h["run"]]) for h in heads if h["run"] >= 0]
    guests = own.limit(0)
    if named:
        seats = F.broadcast(spark.createDataFrame(named, "id long, host int"))
        guests = rows.join(seats, "id").select("id", "text", F.col("host").alias("run"), F.lit(1).alias("guest"))
    if heads[-1]["run"] < 0:
        nameless = rows.where("id is null").orderBy("text").limit(1)
        guests = guests.unionByName(nameless.select("id", "text", F.lit(host[-1]).alias("run"), F.lit(1).alias("guest")))
    seated = own.unionByName(guests).repartition("run").withColumn("print", fingerprint(F.col("text")))
    w = Window.partitionBy("run").orderBy("guest", F.col("id").desc_nulls_last(), "text")
    following = seated.withColumns({"next_text": F.lead("text").over(w), "next_print": F.lead("print").over(w)})
    return following.where("guest = 0").drop("run", "guest")


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by the start of the following one."""
    k = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - k), F.substring(following, F.lit(1), k))
