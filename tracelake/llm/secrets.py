"""Operator 8: secret scans with DataFrame functions only.

Three kinds of spans come from fixed patterns. The method adds a fourth, `entropy`: every maximal
run of key characters (and the signs = that end it) is a candidate, its character class (hex or
base64) sets the alphabet and the threshold, and a window slides over it. Counts of the window's
characters change by the one that enters and the one that leaves, and with them the sum of
c*log2(c), so each step costs the same whatever the window. A candidate whose best window reaches
the threshold is a span, unless an allow-list names it or a span of the fixed kinds holds it. Of a
candidate that the allow-list names, the parts between slashes are judged on their own, so a harmless
word doesn't hide a secret beside it.

The work on a text grows with its length and its number of spans: what is built up in order is
built in chunks (`_scanned`), and matched texts are kept, not cut out again.

Offsets are code points, ends exclusive. Defined cases: a null text counts as empty and has no
spans; repeated rows are scanned each; of spans with the same start that of the kind listed first
comes first; texts of any length are scanned whole; other columns are carried along, and `spans`
replaces a column of that name; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import packed, unpacked

# The patterns of the three kinds, the group that is measured, and its least length.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {"assign": (ASSIGN, 2, 6), "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24)}
#: A text without a match of these has no span of the kind.
HINTS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/_-]{%d,}=*" % WINDOW
HINT = "[A-Za-z0-9+/_-]{%d}" % WINDOW
#: Bits a character that a window has to reach, of log2(16) = 4 and log2(WINDOW) = 4.32 at most.
LIMITS = {"hex": 3.0, "base64": 3.75}
#: Candidates that are no secrets: words, numbers, identifiers of words, paths, UUIDs, placeholders, hashes of nothing.
ALLOWED = [
    "^[A-Za-z]+$",
    "^[0-9_=+/-]+$",
    "^[A-Za-z]+([-_/=+][A-Za-z]*)+[0-9]{0,4}$",
    "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    "(?i)(example|placeholder|changeme|xxxx|dummy|sample)",
    "^(d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)$",
]
SPAN = "struct<start:int,kind_no:int,end:int,kind:string>"
#: A span, and for a candidate what it says.
FOUND = "struct<start:int,kind_no:int,end:int,kind:string,run:string>"
#: Rows that `_scanned` takes at once, and counts in one long of `best_window`, of BITS each.
CHUNK = 256
FIELDS, BITS = 12, 5


def _let(value: Column, use) -> Column:
    """use(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chunks(rows: Column) -> Column:
    last = F.floor(F.greatest(F.size(rows) - 1, F.lit(0)) / CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(rows, k * CHUNK + 1, F.lit(CHUNK)))


def _scanned(rows: Column, kind: str, step) -> Column:
    """What step(state, row) gives in order: (next state, whether to keep, result of type `kind`). The state starts at 0.

    An array that grows by one is copied each time, so results grow in chunks, and the chunks by one.
    """
    empty = F.array().cast(f"array<{kind}>")

    def small(acc: Column, x: Column) -> Column:
        state, keep, out = step(acc["state"], x)
        grown = F.when(keep, F.array_append(acc["out"], out.cast(kind))).otherwise(acc["out"])
        return F.struct(state.cast("int").alias("state"), grown.cast(f"array<{kind}>").alias("out"))

    def large(acc: Column, chunk: Column) -> Column:
        start = F.struct(acc["state"].alias("state"), empty.alias("out"))
        return _let(F.aggregate(chunk, start, small), lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).cast(f"array<array<{kind}>>").alias("out")))

    start = F.struct(F.lit(0).alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return _let(rows, lambda all_: F.flatten(F.aggregate(_chunks(all_), start, large, lambda acc: acc["out"])))


def _found(text: Column, kind: str, no: int, pattern: str, group: int, least: int, say: bool = False) -> Column:
    """Spans of the non-overlapping matches of a pattern, leftmost first, whose group is long enough.

    The gaps between matches and the matches themselves add up to the offsets.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    rows = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), F.transform(sized, F.length).alias("size"))

    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        start = at + x["gap"]
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        run = x["hit"] if say else F.lit(None).cast("string")
        return end, x["size"] >= least, F.struct(start.alias("start"), F.lit(no).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), run.alias("run"))

    return _scanned(rows, FOUND, step)


def best_window(text: Column, alphabet: str) -> Column:
    """The largest Shannon entropy, in bits a character, of a window of a text over an alphabet.

    State: the counts, FIELDS of them in a long, the sum of c*log2(c), and the best so far. Texts
    shorter than the window have none (-1).
    """

    def term(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))

    words = -(-len(alphabet) // FIELDS)
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("best"))
    # Places in the alphabet, from 0, of what enters and what leaves; nothing (-1) leaves the first window.
    into = F.transform(F.split(text, ""), lambda c: F.position(c, F.lit(alphabet)) - 1)
    rows = _let(into, lambda i: F.arrays_zip(i.alias("into"), F.concat(F.array_repeat(F.lit(-1), WINDOW), F.slice(i, 1, F.greatest(F.length(text) - WINDOW, F.lit(0)))).alias("out")))

    def place(p: Column) -> tuple[Column, Column]:
        return F.floor(p / FIELDS).cast("int"), (F.pmod(p, F.lit(FIELDS)) * BITS).cast("int")

    def moved(x: Column, i: Column) -> Column:
        (in_word, in_bit), (out_word, out_bit) = place(x["into"]), place(x["out"])
        return F.struct(in_word.alias("in_word"), in_bit.alias("in_bit"), out_word.alias("out_word"), out_bit.alias("out_bit"), (x["into"] == x["out"]).alias("same"), (i >= WINDOW - 1).alias("full"))

    rows = F.transform(F.filter(rows, lambda x: x["into"].isNotNull()), moved)
    one = F.lit(1).cast("long")

    def count(acc: Column, word: Column, bit: Column) -> Column:
        return F.call_function("shiftright", F.get(acc["counts"], word), bit).bitwiseAND(F.lit((1 << BITS) - 1))

    def step(acc: Column, x: Column) -> Column:
        a = count(acc, x["in_word"], x["in_bit"])
        b = count(acc, F.greatest(x["out_word"], F.lit(0)), x["out_bit"])
        left = F.when(x["out_word"] >= 0, term(b - 1) - term(b)).otherwise(F.lit(0.0))
        total = F.when(x["same"], acc["sum"]).otherwise(acc["sum"] + term(a + 1) - term(a) + left)
        more, less = F.call_function("shiftleft", one, x["in_bit"]), F.call_function("shiftleft", one, x["out_bit"])
        counts = F.transform(acc["counts"], lambda c, j: c + F.when(j == x["in_word"], more).otherwise(0) - F.when(j == x["out_word"], less).otherwise(0))
        best = F.when(x["full"], F.greatest(acc["best"], F.lit(math.log2(WINDOW)) - total / WINDOW)).otherwise(acc["best"])
        return F.struct(F.when(x["same"], acc["counts"]).otherwise(counts).alias("counts"), total.alias("sum"), best.alias("best"))

    return F.aggregate(rows, start, step, lambda acc: acc["best"])


HEX, BASE64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _reaches(text: Column) -> Column:
    """Whether a run of key characters reaches its class's threshold."""
    is_hex = text.rlike("^([0-9a-f]+|[0-9A-F]+)$")
    return F.when(is_hex, best_window(F.lower(text), HEX) >= LIMITS["hex"]).otherwise(best_window(text, BASE64) >= LIMITS["base64"])


def _allowed(text: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | text.rlike(pattern)
    return out


def high_entropy(text: Column) -> Column:
    """Whether a candidate, or a part between slashes of one that the allow-list names, is a secret."""
    parts = F.exists(F.split(text, "/"), lambda p: F.when((F.length(p) < WINDOW) | _allowed(p), False).otherwise(_reaches(p)))
    return F.when(F.length(text) < WINDOW, False).when(_allowed(text), F.contains(text, F.lit("/")) & parts).otherwise(_reaches(text))


def scan(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """`docs` with all spans of a text, sorted by start, then kind, then end."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    none = F.array().cast(f"array<{FOUND}>")
    kinds = [F.when(whole.rlike(HINTS[k]), _found(whole, k, no, p, g, n)).otherwise(none) for no, (k, (p, g, n)) in enumerate(KINDS.items())]
    last = len(kinds)
    runs = F.when(whole.rlike(HINT), _found(whole, "entropy", last, CANDIDATE, 0, WINDOW, True)).otherwise(none)

    def apart(reach: Column, x: Column) -> tuple[Column, Column, Column]:
        """In order of the starts, a span of the fixed kinds that reaches as far as a candidate holds it."""
        base = x["kind_no"] < last
        return F.when(base, F.greatest(reach, x["end"])).otherwise(reach), base | (x["end"] > reach), x

    def judged(all_: Column) -> Column:
        found = F.filter(_scanned(all_, FOUND, apart), lambda x: (x["kind_no"] < last) | high_entropy(x["run"]))
        return F.transform(found, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "kind_no", "end", "kind")]).cast(SPAN))

    step = docs.select(packed(kept).alias("own"), F.array_sort(F.concat(*kinds, runs)).alias("found"))
    spans = F.when(F.size("found") > 0, judged(F.col("found"))).otherwise(F.array().cast(f"array<{SPAN}>"))
    return step.select(*unpacked("own", kept), spans.alias(out))


def said(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (or run of overlapping spans) replaced by [kind].

    A text is cut once a chunk of spans, and each chunk's part once a span.
    """

    def first(at: Column, x: Column) -> tuple[Column, Column, Column]:
        return F.greatest(at, x["end"]), x["start"] >= at, F.struct(at.alias("at"), x["start"].alias("start"), x["kind"].alias("kind"))

    def cut(chunk: Column) -> Column:
        a, b = F.get(chunk, F.lit(0))["at"], F.element_at(chunk, -1)["start"]
        part = F.substring(text, a + 1, b - a)
        said = _let(part, lambda p: F.transform(chunk, lambda x: F.concat(F.substring(p, x["at"] - a + 1, x["start"] - x["at"]), F.lit("["), x["kind"], F.lit("]"))))
        return F.array_join(said, "")

    kept = _scanned(spans, "struct<at:int,start:int,kind:string>", first)
    end = F.aggregate(spans, F.lit(0), lambda acc, x: F.greatest(acc, x["end"]))
    return F.concat(_let(kept, lambda k: F.array_join(F.transform(_chunks(k), cut), "")), F.substring(text, end + 1, F.length(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the secrets of a text replaced; texts without any stay as they are."""
    columns = docs.columns
    scanned = scan(docs.select(packed(columns).alias("own"), F.col(f"`{text}`").alias("text")), "text", "spans")
    clean = F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return scanned.select(*[clean.alias(c) if c == text else x for c, x in zip(columns, unpacked("own", columns))])
