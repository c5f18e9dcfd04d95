"""Entropy, character statistics and tokens of short texts, each also as DuckDB text.

Characters are code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.rx import Rx, guard, holds, needed, quoted


#: Different characters up to which each is counted by a pass over the text, which is quick; a text of more is sorted and counted in one pass.
FEW_CHARACTERS = 96


def shannon_entropy(text: Column, few: int = FEW_CHARACTERS) -> Column:
    """Bits a character; 0 for an empty or null text. The work grows in proportion to the text, whatever its alphabet."""
    n = F.length(text)
    part = lambda a, p: a - p * F.log2(p)
    shares = lambda chars: F.transform(chars, lambda c: 1 - F.length(F.replace(text, c, F.lit(""))) / n)

    def run(acc: Column, c: Column) -> Column:
        same = acc["last"] == c
        ended = F.when(same | (acc["run"] == 0), acc["bits"]).otherwise(part(acc["bits"], acc["run"] / n))
        return F.struct(c.alias("last"), F.when(same, acc["run"] + 1).otherwise(F.lit(1)).alias("run"), ended.alias("bits"))

    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("bits"))
    ordered = F.aggregate(F.array_sort(F.filter(F.split(text, ""), lambda c: c != "")), start, run, lambda acc: part(acc["bits"], acc["run"] / n))
    # Lambdas hand the characters on, so that they are found once.
    chars = F.array(F.array_sort(F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")))
    bits = F.transform(chars, lambda x: F.when(F.size(x) <= few, F.aggregate(shares(x), F.lit(0.0), part)).otherwise(ordered))
    return F.coalesce(F.when(n > 0, F.get(bits, F.lit(0))), F.lit(0.0))


def shannon_entropy_sql(text: str) -> str:
    n = f"length({text})"
    p = f"(({n} - length(replace({text}, c, ''))) / {n}::DOUBLE)"
    return f"coalesce(CASE WHEN {n} > 0 THEN list_sum([-{p} * log2({p}) FOR c IN list_sort(list_distinct(string_split({text}, ''))) IF c <> '']) END, 0::DOUBLE)"


def _share(text: Column, kept: str) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, kept, "")), F.lit(0)) / F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1))


# What the character classes leave out; letters beyond ASCII are special.
NOT_DIGIT, NOT_UPPER, NOT_SPECIAL = "[^0-9]", "[^A-Z]", r"[a-zA-Z0-9\s]"


def char_stats(text: Column) -> dict[str, Column]:
    """Length, and shares of digits, capitals and special characters."""
    return {"len": F.coalesce(F.length(text), F.lit(0)), "digit_ratio": _share(text, NOT_DIGIT), "upper_ratio": _share(text, NOT_UPPER), "special_ratio": _share(text, NOT_SPECIAL)}


#: Bytes and texts whose characters are counted at once.
COUNTED, TOGETHER = 1 << 20, 2048
_ASCII = np.arange(128)
_DIGITS, _PLAIN = (_ASCII >= 48) & (_ASCII < 58), np.array([chr(k).isalnum() or chr(k) in "\t\n\x0b\f\r " for k in _ASCII])


def measured(texts: pa.Array) -> dict[str, np.ndarray]:
    """For each text its entropy in bits a character, its length, and its digits, special characters and characters beyond ASCII; null counts as empty.

    The same as `shannon_entropy` and `char_stats` for many texts at once: characters of a block of texts are counted together.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    out = {"entropy": np.zeros(n)} | {k: np.zeros(n, np.int64) for k in ("length", "digits", "special", "beyond")}
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        end = min(n, at + TOGETHER, max(at + 1, int(np.searchsorted(offsets, offsets[at] + COUNTED, side="right")) - 1))
        held = data[offsets[at] : offsets[end]]
        if not len(held) or held.max() < 128:
            row = np.repeat(np.arange(end - at), np.diff(offsets[at : end + 1]))
            table = np.bincount(row << 7 | held, minlength=(end - at) << 7)
            key = np.flatnonzero(table)
            times, row, code = table[key], key >> 7, key & 127
        else:
            codes = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offsets[at:end], offsets[at + 1 : end + 1])]
            key, times = np.unique(np.repeat(np.arange(end - at), list(map(len, codes))) << 21 | np.concatenate(codes), return_counts=True)
            row, code = key >> 21, key & (1 << 21) - 1
        add = lambda name, weights: np.bincount(row, weights, end - at)
        length = add("length", times)
        share = times / length[row]
        ascii_ = code < 128
        kind = np.where(ascii_, code, 0)
        out["entropy"][at:end] = add("entropy", -share * np.log2(share))
        out["length"][at:end] = length
        out["digits"][at:end] = add("digits", times * (ascii_ & _DIGITS[kind]))
        out["special"][at:end] = add("special", times * ~(ascii_ & _PLAIN[kind]))
        out["beyond"][at:end] = add("beyond", times * ~ascii_)
        at = end
    return out


def char_stats_sql(text: str) -> dict[str, str]:
    share = lambda kept: f"coalesce(length(regexp_replace({text}, '{kept}', '', 'g')), 0) / greatest(coalesce(length({text}), 0), 1)::DOUBLE"
    return {"len": f"coalesce(length({text}), 0)::INT", "digit_ratio": share(NOT_DIGIT), "upper_ratio": share(NOT_UPPER), "special_ratio": share(NOT_SPECIAL)}


RUN = "[A-Za-z0-9+/=._-]{16,}"


def high_entropy_tokens(text: Column, least: int = 20, bits: float = 4.3) -> Column:
    """array<struct(token, entropy)> of long runs of key characters with high entropy, in text order."""
    runs = F.filter(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda x: F.length(x) >= least)
    return F.filter(F.transform(runs, lambda x: F.struct(x.alias("token"), shannon_entropy(x).alias("entropy"))), lambda x: x["entropy"] >= bits)


def high_entropy_sql(source: str, key: str, text: str, least: int = 20, bits: float = 4.3) -> str:
    """(key, token, entropy) rows of a DuckDB subquery."""
    return f"SELECT {key}, token, entropy FROM (SELECT {key}, token, {shannon_entropy_sql('token')} AS entropy FROM (SELECT {key}, unnest(regexp_extract_all({text}, '{RUN}')) AS token FROM ({source})) WHERE length(token) >= {least}) WHERE entropy >= {bits}"


# Signs of attack syntax that become tokens of their own, tried in this order. A
# group is what follows the sign and stays in the text.
SYMBOLS = (
    ("§traversal", r"\.\./"),
    ("§jndi", r"jndi:"),
    ("§xss", r"<script"),
    ("§union_select", r"union\s+select"),
    ("§tautology", r"or\s+1\s*=\s*1|'\s*or\s*'1'\s*=\s*'1"),
    ("§sqlcomment", r"--\s|--$|#\s*$"),
    ("§urlenc", r"%[0-9a-f]{2}"),
    ("§b64cmd", r"-enc\s|frombase64|frombase64string"),
    ("§sensitivefile", r"/etc/passwd|/etc/shadow"),
    ("§creddump", r"sekurlsa|logonpasswords|lsass"),
    ("§cmdsep", r";\s*([a-z])"),
    ("§pipe", r"\|\s*([a-z])"),
    ("§cmdsubst", r"\$\("),
    ("§andcmd", r"&&\s*([a-z])"),
    ("§backtick", r"`([a-z])"),
)
#: What a sign's token means to a reader.
LABELS = {
    "§traversal": "path traversal (../)",
    "§jndi": "JNDI lookup",
    "§xss": "<script>",
    "§union_select": "UNION SELECT",
    "§tautology": "OR 1=1",
    "§sqlcomment": "SQL comment (--)",
    "§urlenc": "URL encoding (%xx)",
    "§b64cmd": "Base64 command",
    "§sensitivefile": "sensitive file (/etc/passwd)",
    "§creddump": "credential dump",
    "§cmdsep": "command separator (;)",
    "§pipe": "pipe (|)",
    "§cmdsubst": "command substitution ($())",
    "§andcmd": "chained command (&&)",
    "§backtick": "backtick (`)",
}


def labelled(token: Column) -> Column:
    """What a token means to a reader; words stand for themselves."""
    out = token
    for name, label in LABELS.items():
        out = F.when(token == name, label).otherwise(out)
    return out


def labelled_sql(token: str) -> str:
    return f"CASE {token} " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in LABELS.items()) + f" ELSE {token} END"


WORD, LONG_NUMBER, LONGEST = "[a-z0-9_]{2,}", 4, 24


def _may_hold_signs(lower: Column) -> Column:
    """A cheap test that holds wherever one of the signs occurs."""
    rare = [pattern for name, pattern in SYMBOLS if name != "§tautology"]  # its literal part, "or", is common
    words = sorted(set().union(*(needed(p) for p in rare)))
    return holds(lower, words) | lower.rlike(r"or\s+1|or\s*'1'")


def with_tokens(df: DataFrame, text: str, out: str = "tokens") -> DataFrame:
    """`df` with the tokens of a text: signs first, then words; long numbers and long words are left out.

    A step each sign, as each works on what the one before left; a text without any is null
    meanwhile, which costs nothing. `token_rows` explodes the result.
    """
    now = df.withColumn("lower__", F.lower(F.coalesce(F.col(text), F.lit(""))))
    now = now.withColumn("scratch__", F.when(_may_hold_signs(F.col("lower__")), F.col("lower__")))
    for k, (_, pattern) in enumerate(SYMBOLS):
        rx, scratch = Rx(pattern, False).java, F.col("scratch__")
        count, replaced = F.regexp_count(scratch, F.lit(rx)), F.regexp_replace(scratch, rx, " $1" if "(" in pattern.replace(r"\(", "") else " ")
        some = guard(scratch, (Rx(pattern, False),))  # most texts hold one sign or none
        # A sign is counted first; a text without it stays as it is.
        now = now.withColumn(f"n{k}__", count if some is None else F.when(some, count)).withColumn("scratch__", F.when(F.col(f"n{k}__") > 0, replaced).otherwise(scratch))
    signs = [F.array_repeat(F.lit(name), F.coalesce(f"n{k}__", F.lit(0))) for k, (name, _) in enumerate(SYMBOLS)]
    left = F.coalesce("scratch__", "lower__")
    words = F.filter(F.regexp_extract_all(left, F.lit(WORD), F.lit(0)), lambda w: (F.length(w) <= LONG_NUMBER) | ((F.length(w) <= LONGEST) & ~w.rlike(r"^[0-9]+\z")))
    return now.withColumn(out, F.concat(*signs, words)).drop("lower__", "scratch__", *[f"n{k}__" for k in range(len(SYMBOLS))])


def token_rows(df: DataFrame, text: str, *kept: Column | str) -> DataFrame:
    """(kept columns, token) of every token of a text; `kept` may use the array `tokens`.

    The outer form keeps Spark from testing the array's size below the steps that make it, where every
    step would be worked out again for the test.
    """
    return with_tokens(df, text).select(*kept, F.explode_outer("tokens").alias("token")).where("token is not null")


def tokens_sql(source: str, text: str, out: str = "tokens") -> str:
    """A DuckDB subquery with the tokens of a text in a list column."""
    sql = f"SELECT *, lower(coalesce({text}, '')) AS scratch__ FROM ({source})"
    for k, (_, pattern) in enumerate(SYMBOLS):
        rx = quoted(Rx(pattern, False).re2)
        kept = r" \1" if "(" in pattern.replace(r"\(", "") else " "
        sql = f"SELECT * EXCLUDE (scratch__), len(regexp_extract_all(scratch__, {rx})) AS n{k}__, regexp_replace(scratch__, {rx}, '{kept}', 'g') AS scratch__ FROM ({sql})"
    signs = ", ".join(f"list_transform(range(n{k}__), lambda i: '{name}')" for k, (name, _) in enumerate(SYMBOLS))
    drop = ", ".join(["scratch__", *[f"n{k}__" for k in range(len(SYMBOLS))]])
    words = f"list_filter(regexp_extract_all(scratch__, '{WORD}'), lambda w: NOT (regexp_matches(w, '^[0-9]+$') AND length(w) > {LONG_NUMBER}) AND length(w) <= {LONGEST})"
    return f"SELECT * EXCLUDE ({drop}), flatten([{signs}, {words}]) AS {out} FROM ({sql})"
