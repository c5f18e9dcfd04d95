"""Rule patterns for two engines.

Rules are written once, in the common subset of JavaScript, Java and RE2. Java's \\b is not ASCII
and its $ also matches before a last line feed, so both are spelt out for Spark; RE2 takes them as
they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

try:  # Python's own reader of patterns, which isn't promised to stay
    from re import _constants as op
    from re import _parser
except ImportError:
    _parser = None

_WORD = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


@dataclass(frozen=True)
class Rx:
    """A pattern, and whether case matters."""

    text: str
    ignore_case: bool = True

    @property
    def java(self) -> str:
        """For Spark."""
        body = re.sub(r"\\(.)|(\$)|\[(?:\\.|[^\]\\])*\]", self._java, self.text)
        return f"(?i:{body})" if self.ignore_case else f"(?:{body})"

    @staticmethod
    def _java(m: re.Match) -> str:
        if m[0] == "\\b":
            return _EDGE
        return r"\z" if m[2] else m[0]

    @property
    def re2(self) -> str:
        """For DuckDB."""
        return f"(?i:{self.text})" if self.ignore_case else f"(?:{self.text})"


#: Alternatives of a run of literals that are still told apart.
_ALTERNATIVES = 32


def _exact(item) -> set[str] | None:
    """All texts that a part of a pattern can match, if they are few literals; boundaries match the empty one."""
    kind, value = item
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return {""}
    if kind is op.SUBPATTERN:
        return _joined(map(_exact, value[3]))
    if kind is op.BRANCH:
        parts = [_joined(map(_exact, branch)) for branch in value[1]]
        return None if None in parts or sum(map(len, parts)) > _ALTERNATIVES else set().union(*parts)
    if kind is op.IN and len(value) <= 4 and all(k is op.LITERAL for k, _ in value):
        return {chr(c).lower() for _, c in value}
    if kind is op.MAX_REPEAT and value[1] == 1:  # a part that may be there
        once = _joined(map(_exact, value[2]))
        return None if once is None else once | {""} if value[0] == 0 else once
    return None


def _joined(parts) -> set[str] | None:
    out = {""}
    for part in parts:
        if part is None or len(out) * len(part) > _ALTERNATIVES:
            return None
        out = {a + b for a in out for b in part}
    return out


#: Signs that lines hardly ever hold.
_RARE = "'`$<>|{}\\"


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The set that says more: the one whose shortest text is longer; rare signs count for more than a letter."""
    kept = [x for x in (a, b) if x and "" not in x]
    return max(kept, key=lambda x: min(len(w) + 1.5 * sum(map(w.count, _RARE)) for w in x), default=None)


def _needed(items) -> set[str] | None:
    """Texts one of which every match of a sequence holds, or None if none are known."""
    best, run = None, {""}
    for item in items:
        kind, value = item
        longer = _joined((run, _exact(item)))
        if longer is not None:
            run = longer
            continue
        best, run = _better(best, run), {""}
        if kind is op.SUBPATTERN:
            best = _better(best, _needed(value[3]))
        elif kind is op.BRANCH:
            parts = [_needed(branch) for branch in value[1]]
            best = _better(best, None if None in parts else set().union(*parts))
        elif kind is op.MAX_REPEAT and value[0] > 0:
            best = _better(best, _needed(value[2]))
    return _better(best, run)


@lru_cache(maxsize=None)
def needed(pattern: str) -> frozenset[str] | None:
    """Lower-case texts one of which occurs, case ignored, in every text that a pattern matches; None if none are known.

    They only spare the work of trying a pattern: without Python's reader of patterns the answer is the empty
    text, which every text holds.
    """
    if _parser is None:
        return frozenset({""})
    found = _needed(_parser.parse(pattern))
    return frozenset(found) if found else None


def guard(lower: Column, patterns: tuple[Rx, ...]) -> Column | None:
    """A cheap test of a text in lower case that holds wherever one of the patterns occurs; None if there is none."""
    sets = [needed(p.text) for p in patterns]
    if None in sets:
        return None
    words = sorted(set().union(*sets), key=lambda w: (len(w), w))
    words = [w for k, w in enumerate(words) if not any(v in w for v in words[:k])]  # a longer one says no more than its part
    return holds(lower, words)


def _trie(words: list[str]) -> str:
    """A pattern of one of a few words, which looks at the start that some of them share once."""
    if "" in words:
        return ""  # the others only go on from there
    tails: dict[str, list[str]] = {}
    for w in words:
        tails.setdefault(w[0], []).append(w[1:])
    parts = [_literal(a) + _trie(rest) for a, rest in sorted(tails.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def _literal(character: str) -> str:
    return character if character.isalnum() else f"\\x{{{ord(character):x}}}"


def gate(lower: Column, patterns: tuple[Rx, ...], *more: str) -> Column | None:
    """One test of a text in lower case for many patterns at once, and words besides: it holds wherever one of them occurs; None if there is none.

    The text is walked through once, where `guard` does so for each word.
    """
    sets = [needed(p.text) for p in patterns]
    words = sorted(set(more).union(*[s for s in sets if s]))
    if None in sets or "" in words:
        return None
    starts = "".join(_literal(a) for a in sorted({w[0] for w in words}))
    return lower.rlike(f"(?=[{starts}]){_trie(words)}")


def holds(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of a few words, as a short expression."""
    if len(words) == 1:
        return F.contains(text, F.lit(words[0]))
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def i(*patterns: str) -> tuple[Rx, ...]:
    """Patterns that ignore case."""
    return tuple(Rx(p) for p in patterns)


def c(*patterns: str) -> tuple[Rx, ...]:
    """Patterns for which case matters."""
    return tuple(Rx(p, False) for p in patterns)


def any_of(text: Column, patterns: tuple[Rx, ...], lower: Column | None = None) -> Column:
    """Whether any of the patterns occurs in a text: one literal expression, compiled once a task.

    With the text in lower case it is tried only where a literal part of a pattern occurs.
    """
    found = text.rlike("|".join(p.java for p in patterns))
    cheap = guard(lower, patterns) if lower is not None else None
    return found if cheap is None else cheap & found


def matched(texts: pa.Array, patterns: list[str]) -> pa.Array:
    """For each text a number whose bit k says whether RE2's pattern k occurs; most texts are passed by with one test for all."""
    some = pc.match_substring_regex(texts, pattern="|".join(patterns))
    at = np.flatnonzero(pc.fill_null(some, False).to_numpy(zero_copy_only=False))
    few, bits = texts.take(pa.array(at)), np.zeros(len(at), np.int64)
    for k, pattern in enumerate(patterns):
        bits |= pc.match_substring_regex(few, pattern=pattern).to_numpy(zero_copy_only=False).astype(np.int64) << k
    out = np.zeros(len(texts), np.int64)
    out[at] = bits
    return pa.array(out)


def occurring(text: Column, groups: list[tuple[Rx, ...]]) -> Column:
    """A number whose bit k says whether a pattern of group k occurs in a text, 0 if it is null; up to 63 groups.

    A batch of texts is matched at once by RE2, which DuckDB has as well: one walk through a text for all
    alternatives of a pattern.
    """
    patterns = ["|".join(p.re2 for p in g) for g in groups]

    @F.arrow_udf("long")
    def bits(texts: pa.Array) -> pa.Array:
        return matched(texts, patterns)

    return bits(text)


def bit(bits: Column, k: int) -> Column:
    """Whether bit k of a number of `occurring` is set."""
    return bits.bitwiseAND(F.lit(1 << k).cast("long")) != 0


def any_sql(text: str, patterns: tuple[Rx, ...]) -> str:
    """The same for DuckDB."""
    return f"regexp_matches({text}, {quoted('|'.join(p.re2 for p in patterns))})"


def quoted(text: str) -> str:
    """A DuckDB string literal."""
    return "'" + text.replace("'", "''") + "'"


def first_of(cases: list[tuple[Column, Column]], other: Column) -> Column:
    """The value of the first condition that holds."""
    return reduce(lambda acc, x: F.when(x[0], x[1]).otherwise(acc), reversed(cases), other)
