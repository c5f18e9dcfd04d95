"""Operator 2: SentencePiece encoding and decoding, exact for merge-type (BPE) models.

A text is cut where no piece can reach across (before a run of the space sign, and around
characters that no piece holds), and each distinct stretch is encoded by backtracking. One run of an
Aho-Corasick automaton over the reversed stretch gives the longest piece that starts at every
position. A piece may follow another only if merging their joint text gives the two back, and a
bitfield marks positions from which no valid continuation exists. Bytes stand in for characters that
no piece holds. The result equals the library's, which is what the tests hold it to.

Stretches go through automaton and backtracking in columns: numpy arrays hold a state, a position
and a 64-bit bitfield for each of many stretches (those of over SHORT characters backtrack one by
one). The tables are built on the driver and broadcast; their size is that of the vocabulary, and
executors need no model file. A task remembers stretches up to a bound and forgets them at its end.

Defined cases: a null text counts as empty; an empty text has no ids; repeated rows are encoded
each; ids decode to null if the array is null; an id outside the vocabulary raises. Texts of any
length are encoded whole. Other columns are carried along, and output columns replace input columns
of the same name. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import packed, released, unpacked
from tracelake.session import ship

SPACE = "▁"
#: Stretches, and characters of them, that a task remembers, about.
REMEMBERED, CHARACTERS = 150_000, 2_000_000
#: Characters of a stretch that has its bitfield in one number; starts of a window of a longer one.
SHORT = 63
#: Stretches that backtrack at once, and characters of the texts encoded at once, about.
ROWS, TEXTS = 1 << 14, 2_000_000
#: Slots of the hash of transitions (a power of two) and of the memory of pairs.
_SLOTS, _PAIRS = 19, 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * _ODD) >> np.uint64(64 - bits)).astype(np.int64)


class Automaton:
    """Aho-Corasick over reversed pieces, as arrays: read backwards, a state knows the longest piece that starts where it is."""

    def __init__(self, ids: dict[str, int], kind: np.ndarray, kinds: int):
        states, step = [""], {"": 0}
        for name in sorted(ids, key=len):
            for k in range(len(name)):
                end = name[len(name) - 1 - k :]
                if end not in step:
                    step[end] = len(states)
                    states.append(end)
        self.kinds, self.reach = kinds, max(map(len, ids))
        self.fail = np.zeros(len(states), np.int64)
        self.best = np.full(len(states), -1, np.int64)
        for end in sorted(states[1:], key=len):
            at = step[end]
            self.fail[at] = next(step[end[:n]] for n in range(len(end) - 1, -1, -1) if end[:n] in step)
            self.best[at] = ids.get(end, self.best[self.fail[at]])
        keys = np.array([step[end[1:]] * kinds + int(kind[ord(end[0])]) for end in states[1:]], np.int64)
        self.keys, self.to = np.full(1 << _SLOTS, -1, np.int64), np.full(1 << _SLOTS, -1, np.int32)
        for key, slot, to in zip(keys.tolist(), _slot(keys, _SLOTS).tolist(), range(1, len(states))):
            while self.keys[slot] >= 0:
                slot = (slot + 1) % (1 << _SLOTS)
            self.keys[slot], self.to[slot] = key, to

    def goto(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The states along the trie, -1 where there is none."""
        key = state * self.kinds + kind
        slot = _slot(key, _SLOTS)
        held = self.keys[slot]
        out = np.where(held == key, self.to[slot], -1)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % (1 << _SLOTS)
            held = self.keys[slot[open_]]
            same = held == key[open_]
            out[open_[same]] = self.to[slot[open_[same]]]
            open_ = open_[~same & (held >= 0)]
        return out

    def longest(self, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The longest piece at every position of stretches [start, end) of one array of character kinds."""
        out = np.full(len(kinds), -1, np.int64)
        # Stretches are read in windows; a window reads so far beyond its own positions that its state is the one of the whole.
        n = -(-(ends - starts) // (SHORT + 1))
        owner = np.repeat(np.arange(len(starts)), n)
        first = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * (SHORT + 1)
        own = np.minimum(first + SHORT + 1, ends[owner])
        at = np.minimum(own + self.reach - 1, ends[owner])
        order = np.argsort(first - at, kind="stable")  # longest first, so that those still read are the first ones
        first, own, at = first[order], own[order], at[order] - 1
        state = np.zeros(len(order), np.int64)
        live = len(order)
        while True:
            live = int(np.searchsorted(first[:live] - at[:live], 0, side="right"))
            if not live:
                return out
            now, kind = state[:live], kinds[at[:live]]
            to = self.goto(now, kind)
            back = np.flatnonzero((to < 0) & (now > 0))
            while len(back):
                now[back] = self.fail[now[back]]
                to[back] = self.goto(now[back], kind[back])
                back = back[(to[back] < 0) & (now[back] > 0)]
            state[:live] = np.maximum(to, 0)
            mine = at[:live] < own[:live]
            out[at[:live][mine]] = self.best[state[:live][mine]]
            at[:live] -= 1


class MergeTokenizer:
    """Vocabulary of a merge-type model with byte fallback and identity normalisation."""

    def __init__(self, model_path: str):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=model_path)
        if any(library.normalize(x) != SPACE + x.replace(" ", SPACE) for x in ("a", " a  b ", "\tﬁ é")):
            raise ValueError("only models that keep texts as they are and add one space in front are supported")
        self.size = library.get_piece_size()
        names = [library.id_to_piece(i) for i in range(self.size)]
        special = [library.is_control(i) or library.is_unknown(i) for i in range(self.size)]
        self.byte_of = {i: int(names[i][3:5], 16) for i in range(self.size) if library.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        if len(self.id_of_byte) != 256 or any(library.is_unused(i) for i in range(self.size)):
            raise ValueError("only models with 256 byte pieces and no unused pieces are supported")
        self.ids = {names[i]: i for i in range(self.size) if i not in self.byte_of and not special[i]}
        self.names = names
        self.score = {name: library.get_score(i) for name, i in self.ids.items()}
        known = sorted({c for name in self.ids for c in name})
        if not set(known) <= self.ids.keys():
            raise ValueError("every character of a piece has to be a piece itself")
        self.kind = np.zeros(ord(known[-1]) + 1, np.int32)  # 0: a character that no piece holds
        self.kind[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.automaton = Automaton(self.ids, self.kind, len(known) + 1)
        self.shorter = np.full(self.size, -1, np.int64)
        for name, i in self.ids.items():  # the longest piece that is a proper prefix
            self.shorter[i] = next((self.ids[name[:n]] for n in range(len(name) - 1, 0, -1) if name[:n] in self.ids), -1)
        self.lengths = np.array([len(name) for name in names], np.int64)
        own = "".join(re.escape(c) for c in known if c != SPACE)
        whole = any(SPACE in name.lstrip(SPACE) for name in self.ids)
        self.pattern = f"[{SPACE}{own}]+|." if whole else f"{SPACE}+[{own}]*|[{own}]+|."
        self.control = {i for i in range(self.size) if library.is_control(i)}
        self.plain = [("" if special[i] else name.replace(SPACE, " ")) for i, name in enumerate(names)]
        for i in range(self.size):
            if library.is_unknown(i):
                self.plain[i] = " ⁇ "
        self._start()

    def _start(self) -> None:
        self.stretches = re.compile(self.pattern, re.DOTALL)
        self.pair_key = np.full(1 << _PAIRS, -1, np.int64)
        self.pair_fits = np.zeros(1 << _PAIRS, bool)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("stretches", "pair_key", "pair_fits")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def merged(self, text: str) -> list[str]:
        """Merges the characters of a short text: best score first, leftmost among equals."""
        parts = list(text)
        score = self.score.get
        scores = [score(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for k, s in enumerate(scores):
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at])
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1])

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the joint text of two pieces gives the two back."""
        a, b = self.names[left], self.names[right]
        return self.merged(a + b) == [a, b]

    def fitting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`fits` of each pair; nothing on the left (-1) fits. Pairs are remembered in as many slots as there are."""
        key = left * self.size + right
        key[left < 0] = -1
        slot = _slot(key, _PAIRS)
        known = self.pair_key[slot] == key
        out = np.where(left < 0, True, self.pair_fits[slot])
        new = np.flatnonzero(~known & (left >= 0))
        if len(new):
            pairs, where = np.unique(key[new], return_inverse=True)
            found = np.array([self.fits(*divmod(p, self.size)) for p in pairs.tolist()], bool)
            out[new] = found[where]
            self.pair_key[slot[new]] = key[new]
            self.pair_fits[slot[new]] = out[new]
            # Two new pairs may meet in a slot: what it holds has to be of the key that it names.
            self.pair_fits[slot[new]] = found[np.searchsorted(pairs, self.pair_key[slot[new]])]
        return out

    def _columns(self, first: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backtracking over short stretches at once: their pieces one after the other, and how many each has."""
        n = len(starts)
        at, depth, last = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
        failed, out = np.zeros(n, np.uint64), np.empty((n, int(sizes.max(initial=0))), np.int32)
        token, one = first[starts], np.uint64(1)
        live = np.arange(n)
        while len(live):
            t = token[live]
            end = at[live] + self.lengths[t]
            good = (failed[live] >> end.astype(np.uint64)) & one == 0
            open_ = np.flatnonzero(good)
            good[open_] = self.fitting(last[live[open_]], t[open_])
            go, back = live[good], live[~good]
            out[go, depth[go]] = last[go] = t[good]
            depth[go] += 1
            at[go] = end[good]
            go = go[at[go] < sizes[go]]
            token[go] = first[starts[go] + at[go]]
            token[back] = self.shorter[t[~good]]
            stuck = back[token[back] < 0]
            while len(stuck):  # nothing is left to try here: this position fails
                failed[stuck] |= one << at[stuck].astype(np.uint64)
                depth[stuck] -= 1
                t = out[stuck, depth[stuck]].astype(np.int64)
                at[stuck] -= self.lengths[t]
                last[stuck] = np.where(depth[stuck] > 0, out[stuck, depth[stuck] - 1], -1)
                token[stuck] = self.shorter[t]
                stuck = stuck[token[stuck] < 0]
            live = np.concatenate([go, back])
        return out[np.arange(out.shape[1]) < depth[:, None]], depth

    def _alone(self, longest: list[int]) -> list[int]:
        """Backtracking over one stretch, given the longest piece at every position."""
        lengths, shorter, pairs = self.lengths.tolist(), self.shorter.tolist(), {}
        n = len(longest)
        failed = bytearray(n // 8 + 1)
        out: list[int] = []
        at, last, token = 0, -1, longest[0]
        while True:
            end = at + lengths[token]
            if not failed[end >> 3] >> (end & 7) & 1:
                fits = last < 0 or pairs.get((last, token))
                if fits is None:
                    if len(pairs) >= REMEMBERED:
                        pairs.clear()
                    fits = pairs[last, token] = self.fits(last, token)
                if fits:
                    out.append(token)
                    at, last = end, token
                    if at == n:
                        return out
                    token = longest[at]
                    continue
            token = shorter[token]
            while token < 0:
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= lengths[token]
                last = out[-1] if out else -1
                token = shorter[token]

    def encode_stretches(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches one after the other, and how many each has."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes)
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        kinds = np.where(codes < len(self.kind), self.kind[np.minimum(codes, len(self.kind) - 1)], 0)
        first = self.automaton.longest(kinds, ends - sizes, ends)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        foreign = np.flatnonzero(kinds[ends - sizes] == 0)  # one character each
        if len(foreign):
            raw = [parts[k].encode() for k in foreign]
            found.append((foreign, np.array([self.id_of_byte[b] for x in raw for b in x], np.int32), np.array([len(x) for x in raw])))
        plain = np.flatnonzero(kinds[ends - sizes] > 0)
        short = plain[sizes[plain] <= SHORT]
        short = short[np.argsort(sizes[short], kind="stable")]
        for k in range(0, len(short), ROWS):
            some = short[k : k + ROWS]
            found.append((some, *self._columns(first, (ends - sizes)[some], sizes[some])))
        for k in plain[sizes[plain] > SHORT].tolist():
            ids = self._alone(first[ends[k] - sizes[k] : ends[k]].tolist())
            found.append((np.array([k]), np.array(ids, np.int32), np.array([len(ids)])))
        counts, at = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        flat, filled = [np.empty(0, np.int32)], 0
        for who, ids, n in found:
            counts[who], at[who] = n, filled + np.cumsum(n) - n
            flat.append(ids)
            filled += len(ids)
        return np.concatenate(flat)[_ragged(at, counts)], counts

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text."""
        return Memory(self).encode([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that form no character become U+FFFD each."""
        if not ids:
            return ""
        plain = self.plain
        if min(ids) < 0:
            raise ValueError("an id outside the vocabulary")
        if self.byte_of.keys().isdisjoint(ids):
            parts = map(plain.__getitem__, ids)
        else:
            parts, held = [], bytearray()
            for i in ids:
                if i in self.byte_of:
                    held.append(self.byte_of[i])
                    continue
                if held:
                    parts.append(_characters(held))
                    held = bytearray()
                parts.append(plain[i])
            parts.append(_characters(held))
        first = next((i for i in ids if i not in self.control), ids[0])
        text = "".join(parts)
        return text[1:] if self.names[first].startswith(SPACE) else text


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class _Numbered(dict):
    def __missing__(self, part: str) -> int:
        n = self[part] = len(self)
        return n


class Memory:
    """What one task knows of stretches: their numbers, and their ids in one array."""

    def __init__(self, own: MergeTokenizer):
        self.own = own
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.filled = _Numbered(), 0
        self.flat, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after the other, and how many each has."""
        number, cut = self.numbers.__getitem__, self.own.stretches.findall
        rows, per = [np.empty(0, np.int64)], []
        before = len(self.numbers)
        for text in texts:
            parts = cut(SPACE + text.replace(" ", SPACE)) if text else []
            per.append(len(parts))
            rows.append(np.fromiter(map(number, parts), np.int64, len(parts)))
        fresh = list(islice(self.numbers, before, None))
        if fresh:
            flat, counts = self.own.encode_stretches(fresh)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.flat = np.concatenate([self.flat, flat])
            self.filled += sum(map(len, fresh))
        row = np.concatenate(rows)
        counts = self.counts[row]
        ids = self.flat[_ragged(self.starts[row], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(per)] if per else np.empty(0, np.int64)
        if len(self.numbers) >= REMEMBERED or self.filled >= CHARACTERS:
            self._forget()
        return ids, np.diff(ends, prepend=0)


def _characters(held: bytearray) -> str:
    try:
        return held.decode()
    except UnicodeDecodeError:
        pass
    out, k = [], 0
    while k < len(held):
        for n in range(1, 5):
            try:
                out.append(held[k : k + n].decode())
                k += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


@lru_cache(maxsize=2)
def tokenizer(model_path: str) -> MergeTokenizer:
    """One vocabulary per process and model."""
    return MergeTokenizer(model_path)


def decoded(ids: Column, model_path: str) -> Column:
    """Text of an array<int> column."""
    ship()
    held = _sent(model_path)

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        own = held.value
        return pa.array([None if not x.is_valid else own.decode(x.values.to_pylist()) for x in rows], pa.string())

    return decode(ids)


def _sent(model_path: str):
    """The vocabulary's tables on the executors: as large as the vocabulary, whatever the input."""
    from pyspark.sql import SparkSession

    return SparkSession.active().sparkContext.broadcast(tokenizer(model_path))


def _groups(texts: pa.Array):
    """Slices (start, count) of texts of about TEXTS bytes, one text at least."""
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float))
    filled, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = filled[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(filled, before + TEXTS, side="right")))
        yield at, end - at
        at = end


NEW = ("ids", "decoded")


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", out: str = "ids", keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all of them, if it is None) and the ids of column `text` in column `out`.

    With `decoded`, the text that the ids decode to comes in that column from the same pass. A pass
    of its own: as a column function it would run again inside every function of its result.
    """
    ship(docs.sparkSession)
    made = [out] if decoded is None else [out, decoded]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"), packed(kept).alias("own"))
    held = _sent(model_path)

    def encode(batches):
        own = held.value
        memory = Memory(own)
        for batch in batches:
            for at, n in _groups(batch.column(0)):
                part = batch.slice(at, n)
                ids, counts = memory.encode(part.column(0).to_pylist())
                ends = np.concatenate([[0], np.cumsum(counts)])
                columns = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))]
                if decoded is not None:
                    columns.append(pa.array([own.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(1), *columns], ["own", *NEW[: len(columns)]])

    kinds = [T.ArrayType(T.IntegerType()), T.StringType()]
    schema = T.StructType([rows.schema["own"], *[T.StructField(c, t) for c, t in zip(NEW, kinds[: len(made)])]])
    return rows.mapInArrow(released(encode), schema).select(*unpacked("own", kept), *[F.col(n).alias(c) for n, c in zip(NEW, made)])


def decode_documents(docs: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`docs` with the text of the ids in column `ids` in column `out` (replaced if there is one)."""
    return docs.withColumn(out, decoded(F.col(f"`{ids}`"), model_path))
