"""Random numbers that repeat: a seed from data (FNV-1a) and a 32-bit generator (mulberry32), both published algorithms.

The generator's state is a counter, so any number of its stream can be had by its position, in any
order and side by side.
"""

from __future__ import annotations

import numpy as np

# The offset and the prime of 32-bit FNV-1a, and the step of mulberry32.
FNV_OFFSET, FNV_PRIME, STEP = 2166136261, 16777619, 0x6D2B79F5
_MASK = (1 << 32) - 1


def seed_from(*parts: str | int) -> int:
    """A 32-bit seed of what identifies the data, by its UTF-16 units."""
    raw = "|".join(map(str, parts)).encode("utf-16-le", "surrogatepass")
    h = FNV_OFFSET
    for low, high in zip(raw[::2], raw[1::2]):
        h = (h ^ (low | high << 8)) * FNV_PRIME & _MASK
    return h


def seed_from_sql(text: str) -> str:
    """The same of a DuckDB string of the joined parts, without characters beyond 16 bits."""
    return f"list_reduce(list_transform(string_split({text}, ''), lambda c: unicode(c)::HUGEINT), lambda h, c: (xor(h, c) * {FNV_PRIME}) & {_MASK}, {FNV_OFFSET}::HUGEINT)"


def uniform(seed: int, positions: np.ndarray) -> np.ndarray:
    """The numbers at these positions (from 0) of a seed's stream, from 0 to below 1."""
    mask = np.uint64(_MASK)
    state = (np.uint64(seed & _MASK) + (np.asarray(positions).astype(np.uint64) + np.uint64(1)) * np.uint64(STEP)) & mask
    x = (state ^ (state >> np.uint64(15))) * (state | np.uint64(1)) & mask
    x ^= (x + ((x ^ (x >> np.uint64(7))) * (x | np.uint64(61)) & mask)) & mask
    return (x ^ (x >> np.uint64(14))).astype(np.float64) / 2**32


def uniform_sql(seed: str, position: str) -> str:
    """The same for DuckDB, as nested expressions of HUGEINT."""
    state = f"((({seed})::HUGEINT + (({position})::HUGEINT + 1) * {STEP}) & {_MASK})"
    one = f"list_transform([{state}], lambda s: (xor(s, s >> 15) * (s | 1)) & {_MASK})"
    two = f"list_transform({one}, lambda x: xor(x, (x + ((xor(x, x >> 7) * (x | 61)) & {_MASK})) & {_MASK}))"
    return f"(list_transform({two}, lambda x: xor(x, x >> 14)::DOUBLE / 4294967296.0)[1])"
