import re
from collections import Counter
from itertools import permutations

import numpy as np

from tracelake.llm import audit


def fails(rows):
    """(part, the letters that fail) of each row (doc_id, text, source)."""
    out = []
    for id, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        out.append((source or "", own + "E" * any(id is not None and i is not None and i < id and (t or "") == text for i, t, _ in rows)))
    return out


def brute(rows, labels):
    out, found = [], fails(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    for part in sorted({p for p, _ in found}):
        own = [(r[0], f) for r, (p, f) in zip(rows, found) if p == part]
        removed_by, steps = Counter(), []
        for order in permutations("ABCDE"):
            left, gone = own, set()
            for k, letter in enumerate(order, 1):
                removed = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                removed_by[letter] += len(removed)
                redundant = sum(letter in f for _, f in own) - len(removed)
                steps.append((part, "".join(order), k, len(left), len(removed), redundant, sum(f == letter for _, f in own), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed), letter))
        out += [(*s[:-1], removed_by[s[-1]]) for s in steps]
    return sorted(out)


ROWS = [
    (1, "plain words " * 20 + " ".join(f"w{k}" for k in range(80)), "a"), (2, "short", "a"), (3, "short", "b"), (4, None, None), (5, "", ""), (None, "short", "b"), (None, None, "c"),
    (6, "SHOUTING " * 60, "a"), (7, "x # y", "b"), (8, " ".join(f"w{k}" for k in range(80)), "b"), (9, " ".join(f"w{k}" for k in range(80)), "a"), (9, " ".join(f"w{k}" for k in range(80)), "a"),
    (10, "a\x0bb\x0cc d e", "é"), (11, "long " * 40_000 + "$", "é"), (12, "ÀÉ" * 10, "a"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (6, None, 1), (9, 1, None), (None, 1, 1), (77, 1, 1)]


def found(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x", "y", 3) for r in rows], "doc_id long, text string, source string, mask int, part string, same string, n long")
    marks = spark.createDataFrame([(*r, "q") for r in labels], "doc_id long, quality int, toxic int, part string")
    return audit.audit(docs, marks)


def test_against_counting_each_order(spark):
    got = found(spark, ROWS, LABELS)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute(ROWS, LABELS)


def test_empty_tables(spark):
    assert found(spark, [], LABELS).collect() == []
    assert sorted(map(tuple, found(spark, ROWS[:3], []).collect())) == brute(ROWS[:3], [])


def test_walk_against_sums():
    cells = np.random.default_rng(2).integers(0, 9, (3, 4, 32))
    masks = np.arange(32)
    got = audit.states(cells)
    for active in range(32):
        assert (got[..., active] == cells[..., masks & active == 0].sum(axis=-1)).all()
