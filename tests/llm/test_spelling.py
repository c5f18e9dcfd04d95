import random
import re
import zlib
from collections import Counter

import pytest

from tracelake.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def brute(rows):
    counts = Counter()
    for id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    forms, out = {}, []
    others = {w: [x for x in counts if near(w, x)] for w in counts}
    for w, n in counts.items():
        best = min(others[w], key=lambda x: (-counts[x], x), default=None)
        if best and counts[best] >= 2 * n:
            forms[w] = best
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, n, len(others[w]), forms.get(w), counts.get(forms.get(w)), root))
    return sorted(out)


def rows_of(seed, n):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcéß") for _ in range(rnd.randint(4, 8))) for _ in range(60)] + ["Straße", "STRASSE", "kitten", "sitten", "kittens", "aaaaa", "aaaaaa", "×÷×÷×", "Éclair"]
    out = []
    for k in range(n):
        own = [rnd.choice(words) for _ in range(60)]
        own += [w[: rnd.randrange(len(w))] + rnd.choice("abxyz") + w[rnd.randrange(len(w)) :] for w in rnd.choices(words, k=8)] * rnd.randint(1, 3)
        out.append((rnd.choice([k, k, None, 3]), rnd.choice(["", " ", "1"]).join(["", *[w + rnd.choice(" .,\n-") for w in own]])))
    return out + [(1, None), (2, ""), (3, "12 34"), (4, "a" * 400 + " " + "kitten " * 300)]


def found(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n int, word string, slot string")
    return sorted(tuple(r) for r in spelling.variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_against_all_pairs(spark):
    rows = rows_of(1, 40)
    expected = brute(rows)
    assert len(expected) > 100 and any(r[3] for r in expected)
    assert found(spark, rows) == expected


def test_empty_tables(spark):
    assert found(spark, []) == [] and found(spark, [(1, "no word often enough")]) == []


@pytest.mark.parametrize("crowded", [0, 4, 10**9])
def test_crowded_chunks_lose_no_pair(spark, crowded):
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(5, 9))) for _ in range(300)})
    pairs = {(r["a"], r["b"]) for r in spelling.near(spark.createDataFrame([(w,) for w in words], "word string"), crowded).collect()}
    assert pairs == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(spelling, "STRETCH", 7)
    text = "alpha betas " * 30 + "x" * 50 + " gamma"
    assert spelling.words_of(10**12, text) == Counter(spelling.slipped(str(10**12), w) for w in text.split())


def test_chains_are_followed_to_the_end(spark):
    forms = [(f"w{k}", f"w{k + 1}") for k in range(37)] + [("x", "w36")]
    got = {r["word"]: r["root"] for r in spelling.followed(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {w: "w37" for w, _ in forms}
