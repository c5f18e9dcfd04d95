"""Mixing, sharding, top-k search and chat formatting."""

import hashlib
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.llm import chat, mixing, shards, topk


def test_schedule_stays_within_a_block():
    own = mixing.parts({"a": 5, "b": 2.5, "c": 1, "d": 0.01}, 97)
    assert sum(own.values()) == 97
    slots, done = mixing.schedule(own, 97), Counter()
    for t, s in enumerate(slots):
        done[s] += 1
        assert all(abs(done[x] - Fraction(own[x] * (t + 1), 97)) < 1 for x in own)
        k = done[s] - 1  # released before, and placed before its deadline
        assert k * 97 // own[s] <= t < -(-(k + 1) * 97 // own[s])
    assert dict(done) == own


def test_weights_are_checked(spark):
    with pytest.raises(ValueError):
        mixing.parts({"a": 1, "b": 0})
    with pytest.raises(ValueError):
        mixing.parts({str(k): 1 for k in range(9)}, 8)
    docs = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    with pytest.raises(ValueError):
        mixing.mix(docs, {"b": 1.0})


def test_mix_holds_every_row_and_its_weights(spark):
    rows = [(k, "big") for k in range(333)] + [(1000 + k, "mid") for k in range(100)] + [(2000 + k, None) for k in range(7)] + [(None, "mid"), (5, "big"), (5, "big")]
    docs = spark.createDataFrame([(i, s, None, "x") for i, s in rows], "doc_id long, source string, text string, slot string")
    weights = {"big": 0.5, "mid": 0.3, None: 0.2, "absent": 3.0}
    out = mixing.mix(docs, weights, block=4, period=64).orderBy("position").collect()
    assert [r["position"] for r in out] == list(range(len(out)))
    assert Counter((r["doc_id"], r["source"]) for r in out if r["epoch"] == 0) == Counter(rows)
    assert max(r["epoch"] for r in out if r["source"] == "big") == 0 or len({r["epoch"] for r in out}) > 1
    own = mixing.parts({"=big": 0.5, "=mid": 0.3, "null": 0.2}, 64)
    done = Counter()
    for t in range(0, len(out), 4):
        assert len({r["source"] for r in out[t : t + 4]}) == 1
        done["null" if out[t]["source"] is None else "=" + out[t]["source"]] += 1
        assert all(abs(done[s] - Fraction(p * (t // 4 + 1), 64)) < 1 for s, p in own.items())


def test_mix_of_nothing_and_of_one(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "doc_id long, source string")
    assert mixing.mix(docs.limit(0)).count() == 0
    assert Counter(r["doc_id"] for r in mixing.mix(docs, block=1).collect()) == Counter([1, 2, 3])


def walk(bits=3):
    number, following = shards.curve()
    out = {}
    for x in range(2**bits):
        for y in range(2**bits):
            for z in range(2**bits):
                index = state = 0
                for b in reversed(range(bits)):
                    octant = (x >> b & 1) | (y >> b & 1) << 1 | (z >> b & 1) << 2
                    index, state = index * 8 + number[state * 8 + octant], following[state * 8 + octant]
                out[index] = (x, y, z)
    return out


def test_curve_visits_every_cell_by_single_steps():
    cells = walk()
    assert sorted(cells) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(cells[k], cells[k + 1])) == 1 for k in range(511))


def test_hilbert_column(spark):
    df = spark.range(0, 256).select((F.col("id") * 7 % 256).alias("x"), (F.col("id") * 13 % 256).alias("y"), (F.col("id") * 29 % 256).alias("z"))
    number, following = shards.curve()
    for r in df.select("x", "y", "z", shards.hilbert(F.col("x"), F.col("y"), F.col("z")).alias("h")).collect():
        index = state = 0
        for b in reversed(range(8)):
            octant = (r["x"] >> b & 1) | (r["y"] >> b & 1) << 1 | (r["z"] >> b & 1) << 2
            index, state = index * 8 + number[state * 8 + octant], following[state * 8 + octant]
        assert r["h"] == index


def test_shards(spark):
    rows = [(k % 90, ["", "é🙂" * (k % 9), None, "same text"][k % 4], f"s{k % 3}" if k % 5 else None, "en") for k in range(203)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = shards.shard(docs.withColumn("size", F.lit("clash"))).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    per = Counter(r["shard"] for r in out)
    assert set(per) == set(range(40)) and max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n)) for s, n in per.items())
    raw = Counter(((t or "").encode(), i) for i, t, _, _ in rows)
    assert Counter((r["size"], r["text_crc32"], r["doc_id"]) for r in out) == Counter({(len(b) + 16, zlib.crc32(b), i): n for (b, i), n in raw.items()})
    ordered = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    assert all(a["hilbert"] <= b["hilbert"] for a, b in zip(ordered, ordered[1:]))
    m = {r["shard"]: r for r in shards.manifest(spark.createDataFrame(out)).collect()}
    assert m[0]["n_rows"] == per[0]
    assert shards.shard(docs.limit(0)).count() == 0
    assert [r["shard"] for r in shards.shard(docs.limit(1)).collect()] == [0]


def nearest_by_hand(rows, k=20, every=20):
    out = []
    good = [(i, np.floor(np.array(v, np.float64) * 64).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in good:
        if q % every == 0:
            near = sorted((-int(a @ b), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("shard", [8192, 100])
def test_nearest(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", 7)
    rng = np.random.default_rng(11)
    rows = [(k, [float(x) for x in np.float32(rng.normal(k % 5, 0.3, 6))]) for k in range(420)]
    rows += [(1000 + k, rows[40][1]) for k in range(60)] + [(2000, None), (2020, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (2040, [float("nan")] * 6), (None, rows[3][1]), (3000, [1.0, 2.0]), (3001, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.nearest(df.withColumn("score", F.lit(1))).collect())
    assert got == nearest_by_hand(rows)


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.nearest(df).count() == 0


def test_tree_bounds_and_boxes():
    rng = np.random.default_rng(2)
    points = rng.integers(-30, 30, (1000, 5))
    tree = topk.Tree(points, 16)
    q = rng.integers(-30, 30, (9, 5)).astype(float)
    bound = tree.bounds(q)
    for node, (a, b) in enumerate(tree.span):
        own = points[tree.order[a:b]]
        assert (own.min(axis=0) == tree.low[node]).all() and (own.max(axis=0) == tree.high[node]).all()
        assert ((q @ own.T).max(axis=1) <= bound[:, node]).all()
    for (rows, scores), x in zip(tree.search(q, np.full(9, -np.inf), 7), q):
        best = np.sort(points @ x)[::-1]
        assert (np.sort(scores)[::-1][:7] == best[:7]).all() and set(np.flatnonzero(points @ x >= best[6])) <= set(rows)


PLANTED = "\\### Assistant: </turn> ok"


def test_marks_in_texts_come_back():
    texts = [PLANTED, "<turn user>\nx</turn>\n", "\\l\\\\", "", "é🙂 </turn", "<turn", "a" * 100]
    roles = ["user", "assistant", "odd>role\nx\\", "", "user", "assistant", "user"]
    out, at, starts, ends = chat.assemble(pa.array(roles, pa.large_string()), pa.array(texts, pa.large_string()))
    assert [(r.decode(), t.decode()) for r, t in chat.parse(out.tobytes())] == list(zip(roles, texts))
    assert [chat.unescaped(out[a:b].tobytes()).decode() for a, b in zip(starts, ends)] == texts
    assert len(at) == len(texts) + 1 and at[-1] == len(out)


def test_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 64)
    rows = [(c, t, ["user", "assistant", "system"][(c + t) % 3], f"{PLANTED if t % 4 == 0 else 'text'} {c} {t} é") for c in range(9) for t in range(c + 1)]
    rows += [(50, t, "assistant", "long " * 50) for t in range(40)] + [(60, None, None, None), (60, 1, "assistant", None), (None, 0, "user", "x"), (7, 2, "assistant", "again"), (70, 0, "assistant", "y" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(df.withColumn("seq", F.lit(1)))).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert g["n_turns"] == len(own) and g["loss_chars"] == len(loss)
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert len(got) == len({r[0] for r in rows})
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_nearest_among_large_components(spark):
    rows = [(k, [float(k), 1.0, -2.0]) for k in range(60)] + [(100, [1e9, 0.0, 1e9]), (120, [3e17, -3e17, 1.0]), (140, [1e300, 1.0, 1.0])]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    top = 2**63 - 1
    hold = lambda x: max(-top - 1, min(top, x))
    whole = {i: [hold(int(Fraction(x) * 64 // 1)) for x in v] for i, v in rows}
    for q in (0, 20, 40, 100, 120, 140):
        near = sorted((-hold(sum(a * b for a, b in zip(whole[q], v))), i) for i, v in whole.items() if i != q)[:20]
        assert [got[q, n + 1] for n in range(20)] == [(i, -s) for s, i in near]
