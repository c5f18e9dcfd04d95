"""The queries over the smallest tables, beside plain Python."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tests.llm.test_simhash import by_hand, grouped
from tests.llm.test_text_operators import PATTERNS, spans_by_hand, vector
from tracelake.llm import langid, mixing, quality, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1_is_the_schedule_walked_by_hand(spark, docs):
    out = sorted(rows(spark, "op1_mixing"), key=lambda r: r["position"])
    assert [r["position"] for r in out] == list(range(len(out)))
    sizes = Counter("null" if s is None else f"={s}" for *_, s in docs)
    own = mixing.exact({n: float(c) ** mixing.POWER for n, c in sizes.items()})
    total, names, done, order, t = sum(own.values()), sorted(own), dict.fromkeys(own, 0), [], 0
    while any(done[n] * mixing.BLOCK < sizes[n] for n in names):
        ready = [n for n in names if done[n] * total // own[n] <= t]
        best = min(ready, key=lambda n: (-(-(done[n] + 1) * total // own[n]), n))
        order.append(best)
        done[best] += 1
        t += 1
        assert all(abs(done[n] - Fraction(own[n] * t, total)) < 1 for n in names)
    slots = defaultdict(set)
    for r in out:
        slots[r["slot"]].add("null" if r["source"] is None else f"={r['source']}")
    assert [slots[k] for k in range(len(order))] == [{n} for n in order]
    assert Counter((r["doc_id"], r["source"]) for r in out if r["epoch"] == 0) == Counter((i, s) for i, _, _, s in docs)


def test_op2_is_the_library(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = set()
    for i, t, *_ in docs:
        ids = library.encode(t or "")
        want.add((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")))
    assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(spark, "op2_pieces")} == want


def test_op3_goes_by_the_nearest_centroid(spark, docs):
    found = {r["doc_id"]: r for r in rows(spark, "op3_language")}
    held = {i for i, *_ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, r in found.items() if r["held_out"]} == held and set(found) == {d[0] for d in docs}
    taught = [(t, l) for i, t, l, _ in docs if i not in held and l is not None]
    vectors = [langid.counts(t) for t, _ in taught]
    seen = np.sum([v > 0 for v in vectors if v is not None], axis=0)
    model = langid.train(spark.createDataFrame([(k, t, l) for k, (t, l) in enumerate(taught)], "doc_id long, text string, lang string"))
    assert np.allclose(model.idf, np.log((1 + sum(v is not None for v in vectors)) / (1 + seen)) + 1)
    right = []
    for i, t, lang, _ in docs:
        r = found[i]
        if not t or not any(map(str.isalpha, t)):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        x = np.log1p(langid.counts(t)) * model.idf
        like = [float(x @ c) / np.linalg.norm(x) for c in model.centroids]
        assert r["score"] == pytest.approx(max(like), abs=1e-2) and 0 <= r["score"] <= 1
        if i in held and lang:
            right.append(r["lang_pred"] == lang)
    assert np.mean(right) > 0.95


def test_op3_numbers_are_no_letters():
    assert all(langid.counts(x) is None for x in ("½", "²", "①", "Ⅷ", "12 !?")) and langid.counts("ß1") is not None


def test_op3_sample_holds_no_repeats(spark):
    docs = spark.createDataFrame([(None, f"text {k % 3} of the few", "en") for k in range(6000)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == ["en"] and 1 <= len(model.centroids) <= 3


def test_op4_edits_and_digests(spark, docs):
    found = {r["doc_id"]: r for r in rows(spark, "op4_fingerprints")}
    order = sorted(docs, key=lambda d: -d[0])
    for (i, t, *_), (_, following, *_) in zip(order, [*order[1:], order[0]]):
        t, following = t or "", following or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + following[:k]
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited)) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert r["fingerprint"] == vector(t) and r["edited_fingerprint"] == vector(edited)
        assert (t != edited) or r["near_edited"] == 1


def test_op5_scores_every_document(spark, docs):
    found = {r["doc_id"]: r for r in rows(spark, "op5_quality")}
    assert set(found) == {d[0] for d in docs} and all(0 <= r["quality_score"] <= 1 and r["good"] == (r["quality_score"] >= 0.5) for r in found.values())


def test_op6_slots_and_sizes(spark, docs):
    out = rows(spark, "op6_shards")
    raw = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == raw and {r["law"] for r in out} == {"rows"}
    per = defaultdict(list)
    for r in out:
        per[r["shard"]].append(r["slot"])
    assert set(per) == set(range(40)) and all(sorted(x) == list(range(len(x))) for x in per.values()) and max(map(len, per.values())) - min(map(len, per.values())) <= 1


def test_op8_digests(spark, docs):
    found = {r["doc_id"]: r for r in rows(spark, "op8_secrets")}
    for i, t, *_ in docs:
        base = sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(PATTERNS) for m in p.finditer(t or "") if len(m[g]) >= least)
        names = [PATTERNS[k][0] for _, k, _ in base]
        r = found[i]
        assert r["base_sha256"] == sha(",".join(f"{n}:{a}:{b}" for n, (a, _, b) in zip(names, base))) and r["spans"] == spans_by_hand(t or "")
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(names.count(n) for n in ("assign", "access", "hex"))


def test_op10_prints_and_components(spark, docs):
    found = {r["doc_id"]: r for r in rows(spark, "op10_simhash")}
    prints = {i: by_hand(t) for i, t, *_ in docs}
    assert {i: r["fingerprint"] for i, r in found.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in found.items()} == grouped(sorted(prints.items()))
