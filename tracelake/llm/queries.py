"""Queries of the operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import audit, chat, fingerprints, langid, mixing, pieces, quality, secrets, shards, simhash, spelling, topk, vectors
from tracelake.llm.common import row_of_file, table


def model_path() -> str:
    """The public piece model that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs.select("doc_id", "source", row_of_file(docs).alias("row")), row="row")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = pieces.encode_documents(docs, model_path(), keep=["doc_id"], decoded="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.fold(F.col("doc_id")) == 0
    model = langid.train(docs.where(~held))
    found = langid.identify(docs.select("doc_id", "text", held.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.with_following(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = rows.withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_print", fingerprints.fingerprint(F.col("edited")))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.written(F.col("print")).alias("fingerprint"),
        fingerprints.written(F.col("edited_print")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        fingerprints.likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "quality_score", "good")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.shard(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def of(kind: str):
        return F.filter("spans", lambda x: x["kind"] == kind)

    base = F.filter("spans", lambda x: x["kind_no"] < len(secrets.KINDS))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(secrets.said(base), 256).alias("base_sha256"),
        secrets.said(F.col("spans")).alias("spans"),
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_turns(turns))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_pieces, op3_language, op4_fingerprints, op5_quality, op6_shards, op7_topk, op8_secrets, op9_chat, op10_simhash, op11_vectors, op12_spelling, op13_audit)}

#: Escaped lengths follow the template of chat.py.
_OP9 = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), sized AS (
  SELECT *, 6 + length(replace(replace(replace(role, '\\', '\\\\'), '>', '\\g'), chr(10), '\\n')) + 2
    + length(replace(replace(replace(text, '\\', '\\\\'), '<turn ', '\\lturn '), '</turn>', '\\l/turn>')) + 8 AS n
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
) WHERE rank <= 20
"""

_OP11 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b
), least AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY 1), counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN counted USING (vec_id)
"""

#: The CRC of a string by its table of 256 values, which the query works out; levenshtein() counts bytes, so
#: letters beyond ASCII stand for other bytes there.
_BEYOND = "".join(map(chr, range(0xC0, 0x100)))
_BYTES = "".join(c for c in map(chr, range(33, 127)) if not c.islower() and c != "'")[:64]
_OP12 = f"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc_table
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), per AS (SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hex FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT run, k, xor(list_reduce(list_transform(range(length(hex) // 2), lambda i: ('0x' || hex[2 * i + 1 : 2 * i + 2])::BIGINT), lambda c, x: xor(c >> 8, crc_table[xor(c & 255, x) + 1]), 4294967295), 4294967295) AS h FROM per, crc
), words AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3
), said AS MATERIALIZED (SELECT word, n, length(word) AS size, translate(word, '{_BEYOND}', '{_BYTES}') AS bytes FROM words
), near AS MATERIALIZED (
  SELECT a.word AS word, b.word AS other, b.n AS m FROM said a JOIN said b ON b.size BETWEEN a.size - 1 AND a.size + 1 AND a.word <> b.word AND levenshtein(a.bytes, b.bytes) = 1
), best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word
), forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL SELECT chain.word, forms.form, step + 1 FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NOT NULL
), roots AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

_WORDS = r"[^\x20\x09-\x0D]+"
_OP13 = rf"""
WITH letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)),
first AS (SELECT coalesce(text, '') AS text, min(doc_id) AS doc_id FROM documents GROUP BY 1),
found AS (
  SELECT d.doc_id, coalesce(source, '') AS part, coalesce(d.text, '') AS text, f.doc_id AS first, regexp_extract_all(coalesce(d.text, ''), '{_WORDS}') AS words
  FROM documents d JOIN first f ON f.text = coalesce(d.text, '')
), masked AS (
  SELECT doc_id, part, (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > first THEN 16 ELSE 0 END) AS mask FROM found
), marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1
), cells AS MATERIALIZED (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM masked LEFT JOIN marks USING (doc_id) GROUP BY 1, 2
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[: step - 1]), 0)::BIGINT AS before FROM orders, range(1, 6) AS s(step)
), counted AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM counted
"""

ORACLE_SQL = {"op7_topk": _OP7, "op9_chat": _OP9, "op11_vectors": _OP11, "op12_spelling": _OP12, "op13_audit": _OP13}
