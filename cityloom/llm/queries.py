"""The registered queries of the training-data operators, and the SQL that some of them are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.llm import chat, exact_dedup, infill, langid, licenses, mixing, ngram_join, pieces, pii, pivots, ranked, toxicity, warc
from cityloom.llm.common import bounded_batches, documents, id_remainder
from cityloom.llm.words import WORD


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    both = pieces.decode(pieces.encode(docs)).select("doc_id", "text", "token_ids", "decoded")
    return both.select(
        "doc_id",
        F.coalesce(F.size("token_ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
        F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"),
        F.sha2(F.coalesce("decoded", F.lit("")), 256).alias("decoded_sha256"),
        "token_ids",
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = id_remainder("doc_id", 3) == 1
    net = langid.train(docs.where(~F.coalesce(held_out, F.lit(False))))
    return langid.identify(docs.select("doc_id", "text"), net).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return pivots.near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    read = chat.read_back(chat.format_conversations(table.unionByName(extra)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir).select("doc_id", "text"))

    def count(n: int):
        return F.size(F.filter("spans", lambda x: x["k"] == n)).cast("long")

    counts = [count(n).alias(f"n_{k}") for n, k in enumerate(pii.BASE)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2("base_text", 256).alias("base_sha256"), F.col("spans_text").alias("spans"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    back = warc.archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "chance")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.CompressionClassifier:
    """Learnt from the labelled rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(F.col("toxic").isNotNull() & (id_remainder("doc_id", 5) != 0))
    return toxicity.train(docs, labels)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(documents(spark, sf_dir))
    back = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        licenses.labels_of(base).alias("base_labels"), licenses.labels_of(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["strength"])), F.lit(0.0)).alias("score"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_language_id, op3_embedding_dedup, op4_exact_dedup, op5_chat_format, op6_pii, op7_warc, op8_ngram_join, op9_mixing, op10_toxicity, op11_fill_in_middle, op12_ranked_search, op13_license_scan, pipeline)}

_OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), ok AS (SELECT vec_id, e, norm FROM u WHERE norm > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), comp AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x),
deg AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id)::BIGINT AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN comp ON comp.x = vec_id LEFT JOIN deg ON deg.x = vec_id
"""

_OP4 = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256 FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def _escaped(x: str) -> str:
    out = f"replace({x}, chr(92), chr(92) || 'b')"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || 'e{c[1:]}')"
    return out


_OP5 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.TURN) + 1 + len(chat.END)} + length(replace({_escaped("role")}, chr(10), chr(92) || 'l')) + length({_escaped("text")}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_OP7 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < best THEN best END AS refers_to FROM w
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '{WORD}')"

_OP11 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), g AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g
), p AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""

_OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
k AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM k),
i AS (SELECT row_number() OVER () AS item, item_id, list_distinct({_WORDS}) AS terms FROM benchmark),
q AS (SELECT item, item_id, unnest(terms) AS term FROM i),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
f AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM s) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p GROUP BY term),
c AS (
  SELECT item, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN f USING (term) JOIN k USING (r), s GROUP BY item, item_id, r, doc_id
), o AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM c WHERE score > 0)
SELECT * FROM o WHERE rank <= 10
"""


def _op13() -> str:
    def places(phrase: str) -> str:
        return "list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split(), 1)) + ")"

    both = [*licenses.BASE, *licenses.TEMPLATES]
    met = [f"regexp_matches(j, '{licenses.pattern(t)}')" for _, t in both]
    named = lambda some: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {m} THEN '{name}' END" for m, (name, _) in some) + "], lambda x: x IS NOT NULL))), ',')"
    pairs = list(zip(met, both))
    strength = ", ".join(f"CASE WHEN {m} THEN {licenses.mandatory(t)}::DOUBLE / {licenses.mandatory(t) + 1} ELSE 0 END" for m, (_, t) in pairs)
    return f"""
WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j, list_concat({", ".join(places(t) for _, t in licenses.BASE)}) AS hits FROM t)
SELECT doc_id, len(w) AS n_words, len(hits) AS n_base, list_min(hits) AS first_word, list_max(hits) AS last_word,
  {named(pairs[: len(licenses.BASE)])} AS base_labels, {named(pairs)} AS labels, greatest({strength})::DOUBLE AS score FROM b
"""


ORACLE_SQL = {"op3_embedding_dedup": _OP3, "op4_exact_dedup": _OP4, "op5_chat_format": _OP5, "op7_warc": _OP7, "op11_fill_in_middle": _OP11, "op12_ranked_search": _OP12, "op13_license_scan": _op13()}
