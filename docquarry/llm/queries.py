"""The corpus operators' queries over the driver tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docquarry.llm import bpe, covertree, exact_dedup, jaccard, langid, packing, recompress, suffix_dedup, toxicity, wordpiece
from docquarry.session import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_table(table(spark, sf_dir, "documents"), vocabulary(), public_tokenizers.PATTERN)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_table(table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = covertree.quantised(table(spark, sf_dir, "embeddings"))
    return covertree.top_k(vectors, F.col("vec_id") % 20 == 0, 20)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.dedup_words(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.dedup_table(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.learn(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score_table(documents, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_table(table(spark, sf_dir, "documents"), vocabulary())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.learn(documents, ~langid.held_out())
    return langid.predict_table(documents, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_byte_bpe, op2_suffix_array_dedup, op3_best_fit_packing, op4_exact_top_k, op5_substring_dedup, op6_exact_dedup, op7_toxicity, op8_token_counts, op9_language_id, op10_ngram_jaccard, pipeline]
    return {f.__name__: f for f in own}


_OP2 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, length(h) // 2 AS n, unnest(range(length(h) // 2)) AS p FROM d),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS byte, CASE WHEN p + 50 <= n THEN substr(h, 2 * p + 1, 100) END AS s FROM b),
f AS (SELECT s, min(doc_id) AS first FROM w WHERE s IS NOT NULL GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT w.doc_id, w.p, w.byte, coalesce(f.first < w.doc_id, false) AS dup FROM w LEFT JOIN f ON w.s = f.s),
c AS (SELECT doc_id, p, byte, max(dup::int) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM g),
e AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), 0) AS prev FROM c),
k AS (SELECT doc_id, sum(gone) AS removed, sum((gone = 1 AND prev = 0)::int) AS spans, string_agg(byte, '' ORDER BY p) FILTER (gone = 0) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, (length(d.h) // 2)::bigint AS n_bytes, coalesce(k.removed, 0)::bigint AS n_removed, coalesce(k.spans, 0)::bigint AS n_spans,
       sha256(unhex(coalesce(k.kept, ''))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

_OP4 = """
WITH v AS (SELECT vec_id, [floor(64 * x::double) for x in embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::int AS rank, vec_id, score FROM r WHERE rank <= 20
"""

_OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT doc_id, ws, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS p FROM d),
w AS (SELECT doc_id, p, ws[p] AS word, CASE WHEN p + 19 <= n THEN array_to_string(ws[p:p + 19], ' ') END AS s FROM b),
f AS (SELECT s, min(struct_pack(d := doc_id, p := p)) AS first FROM w WHERE s IS NOT NULL GROUP BY s HAVING count(*) > 1),
g AS (SELECT w.doc_id, w.p, w.word, coalesce(f.first <> struct_pack(d := w.doc_id, p := w.p), false) AS dup FROM w LEFT JOIN f ON w.s = f.s),
c AS (SELECT doc_id, p, word, max(dup::int) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM g),
k AS (SELECT doc_id, sum(gone) AS removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::bigint AS n_words, coalesce(k.removed, 0)::bigint AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

_OP6 = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""

_OP10 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS digest FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE common >= 0.8 * (a.n + b.n - common) - 1e-9),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
low AS (SELECT x, min(y) AS y FROM r GROUP BY x),
k AS (SELECT x, count(*) AS links, count(DISTINCT m.digest) FILTER (m.digest <> o.digest) AS texts FROM l JOIN n m ON m.doc_id = y JOIN n o ON o.doc_id = x GROUP BY x)
SELECT d.doc_id, least(d.doc_id, coalesce(low.y, d.doc_id)) AS class_id, coalesce(k.links, 0)::bigint AS n_links,
       coalesce(k.texts, 0)::bigint AS n_text_links, coalesce(n.n, 0)::int AS n_shingles
FROM d LEFT JOIN low ON low.x = d.doc_id LEFT JOIN k ON k.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    own = {"op2_suffix_array_dedup": _OP2, "op4_exact_top_k": _OP4, "op5_substring_dedup": _OP5, "op6_exact_dedup": _OP6, "op10_ngram_jaccard": _OP10}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
