"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import decontaminate, html_text, infill, langid, ngram_join, quality, rabitq, sharding, substring_dedup, token_count, toxicity, unigram, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose 4-word shingle sets have Jaccard similarity 0.85 or more, as components."""
    found = ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), words=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal row counts, equal texts together where a shard can hold them."""
    out = sharding.assign(_table(spark, sf_dir, "documents"), shards=40)
    none = F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", none)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that occurred before and, within lines, without repeated sentences from 20 words or 100 characters on."""
    return substring_dedup.dedup(_table(spark, sf_dir, "documents"), least_words=20, every_line=True, least_chars=100)


def vocabulary(name: str) -> str:
    """The place of a vocabulary file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by byte_bpe_50k.json."""
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by a byte convolutional network learnt from four folds of five."""
    return langid.identify(_table(spark, sf_dir, "documents")).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside an occurrence of 10 consecutive words of a benchmark item."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings for each one whose vec_id is divisible by 20."""
    return rabitq.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from confirmed toxic and unlabelled texts."""
    found = toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram pieces of every document by piece_bpe_32k.model, and whether they decode to its text."""
    return unigram.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model")).select("doc_id", "n_pieces", "piece_ids", "decodes")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by boosted trees learnt from four folds of five."""
    found = quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every usable embedding."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), most=32)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle moved to the end, and the text restored from that, as digests."""
    out = infill.transform(_table(spark, sf_dir, "documents"), seed=1, unit="char", share=90, spm=20)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(), 256).alias("restored_sha256"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_sharding": op2_sharding,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_html_extraction": op6_html_extraction,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_toxicity": op9_toxicity,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_quality": op11_quality,
    "op12_whitening": op12_whitening,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w
), c AS (
  SELECT min(doc_id) AS class_id, any_value(s) AS s, len(any_value(s)) AS n, list_sort(s) AS k FROM s WHERE len(s) > 0 GROUP BY list_sort(s)
), t AS (
  SELECT class_id, n, unnest(s) AS g FROM c
), link AS (
  SELECT a.class_id AS a, b.class_id AS b FROM t a JOIN t b ON a.g = b.g AND a.class_id < b.class_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85
  GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(a, b) AS (
  SELECT DISTINCT a, a FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a
), comp AS (
  SELECT a AS class_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(comp.component_id, c.class_id, s.doc_id) AS component_id, coalesce(c.class_id, s.doc_id) AS class_id
FROM s LEFT JOIN c ON list_sort(s.s) = c.k LEFT JOIN comp ON comp.class_id = c.class_id
""",
    "op7_benchmark_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0
), iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p+n-1], ' ') AS g FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM i)
), dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p+n-1], ' ') AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, item_id, p, dw.n FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g
), pos AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
""",
    "op13_fill_in_middle": r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id::VARCHAR) AS h FROM documents
), k AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
    CASE WHEN n = 0 OR h IS NULL OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), c AS (
  SELECT *, substring(t, 1, least(a, b)) AS p, substring(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m, substring(t, greatest(a, b) + 1) AS s FROM k
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN least(a, b) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
""",
}
