"""The operators' registered queries over whole tables, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from .bpe import bpe_encode
from .decontaminate import contaminated
from .fill_in_middle import fill_in_middle, restore
from .language_id import identify_language
from .lexical_search import lexical_search
from .near_dedup import near_duplicates
from .piece_bpe import piece_encode
from .quality import quality
from .secret_scan import secret_spans
from .substring_dedup import remove_repeats
from .token_counts import token_counts
from .topk_search import exact_top_k
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(_table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restore(fill_in_middle(_table(spark, sf_dir, "documents")))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = piece_encode(_table(spark, sf_dir, "documents"), with_decoded=True)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_minhash_dedup": op3_minhash_dedup,
        "op4_secret_scan": op4_secret_scan,
        "op5_token_counts": op5_token_counts,
        "op6_toxicity": op6_toxicity,
        "op7_decontamination": op7_decontamination,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_exact_topk": op9_exact_topk,
        "op10_quality": op10_quality,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_piece_bpe": op12_piece_bpe,
        "op13_lexical_search": op13_lexical_search,
        "pipeline": corpus_pipeline.run,
    }


_OP3 = r"""
WITH RECURSIVE lowered AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents WHERE doc_id IS NOT NULL
), sets AS (
  SELECT doc_id, CASE WHEN words IS NULL OR len(words) = 0 THEN []::VARCHAR[]
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams
  FROM lowered
), sizes AS (SELECT doc_id, len(grams)::BIGINT AS n FROM sets),
rows AS (SELECT doc_id, hash(unnest(grams)) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM rows a JOIN rows b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT l.b, r.root FROM reach r JOIN both_ways l ON l.a = r.node
)
SELECT s.doc_id, s.n AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sizes s JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) c ON c.node = s.doc_id
"""

_OP9 = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


_OP8 = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents WHERE doc_id IS NOT NULL
), starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS i FROM split WHERE len(words) >= 13
), windows AS (
  SELECT s.doc_id, s.i, md5(array_to_string(d.words[s.i:s.i + 12], ' ')) AS w FROM starts s JOIN split d USING (doc_id)
), firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (w) WHERE first < doc_id
), gone_lists AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN words
    ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda p: NOT list_contains(gone, p[2])), lambda p: p[1]) END, ' '), '')) AS kept_sha256
FROM split d LEFT JOIN gone_lists g ON g.doc_id = d.doc_id
"""


_OP11 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t, sha256('42:' || doc_id) AS h
  FROM documents
), draws AS (
  SELECT *, len(t) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM cut
), units AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM draws
), parts AS (
  SELECT *, coalesce(array_to_string(t[1:a], ''), '') AS prefix, coalesce(array_to_string(t[a + 1:b], ''), '') AS middle, coalesce(array_to_string(t[b + 1:n], ''), '') AS suffix FROM units
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

_OP13 = r"""
WITH bags AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE doc_id IS NOT NULL
), totals AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(t)) AS BIGINT) AS big_l FROM bags WHERE len(t) > 0),
asked AS (
  SELECT item_id, term, CAST(count(*) AS BIGINT) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY 1, 2
), words AS (SELECT doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM bags),
postings AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * max(big_n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM postings, totals GROUP BY term
), scores AS (
  SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY 1, 2
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_dedup": _OP3, "op8_substring_dedup": _OP8, "op9_exact_topk": _OP9, "op11_fill_in_middle": _OP11, "op13_lexical_search": _OP13}
