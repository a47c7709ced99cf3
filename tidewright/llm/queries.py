"""The registered queries of the corpus operators: production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_extract, jaccard_join, language, license_scan, quality, secret_scan, substring_dedup, token_count
from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op3_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_licences(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op8_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents")).drop("n_linked")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), also=("url",))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: Links of 4-word shingle sets by counting shared shingles, then everything a document reaches.
OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON r.m = l.a)
SELECT doc_id, n.n AS n_shingles, (SELECT min(m) FROM r WHERE r.d = n.doc_id) AS component_id FROM n
"""
#: Every diagonal with six equal words or more, without seeds; then its best window.
OP4_SQL = r"""
WITH d AS (SELECT doc_id AS id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS t FROM documents),
b AS (SELECT item_id AS id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS t FROM benchmark),
dp AS (SELECT id, len(t) AS n, unnest(range(0, len(t))) AS i, unnest(t) AS w FROM d),
bp AS (SELECT id, len(t) AS n, unnest(range(0, len(t))) AS i, unnest(t) AS w FROM b),
g AS (SELECT dp.id AS doc, bp.id AS item, dp.i - bp.i AS shift, greatest(0, dp.i - bp.i) AS lo, least(dp.n, dp.i - bp.i + bp.n) AS hi, list(dp.i) AS equal FROM dp JOIN bp ON dp.w = bp.w GROUP BY ALL HAVING count(*) >= 6),
v AS (SELECT *, least(13, hi - lo) AS width FROM g WHERE hi - lo >= 8),
s AS (SELECT doc, item, width, equal, unnest(range(lo, hi - width + 1)) AS st FROM v),
m AS (SELECT doc, item, width, st, len(list_filter(equal, lambda p: p >= st AND p < st + width)) AS n FROM s),
x AS (SELECT doc, item, max({'n': n, 'w': width, 's': -st}) AS best FROM m WHERE n * 100 >= width * 70 GROUP BY 1, 2)
SELECT doc AS doc_id, item AS item_id, CAST(best.n AS INTEGER) AS n_matched, CAST(best.w AS INTEGER) AS n_window, CAST(-best.s AS INTEGER) AS at_word FROM x
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": OP4_SQL, "op6_jaccard_join": OP6_SQL}
