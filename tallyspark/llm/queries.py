"""Registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.contamination import find_leaks
from tallyspark.llm.html_text import extract_text
from tallyspark.llm.jaccard import jaccard_components
from tallyspark.llm.language import fit_language, identify
from tallyspark.llm.licences import oracle_sql as licence_sql
from tallyspark.llm.licences import scan_licences
from tallyspark.llm.lines import dedup_lines
from tallyspark.llm.negatives import mine_negatives
from tallyspark.llm.neighbours import nearest
from tallyspark.llm.packing import pack_documents
from tallyspark.llm.phrases import mine_phrases
from tallyspark.llm.quality import fit_quality, score_quality
from tallyspark.llm.shared import remainder, table
from tallyspark.llm.substrings import dedup_substrings
from tallyspark.llm.warc import build_derivatives, responses_of_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op10_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model of the labels outside the held-out third."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    model = fit_quality(documents, labels.where(remainder(F.col("doc_id"), 3) != 1))
    return score_quality(documents, model).select(
        "document.doc_id",
        F.coalesce(remainder(F.col("document.doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(table(spark, sf_dir, "pages"))


@query
def op9_nearest_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth embedding."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under the 4-word shingle Jaccard join."""
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 13-word windows that smaller doc_ids hold."""
    return dedup_substrings(table(spark, sf_dir, "documents"), window=13).select(
        "document.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bin of every piece of every document; near copies (five words, similarity 0.8) conflict."""
    documents = table(spark, sf_dir, "documents")
    return pack_documents(documents, groups=jaccard_components(documents, words=5, percent=80))


@query
def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an exact or edited copy of a test item, and where."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("document.doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a network that learns from four fifths of the labelled ones."""
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    net = fit_language(documents.where(remainder(F.col("doc_id"), 5) != 0))
    return identify(documents.select("doc_id", held_out.alias("held_out"), "text"), net).select("document.doc_id", "document.held_out", "lang_pred", "score")


@query
def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page, taken as a response record."""
    return build_derivatives(responses_of_pages(table(spark, sf_dir, "pages")), "page_id")


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses whose notices or texts occur in a document."""
    return scan_licences(table(spark, sf_dir, "documents"))


@query
def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language."""
    return mine_phrases(table(spark, sf_dir, "documents"))


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that a smaller doc_id holds."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "document.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of five positives of every fiftieth embedding."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", shifted.alias("label"))
    return mine_negatives(rows, F.col("vec_id") % 50 == 0)


ORACLE_SQL["op3_license_scan"] = licence_sql()
_WORDS = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL["op5_ngram_jaccard"] = f"""
WITH RECURSIVE docs AS (
  SELECT DISTINCT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS sh
  FROM docs
), items AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS s FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id, doc_id AS c FROM docs UNION SELECT l.b, r.c FROM reached r JOIN links l ON r.doc_id = l.a
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM sets s JOIN reached r USING (doc_id) GROUP BY ALL
"""

ORACLE_SQL["op8_substring_dedup"] = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM docs),
windows AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS pos, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i : i + 12], ' '))) AS s
  FROM docs WHERE len(ws) >= 13
), firsts AS (SELECT s, min(doc_id) AS f FROM windows GROUP BY s),
late AS (SELECT doc_id, pos FROM windows JOIN firsts USING (s) WHERE doc_id > f),
marked AS (
  SELECT words.doc_id, words.pos, w,
    max(late.pos) OVER (PARTITION BY words.doc_id ORDER BY words.pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words LEFT JOIN late ON late.doc_id = words.doc_id AND late.pos = words.pos
), summed AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN summed USING (doc_id)
"""

ORACLE_SQL["op11_phrase_mining"] = rf"""
WITH pieces AS MATERIALIZED (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split(translate({_LOWER}, '.,;:!?' || chr(11) || chr(12) || chr(13), repeat(chr(10), 9)), chr(10))) AS piece
  FROM documents
), texts AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS MATERIALIZED (
  SELECT lang, 1 AS k, unnest(ws) AS g FROM texts
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM texts
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM texts
), f AS MATERIALIZED (SELECT lang, k, g, count(*) AS n FROM grams GROUP BY ALL),
candidates AS MATERIALIZED (SELECT lang, k, g, n, string_split(g, ' ') AS ws FROM f WHERE k > 1 AND n >= 10),
parts AS MATERIALIZED (
  SELECT lang, g, n AS a, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)
), cuts AS MATERIALIZED (
  SELECT p.lang, p.g, a, cut, x.n AS l, y.n AS r, CAST(1000000 AS HUGEINT) * a * a // (CAST(x.n AS HUGEINT) * y.n) AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.g = head JOIN f y ON y.lang = p.lang AND y.g = tail
), scored AS MATERIALIZED (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
longer AS MATERIALIZED (
  SELECT lang, pair, max(n) AS n FROM (
    SELECT lang, n, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS pair FROM candidates WHERE k = 3
  ) GROUP BY ALL
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN longer o ON o.lang = s.lang AND o.pair = s.g WHERE o.n IS NULL OR 100 * o.n < 50 * s.a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT ranked.lang, rank, g AS phrase, a, l, r, totals.n, CAST(score AS BIGINT) AS score
FROM ranked JOIN (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang) totals USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL["op12_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), judged AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

ORACLE_SQL["op13_hard_negatives"] = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
