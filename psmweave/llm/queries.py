"""One registered query per operator, each over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psmweave.llm import (
    decontaminate,
    exact,
    extract,
    kneser_ney,
    linededup,
    middle,
    pii,
    quality,
    search,
    sentences,
    simhash,
    tokencount,
    toxicity,
)
from psmweave.llm.store import bound_batches
from psmweave.runtime import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            bound_batches(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), l AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)),
         lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5
), r AS (
  SELECT doc_id, i,
         count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS n
  FROM g
), c AS (
  SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words
  FROM r, (SELECT unnest(range(0, 5)) AS o) WHERE n > 1 GROUP BY doc_id
), m AS (
  SELECT d.doc_id, d.text, d.w,
         len(d.w)::BIGINT AS n_words,
         length(array_to_string(d.w, ''))::BIGINT AS word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l.lines) - len(list_distinct(l.lines)))::BIGINT AS n_dup_lines,
         len(l.lines) AS n_lines,
         coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR 5 * n_symbols > n_words
            OR 2 * len(list_filter(w, lambda x: suffix(x, '!'))) > n_words
            OR 2 * length(regexp_replace(text, '[^0-9]', '', 'g')) > word_chars
            OR 2 * n_dup_lines > n_lines) AS kept
FROM m
"""


@query("op10_quality_rules", QUALITY_SQL)
def _quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf, "documents"))


@query("op9_benchmark_decontamination")
def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op5_simhash_near_dedup")
def _near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op6_sentencepiece")
def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.round_trip(table(spark, sf, "documents"))


@query("op7_token_counts")
def _token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf, "documents"))


@query("op8_line_dedup")
def _lines(spark: SparkSession, sf: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf, "documents"))
    return done.select(
        F.col("__row.doc_id").alias("doc_id"), F.col("kept_text").alias("text"), "n_deleted", "emptied"
    )


@query("op1_pii")
def _personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digest(pii.extract(table(spark, sf, "documents")))


@query("op2_kneser_ney")
def _language_model(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = kneser_ney.held_out(F.col("doc_id"))
    model = kneser_ney.train(docs.filter(~out))
    scores = kneser_ney.score(docs, model)
    return scores.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op3_html_main_text")
def _main_text(spark: SparkSession, sf: str) -> DataFrame:
    return extract.main_text(table(spark, sf, "pages"))


@query("op4_toxicity")
def _toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels")
    out = toxicity.held_out(F.col("doc_id"))
    model = toxicity.train(docs, labels.filter(~out))
    return toxicity.score(docs, *model).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


SEARCH_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), q AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark
), c AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0
), w AS (
  SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(terms) AS term FROM q) GROUP BY ALL
), p AS (
  SELECT d, doc_id, n, term, count(*) AS tf
  FROM (SELECT d, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) GROUP BY ALL
), f AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM p, c GROUP BY term, n_docs
), s AS (
  SELECT q, item_id, d, doc_id,
    sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM w JOIN f USING (term) JOIN p USING (term), c GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""


@query("op11_ranked_search", SEARCH_SQL)
def _search(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


MIDDLE_SQL = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
    list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), k, 8))::UBIGINT) AS h
  FROM documents
), c AS (
  SELECT doc_id, text, n, least(h[1] % (n + 1), h[2] % (n + 1))::BIGINT AS a, greatest(h[1] % (n + 1), h[2] % (n + 1))::BIGINT AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90
      THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), o AS (
  SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM c
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM o
"""


@query("op12_fill_in_middle", MIDDLE_SQL)
def _fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    return middle.digest(middle.transform(table(spark, sf, "documents")))


EXACT_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(text) AS text_sha256
FROM t JOIN g USING (text)
"""


@query("op13_exact_dedup", EXACT_SQL)
def _exact(spark: SparkSession, sf: str) -> DataFrame:
    return exact.mark_duplicates(table(spark, sf, "documents"))
