"""The queries of this package and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, hard_negatives, html_text, licenses, lm_score, minhash, mixing
from . import packing, quality, ranked_search, simhash, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op1_exact_dedup",
    r"""
    WITH t AS (
      SELECT doc_id, length(coalesce(text, '')) AS size,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
      FROM documents),
    r AS (
      SELECT *, row_number() OVER w AS place,
             first_value(doc_id) OVER w AS keep_id,
             count(*) OVER (PARTITION BY body) AS group_size
      FROM t WINDOW w AS (PARTITION BY body ORDER BY size DESC, doc_id NULLS LAST))
    SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM r
    """,
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


@query("op2_quality")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


@query("op3_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


@query("op4_mixing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select(
        "doc_id", "source", "mix_weight", "mix_repeats", "mix_epoch", "mix_block", "mix_order"
    )


@query("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


@query(
    "op6_top_k",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding,
                                    lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, d.vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT)
               AS score
      FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id),
    r AS (
      SELECT query_id, CAST(row_number() OVER
               (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
             vec_id, score
      FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))


@query("op7_simhash")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op8_lm_score")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.language_scores(table(spark, folder, "documents"))


@query("op9_html_text")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(table(spark, folder, "pages"))


@query("op10_licenses", licenses.oracle_sql())
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


@query(
    "op11_ranked_search",
    r"""
    WITH words AS (
      SELECT doc_id, row_number() OVER () AS place,
             regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
      FROM documents WHERE text IS NOT NULL),
    d AS (SELECT * FROM words WHERE len(terms) > 0),
    total AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d),
    tf AS (
      SELECT place, doc_id, len(terms) AS size, term, count(*) AS tf
      FROM (SELECT place, doc_id, terms, unnest(terms) AS term FROM d) GROUP BY ALL),
    q AS (
      SELECT item_id, term, count(*) AS times
      FROM (SELECT item_id, unnest(regexp_extract_all(
              translate(min(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark GROUP BY item_id)
      GROUP BY ALL),
    w AS (
      SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(n) + 2) / (2 * count(*) + 1)))::BIGINT AS w
      FROM tf, total WHERE term IN (SELECT term FROM q) GROUP BY term),
    s AS (
      SELECT item_id, place, doc_id,
             sum(times * w * ((1000000000 * tf)
                 // (1000 * tf + 8 * (25 + (75 * size * n) // l))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term), total GROUP BY item_id, place, doc_id),
    r AS (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)
                AS rank
      FROM s WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.ranked_search(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


@query(
    "op12_minhash",
    r"""
    WITH RECURSIVE words AS (
      SELECT row_number() OVER () AS place, doc_id,
             regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM documents),
    sets AS (
      SELECT place, doc_id, CASE
               WHEN len(w) < 2 THEN w
               ELSE list_distinct(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2]))
             END AS s
      FROM words),
    class AS (SELECT list_sort(s) AS s, min(place) AS c FROM sets WHERE len(s) > 0 GROUP BY 1),
    one AS (SELECT c, len(s) AS n, unnest(s) AS x FROM class),
    pair AS (
      SELECT a.c AS a, b.c AS b FROM one a JOIN one b
        ON a.x = b.x AND a.c < b.c AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
      GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
    reach AS (
      SELECT c AS a, c AS b FROM class
      UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
    root AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
    named AS (
      SELECT place, doc_id, len(sets.s) AS n, root
      FROM sets LEFT JOIN class ON list_sort(sets.s) = class.s LEFT JOIN root ON root.a = class.c),
    done AS (
      SELECT doc_id, n, CASE WHEN n = 0 THEN doc_id
                             ELSE min(doc_id) OVER (PARTITION BY root) END AS component_id
      FROM named)
    SELECT doc_id, n AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
    FROM done
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.minhash_components(table(spark, folder, "documents"))


@query(
    "op13_hard_negatives",
    """
    WITH t AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding,
                            lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same,
             CAST(list_sum(list_transform(list_zip(a.v, d.v), lambda p: p[1] * p[2])) AS BIGINT)
               AS score
      FROM t a JOIN t d ON a.vec_id % 100 = 0 AND d.vec_id <> a.vec_id),
    p AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score
      FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (
      SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id
                                     ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
        AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    FROM n WHERE rank <= 5
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved))
