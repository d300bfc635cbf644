"""Registered queries of the numbered operators, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_ngram_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.jaccard_join import jaccard_components
    return jaccard_components(table(spark, sf_dir, "documents"))


def tokenizer() -> tuple[dict[bytes, int], str]:
    """Ranks and pattern that operator 9 is registered with."""
    import public_tokenizers
    from quarry.llm.byte_bpe import read_ranks
    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.byte_bpe import token_digests
    return token_digests(table(spark, sf_dir, "documents"), *tokenizer())


@query("op10_html_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.html_text import extract
    return extract(table(spark, sf_dir, "pages"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(concat_ws('|', '11', coalesce(CAST(doc_id AS VARCHAR), ''))) AS key
  FROM documents),
s AS (
  SELECT source, sum(size) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, max(level) OVER () * w) AS target FROM l),
q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT q.size, (upto + k * source_size) / target AS finish FROM q, (VALUES (0), (1)) AS v(k) WHERE size > 0),
r AS (
  SELECT finish, sum(sum(size)) OVER (ORDER BY finish) AS upto FROM c GROUP BY finish),
e AS (SELECT max(finish) AS last FROM r WHERE upto <= (SELECT sum(size) FROM c) * 0.75)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (
         CASE WHEN upto / target <= last THEN 1 ELSE 0 END
         + CASE WHEN (upto + source_size) / target <= last THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM q, e
"""


@query("op5_mix_sources", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.mixing import plan
    from quarry.llm.storage import Stage
    return plan(table(spark, sf_dir, "documents"), Stage(spark, "mix")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.toxicity import scores
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.secrets import secret_spans
    return secret_spans(table(spark, sf_dir, "documents"))


@query("op7_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.fingerprints import fingerprints
    return fingerprints(table(spark, sf_dir, "documents"))


@query("op4_hnsw_neighbours")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.hnsw import nearest
    return nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


@query("op2_tool_call_linking")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.tool_calls import TOOLS, derived, format_chat
    return format_chat(derived(table(spark, sf_dir, "conversations")), TOOLS)


@query("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.licenses import license_scan
    return license_scan(table(spark, sf_dir, "documents"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.periodic_runs import periodic_runs
    return periodic_runs(table(spark, sf_dir, "documents"), edit=True)


OP13_SQL = """
WITH r AS (
  SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
a AS (SELECT vec_id, min({'label': label, 'v': v}) AS a FROM r WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.a.label AS same,
         CAST(list_inner_product(a.a.v, r.v) AS BIGINT) AS score
  FROM a JOIN r ON r.vec_id <> a.vec_id AND len(r.v) = len(a.a.v)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id, positive_score ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 5
"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.hard_negatives import hard_negatives
    return hard_negatives(table(spark, sf_dir, "embeddings"))


@query("op11_personal_data")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.personal_data import personal_spans
    return personal_spans(table(spark, sf_dir, "documents"))
