"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.common import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.suffix import repeats

    return repeats(_table(spark, sf_dir, "documents"), span=50)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.secrets import report

    return report(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op6_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.wordbpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_uniform_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.topk import top_products

    return top_products(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.huffman import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80).drop("row_hash")


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP10_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
h AS (SELECT doc_id, md5_number(string_agg(s, chr(10) ORDER BY s)) AS h FROM s GROUP BY doc_id),
r AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS r FROM h),
f AS (SELECT s.* FROM s JOIN r ON s.doc_id = r.doc_id AND r.r = r.doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM f a JOIN f b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
      UNION SELECT r, doc_id FROM r WHERE r <> doc_id),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT c.doc_id, g.b FROM c JOIN g ON g.a = c.reached)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reached) AS c FROM c GROUP BY doc_id) m USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op8_uniform_threshold_topk": OP8_SQL, "op10_hyperminhash_dedup": OP10_SQL}
