"""Registry of queries and the stand-in tables that they run on, each with the same definition in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import constants as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Pairs of the stand-in: all admitted ones and three that aren't.
PAIRS = [(c, x) for c, langs in K.ALLOWED.items() for x in langs] + [("usecase", "puml"), ("neural", "nn_keras"), ("state", "scxml")]


def _literal(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


GEN_SQL = f"""
gen AS (
    SELECT doc_id AS id, ({_literal([c for c, _ in PAIRS])})[1 + doc_id % {len(PAIRS)}] AS category_key,
           ({_literal([x for _, x in PAIRS])})[1 + doc_id % {len(PAIRS)}] AS lang_key,
           (['low', 'medium', 'high'])[1 + doc_id % 3] AS complexity, doc_id // 3 AS id_compl, text AS code,
           n_chars AS width, CASE WHEN doc_id % 50 = 7 THEN 0 ELSE 1 + (doc_id * 37) % 1999 END AS height,
           CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'length' ELSE 'stop' END AS finish_reason,
           CASE WHEN doc_id % 13 = 0 THEN '{{"node_types":{{}}}}' WHEN doc_id % {len(PAIRS)} = {PAIRS.index(('neural', 'nn_onnx_graph'))} THEN concat('{{"node_types":{{"op_types":{{"nodes":', n_chars % 40, ',"sequences":', doc_id % 5, '}}}}}}')
                ELSE concat('{{"node_types":{{"nodes":', n_chars % 40, ',"edges":', doc_id % 17, ',"sequences":', doc_id % 5, ',"start_events":1}}}}') END AS statistics
    FROM documents
)"""


def gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in of rendered generations."""
    d, n = F.col("doc_id"), len(PAIRS)
    at = (d % n).cast("int") + 1
    nested = PAIRS.index(("neural", "nn_onnx_graph"))
    cats, langs = F.array(*(F.lit(c) for c, _ in PAIRS)), F.array(*(F.lit(x) for _, x in PAIRS))
    nodes = F.concat(F.lit('"nodes":'), (F.col("n_chars") % 40).cast("string"))
    sequences = F.concat(F.lit(',"sequences":'), (d % 5).cast("string"))
    stats = (
        F.when(d % 13 == 0, '{"node_types":{}}')
        .when(d % n == nested, F.concat(F.lit('{"node_types":{"op_types":{'), nodes, sequences, F.lit("}}}")))
        .otherwise(F.concat(F.lit('{"node_types":{'), nodes, F.lit(',"edges":'), (d % 17).cast("string"), sequences, F.lit(',"start_events":1}}')))
    )
    return table(spark, sf_dir, "documents").select(
        d.alias("id"),
        F.element_at(cats, at).alias("category_key"),
        F.element_at(langs, at).alias("lang_key"),
        F.element_at(F.array(*map(F.lit, K.COMPLEXITIES)), (d % 3).cast("int") + 1).alias("complexity"),
        F.floor(d / 3).alias("id_compl"),
        F.col("text").alias("code"),
        F.col("n_chars").alias("width"),
        F.when(d % 50 == 7, 0).otherwise(1 + (d * 37) % 1999).alias("height"),
        F.when(d % 11 == 0, None).when(d % 7 == 0, "length").otherwise("stop").alias("finish_reason"),
        stats.alias("statistics"),
    )


#: In SQL: a stable draw from 0 to n - 1.
def pick_sql(n, key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT % {n})"


#: In SQL: links (a, b) of documents whose sets of words have a similarity of at least 0.9, and ``last.gone``, what greedy removal in order of ids drops.
JACCARD_SQL = r"""tok AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS w FROM documents) WHERE w <> ''),
sz AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM tok a JOIN tok b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b, k::DOUBLE / (x.n + y.n - k) AS j, x.n = k AND y.n = k AS same FROM p JOIN sz x ON p.a = x.doc_id JOIN sz y ON p.b = y.doc_id WHERE 10 * k >= 9 * (x.n + y.n - k))"""
GREEDY_SQL = f"""{JACCARD_SQL},
later AS MATERIALIZED (SELECT b AS x, list(a) AS smaller, row_number() OVER (ORDER BY b) AS i FROM links GROUP BY b),
step AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS gone UNION ALL SELECT later.i, CASE WHEN len(list_filter(smaller, lambda y: NOT list_contains(gone, y))) > 0 THEN list_append(gone, x) ELSE gone END FROM step JOIN later ON later.i = step.i + 1),
last AS MATERIALIZED (SELECT arg_max(gone, i) AS gone FROM step)"""
