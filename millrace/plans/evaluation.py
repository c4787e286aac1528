"""Queries of evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import constants as K
from millrace.functions import text as X
from millrace.functions.molecules import molecule
from millrace.operators import evaluate, stats
from millrace.plans.base import GEN_SQL, gen, query, table
from millrace.sources import io

_CHARS = ", ".join(f"'{x}'" for x in K.CHARACTER_LANGUAGES)
_SIZED = rf"""{GEN_SQL}, sized AS (SELECT *, CASE WHEN lang_key IN ({_CHARS}) THEN length(regexp_replace(code, '^\s+|\s+$', '', 'g')) ELSE len(list_filter(string_split(code, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')) END AS size,
  len(list_filter(string_split_regex(code, '\s+'), lambda x: x <> '')) AS description, height > 0 AND id % 6 <> 0 AS image FROM gen)"""


def _sized(spark, sf_dir) -> DataFrame:
    rows = gen(spark, sf_dir)
    return rows.withColumns({"size": evaluate.code_size(F.col("lang_key"), F.col("code")), "description": X.word_count(F.col("code")), "image": (F.col("height") > 0) & (F.col("id") % 6 != 0)})


_MEASURES = """count(*) AS n, trunc(coalesce(avg(description) FILTER (description > 0), 0))::INTEGER AS description_mean, trunc(coalesce(avg(size) FILTER (size > 0), 0))::INTEGER AS code_mean,
  count(*) FILTER (size <= 0) AS no_code, sum(image::INTEGER)::BIGINT AS images, round(avg(image::INTEGER), 4) AS image_mean"""


def _measures() -> list:
    return [c.alias(k) for k, c in evaluate.measures(F.col("description"), F.col("size"), F.col("image")).items()]


@query(f"WITH {_SIZED} SELECT id, size::INTEGER AS size FROM sized")
def code_size_by_lang(spark, sf_dir) -> DataFrame:
    return _sized(spark, sf_dir).select("id", F.col("size").cast("int").alias("size"))


@query(f"WITH {_SIZED} SELECT {_MEASURES} FROM sized")
def codegen_overall(spark, sf_dir) -> DataFrame:
    return _sized(spark, sf_dir).agg(*_measures())


@query(f"WITH {_SIZED} SELECT complexity, category_key, lang_key, {_MEASURES} FROM sized WHERE lang_key <> 'hmm' GROUP BY 1, 2, 3")
def codegen_group_stats(spark, sf_dir) -> DataFrame:
    rows = _sized(spark, sf_dir).where(F.col("complexity").isin(*K.COMPLEXITIES) & (F.col("lang_key") != "hmm"))
    return rows.groupBy("complexity", "category_key", "lang_key").agg(*_measures())


@query(f"WITH {_SIZED} SELECT concat_ws('_', category_key, lang_key) AS cat_lang, round(avg(image::INTEGER), 4) AS mean FROM sized GROUP BY 1")
def codegen_lang_mean(spark, sf_dir) -> DataFrame:
    return _sized(spark, sf_dir).groupBy(F.concat_ws("_", "category_key", "lang_key").alias("cat_lang")).agg(F.round(F.avg(F.col("image").cast("int")), 4).alias("mean"))


@query(f"WITH {_SIZED} SELECT lang_key, count(*)::VARCHAR AS n, replace(printf('%.4f', avg(size)::DOUBLE), '.', ',') AS size FROM sized GROUP BY 1")
def codegen_report_rows(spark, sf_dir) -> DataFrame:
    rows = _sized(spark, sf_dir).groupBy("lang_key").agg(F.count("*").alias("n"), F.avg("size").alias("size"))
    return rows.select(*io.report_row({"lang_key": "string", "n": "bigint", "size": "double"}))


_TRIPLES = " UNION ALL ".join(
    f"SELECT '{m}' AS measure, count(*) AS n, round(avg(t), 4) AS share FROM (SELECT unnest([(m > l * (1 + 0.1::DOUBLE))::INTEGER, (h > m * (1 + 0.1::DOUBLE))::INTEGER, (h > l * (1 + 0.1::DOUBLE))::INTEGER]) AS t FROM (SELECT id_compl, max({m}) FILTER (complexity = 'low') AS l, max({m}) FILTER (complexity = 'medium') AS m, max({m}) FILTER (complexity = 'high') AS h FROM sized GROUP BY 1) WHERE l > 0 AND m > 0 AND h > 0)"
    for m in ("description", "size")
)


@query(f"WITH {_SIZED} {_TRIPLES}")
def complexity_monotone(spark, sf_dir) -> DataFrame:
    return evaluate.monotone(_sized(spark, sf_dir), "id_compl", "complexity", ["description", "size"])


_TEST = """test AS (SELECT item_id, (['qa', 'count', 'choice'])[1 + item_id % 3] AS type, (['low', 'medium', 'high'])[1 + item_id % 3] AS difficulty, concat('cat', item_id % 4) AS category_key,
  CASE WHEN item_id % 4 = 0 THEN false WHEN item_id % 5 = 0 THEN true ELSE item_id % 2 = 0 END AS correct, item_id % 7 = 0 AS not_stop FROM benchmark)"""


@query(
    f"""WITH {_TEST}, m AS (SELECT 'total' AS key, '' AS value, * FROM test UNION ALL SELECT 'type', type, * FROM test UNION ALL SELECT 'category_key', category_key, * FROM test UNION ALL SELECT 'difficulty', difficulty, * FROM test)
SELECT key, value, count(*) AS n, sum(correct::INTEGER)::BIGINT AS right_, round(avg(correct::INTEGER), 4) AS share, count(*) FILTER (not_stop) AS cut FROM m GROUP BY 1, 2"""
)
def testset_accuracy(spark, sf_dir) -> DataFrame:
    i = F.col("item_id")
    gold = F.concat(F.lit("Item"), i.cast("string"), F.lit("."))
    said = F.when(i % 4 == 0, F.lit("Answer: wrong) item")).when(i % 5 == 0, F.concat(F.lit("it is item"), i.cast("string"), F.lit("."))).when(i % 2 == 0, F.concat(F.lit("Because.\nAnswer: item"), i.cast("string"), F.lit(".: more\nrest"))).otherwise("Answer: no")
    rows = table(spark, sf_dir, "benchmark").select(
        F.element_at(F.array(*map(F.lit, ["qa", "count", "choice"])), (i % 3).cast("int") + 1).alias("type"),
        F.element_at(F.array(*map(F.lit, K.COMPLEXITIES)), (i % 3).cast("int") + 1).alias("difficulty"),
        F.concat(F.lit("cat"), (i % 4).cast("string")).alias("category_key"),
        evaluate.answer_correct(said, gold).cast("int").alias("ok"),
        (i % 7 == 0).alias("not_stop"),
    )
    return stats.counts_by(rows, ["type", "category_key", "difficulty"], right_=F.sum("ok"), share=F.round(F.avg("ok"), 4), cut=F.count_if("not_stop"))


@query(
    r"""SELECT p_partkey, len(regexp_extract_all(p_name, '\[[^\]]+\]|Cl|Br|[BCNOPSFIbcnops]'))::INTEGER AS atoms, (len(regexp_extract_all(regexp_replace(concat(p_name, p_size), '\[[^\]]+\]', '', 'g'), '%[0-9]{2}|[0-9]')) // 2)::BIGINT AS rings FROM part"""
)
def smiles_atom_counts(spark, sf_dir) -> DataFrame:
    notation = F.concat("p_name", F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", evaluate.atoms(F.col("p_name")).alias("atoms"), evaluate.rings(notation).alias("rings"))


@query(
    """SELECT p_partkey, (1 + p_size % 7 + p_partkey % 2 + 6 * (p_partkey % 3 = 0)::INTEGER + 10 * (p_partkey % 4 = 0)::INTEGER)::INTEGER AS atoms, ((p_partkey % 3 = 0)::INTEGER + 2 * (p_partkey % 4 = 0)::INTEGER)::INTEGER AS rings, (p_partkey % 2)::INTEGER AS nitrogen
FROM part WHERE p_partkey % 11 <> 0 UNION ALL SELECT p_partkey, NULL, NULL, NULL FROM part WHERE p_partkey % 11 = 0"""
)
def molecule_counts(spark, sf_dir) -> DataFrame:
    # a chain, a branch, a benzene and two fused rings, as the part's numbers say; every eleventh has an open ring
    k = F.col("p_partkey")
    pieces = [F.repeat(F.lit("C"), (1 + F.col("p_size") % 7).cast("int")), F.when(k % 2 == 1, "(=[NH2+])").otherwise(""), F.when(k % 3 == 0, "c1ccccc1").otherwise(""), F.when(k % 4 == 0, ".c1ccc%12ccccc%12c1").otherwise(""), F.when(k % 11 == 0, ".C7").otherwise("")]
    seen = table(spark, sf_dir, "part").select(k, molecule(F.concat(*pieces)).alias("m"))
    return seen.select(k, "m.atoms", "m.rings", F.when(F.col("m.atoms").isNotNull(), F.coalesce(F.col("m.elements")["N"], F.lit(0))).alias("nitrogen"))
