"""Queries of splits, unions and assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import stablerand as R
from millrace.operators import split, stats
from millrace.plans.base import GEN_SQL, gen, pick_sql, query, table


def _keyed(spark, sf_dir) -> DataFrame:
    return gen(spark, sf_dir).withColumn("cat_lang", F.concat_ws("_", "category_key", "lang_key"))


_KEYED = f"{GEN_SQL}, keyed AS (SELECT *, concat_ws('_', category_key, lang_key) AS cat_lang FROM gen)"


def _split_sql(sizes: tuple[int, int, int], over: list[str], full: list[str], reserve: int, salt: str) -> str:
    a, b, c = sizes
    o, f = ", ".join(f"'{x}'" for x in over), ", ".join(f"'{x}'" for x in full)
    k = f"md5(concat_ws(':', '{salt}', id))"
    return f"""WITH {_KEYED}, r AS (SELECT *, cat_lang = 'chart_plotly' AND id % 13 <> 0 AS res FROM keyed),
p AS (SELECT *, row_number() OVER (PARTITION BY cat_lang ORDER BY {k}) AS p, count(*) OVER (PARTITION BY cat_lang) AS n,
  row_number() OVER (PARTITION BY cat_lang ORDER BY md5(concat_ws(':', '{salt}again', id))) AS q, res AND row_number() OVER (PARTITION BY cat_lang, res ORDER BY {k}) <= {reserve} AS held FROM r),
s AS (SELECT *, row_number() OVER (PARTITION BY cat_lang, held ORDER BY {k}) AS s FROM p)
SELECT id, cat_lang, 1 AS bucket FROM s WHERE cat_lang IN ({o}) AND p <= {a} UNION ALL SELECT id, cat_lang, 2 FROM s WHERE cat_lang IN ({o}) AND p > n - {b}
UNION ALL SELECT id, cat_lang, 3 FROM s WHERE cat_lang IN ({o}) AND q <= {c} UNION ALL SELECT id, cat_lang, unnest([1, 2, 3]) FROM s WHERE cat_lang IN ({f})
UNION ALL SELECT id, cat_lang, CASE WHEN held THEN 4 WHEN s <= {a} THEN 1 WHEN s <= {a + b} THEN 2 WHEN s <= {a + b + c} THEN 3 ELSE 4 END FROM s WHERE cat_lang NOT IN ({o}, {f})"""


#: Quotas of the stand-in, a hundredth of the real ones (4000, 1000, 1000 and 2000 each); they stay parameters.
_QA, _PS = (20, 8, 8), (12, 12, 12)
_OVER_QA, _FULL_QA = ["quantum_qasm", "mol_smiles"], ["dna_vienna", "chess_fen"]
_OVER_PS, _FULL_PS = ["quantum_qasm", "mol_smiles", "dna_vienna"], ["chess_fen"]


def _split(spark, sf_dir, sizes, over, full, reserve, salt) -> DataFrame:
    rows = _keyed(spark, sf_dir)
    reserved = (F.col("cat_lang") == "chart_plotly") & (F.col("id") % 13 != 0)
    return split.quota_split(rows, "cat_lang", "id", sizes, over, full, reserved, reserve, salt).select("id", "cat_lang", "bucket")


@query(_split_sql(_QA, _OVER_QA, _FULL_QA, 10, "qa"))
def split_qa(spark, sf_dir) -> DataFrame:
    return _split(spark, sf_dir, _QA, _OVER_QA, _FULL_QA, 10, "qa")


@query(_split_sql(_PS, _OVER_PS, _FULL_PS, 10, "ps"))
def split_ps(spark, sf_dir) -> DataFrame:
    return _split(spark, sf_dir, _PS, _OVER_PS, _FULL_PS, 10, "ps")


_N = 12


@query(
    f"""WITH {_KEYED}, rest AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY cat_lang) AS cnt FROM keyed WHERE id % 3 <> 0 WINDOW w AS (PARTITION BY cat_lang ORDER BY md5(concat_ws(':', 'struct', id)))),
plain AS (SELECT *, row_number() OVER (PARTITION BY cat_lang ORDER BY md5(concat_ws(':', 'struct', id))) AS rn FROM keyed WHERE id % 3 = 0), have AS (SELECT cat_lang, count(*) AS cnt FROM rest GROUP BY 1),
first AS (SELECT cat_lang, id, (CASE WHEN cnt > {3 * _N} THEN CASE WHEN rn <= {3 * _N} THEN (rn - 1) // {_N} + 1 END ELSE least((rn - 1) // greatest(cnt // 3, 1), 2) + 1 END)::INTEGER AS bucket, 'rest' AS pool FROM rest),
need AS (SELECT p.cat_lang, p.id, p.rn, coalesce(cnt, 0) AS cnt, unnest([1, 2, 3]) AS bucket FROM plain p LEFT JOIN have h ON p.cat_lang = h.cat_lang WHERE coalesce(cnt, 0) <= {3 * _N})
SELECT * FROM first WHERE bucket IS NOT NULL UNION ALL SELECT cat_lang, id, bucket, 'plain' FROM need WHERE rn <= {_N} - CASE WHEN bucket < 3 THEN cnt // 3 ELSE cnt - 2 * (cnt // 3) END"""
)
def split_struct(spark, sf_dir) -> DataFrame:
    rows = _keyed(spark, sf_dir)
    return split.thirds(rows.where("id % 3 = 0"), rows.where("id % 3 <> 0"), "cat_lang", "id", _N, "struct")


@query(f"WITH {_KEYED} SELECT cat_lang, bool_or(id % 2 = 0) AS in_a, bool_or(id % 2 <> 0 OR id % 5 = 0) AS in_b FROM keyed GROUP BY cat_lang")
def split_setops(spark, sf_dir) -> DataFrame:
    rows = _keyed(spark, sf_dir)
    a, b = rows.where("id % 2 = 0").select("cat_lang").distinct(), rows.where("id % 2 <> 0 OR id % 5 = 0").select("cat_lang").distinct()
    keys = a.union(b).distinct()
    only_b = keys.exceptAll(a).withColumn("not_a", F.lit(True))
    return keys.join(only_b, "cat_lang", "left").join(b.withColumn("b", F.lit(True)), "cat_lang", "left").select("cat_lang", F.col("not_a").isNull().alias("in_a"), F.coalesce("b", F.lit(False)).alias("in_b"))


@query(f"WITH {_KEYED} SELECT id, coalesce(json_extract(statistics, '$.node_types')::VARCHAR <> '{{}}', false) AS has_nodes FROM keyed WHERE category_key IN ('chart', 'table')")
def split_chart_branch(spark, sf_dir) -> DataFrame:
    nodes = F.from_json("statistics", "node_types map<string,string>")["node_types"]
    return _keyed(spark, sf_dir).where(F.col("category_key").isin("chart", "table")).select("id", F.coalesce(F.size(nodes) > 0, F.lit(False)).alias("has_nodes"))


_TRAIN = """train AS (
  SELECT concat('p', doc_id) AS id, CASE WHEN doc_id % 2 = 0 THEN 'qa_problem' ELSE 'qa_detail' END AS type, 'problem' AS user, md5(text) AS assistant, source AS category_key, lang AS domain, 'low' AS difficulty FROM documents
  UNION ALL SELECT concat('b', item_id), 'description', 'describe', md5(text), 'benchmark', '', 'medium' FROM benchmark
  UNION ALL SELECT concat('c', conv_id, '_', turn), 'captioning', role, md5(text), 'chat', '', 'high' FROM conversations)"""


def _train(spark, sf_dir) -> DataFrame:
    def part(df, id_, kind, user, category, domain, difficulty):
        return df.select(id_.alias("id"), kind.alias("type"), user.alias("user"), F.md5("text").alias("assistant"), category.alias("category_key"), domain.alias("domain"), F.lit(difficulty).alias("difficulty"))

    d, b, c = (table(spark, sf_dir, t) for t in ("documents", "benchmark", "conversations"))
    parts = [
        part(d, F.concat(F.lit("p"), F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 2 == 0, "qa_problem").otherwise("qa_detail"), F.lit("problem"), F.col("source"), F.col("lang"), "low"),
        part(b, F.concat(F.lit("b"), F.col("item_id").cast("string")), F.lit("description"), F.lit("describe"), F.lit("benchmark"), F.lit(""), "medium"),
        part(c, F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")), F.lit("captioning"), F.col("role"), F.lit("chat"), F.lit(""), "high"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {_TRAIN} SELECT * FROM train")
def assemble_union(spark, sf_dir) -> DataFrame:
    return _train(spark, sf_dir)


@query(f"WITH {_TRAIN} SELECT id, type, CASE WHEN row_number() OVER (PARTITION BY type ORDER BY md5(concat_ws(':', '42', id))) <= count(*) OVER (PARTITION BY type) // 2 THEN 1 ELSE 2 END AS half FROM train")
def assemble_halves(spark, sf_dir) -> DataFrame:
    return split.halves(_train(spark, sf_dir).withColumn("k", R.key("42", F.col("id"))), "k", "type").select("id", "type", "half")


@query(
    f"""WITH {_TRAIN} SELECT 'total' AS key, '' AS value, count(*) AS n FROM train UNION ALL SELECT 'type', type, count(*) FROM train GROUP BY type
UNION ALL SELECT 'difficulty', difficulty, count(*) FROM train GROUP BY difficulty UNION ALL SELECT 'domain', domain, count(*) FROM train GROUP BY domain UNION ALL SELECT 'category_key', category_key, count(*) FROM train GROUP BY category_key"""
)
def assembled_stats(spark, sf_dir) -> DataFrame:
    return stats.counts_by(_train(spark, sf_dir), ["type", "difficulty", "domain", "category_key"])


@query(f"WITH {GEN_SQL} SELECT id, concat('Code:', chr(10), '```', lang_key, chr(10), code, chr(10), '```') AS assistant FROM gen WHERE {pick_sql(2, "concat_ws(':', 'code', id)")} = 0")
def code_translate_rows(spark, sf_dir) -> DataFrame:
    rows = gen(spark, sf_dir).where(R.pick(2, "code", F.col("id")) == 0)
    return rows.select("id", F.concat(F.lit("Code:\n```"), "lang_key", F.lit("\n"), "code", F.lit("\n```")).alias("assistant"))


@query("SELECT doc_id, md5(concat_ws(':', '42', doc_id)) AS place FROM documents")
def seeded_shuffle(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.key("42", F.col("doc_id")).alias("place")).orderBy("place")
