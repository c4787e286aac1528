"""Queries of question building."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import constants as K
from millrace.functions import templates as T
from millrace.operators import filters, qa
from millrace.plans.base import GEN_SQL, gen, pick_sql, query, table


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(items) + "]"


def _fill(template: str, **values: str) -> str:
    """concat(...) of a template's parts."""
    parts, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [_text(head), values[name]]
    return f"concat({', '.join([*parts, _text(rest)])})"


def _worded(templates: list[str], salt: str, keys: str, **values: str) -> str:
    return f"({_list(_fill(t, **values) for t in templates)})[1 + {pick_sql(len(templates), f"concat_ws(':', '{salt}', {keys})")}]"


def _terse(keys: str) -> str:
    return f"{pick_sql(3, f"concat_ws(':', 'terse', {keys})")} = 0"


_TEMPLATES = "tmpl AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {_list(map(_text, v))})" for k, v in T.STRUCTURAL.items()) + ") AS t(k, asked))"


@query(
    f"""WITH {GEN_SQL}, {_TEMPLATES}, n AS (SELECT id, category_key, lang_key, CASE WHEN lang_key IN ({', '.join(map(_text, K.BY_CATEGORY))}) THEN category_key ELSE lang_key END AS raw,
  CASE WHEN lang_key = 'nn_onnx_graph' AND json_extract(statistics, '$.node_types.op_types') IS NOT NULL THEN json_extract(statistics, '$.node_types.op_types') ELSE json_extract(statistics, '$.node_types') END AS j FROM gen),
e AS (SELECT id, category_key, lang_key, raw, unnest(json_keys(j)) AS subject, j FROM n),
q AS (SELECT id, category_key, subject, (j->>subject)::BIGINT AS gold_answer, CASE WHEN subject = 'sequences' AND lang_key = 'fasta' THEN 'fasta_seq' WHEN raw IN ({', '.join(map(_text, K.UML_KEYS))}) THEN 'uml' ELSE raw END AS k FROM e),
d AS (SELECT q.*, gold_answer::VARCHAR AS cnt, asked[1 + {pick_sql('len(asked)', "concat_ws(':', 'template', id, subject)")}] AS t, {_terse('id, subject')} AS terse FROM q JOIN tmpl ON q.k = tmpl.k WHERE gold_answer > 0 AND subject NOT IN ({', '.join(map(_text, K.SILENT_NODES))}))
SELECT id, subject, gold_answer, concat(replace(CASE WHEN category_key IN ('chart', 'table') THEN replace(t, 'diagram', category_key) ELSE t END, '{{component}}', subject), CASE WHEN terse THEN {_text(T.COUNT_FORMAT)} ELSE '' END) AS "user",
  CASE WHEN terse THEN cnt ELSE {_worded(T.ANSWERS['structural'], 'said', 'id, subject', cnt='cnt', component='subject')} END AS assistant,
  row_number() OVER (PARTITION BY id ORDER BY md5(concat_ws(':', 'one', id, subject))) = 1 AS chosen FROM d"""
)
def structural_questions(spark, sf_dir) -> DataFrame:
    rows = gen(spark, sf_dir).withColumn("nodes", filters.node_counts(F.col("statistics"), F.col("lang_key")))
    return qa.node_questions(rows, "nodes", "id")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_BASE = f"""contrary AS (SELECT a.n_name AS category, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey <> b.n_regionkey),
excluded AS (SELECT n_name AS other, ({_list(map(_text, _SEGMENTS))})[1 + n_nationkey % 5] AS domain FROM nation),
rows_ AS (SELECT c_custkey AS id, n_name AS category, concat(n_name, 's') AS name, c_name AS value, c_mktsegment AS domain FROM customer JOIN nation ON c_nationkey = n_nationkey),
numbered AS (SELECT category, value, row_number() OVER (PARTITION BY category ORDER BY md5(concat_ws(':', 'pool', value))) - 1 AS pos FROM (SELECT DISTINCT category, value FROM rows_)),
sizes AS (SELECT category, count(*) AS size FROM numbered GROUP BY 1)"""


def _base(spark, sf_dir):
    """(rows, contrary, pool, excluded) of the stand-in: customers as personas, nations as categories."""
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_name").alias("category"), F.col("n_regionkey").alias("r")), n.select(F.col("n_name").alias("other"), F.col("n_regionkey").alias("s"))
    contrary = a.join(F.broadcast(b), F.col("r") != F.col("s")).select("category", "other")  # the category catalogue
    excluded = n.select(F.col("n_name").alias("other"), F.element_at(F.array(*map(F.lit, _SEGMENTS)), (F.col("n_nationkey") % 5).cast("int") + 1).alias("domain"))
    joined = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = joined.select(F.col("c_custkey").alias("id"), F.col("n_name").alias("category"), F.concat("n_name", F.lit("s")).alias("name"), F.col("c_name").alias("value"), F.col("c_mktsegment").alias("domain"))
    return rows, contrary, rows.select("category", "value"), excluded


def _variants_sql(kinds, salt: str, need: str, twice: int = 0) -> str:
    n = len(kinds)
    each = ", ".join(f"({i}, {gold}, {hard})" for i, (gold, hard) in enumerate(kinds))
    return f"base AS (SELECT r.*, variant, gold, hard, {need} AS need, variant = draw % {n} AS chosen FROM (SELECT *, {pick_sql(n + twice, f"concat_ws(':', '{salt}', id)")} AS draw FROM rows_) r CROSS JOIN (VALUES {each}) AS v(variant, gold, hard))"


def _options_sql(salt: str, exclude: bool) -> str:
    mine = "id, variant"
    anti = "AND NOT EXISTS (SELECT 1 FROM excluded x WHERE x.other = c.other AND x.domain = r.domain)" if exclude else ""
    return f"""ranked AS (SELECT r.id, r.variant, r.value, r.need, r.hard, c.other, s.size, row_number() OVER (PARTITION BY r.id, r.variant ORDER BY md5(concat_ws(':', '{salt}', r.id, r.variant, c.other))) AS rank FROM base r JOIN contrary c ON r.category = c.category JOIN sizes s ON s.category = c.other WHERE r.need > 0 {anti}),
drawn AS (SELECT id, variant, value, need, other, size, rank FROM ranked WHERE rank <= need - hard::INTEGER UNION ALL SELECT id, variant, value, need, r.category, size, need FROM base r JOIN sizes s ON r.category = s.category WHERE hard AND need > 0),
tries AS (SELECT *, ({pick_sql('size', f"concat_ws(':', '{salt}at', {mine}, other)")} + t) % size AS pos FROM (SELECT *, unnest([0, 1]) AS t FROM drawn)),
found AS (SELECT {mine}, rank, need, arg_min(m.value, t) AS option FROM tries JOIN numbered m ON tries.other = m.category AND tries.pos = m.pos WHERE m.value <> tries.value GROUP BY {mine}, rank, need),
opts AS (SELECT {mine}, list(option ORDER BY md5(concat_ws(':', '{salt}mix', {mine}, option))) AS options FROM found GROUP BY {mine}, need HAVING count(*) = need)"""


def _association_sql(subject: str, kinds, exclude: bool) -> str:
    keys = f"'{subject}', id, variant"
    values = {"answer": "gold_answer", "subject": f"'{subject}'", "category": "category"}
    layout = _fill(T.ASSOCIATION, question=_worded(T.QUESTIONS[subject], "asked", keys), format=f"CASE WHEN terse THEN {_text(T.LETTER_FORMAT)} ELSE '' END", **{x: f"options[{i + 1}]" for i, x in enumerate("abcd")})
    return f"""WITH {_BASE}, {_variants_sql(kinds, subject, "CASE WHEN gold THEN 3 ELSE 4 END")}, {_options_sql(subject, exclude)},
p AS (SELECT b.id, b.variant, b.category, b.value, b.gold, b.hard, b.chosen, o.options, {pick_sql(4, f"concat_ws(':', 'place', '{subject}', b.id, b.variant)")} AS place FROM base b JOIN opts o ON b.id = o.id AND b.variant = o.variant),
q AS (SELECT id, variant, category, gold, hard, chosen, {_terse(keys)} AS terse, CASE WHEN gold THEN list_concat(list_concat(options[:place], [value]), options[place + 1:]) ELSE options END AS options,
  CASE WHEN gold THEN place ELSE -1 END::INTEGER AS answer_idx, CASE WHEN gold THEN (['A', 'B', 'C', 'D'])[1 + place] ELSE 'NONE' END AS gold_answer FROM p)
SELECT id, variant, {layout} AS "user", CASE WHEN terse THEN CASE WHEN gold THEN gold_answer ELSE 'None' END WHEN gold THEN {_worded(T.ANSWERS['association'], 'said', keys, **values)} ELSE {_worded(T.ANSWERS['none'], 'said', keys, **values)} END AS assistant,
  CASE WHEN NOT hard THEN 'low' WHEN gold THEN 'medium' ELSE 'high' END AS difficulty, '{subject}' AS subject, array_to_string(options, '|') AS options, answer_idx, gold_answer, chosen FROM q"""


def _listed(df: DataFrame) -> DataFrame:
    return df.withColumn("options", F.array_join("options", "|"))


@query(_association_sql("persona", qa.PERSONA, True))
def association_questions(spark, sf_dir) -> DataFrame:
    """Personas: with and without the right one; categories that exclude the row's domain give no options."""
    rows, contrary, pool, excluded = _base(spark, sf_dir)
    return _listed(qa.association(qa.variants(rows, qa.PERSONA, False, "persona"), contrary, pool, "persona", excluded))


@query(_association_sql("caption", qa.CAPTION, False))
def association_captions(spark, sf_dir) -> DataFrame:
    """Captions: with and without the right one, easy and hard."""
    rows, contrary, pool, _ = _base(spark, sf_dir)
    return _listed(qa.association(qa.variants(rows, qa.CAPTION, False, "caption"), contrary, pool, "caption"))


def _consistency_sql(subject: str) -> str:
    keys = f"'{subject}', id, variant"
    layout = _fill(T.CONSISTENCY, question=_worded(T.QUESTIONS[subject], "asked", keys), subject=f"'{subject.capitalize()}'", text="shown", format=f"CASE WHEN terse THEN {_text(T.WORD_FORMAT)} ELSE '' END")
    said = _worded(T.ANSWERS["consistency"], "said", keys, answer="gold_answer", subject=f"'{subject}'", neg="CASE WHEN gold THEN '' ELSE 'not ' END", category="category")
    return f"""WITH {_BASE}, {_variants_sql(qa.CONSISTENCY, subject, "CASE WHEN gold THEN 0 ELSE 1 END", 2)}, {_options_sql(subject, False)},
q AS (SELECT b.id, b.variant, b.category, b.gold, b.hard, b.chosen, CASE WHEN gold THEN b.value ELSE o.options[1] END AS shown, CASE WHEN gold THEN 'Yes' ELSE 'No' END AS gold_answer, {_terse(f"'{subject}', b.id, b.variant")} AS terse FROM base b LEFT JOIN opts o ON b.id = o.id AND b.variant = o.variant)
SELECT id, variant, {layout} AS "user", CASE WHEN terse THEN gold_answer ELSE {said} END AS assistant, CASE WHEN hard THEN 'high' ELSE 'low' END AS difficulty, '{subject}' AS subject, shown AS options, gold::INTEGER AS answer_idx, gold_answer, chosen FROM q WHERE shown IS NOT NULL"""


@query(_consistency_sql("problem"))
def consistency_questions(spark, sf_dir) -> DataFrame:
    """Problems: the right one, one of a contrary category, another of the same category; the first two count twice in the choice."""
    rows, contrary, pool, _ = _base(spark, sf_dir)
    return _listed(qa.consistency(qa.variants(rows, qa.CONSISTENCY, False, "problem", 2), contrary, pool, "problem"))


@query(_consistency_sql("description"))
def consistency_descriptions(spark, sf_dir) -> DataFrame:
    """Descriptions, in the same variants."""
    rows, contrary, pool, _ = _base(spark, sf_dir)
    return _listed(qa.consistency(qa.variants(rows, qa.CONSISTENCY, False, "description", 2), contrary, pool, "description"))
