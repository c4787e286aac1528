"""Queries of the quality cascade: keys, filters, statistics, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import constants as K
from millrace.functions import text as X
from millrace.operators import dedup, filters, pictures, stats
from millrace.plans.base import GEN_SQL, GREEDY_SQL, JACCARD_SQL, gen, query, table

_DOMAIN_SQL = "CASE " + " ".join("WHEN k IN (" + ", ".join(f"'{n}'" for n in names) + f") THEN '{d}'" for d, names in K.DOMAINS.items()) + " ELSE '' END"
_ALLOW_SQL = "(" + " OR ".join(f"(category_key = '{c}' AND lang_key IN (" + ", ".join(f"'{x}'" for x in langs) + "))" for c, langs in K.ALLOWED.items()) + ")"
_KEYS_SQL = f"""{GEN_SQL}, keyed AS (
    SELECT *, concat_ws('_', category_key, lang_key) AS cat_lang, concat_ws('_', category_key, lang_key, complexity) AS cat_lang_compl,
           {_DOMAIN_SQL.replace("k IN", "(CASE WHEN lang_key IN ('puml', 'mermaid') THEN category_key ELSE lang_key END) IN")} AS domain
    FROM gen
)"""
_RATIO_SQL = "CASE " + " ".join(f"WHEN category_key = '{c}' THEN {r}" for c, r in K.RATIOS.items()) + f" ELSE {K.RATIO} END"
_RATIO_OK = f"(height > 0 AND width::DOUBLE / height >= 1 / ({_RATIO_SQL})::DOUBLE AND width::DOUBLE / height <= ({_RATIO_SQL})::DOUBLE)"
_STRIP = r"regexp_replace(code, '^\s+|\s+$', '', 'g')"


@query(f"WITH {_KEYS_SQL} SELECT id, cat_lang, cat_lang_compl, domain FROM keyed")
def derive_keys(spark, sf_dir) -> DataFrame:
    return filters.with_keys(gen(spark, sf_dir)).select("id", "cat_lang", "cat_lang_compl", "domain")


@query(f"WITH {_KEYS_SQL} SELECT domain, count(*) AS n, count(DISTINCT cat_lang) AS pairs FROM keyed GROUP BY domain")
def domain_lookup(spark, sf_dir) -> DataFrame:
    return filters.with_keys(gen(spark, sf_dir)).groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("cat_lang").alias("pairs"))


@query(f"WITH {GEN_SQL} SELECT id, CASE WHEN finish_reason IS NOT DISTINCT FROM 'stop' THEN 'stop' ELSE 'not_stop' END AS side FROM gen")
def finish_split(spark, sf_dir) -> DataFrame:
    rows, stop = gen(spark, sf_dir), F.col("finish_reason").eqNullSafe(F.lit("stop"))
    return rows.where(stop).select("id", F.lit("stop").alias("side")).union(rows.where(~stop).select("id", F.lit("not_stop").alias("side")))


@query(f"WITH {GEN_SQL} SELECT id, category_key, lang_key FROM gen WHERE {_ALLOW_SQL}")
def allowlist_semi(spark, sf_dir) -> DataFrame:
    return filters.allowed(gen(spark, sf_dir)).select("id", "category_key", "lang_key")


@query(r"SELECT doc_id, source FROM documents WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''")
def nonblank(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").where(X.nonblank(F.col("text"))).select("doc_id", "source")


_NODES_SQL = f"""{GEN_SQL}, counted AS (
    SELECT *, CASE WHEN lang_key = 'nn_onnx_graph' AND json_extract(statistics, '$.node_types.op_types') IS NOT NULL
                   THEN json_extract(statistics, '$.node_types.op_types') ELSE json_extract(statistics, '$.node_types') END AS j FROM gen
), nodes AS (
    SELECT *, coalesce((j->>'nodes')::BIGINT, 0) + coalesce((j->>'edges')::BIGINT, 0) + coalesce((j->>'sequences')::BIGINT, 0) + coalesce((j->>'start_events')::BIGINT, 0) AS total,
           (j->>'nodes')::BIGINT AS n_nodes, (j->>'edges')::BIGINT AS n_edges, (j->>'sequences')::BIGINT AS n_seq, (j->>'start_events')::BIGINT AS n_start,
           j::VARCHAR = '{{}}' AS is_empty FROM counted
)"""


@query(
    f"""WITH {_NODES_SQL}, m AS (SELECT *, (['all', 'sum', 'len', 'nodes', 'gone'])[1 + id % 5] AS mode, 5 + id % 60 AS lim FROM nodes)
SELECT id, mode,
  CASE mode WHEN 'all' THEN coalesce(n_nodes, 0) <= lim AND coalesce(n_edges, 0) <= lim AND coalesce(n_seq, 0) <= lim AND coalesce(n_start, 0) <= lim
            WHEN 'sum' THEN total <= lim WHEN 'len' THEN length({_STRIP}) <= lim WHEN 'nodes' THEN coalesce(n_nodes <= lim, false) ELSE false END AS at_most,
  CASE mode WHEN 'all' THEN coalesce(n_nodes, lim) >= lim AND coalesce(n_edges, lim) >= lim AND coalesce(n_seq, lim) >= lim AND coalesce(n_start, lim) >= lim
            WHEN 'sum' THEN total >= lim WHEN 'len' THEN length({_STRIP}) >= lim WHEN 'nodes' THEN coalesce(n_nodes >= lim, false) ELSE false END AS at_least
FROM m"""
)
def check_limit_modes(spark, sf_dir) -> DataFrame:
    rows = gen(spark, sf_dir).withColumn("nodes", filters.node_counts(F.col("statistics"), F.col("lang_key")))
    mode = F.element_at(F.array(*map(F.lit, ["all", "sum", "len", "nodes", "gone"])), (F.col("id") % 5).cast("int") + 1)
    limit = (5 + F.col("id") % 60).cast("double")
    return rows.select("id", mode.alias("mode"), filters.within(F.col("nodes"), F.col("code"), mode, limit, True).alias("at_most"), filters.within(F.col("nodes"), F.col("code"), mode, limit, False).alias("at_least"))


def _limits():
    """Stand-in limits of a row, by its category."""
    c = F.col("category_key")
    return (
        F.when(c == "chess", None).when(c == "music", F.lit("len")).when(c == "dna", F.lit("nodes")).otherwise("sum"),
        F.when(c == "chess", None).when(c == "music", 4000.0).when(c == "dna", 12.0).otherwise(45.0),
        F.when(c == "chess", None).otherwise("nodes"),
        F.when(c == "chess", None).otherwise(3.0),
    )


_GATE_SQL = f"""CASE WHEN is_empty AND category_key = 'chart' THEN true WHEN is_empty AND category_key <> 'mol' THEN false WHEN category_key = 'chess' THEN true
  ELSE coalesce(CASE WHEN lang_key = 'fasta' THEN coalesce(CASE WHEN n_seq > 0 THEN (total - n_seq)::DOUBLE / n_seq <= 12.0 END, false)
                     WHEN category_key = 'music' THEN length({_STRIP}) <= 4000 WHEN category_key = 'dna' THEN n_nodes <= 12 ELSE total <= 45 END, false)
       AND coalesce(n_nodes >= 3, false) END"""


@query(f"WITH {_NODES_SQL} SELECT id, category_key, {_GATE_SQL} AS passes FROM nodes")
def stats_gate(spark, sf_dir) -> DataFrame:
    rows = gen(spark, sf_dir).withColumn("nodes", filters.node_counts(F.col("statistics"), F.col("lang_key")))
    gate = filters.stats_gate(F.col("nodes"), F.col("category_key"), F.col("lang_key"), F.col("code"), *_limits())
    return rows.select("id", "category_key", gate.alias("passes"))


@query(f"WITH {GEN_SQL} SELECT id, {_RATIO_OK} AS passes FROM gen")
def aspect_ratio(spark, sf_dir) -> DataFrame:
    return gen(spark, sf_dir).select("id", filters.ratio_ok(F.col("width"), F.col("height"), F.col("category_key")).alias("passes"))


def _ruled(spark, sf_dir) -> DataFrame:
    """Every row with the first rule it breaks."""
    rows = filters.with_keys(gen(spark, sf_dir)).withColumn("nodes", filters.node_counts(F.col("statistics"), F.col("lang_key")))
    rules = [
        ("allow", filters.is_allowed(F.col("category_key"), F.col("lang_key"))),
        ("blank", X.nonblank(F.col("code"))),
        ("stats", filters.stats_gate(F.col("nodes"), F.col("category_key"), F.col("lang_key"), F.col("code"), *_limits())),
        ("ratio", filters.ratio_ok(F.col("width"), F.col("height"), F.col("category_key"))),
    ]
    return rows.withColumn("reason", filters.first_fail(rules)).withColumn("content", F.md5(X.squash(F.col("code"))))


def _judged(spark, sf_dir) -> DataFrame:
    """The same, and ``copy`` for rows beyond the cap; it counts rows that pass all rules only."""
    rows = filters.cap_per_key(_ruled(spark, sf_dir), ["cat_lang", "content", F.col("reason").isNull()], ["id"], 3)
    return rows.withColumn("reason", F.when(F.col("reason").isNull() & ~F.col("keep"), "copy").otherwise(F.col("reason")))


_JUDGED_SQL = f"""{_NODES_SQL}, keyed AS (
    SELECT *, concat_ws('_', category_key, lang_key) AS cat_lang, concat_ws('_', category_key, lang_key, complexity) AS cat_lang_compl FROM nodes
), ruled AS (
    SELECT *, CASE WHEN NOT {_ALLOW_SQL} THEN 'allow' WHEN coalesce({_STRIP}, '') = '' THEN 'blank' WHEN NOT ({_GATE_SQL}) THEN 'stats' WHEN NOT {_RATIO_OK} THEN 'ratio' END AS rule FROM keyed
), judged AS (
    SELECT *, CASE WHEN rule IS NULL AND row_number() OVER (PARTITION BY cat_lang, regexp_replace(code, '\\s+', '', 'g'), rule IS NULL ORDER BY id) > 3 THEN 'copy' ELSE rule END AS reason FROM ruled
)"""


@query(f"WITH {_JUDGED_SQL} SELECT id, reason FROM judged")
def filter_reasons(spark, sf_dir) -> DataFrame:
    return _judged(spark, sf_dir).select("id", "reason")


@query(f"WITH {_JUDGED_SQL} SELECT id, cat_lang, cat_lang_compl, width, height FROM judged WHERE reason IS NULL")
def filter_cascade(spark, sf_dir) -> DataFrame:
    # rejected rows don't travel: the cap sees survivors only
    rows = _ruled(spark, sf_dir).where(F.col("reason").isNull()).select("id", "cat_lang", "cat_lang_compl", "width", "height", "content")
    return filters.cap_per_key(rows, ["cat_lang", "content"], ["id"], 3).where("keep").drop("content", "keep")


@query(
    f"""WITH {_JUDGED_SQL}, s AS (SELECT *, (reason IS DISTINCT FROM 'allow')::BIGINT AS a, coalesce(reason NOT IN ('allow', 'blank'), true)::BIGINT AS b,
  coalesce(reason NOT IN ('allow', 'blank', 'stats'), true)::BIGINT AS c, coalesce(reason = 'copy', true)::BIGINT AS d, (reason IS NULL)::BIGINT AS e FROM judged)
SELECT key, value, count(*) AS n, sum(a)::BIGINT AS after_allow, sum(b)::BIGINT AS after_blank, sum(c)::BIGINT AS after_stats, sum(d)::BIGINT AS after_ratio, sum(e)::BIGINT AS after_copies FROM (
  SELECT 'total' AS key, '' AS value, * FROM s UNION ALL SELECT 'category_key', category_key, * FROM s
  UNION ALL SELECT 'cat_lang', cat_lang, * FROM s UNION ALL SELECT 'cat_lang_compl', cat_lang_compl, * FROM s) GROUP BY key, value"""
)
def stage_stats(spark, sf_dir) -> DataFrame:
    order = ["allow", "blank", "stats", "ratio", "copy"]
    left = {f"after_{name if name != 'copy' else 'copies'}": F.sum(F.coalesce(~F.col("reason").isin(*order[: i + 1]), F.lit(True)).cast("bigint")) for i, name in enumerate(order)}
    return stats.counts_by(_judged(spark, sf_dir), ["category_key", "cat_lang", "cat_lang_compl"], **left)


_SCORED = """scored AS (SELECT d.doc_id AS id, CASE WHEN d.doc_id % 9 = 4 THEN 'length' ELSE 'stop' END AS finish_reason,
  CASE WHEN l.toxic = 1 THEN 'maybe' WHEN l.quality = 1 THEN 'True' WHEN l.quality = 0 THEN 'FALSE' ELSE 'null' END AS score
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query(
    f"""WITH {_SCORED}, r AS (SELECT id, CASE WHEN finish_reason <> 'stop' THEN 'not_stop' WHEN lower(score) IN ('true', 'false', 'null') THEN lower(score) ELSE 'fail' END AS route FROM scored)
SELECT id, route FROM r"""
)
def score_route(spark, sf_dir) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    score = F.when(F.col("toxic") == 1, "maybe").when(F.col("quality") == 1, "True").when(F.col("quality") == 0, "FALSE").otherwise("null")
    finish = F.when(F.col("doc_id") % 9 == 4, "length").otherwise("stop")
    return d.join(l, "doc_id", "left").select(F.col("doc_id").alias("id"), filters.score_route(finish, score).alias("route"))


@query("SELECT source, md5(regexp_replace(text, '\\s+', '', 'g')) AS content, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, regexp_replace(text, '\\s+', '', 'g') ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3")
def cap_dups_code(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("content", F.md5(X.squash(F.col("text"))))
    return filters.cap_per_key(d, ["source", "content"], ["doc_id"], 3).where("keep").select("source", "content", "doc_id")


@query("SELECT lang, doc_id, rn <= 3 AS keep FROM (SELECT *, row_number() OVER (PARTITION BY lang, md5(lower(trim(text))) ORDER BY doc_id) AS rn FROM documents)")
def cap_dups_hash(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("hash", F.md5(F.lower(F.trim("text"))))
    return filters.cap_per_key(d, ["lang", "hash"], ["doc_id"], 3).select("lang", "doc_id", "keep")


@query(
    """WITH g AS (SELECT source, regexp_replace(text, '\\s+', '', 'g') AS s, count(*) AS copies, min(doc_id) AS first_id, count(*) - least(count(*), 3) AS removed FROM documents GROUP BY 1, 2 HAVING count(*) > 1)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY copies DESC, first_id) AS INTEGER) AS rank, copies, first_id, removed, substr(s, 1, 120) AS preview FROM g"""
)
def dup_report(spark, sf_dir) -> DataFrame:
    return dedup.duplicate_report(table(spark, sf_dir, "documents"), "source", X.squash(F.col("text")), "doc_id", 3)


@query(
    f"""WITH {JACCARD_SQL}, both_ways AS (SELECT a AS x, b AS y, same FROM links UNION ALL SELECT b, a, same FROM links)
SELECT sz.doc_id, sz.n AS n_tokens, least(sz.doc_id, coalesce(min(y) FILTER (same), sz.doc_id)) AS class_id, count(y) AS n_links FROM sz LEFT JOIN both_ways ON sz.doc_id = x GROUP BY 1, 2"""
)
def jaccard_pairs(spark, sf_dir) -> DataFrame:
    return dedup.link_counts(table(spark, sf_dir, "documents"), 9, 10)


@query(f"WITH RECURSIVE {GREEDY_SQL} SELECT doc_id, NOT list_contains(gone, doc_id) AS kept FROM sz, last")
def minhash_dedup(spark, sf_dir) -> DataFrame:
    return dedup.greedy_keep_first(table(spark, sf_dir, "documents"), 9, 10)


@query(
    """WITH t AS (SELECT doc_id, [ascii(substr(text, 1 + CAST(floor(i * length(text) / 64.0) AS INTEGER), 1)) FOR i IN range(64)] AS thumb FROM documents WHERE length(text) > 0),
h AS (SELECT *, array_to_string([CASE WHEN v * 64 > list_sum(thumb) THEN '1' ELSE '0' END FOR v IN thumb], '')::BIT AS hash FROM t),
p AS (SELECT a.doc_id, b.doc_id AS other, a.thumb = b.thumb AS same, list_max([abs(z[1] - z[2]) FOR z IN list_zip(a.thumb, b.thumb)]) <= 5 AS close FROM h a JOIN h b ON a.doc_id <> b.doc_id AND bit_count(xor(a.hash, b.hash)) <= 4)
SELECT h.doc_id, least(h.doc_id, coalesce(min(other) FILTER (same), h.doc_id)) AS class_id, count(other) AS n_near, count(other) FILTER (close) AS n_close FROM h LEFT JOIN p USING (doc_id) GROUP BY h.doc_id"""
)
def pictures_near(spark, sf_dir) -> DataFrame:
    # the stand-in's thumbnail is made of 64 of the text's characters at even steps; a text isn't split, as it may be long
    rows = table(spark, sf_dir, "documents").where(F.length("text") > 0).select(F.col("doc_id").alias("id"), "text", F.length("text").alias("n"))
    at = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.ascii(F.substring("text", (F.floor(i * F.col("n") / 64) + 1).cast("int"), 1)).cast("long"))
    return pictures.near_counts(rows.select("id", at.alias("thumb"))).withColumnRenamed("id", "doc_id")
