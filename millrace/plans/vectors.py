"""Queries on vectors, personas and clusters. Queries are the rows whose id is divisible by 50, against all others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import stablerand as R
from millrace.functions import text as X
from millrace.functions.lineage import shared_path
from millrace.operators import assign, cluster, embed, index, vector
from millrace.plans.base import pick_sql, query, table

_VEC = """v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS vec FROM embeddings),
s AS (SELECT q.id AS query_id, q.label AS topic, v.id, v.label, round(list_dot_product(v.vec, q.vec), 6) AS score FROM v JOIN v q ON q.id % 50 = 0 AND q.id <> v.id)"""


def _corpus(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", vector.as_doubles(F.col("embedding")).alias("vec"))


def _asked(rows: DataFrame) -> DataFrame:
    return rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("topic"), F.col("vec").alias("qvec"))


def _nearest(spark, sf_dir, k: int, tag: str | None = None) -> DataFrame:
    rows = _corpus(spark, sf_dir)
    return vector.nearest(rows, _asked(rows), k, tag=tag)


@query("SELECT vec_id, round(list_dot_product(w, w), 6) AS norm2, round(w[1], 6) AS first FROM (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS w FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))")
def vector_normalize(spark, sf_dir) -> DataFrame:
    unit = vector.normalized(F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", unit.alias("w"))
    return rows.select("vec_id", F.round(vector.dot("w", "w"), 6).alias("norm2"), F.round(F.col("w")[0], 6).alias("first"))


@query(f"WITH {_VEC} SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s) WHERE rank <= 5")
def vector_topk(spark, sf_dir) -> DataFrame:
    return _nearest(spark, sf_dir, 5).select("query_id", "rank", "id", "score")


@query(f"WITH {_VEC} SELECT id, score FROM s WHERE query_id = 0 ORDER BY score DESC, id LIMIT 10")
def vector_search_one(spark, sf_dir) -> DataFrame:
    rows = _corpus(spark, sf_dir)
    one = rows.where("id = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    return vector.scores(rows, one).where("id <> query_id").orderBy(F.desc("score"), "id").limit(10).select("id", "score")


#: Stand-in of query texts: the query with number 200 is the first with more than 8 commas.
_LONG = "CASE WHEN query_id = 200 THEN repeat('a,', 9) ELSE 'a, b' END"


@query(
    f"""WITH {_VEC}, q AS (SELECT DISTINCT query_id, CASE WHEN query_id >= (SELECT min(vec_id) FROM embeddings WHERE vec_id = 200) THEN 0.4::DOUBLE ELSE 0.45::DOUBLE END AS threshold FROM s)
SELECT s.query_id, threshold, count(*) AS n, min(id) AS least_id, max(score) AS best FROM s JOIN q ON s.query_id = q.query_id WHERE score >= coalesce(threshold, 0.45) GROUP BY 1, 2"""
)
def vector_topk_threshold(spark, sf_dir) -> DataFrame:
    rows = _corpus(spark, sf_dir)
    asked = _asked(rows).withColumn("query", F.expr(_LONG))
    limits = vector.sticky_threshold(asked, "query_id", "query").select("query_id", "qvec", F.col("threshold").cast("double"))
    return vector.hits(rows, limits)


_STATS = f"""{_VEC}, m AS (SELECT id, topic, count(*) AS matches, round(avg(score), 9) AS mean_score FROM s WHERE score >= 0.05 GROUP BY 1, 2)"""


def _stats(spark, sf_dir) -> DataFrame:
    rows = _corpus(spark, sf_dir)
    return vector.topic_totals(rows, _asked(rows), 0.05).withColumn("mean_score", F.round("mean_score", 9))


@query(f"WITH {_STATS} SELECT id, count(*) AS n_topics, string_agg(concat(topic, '=', matches), ',' ORDER BY topic) AS topics FROM m GROUP BY id")
def persona_topics(spark, sf_dir) -> DataFrame:
    maps = assign.topic_maps(_stats(spark, sf_dir))
    listed = F.transform(F.map_entries("topics"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")))
    return maps.select("id", F.size("topics").cast("bigint").alias("n_topics"), F.array_join(listed, ",").alias("topics"))


@query(f"WITH {_STATS} SELECT topic, count(DISTINCT id) AS personas FROM m GROUP BY topic")
def topic_persona_count(spark, sf_dir) -> DataFrame:
    return _stats(spark, sf_dir).groupBy("topic").agg(F.countDistinct("id").alias("personas"))


_RULE = "(matches >= 2 OR mean_score >= 0.3)"
_CUT = 40


@query(f"WITH {_STATS} SELECT topic, id, idx, matches, mean_score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY mean_score DESC, id)::INTEGER AS idx FROM m WHERE {_RULE}) WHERE idx <= {_CUT}")
def persona_assign(spark, sf_dir) -> DataFrame:
    rows = _stats(spark, sf_dir).where(assign.is_candidate(F.col("matches"), F.col("mean_score"), F.lit(2), F.lit(0.3)))
    return assign.assigned(rows, _CUT).where("chosen").select("topic", "id", F.col("rank").alias("idx"), "matches", "mean_score")


@query(
    f"""WITH {_STATS} SELECT topic, concat('min_', id) AS id FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY mean_score DESC, id) AS idx FROM m WHERE {_RULE}) WHERE idx > {_CUT}
UNION ALL SELECT topic, concat('min_', id) FROM m WHERE NOT {_RULE}"""
)
def persona_minor(spark, sf_dir) -> DataFrame:
    rows = _stats(spark, sf_dir)
    rule = assign.is_candidate(F.col("matches"), F.col("mean_score"), F.lit(2), F.lit(0.3))
    over = assign.assigned(rows.where(rule), _CUT).where("NOT chosen").select("topic", "id")
    return over.unionAll(rows.where(~rule).select("topic", "id")).select("topic", F.concat(F.lit("min_"), F.col("id").cast("string")).alias("id"))


_DOMAINS = ["retail", "energy", "health", "travel", "finance", "sport", "law", "food"]


@query(
    f"""WITH {_STATS}, d AS (SELECT unnest({_DOMAINS}) AS domain), x AS (
  SELECT m.topic, m.id, d.domain, row_number() OVER (PARTITION BY m.topic, m.id ORDER BY md5(concat_ws(':', 'domain', m.id, m.topic, d.domain)))::INTEGER - 1 AS dom_pos FROM m CROSS JOIN d WHERE m.topic % 2 = 0 AND {_RULE})
SELECT * FROM x WHERE dom_pos < 3 UNION ALL SELECT topic, id, '', 0 FROM m WHERE topic % 2 = 1 AND {_RULE}"""
)
def domain_assign(spark, sf_dir) -> DataFrame:
    rows = _stats(spark, sf_dir).where(assign.is_candidate(F.col("matches"), F.col("mean_score"), F.lit(2), F.lit(0.3)))
    return assign.fan_out(rows, _DOMAINS, 3, "domain", F.col("topic") % 2 == 0).select("topic", "id", "domain", "dom_pos")


@query(f"WITH {_VEC} SELECT query_id, label, id AS nearest, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r = 1")
def nn_label_propagate(spark, sf_dir) -> DataFrame:
    return _nearest(spark, sf_dir, 1, "label").select("query_id", "label", F.col("id").alias("nearest"), "score")


@query(
    f"""WITH a AS (SELECT vec_id AS id, label, 0 AS prio FROM embeddings WHERE vec_id % 3 = 0), b AS (SELECT vec_id AS id, (label + vec_id % 2)::INTEGER AS label, 1 AS prio FROM embeddings WHERE vec_id NOT IN (SELECT id FROM a)),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY prio, CASE WHEN prio = 0 THEN lpad(id::VARCHAR, 20, '0') ELSE md5(concat_ws(':', '42', id)) END)::INTEGER AS place FROM u)
SELECT label, place, id, prio FROM r WHERE place <= 30"""
)
def label_quota_sample(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    first = e.where("id % 3 = 0").select("id", "label", F.lit(0).alias("prio"))
    second = e.select("id", (F.col("label") + F.col("id") % 2).cast("int").alias("label"), F.lit(1).alias("prio")).join(first.select("id"), "id", "left_anti")
    order = F.when(F.col("prio") == 0, F.lpad(F.col("id").cast("string"), 20, "0")).otherwise(R.key("42", F.col("id")))
    return vector.quota(first.unionByName(second), "label", [F.col("prio"), order], 30).select("label", "place", "id", "prio")


@query("""SELECT label, place::INTEGER AS place, id FROM (SELECT label, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', 'stop', vec_id)), vec_id) AS place FROM embeddings WHERE label <> -1) WHERE place <= 10""")
def label_quota_stop(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label").where("label <> -1")
    labels = rows.select("label").distinct().count()
    out, _ = vector.quota_until_full(rows.withColumnRenamed("label", "seen"), lambda part: part.withColumn("label", F.col("seen")), "label", labels, [R.key("stop", F.col("id")), F.col("id")], 10)
    return out.select("label", "place", "id")


@query(f"WITH {_VEC} SELECT query_id, string_agg(id::VARCHAR, ',' ORDER BY score DESC, id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r > 3 AND r <= 8 GROUP BY query_id")
def ranked_slice(spark, sf_dir) -> DataFrame:
    best = _nearest(spark, sf_dir, 8)
    listed = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("r"))
    return listed.select("query_id", F.array_join(F.transform(F.slice("r", 4, 5), lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("SELECT label, id FROM (SELECT label, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', 'sample', vec_id))) AS r FROM embeddings WHERE label <> -1) WHERE r <= 10")
def cluster_sample(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("label <> -1").select("label", F.col("vec_id").alias("id"))
    return vector.quota(rows, "label", [R.key("sample", F.col("id"))], 10).select("label", "id")


@query(
    """SELECT label, count(*) AS n, md5(string_agg(concat('Example ', r, ':', chr(10), 'vector ', id), chr(10) || chr(10) ORDER BY r)) AS prompt
FROM (SELECT label, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', 'sample', vec_id))) AS r FROM embeddings WHERE label <> -1) WHERE r <= 10 GROUP BY label"""
)
def cluster_examples(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("label <> -1").select("label", F.col("vec_id").alias("id"))
    rows = vector.quota(rows, "label", [R.key("sample", F.col("id"))], 10)
    listed = rows.groupBy("label").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("place", F.concat(F.lit("vector "), F.col("id").cast("string")).alias("t")))).alias("r"))
    return listed.select("label", "n", F.md5(X.examples(F.col("r.t"))).alias("prompt"))


@query(f"WITH {_VEC} SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM (SELECT v.id, q.id AS query_id, round(list_dot_product(v.vec, q.vec), 6) AS score FROM v JOIN v q ON q.id % 50 = 0)) WHERE rank <= 5")
def vector_index_search(spark, sf_dir) -> DataFrame:
    """The saved index, exact: lists whose bound can't reach the k-th score stay closed."""
    rows = _corpus(spark, sf_dir).select("id", "vec")
    found = index.build(rows, shared_path(spark, "index"), 8)
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    return index.search(found, queries, 5).select("query_id", "rank", "id", "score")


@query()
def vector_index_probed(spark, sf_dir) -> DataFrame:
    """The saved index, as many lists as were measured to find enough; no SQL, as the result is approximate (tests state its recall)."""
    rows = _corpus(spark, sf_dir).select("id", "vec")
    found = index.build(rows, shared_path(spark, "index"), 8)
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    return index.search(found, queries, 5, found.probes).select("query_id", "rank", "id", "score")


@query()
def neighbour_graph(spark, sf_dir) -> DataFrame:
    """About the 15 nearest others of every vector, by NN-descent; no SQL, as the result is approximate (tests state its recall)."""
    return embed.neighbours(_corpus(spark, sf_dir).select("id", "vec"))


@query()
def neighbour_embedding(spark, sf_dir) -> DataFrame:
    """Two dimensions for every vector; no SQL, as it is an iterated layout (tests state how many neighbours it keeps)."""
    return embed.embed(_corpus(spark, sf_dir).select("id", "vec")).withColumnRenamed("id", "vec_id")


@query("SELECT vec_id AS id, CASE WHEN label % 4 = 3 THEN 'None' ELSE concat('group ', label) END AS summary FROM embeddings")
def cluster_label_join(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") % 4 == 3, -1).otherwise(F.col("label")).alias("label"))
    summaries = e.where("label <> -1").select("label").distinct().withColumn("summary", F.concat(F.lit("group "), F.col("label").cast("string")))
    joined = e.join(F.broadcast(summaries), "label", "left")  # one row a cluster
    return joined.select("id", F.coalesce("summary", F.when(F.col("label") == -1, "None")).alias("summary"))


@query("SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS x, round(avg(embedding[2]::DOUBLE), 6) AS y, count(*) AS n FROM embeddings GROUP BY label")
def cluster_centroids(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("x"), F.round(F.avg(F.col("embedding")[1].cast("double")), 6).alias("y"), F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT label) AS labels, count(DISTINCT vec_id) AS ids FROM embeddings")
def distinct_counts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").agg(F.countDistinct("label").alias("labels"), F.countDistinct("vec_id").alias("ids"))


_PTS = "p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


@query(
    f"""WITH RECURSIVE {_PTS}, near AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.02 * 0.02),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 4), links AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id, id AS label FROM core UNION SELECT links.b, reach.label FROM reach JOIN links ON reach.id = links.a),
labels AS (SELECT id, min(label) AS label FROM reach GROUP BY id), border AS (SELECT near.a AS id, min(label) AS label FROM near JOIN labels ON near.b = labels.id GROUP BY near.a)
SELECT p.id, coalesce(labels.label, border.label, -1) AS label FROM p LEFT JOIN labels ON p.id = labels.id LEFT JOIN border ON p.id = border.id"""
)
def dbscan(spark, sf_dir) -> DataFrame:
    pts = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return cluster.dbscan(pts, 0.02, 4)


@query()
def pca_projection(spark, sf_dir) -> DataFrame:
    out = cluster.project(table(spark, sf_dir, "embeddings"), "embedding", 2)
    return out.select("vec_id", F.col("projection")[0].alias("x"), F.col("projection")[1].alias("y"))


#: Stand-in of grey pictures: a value for each character of the text, darkened, brightened or as it is.
_PX = "px AS (SELECT doc_id AS id, list_transform(list_filter(string_split(coalesce(text, ''), ''), lambda c: c <> ''), lambda c: CASE WHEN doc_id % 5 = 0 THEN least(ord(c), 255) // 4 WHEN doc_id % 5 = 1 THEN 255 - least(ord(c), 255) // 4 ELSE least(ord(c), 255) END) AS p FROM documents)"


@query(f"WITH {_PX} SELECT id, CASE WHEN len(list_filter(p, lambda v: v <= 50)) / nullif(len(p), 0) >= 0.992 THEN 'black' WHEN len(list_filter(p, lambda v: v >= 205)) / nullif(len(p), 0) >= 0.992 THEN 'white' END AS tone, len(list_distinct(p)) = 1 AS plain FROM px")
def image_rules(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    grey = F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda c: c != ""), lambda c: F.least(F.ascii(c), F.lit(255)))
    p = F.when(d % 5 == 0, F.transform(grey, lambda v: F.floor(v / 4).cast("int"))).when(d % 5 == 1, F.transform(grey, lambda v: F.lit(255) - F.floor(v / 4).cast("int"))).otherwise(grey)
    rows = table(spark, sf_dir, "documents").select(d.alias("id"), p.alias("p"))
    return rows.select("id", cluster.image_shares("p", threshold=0.992).alias("tone"), cluster.one_colour("p").alias("plain"))
