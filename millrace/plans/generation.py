"""Queries of sources, sinks, streams, generation, chat and text parsing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import stablerand as R
from millrace.functions import text as X
from millrace.functions.lineage import shared_dir
from millrace.operators import filters, generate
from millrace.plans.base import GEN_SQL, GREEDY_SQL, gen, pick_sql, query, table
from millrace.sources import io, pages
from millrace.streaming import ingest, ledger, near


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"


@query("SELECT n_name AS category_key, r_name AS \"group\", CASE WHEN n_nationkey % 3 <> 0 THEN concat('about ', lower(n_name)) END AS terms FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0")
def scan_catalog(spark, sf_dir) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    terms = F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit("about "), F.lower("n_name")))
    cat = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("category_key"), F.col("r_name").alias("group"), terms.alias("terms_semantic"))
    return io.with_terms(cat).withColumnRenamed("terms_semantic", "terms")


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def scan_jsonl_roundtrip(spark, sf_dir) -> DataFrame:
    path = _folder(spark, "jsonl")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    io.write_jsonl(rows.where("conv_id % 2 = 0"), path)
    io.write_jsonl(rows.where("conv_id % 2 <> 0"), path, append=True)
    return io.read_jsonl(spark, path, rows.schema).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("SELECT 'documents' AS origin, doc_id AS id, length(text) AS n FROM documents UNION ALL SELECT 'benchmark', item_id, length(text) FROM benchmark")
def scan_multi_union(spark, sf_dir) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("origin"), F.col(i).alias("id"), F.length("text").cast("bigint").alias("n")) for t, i in (("documents", "doc_id"), ("benchmark", "item_id"))]
    return parts[0].unionByName(parts[1])


@query("SELECT event_type, count(*) AS n, count(props) AS with_props, sum(len(json_keys(props)))::BIGINT AS keys FROM events GROUP BY event_type")
def json_stats_decode(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    again = F.from_json(io.statistics_text("m"), "map<string,string>")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("props").alias("with_props"), F.sum(F.size(again)).alias("keys"))


@query()
def stream_ingest_docs(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "documents").schema
    out, marks = _folder(spark, "stream"), _folder(spark, "marks")
    ingest.ingest(ingest.prepared(ingest.read_stream(spark, f"{sf_dir}/documents.parque[t]", schema)), out, marks)
    return spark.read.schema("doc_id long, prompt string").parquet(out).select("doc_id", F.length("prompt").alias("n"))


@query("SELECT doc_id, length(text) AS n, md5(text) AS digest FROM documents")
def stream_pages_docs(spark, sf_dir) -> DataFrame:
    docs, hub, out, marks = table(spark, sf_dir, "documents").select("doc_id", "text"), *(_folder(spark, x) for x in ("hub", "sink", "marks"))
    # a page is found by decoding its row group up to it, so groups are small
    docs.write.option("parquet.block.size", 2**23).parquet(f"{hub}/main/train")
    batch = max(pages.BATCH_ROWS, -(-spark.read.parquet(f"{hub}/main/train").count() // 16))
    sink = ledger.drain(pages.stream_pages(spark, hub, marks, "main", "train", batch_rows=batch), out, marks)
    return sink.read(docs.schema).select("doc_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@query(f"WITH RECURSIVE {GREEDY_SQL}, flags AS (SELECT sz.doc_id, NOT list_contains(last.gone, sz.doc_id) AS kept FROM sz, last) SELECT doc_id, coalesce(kept, true) AS kept FROM documents LEFT JOIN flags USING (doc_id)")
def stream_dedup_docs(spark, sf_dir) -> DataFrame:
    docs, hub, out, marks = table(spark, sf_dir, "documents").select("doc_id", "text"), *(_folder(spark, x) for x in ("hub", "sink", "marks"))
    docs.orderBy("doc_id").write.option("parquet.block.size", 2**23).parquet(f"{hub}/main/train")
    batch = max(pages.BATCH_ROWS, -(-spark.read.parquet(f"{hub}/main/train").count() // 16))
    return near.keep_first(pages.stream_pages(spark, hub, marks, "main", "train", batch_rows=batch), out, marks)


_LANGS = "langs AS (SELECT unnest(['BUILDING', 'FURNITURE']) AS category_key, unnest(['x1', 'y1']) AS lang_key UNION ALL SELECT 'BUILDING', 'x2')"


@query(
    f"""WITH {_LANGS}, l AS (SELECT *, row_number() OVER (PARTITION BY category_key ORDER BY lang_key) - 1 AS pos FROM langs), c AS (SELECT unnest(['low', 'medium', 'high']) AS complexity, unnest([0, 1, 2]) AS level)
SELECT c_custkey AS idx, c_mktsegment AS category_key, lang_key, complexity, concat(c_custkey, '_', pos * 3 + level) AS id, concat(c_custkey, '_', pos) AS id_compl FROM customer JOIN l ON c_mktsegment = category_key CROSS JOIN c"""
)
def catalog_explode(spark, sf_dir) -> DataFrame:
    personas = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_mktsegment").alias("category_key"))
    langs = spark.createDataFrame([("BUILDING", "x1"), ("BUILDING", "x2"), ("FURNITURE", "y1")], "category_key string, lang_key string")
    return generate.expand(personas, langs).select("idx", "category_key", "lang_key", "complexity", "id", "id_compl")


TEMPLATE = "Write a {complexity} {lang} example for {category}{extra}."


@query(
    f"""WITH {GEN_SQL} SELECT id, concat('Write a ', complexity, ' ', lang_key, ' example for ', category_key, CASE WHEN id % 4 = 0 THEN ' with care' ELSE '' END, '.') AS prompt,
{pick_sql(3, "concat_ws(':', 'side', id)")} = 0 AS side FROM gen WHERE id % 10 <> 3"""
)
def prompt_build(spark, sf_dir) -> DataFrame:
    extra = X.optional(F.when(F.col("id") % 4 == 0, "with care"))
    text = X.fill(TEMPLATE, complexity=F.col("complexity"), lang=F.col("lang_key"), category=F.col("category_key"), extra=extra)
    rows = gen(spark, sf_dir).select("id", F.when(F.col("id") % 10 == 3, "").otherwise(text).alias("prompt"))
    return generate.accepted(rows, "prompt", "id").select("id", "prompt", (R.pick(3, "side", F.col("id")) == 0).alias("side"))


@query(
    """SELECT conv_id, turn, md5(CASE turn % 3 WHEN 0 THEN concat('system=', role, ';user=', text) WHEN 1 THEN concat('system=fixed;user=', text) ELSE concat('user=', text) END) AS messages FROM conversations"""
)
def prompt_modes(spark, sf_dir) -> DataFrame:
    t = F.col("turn") % 3
    mode = F.when(t == 0, "system").when(t == 1, "fixed").otherwise("plain")
    m = generate.prompt_messages(mode, F.col("role"), F.col("text"), "fixed")
    shown = F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit("="), x["content"])), ";")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(shown).alias("messages"))


@query(r"SELECT doc_id, array_to_string((list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))[:50], ' ') AS cut FROM documents")
def truncate_tokens(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.first_tokens(F.col("text"), 50).alias("cut"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 70 OFFSET 30")
def skip_take(spark, sf_dir) -> DataFrame:
    return generate.skip_take(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 30, 100)


@query("SELECT r_regionkey AS key, coalesce((SELECT arg_max(n_name, n_nationkey) FROM nation WHERE n_regionkey + 1 = r_regionkey), r_name) AS value FROM region")
def catalog_upsert(spark, sf_dir) -> DataFrame:
    cat = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    fresh = table(spark, sf_dir, "nation").select((F.col("n_regionkey") + 1).alias("key"), F.col("n_name").alias("value"), "n_nationkey")
    return generate.upsert(cat, fresh, "key", "value", "n_nationkey")


def _echo(prompts: list[str]) -> list[str]:
    return [f"Answer: {len(p)}" for p in prompts]


@query()
def llm_map_stub(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prompt"))
    return generate.model_map(rows, "prompt", _echo)


#: Stand-in of generated text: a thought, sections, and a fenced block with a language line.
_TEXT = """t AS (SELECT doc_id AS id, text, concat(CASE WHEN doc_id % 3 = 0 THEN 'so</think>' ELSE '' END, '**Problem:** ', text, CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat(chr(10), 'Description: d', doc_id) END, chr(10), 'Answer: a', doc_id, chr(10), '```', CASE WHEN doc_id % 2 = 0 THEN 'json' ELSE '{"k": 1}' END, chr(10), 'body', chr(10), '```') AS g FROM documents)"""


def _generated(spark, sf_dir) -> DataFrame:
    d, s = F.col("doc_id"), F.col("doc_id").cast("string")
    g = F.concat(
        F.when(d % 3 == 0, "so</think>").otherwise(""), F.lit("**Problem:** "), F.col("text"), F.when(d % 4 == 0, "").otherwise(F.concat(F.lit("\nDescription: d"), s)),
        F.lit("\nAnswer: a"), s, F.lit("\n```"), F.when(d % 2 == 0, "json").otherwise('{"k": 1}'), F.lit("\nbody\n```"),
    )
    return table(spark, sf_dir, "documents").select(d.alias("id"), "text", g.alias("g"))


@query(
    f"""WITH {_TEXT} SELECT id, CASE WHEN id % 2 = 0 THEN 'body' ELSE concat('{{"k": 1}}', chr(10), 'body') END AS code,
md5(problem) AS problem, CASE WHEN id % 4 = 0 THEN '' ELSE concat('d', id) END AS description, concat('a', id) AS answer
FROM (SELECT id, text, regexp_replace(CASE WHEN id % 4 = 0 THEN split_part(replace(g, '**', ''), 'Problem:', 2) ELSE split_part(split_part(replace(g, '**', ''), 'Problem:', 2), 'Description:', 1) END, '^\\s+|\\s+$', '', 'g') AS problem FROM t)"""
)
def extract_sections(spark, sf_dir) -> DataFrame:
    return _generated(spark, sf_dir).select("id", *((F.md5(c) if k == "problem" else c).alias(k) for k, c in generate.post_process(F.col("g")).items()))


@query(
    r"""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 2 THEN '' ELSE concat('u', doc_id) END AS "user", CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'second' END AS assistant FROM documents"""
)
def extract_reverse(spark, sf_dir) -> DataFrame:
    d, s = F.col("doc_id"), F.col("doc_id").cast("string")
    t = F.concat(F.lit("User: old\n"), F.when(d % 3 == 2, "User:").otherwise(F.concat(F.lit("User: u"), s)), F.lit("\n"), F.when(d % 5 == 0, "").otherwise("Assistant: first\nAssistant: second "))
    rows = table(spark, sf_dir, "documents").select(d.alias("id"), t.alias("t"))
    return rows.select("id", X.section(F.col("t"), "User:", "Assistant:", True, reverse=True).alias("user"), X.section(F.col("t"), "Assistant:", "User:", True, reverse=True).alias("assistant"))


@query(f"WITH {_TEXT} SELECT id, md5(regexp_replace(split_part(g, '</think>', 2), '^\\s+|\\s+$', '', 'g')) AS digest FROM t WHERE id % 3 = 0 UNION ALL SELECT id, md5(g) FROM t WHERE id % 3 <> 0")
def strip_reasoning(spark, sf_dir) -> DataFrame:
    return _generated(spark, sf_dir).select("id", F.md5(X.after_tag(F.col("g"), "</think>")).alias("digest"))


@query("SELECT page_id, md5(regexp_replace(html, '<script.*?</script>', '', 'gs')) AS digest, length(regexp_replace(html, '<script.*?</script>', '', 'gs')) AS n FROM pages")
def regex_block_strip(spark, sf_dir) -> DataFrame:
    out = X.without_block(F.col("html"), "<script", "</script>")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(out).alias("digest"), F.length(out).cast("bigint").alias("n"))


@query(
    """SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props))::INTEGER AS n FROM events WHERE len(json_keys(props)) > 0"""
)
def json_extract_llm(spark, sf_dir) -> DataFrame:
    said = F.concat(F.lit("Sure, here it is:\n"), "props", F.lit("\nDone."))
    rows = table(spark, sf_dir, "events").select("event_id", "props", X.braces(said).alias("j"))
    m = F.from_json("j", "map<string,string>")
    return rows.where(F.size(m) > 0).select("event_id", F.map_values(m)[0].alias("first_value"), F.size(m).alias("n"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::INTEGER AS n FROM documents")
def word_counts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.word_count(F.col("text")).alias("n"))


@query(
    """SELECT p_partkey, concat(upper(substr(p_name, 1, 1)), lower(substr(p_name, 2))) AS capital, regexp_replace(lower(p_type), 's$', '') AS one, ends_with(p_brand, '1') AS ends_in_1,
len(p_name) - len(replace(p_name, 'a', '')) AS n_a FROM part"""
)
def scalar_strings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.capitalize(F.col("p_name")).alias("capital"), X.singular(F.lower("p_type")).alias("one"), F.endswith("p_brand", F.lit("1")).alias("ends_in_1"), F.regexp_count("p_name", F.lit("a")).cast("bigint").alias("n_a")
    )


@query(
    """WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS pos FROM nation), b AS (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS pos FROM region)
SELECT pos::BIGINT AS pos, n_name, r_name FROM a FULL JOIN b USING (pos)"""
)
def zip_longest_fill(spark, sf_dir) -> DataFrame:
    # both catalogues number their own rows: the key is the position
    a = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("bigint").alias("pos"), "n_name")
    b = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("bigint").alias("pos"), "r_name")
    return generate.zip_longest(a, b, "pos")


@query(
    """SELECT conv_id, turn, concat('system: be brief | user: ', role, ' | assistant: ', CASE WHEN turn % 2 = 0 THEN concat('<think>', chr(10), length(text), chr(10), '</think>', chr(10)) ELSE '' END, md5(text)) AS chat FROM conversations"""
)
def chat_format(spark, sf_dir) -> DataFrame:
    reason = F.when(F.col("turn") % 2 == 0, F.length("text").cast("string"))
    m = generate.chat(F.lit("be brief"), F.col("role"), F.md5("text"), reason)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), " | ").alias("chat"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '1,200006,2' WHEN 1 THEN '200006,7' ELSE '5,200007,6' END AS ids FROM nation")
def token_repair(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey") % 3
    ids = F.when(k == 0, F.array(*map(F.lit, (1, 200007, 200002, 2)))).when(k == 1, F.array(*map(F.lit, (200006, 200006, 200006, 7)))).otherwise(F.array(*map(F.lit, (5, 200007, 6))))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(generate.repair_tokens(ids).cast("array<string>"), ",").alias("ids"))


@query("SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 5 IN (0, 3) THEN -100 ELSE o_orderkey % 5 END, CASE WHEN o_custkey % 5 IN (0, 3) THEN -100 ELSE o_custkey % 5 END) AS labels FROM orders")
def label_mask(spark, sf_dir) -> DataFrame:
    ids = F.array(F.col("o_orderkey") % 5, F.col("o_custkey") % 5)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(generate.mask_labels(ids, [0, 3]).cast("array<string>"), ",").alias("labels"))
