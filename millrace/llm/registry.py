"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.media import media_digest

    return media_digest(table(spark, sf_dir, "documents"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), 85)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.bpe import code_documents

    return code_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 8)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.bitslice import top_k

    return top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, 10)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.wordpiece import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.substring import removal_digest

    return removal_digest(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.langid import identify_documents

    return identify_documents(table(spark, sf_dir, "documents"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.runs import run_digest

    return run_digest(table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.merkle import proof_digest

    return proof_digest(table(spark, sf_dir, "documents"))


def op13_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.hmm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media, op2_neardup, op3_bpe, op4_sharding, op5_packing, op6_topk, op7_token_counts, op8_substrings, op9_toxicity, op10_langid, op11_runs, op12_manifest, op13_lm)}


OP6_SQL = """
WITH e AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


_BLANK = "[\\x20\\x09-\\x0D]+"

OP2_SQL = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANK}'), lambda x: x <> '') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
    SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)
), e AS (
    SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
    SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a
)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM documents d JOIN r ON d.doc_id = r.id LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.doc_id
"""

OP8_SQL = f"""
WITH w AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_BLANK}'), lambda x: x <> '') AS w FROM documents
), win AS (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)
), f AS (
    SELECT g, min(doc_id) AS m FROM win GROUP BY g
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM (SELECT win.doc_id, win.i FROM win JOIN f ON win.g = f.g WHERE f.m < win.doc_id)
), word AS (
    SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM w
), kept AS (
    SELECT word.doc_id, string_agg(x, ' ' ORDER BY k) AS t, count(*) AS n FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.k = gone.k GROUP BY word.doc_id
)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of an ASCII text that isn't null, bit by bit."""
    step = "list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)), lambda a, c: {step}), 4294967295)"


def _fields_sql(*fields: str) -> str:
    return "sha256(concat(" + ", ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE concat(strlen({f}::VARCHAR), ':', {f}) END" for f in fields) + "))"


OP12_SQL = f"""
WITH RECURSIVE leaf AS (
    SELECT doc_id, lang, {_fields_sql("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
           CASE WHEN coalesce({crc32_sql("doc_id::VARCHAR")} % 7 = 0, false) THEN {_fields_sql("doc_id", "source", "lang", "(n_chars + 1)", "text")} END AS raised FROM documents
), n AS (
    SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) AS tree FROM leaf GROUP BY lang
), numbered AS (
    SELECT doc_id, leaf, coalesce(raised, leaf) AS shown, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf JOIN n ON leaf.lang IS NOT DISTINCT FROM n.lang
), node AS (
    SELECT tree, 0 AS level, pos, n, leaf AS h FROM numbered
    UNION ALL SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY tree, level, pos // 2, n
), sub AS (
    SELECT tree, h AS subroot FROM node WHERE n = 1
), top AS (
    SELECT 0 AS tree, 0 AS level, tree - 1 AS pos, (SELECT count(*) FROM sub) AS n, subroot AS h FROM sub
    UNION ALL SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY tree, level, pos // 2, n
), every AS (
    SELECT * FROM node UNION ALL SELECT * FROM top
), step AS (
    SELECT doc_id, tree AS home, pos AS place, shown AS h, '' AS proof, tree, 0 AS level, pos, n FROM numbered
    UNION ALL
    SELECT s.doc_id, s.home, s.place, CASE WHEN s.n = 1 THEN s.h WHEN e.h IS NULL THEN sha256(s.h) WHEN s.pos % 2 = 1 THEN sha256(concat(e.h, s.h)) ELSE sha256(concat(s.h, e.h)) END,
           concat(s.proof, CASE WHEN s.n > 1 THEN e.h END), CASE WHEN s.n = 1 THEN 0 ELSE s.tree END, CASE WHEN s.n = 1 THEN 0 ELSE s.level + 1 END,
           CASE WHEN s.n = 1 THEN s.tree - 1 ELSE s.pos // 2 END, CASE WHEN s.n = 1 THEN (SELECT count(*) FROM n) ELSE (s.n + 1) // 2 END
    FROM step s LEFT JOIN every e ON e.tree = s.tree AND e.level = s.level AND e.pos = xor(s.pos, 1) WHERE s.tree > 0 OR s.n > 1
)
SELECT d.doc_id, d.leaf, sub.subroot, r.h AS root, sha256(s.proof) AS proof_sha256, s.h AS folded_root, s.h = r.h AS verified
FROM numbered d JOIN sub ON d.tree = sub.tree JOIN (SELECT h FROM top WHERE n = 1) r ON true JOIN (SELECT * FROM step WHERE tree = 0 AND n = 1) s ON s.home = d.tree AND s.place = d.pos
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_neardup": OP2_SQL, "op6_topk": OP6_SQL, "op8_substrings": OP8_SQL, "op12_manifest": OP12_SQL}
