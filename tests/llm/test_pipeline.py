"""The pipeline's stages follow the operators on their own input; the registered queries run."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import test_operators as brute
from millrace.llm import neardup, registry, substring, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs, spark.read.parquet(f"{tmp_path}/{name}"))
        docs = seen[name][1]
    before, after = seen["toxicity"]
    scored = toxicity.score_toxicity(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in scored.where("predicted = 0").select("doc_id").collect()}
    before, after = seen["near_duplicates"]
    kept = neardup.near_duplicates(before, 80).where("kept").select("doc_id")
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in kept.collect()}
    before, after = seen["substrings"]
    removed = {r["doc_id"]: r["n_removed"] for r in substring.substring_dedup(before).collect()}
    words = lambda df: {r["doc_id"]: len(r["text"].encode().split()) for r in df.collect()}
    b, a = words(before), words(after)
    assert {i: b[i] - a[i] for i in b} == removed
    before, after = seen["packing"]
    assert {r[0] for r in after.select("doc_id").distinct().collect()} == {r[0] for r in before.select("doc_id").collect()}
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_stages_against_brute_force(spark):
    """Language, near duplicates and substrings on documents of all kinds; repeated ids and rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000")
    rows = [r.asDict() for r in docs.collect()]
    texts = {r["doc_id"]: r["text"] for r in rows}
    again = spark.createDataFrame([tuple(rows[0].values()), tuple(rows[1].values()), (None, "unnumbered words", "en", "s", 16), (10**9, None, "en", "s", 0)], docs.schema)
    more = docs.union(again)

    training = [(r["lang"], brute.lexical.words_of(r["text"])) for r in rows if r["lang"] and not brute.crc_held_out(r["doc_id"])]
    training += [(r["lang"], brute.lexical.words_of(r["text"])) for r in rows[:2] if r["lang"] and not brute.crc_held_out(r["doc_id"])] + [("en", ["unnumbered", "words"])]
    told = brute.brute_languages(training, [r["text"] for r in more.collect()])
    want = sorted(str(r["doc_id"]) for r, (lang, score) in zip(more.collect(), told, strict=True) if lang != "und" and score >= 0.5)
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.language_stage(spark, more, SF).collect()) == want

    parts = brute.brute_components(texts, 80)
    left = [str(r["doc_id"]) for r in rows + rows[:2] if parts[r["doc_id"]][1] == r["doc_id"]]
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.near_duplicate_stage(spark, more, SF).collect()) == sorted([*left, "None", str(10**9)])

    cut = brute.brute_substrings(texts, 50)
    for r in corpus_pipeline.substring_stage(spark, more, SF).collect():
        if r["doc_id"] in texts:
            n, removed, sha = cut[r["doc_id"]]
            assert len(r["text"].encode().split()) == n - removed
            if removed:
                assert hashlib.sha256(r["text"].encode()).hexdigest() == sha and r["n_chars"] == len(r["text"])
            else:
                assert r["text"] == texts[r["doc_id"]]


def test_stages_on_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_run_equals_stages_in_number(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_oracle(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        want = sorted(map(tuple, c.execute(sql).fetchall()))
        got = sorted(map(tuple, registry.queries()[name](spark, SF).select([d[0] for d in c.description]).collect()))
        assert got == want
