"""Personas to categories: match counts, candidate rule, ranked cut, domain fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import stablerand as R
from millrace.operators.filters import first_of_key

#: Categories that look up another one's matches.
ALIAS = {"sequence": "class", "activity": "class", "component": "class", "usecase": "class", "state": "class", "gantt": "bpmn"}


def topic_stats(matches: DataFrame) -> DataFrame:
    """Rows (id, topic, matches, mean_score) from rows (id, topic, score)."""
    return matches.groupBy("id", "topic").agg(F.count("*").alias("matches"), F.avg("score").alias("mean_score"))


def topic_maps(stats: DataFrame) -> DataFrame:
    """Rows (id, topics map, means map)."""
    return stats.groupBy("id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", "matches")))).alias("topics"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", "mean_score")))).alias("means"),
    )


def is_candidate(matches: Column, mean: Column, least: Column, thresh: Column, keyword: Column | None = None) -> Column:
    rule = (matches >= least) | (mean >= thresh)
    return rule if keyword is None else rule | keyword


def assigned(stats: DataFrame, cut: int) -> DataFrame:
    """Candidates with ``chosen`` for the first ``cut`` of their topic by mean score, and their ``rank`` (null beyond)."""
    return first_of_key(stats, ["topic"], [F.desc(F.round("mean_score", 9)), "id"], "id", cut, "chosen", "rank")


def fan_out(rows: DataFrame, domains: list[str], n: int, salt: str, when: Column) -> DataFrame:
    """``n`` domains drawn for each row where ``when`` holds, one empty domain elsewhere."""
    drawn = R.sample(F.array(*map(F.lit, domains)), n, salt, F.col("id"), F.col("topic"))
    return rows.select("*", F.posexplode(F.when(when, drawn).otherwise(F.array(F.lit("")))).alias("dom_pos", "domain"))
