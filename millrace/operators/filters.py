"""Row filters of the quality cascade, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import constants as K
from millrace.functions import text as X


def lookup_key(category: Column, lang: Column) -> Column:
    return F.when(lang.isin(*K.BY_CATEGORY), category).otherwise(lang)


def domain(category: Column, lang: Column) -> Column:
    """The domain of a row, empty where none is listed. The listing is a literal: no join and no shuffle."""
    pairs = [F.lit(x) for d, names in K.DOMAINS.items() for n in names for x in (n, d)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), lookup_key(category, lang)), F.lit(""))


def with_keys(df: DataFrame) -> DataFrame:
    """Adds cat_lang, cat_lang_compl and domain; a missing part prints as None."""
    c, lang, compl = (F.coalesce(F.col(x).cast("string"), F.lit("None")) for x in ("category_key", "lang_key", "complexity"))
    return df.withColumns({"cat_lang": F.concat_ws("_", c, lang), "cat_lang_compl": F.concat_ws("_", c, lang, compl), "domain": domain(F.col("category_key"), F.col("lang_key"))})


def allowed_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, x) for c, langs in K.ALLOWED.items() for x in langs], "category_key string, lang_key string")


def allowed(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(allowed_pairs(df.sparkSession)), ["category_key", "lang_key"], "left_semi")


def is_allowed(category: Column, lang: Column) -> Column:
    tests = [(category == c) & lang.isin(*langs) for c, langs in K.ALLOWED.items()]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def node_counts(statistics: Column, lang: Column) -> Column:
    """The map of node counts from the statistics' JSON; a nested op_types map is unwrapped for the graph language; missing is empty."""
    outer = F.from_json(statistics, "node_types map<string,string>")["node_types"]
    nested = F.try_element_at(outer, F.lit("op_types"))
    inner = F.from_json(nested, "map<string,bigint>")
    flat = F.transform_values(outer, lambda _, v: v.try_cast("bigint") if hasattr(v, "try_cast") else v.cast("bigint"))
    empty = F.create_map().cast("map<string,bigint>")
    return F.coalesce(F.when((lang == "nn_onnx_graph") & nested.isNotNull(), inner).otherwise(flat), empty)


def within(nodes: Column, code: Column, mode: Column, limit: Column, most: bool) -> Column:
    """A limit by its mode: none, all, sum, len, or a node's name, which must be there."""
    total = F.aggregate(F.map_values(nodes), F.lit(0).cast("bigint"), lambda a, x: a + x)
    length = F.length(X.strip(code))
    named = F.try_element_at(nodes, mode)
    ok = (lambda v: v <= limit) if most else (lambda v: v >= limit)
    test = F.when(mode.isNull(), True).when(mode == "all", F.forall(F.map_values(nodes), ok)).when(mode == "sum", ok(total)).when(mode == "len", ok(length)).otherwise(ok(named))
    return F.coalesce(test, F.lit(False))


def sequence_load(nodes: Column) -> Column:
    """Mean number of residues of a sequence: (sum - sequences) / sequences, null without sequences."""
    n = F.try_element_at(nodes, F.lit("sequences"))
    total = F.aggregate(F.map_values(nodes), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.try_divide((total - n).cast("double"), n.cast("double"))


def stats_gate(nodes: Column, category: Column, lang: Column, code: Column, max_node: Column, max_thresh: Column, min_node: Column, min_thresh: Column) -> Column:
    """Empty counts keep charts and drop all but molecules; without limits all stay; sequence files are held to their mean length; the others to both limits."""
    empty = F.size(nodes) == 0
    unlimited = max_node.isNull() & min_node.isNull() & max_thresh.isNull() & min_thresh.isNull()
    upper = F.when(lang == "fasta", F.coalesce(sequence_load(nodes) <= max_thresh, F.lit(False))).otherwise(within(nodes, code, max_node, max_thresh, True))
    both = upper & within(nodes, code, min_node, min_thresh, False)
    return F.when(empty & (category == "chart"), True).when(empty & (category != "mol"), False).when(unlimited, True).otherwise(both)


def ratio_ok(width: Column, height: Column, category: Column) -> Column:
    """Aspect ratio within [1 / r, r]; a height of 0 never passes."""
    widest = F.when(F.lit(False), 0.0)
    for name, r in K.RATIOS.items():
        widest = widest.when(category == name, r)
    widest = widest.otherwise(K.RATIO)
    ratio = F.try_divide(width.cast("double"), height.cast("double"))
    return F.coalesce((ratio >= 1 / widest) & (ratio <= widest), F.lit(False))


def first_fail(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that a row breaks, null if none: all rules in one pass."""
    out = F.when(F.lit(False), "")
    for name, keeps in rules:
        out = out.when(~F.coalesce(keeps, F.lit(False)), name)
    return out


def first_of_key(df: DataFrame, keys: list[Column | str], order: list[Column | str], spread: Column | str, n: int, flag: str = "keep", place: str = "_place", salts: int = 32) -> DataFrame:
    """Marks the first ``n`` rows of each key and numbers them in ``place`` (null beyond), with no key in one task.

    A row with ``n`` rows before it among those of its key that share its salt (a hash of ``spread``) is surely
    out. Only the others, at most ``n`` a salt, meet with their key; the sure ones are dealt by their hash.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(salts))
    rows = df.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, salt).orderBy(*order)) <= n)
    apart = F.when(~F.col("_in"), F.xxhash64(spread))
    rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(*keys, "_in", apart).orderBy(*order)))
    keep = F.col("_in") & (F.col(place) <= n)
    return rows.withColumn(flag, keep).withColumn(place, F.when(keep, F.col(place))).drop("_in")


def cap_per_key(df: DataFrame, keys: list[Column | str], order: list[Column | str], n: int, flag: str = "keep") -> DataFrame:
    """Marks the first ``n`` rows of each key; the first column of ``order`` tells rows apart."""
    return first_of_key(df, keys, order, order[0], n, flag).drop("_place")


def score_route(finish: Column, score: Column) -> Column:
    """stop rows by their verdict (true, false, null, fail); the others to fail_stop."""
    low = F.lower(score)
    return F.when(~finish.eqNullSafe(F.lit("stop")), "not_stop").when(low.isin("true", "false", "null"), low).otherwise("fail")
