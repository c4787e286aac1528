"""Measures of generated code and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import constants as K
from millrace.functions import text as X
from millrace.functions.molecules import molecule


def code_size(lang: Column, code: Column) -> Column:
    """Characters for languages of one line, lines for the others."""
    return F.when(lang.isin(*K.CHARACTER_LANGUAGES), X.char_count(code)).otherwise(X.line_count(code))


def positive_mean(c: Column) -> Column:
    """Mean of the values above 0, cut to an integer; 0 without any."""
    return F.coalesce(F.avg(F.when(c > 0, c)), F.lit(0.0)).cast("int")


def measures(description: Column, code: Column, image: Column) -> dict[str, Column]:
    return {
        "n": F.count("*"),
        "description_mean": positive_mean(description),
        "code_mean": positive_mean(code),
        "no_code": F.count_if(code <= 0),
        "images": F.sum(image.cast("bigint")),
        "image_mean": F.round(F.avg(image.cast("int")), 4),
    }


def greater(new: Column, base: Column, margin: float = 0.1) -> Column:
    return new > base * (1 + margin)


def monotone(df: DataFrame, key: str, level: str, measures_: list[str], margin: float = 0.1) -> DataFrame:
    """Rows (measure, n, share): of complete triples low, medium, high with positive sizes, the share of the three comparisons that grow."""
    wide = df.groupBy(key).pivot(level, K.COMPLEXITIES).agg(*(F.max(m).alias(m) for m in measures_))
    out = None
    for m in measures_:
        low, mid, high = (F.col(f"{x}_{m}" if len(measures_) > 1 else x).cast("double") for x in K.COMPLEXITIES)
        tests = F.array(*(greater(b, a, margin).cast("int") for a, b in ((low, mid), (mid, high), (low, high))))
        part = wide.where((low > 0) & (mid > 0) & (high > 0)).select(F.explode(tests).alias("t")).agg(F.count("*").alias("n"), F.round(F.avg("t"), 4).alias("share")).select(F.lit(m).alias("measure"), "n", "share")
        out = part if out is None else out.union(part)
    return out


def answer_correct(generation: Column, gold: Column, exact: bool = False) -> Column:
    """Whether the answer's head holds the gold answer; without an Answer: section the whole text counts."""
    has = F.contains(generation, F.lit("Answer:"))
    said = F.when(has, X.answer_head(X.section(generation, "Answer:", "\x00", True))).otherwise(generation)
    said, gold = F.lower(said), F.lower(gold)
    return X.strip(said) == X.strip(gold) if exact else F.contains(said, gold)


#: Bracket atoms and the organic subset of line notation, and ring closures (two marks make one).
ATOM = r"\[[^\]]+\]|Cl|Br|[BCNOPSFIbcnops]"


def atoms(c: Column) -> Column:
    return F.regexp_count(c, F.lit(ATOM))


def rings(c: Column) -> Column:
    bare = F.regexp_replace(c, r"\[[^\]]+\]", "")
    return F.floor(F.regexp_count(bare, F.lit(r"%[0-9]{2}|[0-9]")) / 2)


def with_molecules(df: DataFrame, lang: Column, code: str = "code", statistics: str = "statistics") -> DataFrame:
    """The statistics of molecules replaced by their atoms by element and their rings; malformed notation keeps what it had."""
    is_one = F.coalesce(lang == "smiles", F.lit(False))
    seen = df.withColumns({"_one": is_one, "_mol": molecule(F.when(is_one, F.col(code)))})
    named = F.map_concat(F.transform_keys("_mol.elements", lambda k, _: F.concat(k, F.lit(" atoms"))), F.create_map(F.lit("rings"), F.col("_mol.rings")))
    fresh = F.when(F.col("_one") & F.col("_mol.atoms").isNotNull(), F.to_json(F.struct(named.alias("node_types"))))
    return seen.withColumn(statistics, F.coalesce(fresh, F.col(statistics))).drop("_one", "_mol")
