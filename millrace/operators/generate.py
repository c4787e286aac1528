"""Generation inputs, prompts, chat rows, and the parsing of generated text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import constants as K
from millrace.functions import stablerand as R
from millrace.functions import text as X
from millrace.functions.position import between


def expand(personas: DataFrame, languages: DataFrame, cap: int | None = None) -> DataFrame:
    """Each persona times the languages of its category times three complexities.

    ``id`` numbers a persona's rows, ``id_compl`` is shared by the three complexities of a language. ``cap`` keeps
    the first personas of each category.
    """
    if cap is not None:
        personas = personas.withColumn("_n", F.row_number().over(Window.partitionBy("category_key").orderBy("idx"))).where(F.col("_n") <= cap).drop("_n")
    listed = languages.groupBy("category_key").agg(F.array_sort(F.collect_set("lang_key")).alias("langs"))
    rows = personas.join(F.broadcast(listed), "category_key")  # one row a category of the catalogue
    rows = rows.select("*", F.posexplode("langs").alias("at", "lang_key")).drop("langs")
    rows = rows.select("*", F.posexplode(F.array(*map(F.lit, K.COMPLEXITIES))).alias("level", "complexity"))
    number = F.col("at") * 3 + F.col("level")
    idx = F.col("idx").cast("string")
    return rows.withColumns({"id": F.concat_ws("_", idx, number.cast("string")), "id_compl": F.concat_ws("_", idx, F.col("at").cast("string"))}).drop("at", "level")


def accepted(df: DataFrame, prompt: str, order: str, most: int | None = None) -> DataFrame:
    """Rows with a prompt; an empty one doesn't count towards ``most``."""
    rows = df.where(F.coalesce(F.col(prompt), F.lit("")) != "")
    return rows if most is None else rows.orderBy(order).limit(most)


def skip_take(df: DataFrame, order: str, start: int | None, end: int | None) -> DataFrame:
    """Rows from ``start`` to ``end`` of a total order, by counts of ranges of it; a start of 0 or None means all, whatever the end."""
    return between(df, [order], start, end) if start else df


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def prompt_messages(mode: Column, system: Column, user: Column, fixed: str) -> Column:
    """Messages by mode: system (its own system text), fixed (one system text for all), plain (user only)."""
    return F.when(mode == "system", F.array(message("system", system), message("user", user))).when(mode == "fixed", F.array(message("system", F.lit(fixed)), message("user", user))).otherwise(F.array(message("user", user)))


def chat(system: Column, user: Column, answer: Column, reason: Column | None = None) -> Column:
    """A training conversation; with a reason the answer is preceded by it between think tags."""
    said = answer if reason is None else F.when(reason.isNotNull(), F.concat(F.lit("<think>\n"), reason, F.lit("\n</think>\n"), answer)).otherwise(answer)
    return F.array(message("system", system), message("user", user), message("assistant", said))


def post_process(text: Column) -> dict[str, Column]:
    """code, problem, description and answer of a generation."""
    body = X.after_tag(text, "</think>")
    plain = F.replace(body, F.lit("**"), F.lit(""))
    return {
        "code": X.section(body, "```", "```", False, drop_first_line=True),
        "problem": X.section(plain, "Problem:", "Description:", True),
        "description": X.section(plain, "Description:", "Answer:", True),
        "answer": X.section(plain, "Answer:", "```", True),
    }


def upsert(catalogue: DataFrame, fresh: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The catalogue with ``value`` from the last of ``fresh``'s rows for a key, where there is one."""
    last = fresh.groupBy(key).agg(F.max_by(value, order).alias("_new"))
    return catalogue.join(last, key, "left").withColumn(value, F.coalesce("_new", F.col(value))).drop("_new")


def repair_tokens(ids: Column) -> Column:
    """A start token right before an end token becomes an opening one; runs of the opening token collapse to one."""
    n = F.size(ids)
    prev = F.concat(F.array(F.lit(-1)), F.slice(ids, F.lit(1), F.greatest(n - 1, F.lit(0))))
    # an end token after a start token opens; the start token before it goes
    opened = F.zip_with(ids, prev, lambda x, p: F.when((x == K.END_TOKEN) & (p == K.START_TOKEN), K.OPEN_TOKEN).otherwise(x))
    after = F.concat(F.slice(opened, F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(F.lit(-1)))
    kept = F.filter(F.zip_with(opened, after, lambda x, a: F.when((x == K.START_TOKEN) & (a == K.OPEN_TOKEN), -1).otherwise(x)), lambda x: x >= 0)
    before = F.concat(F.array(F.lit(-1)), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
    return F.filter(F.zip_with(kept, before, lambda x, p: F.when((x == K.OPEN_TOKEN) & (p == K.OPEN_TOKEN), -1).otherwise(x)), lambda x: x >= 0)


def mask_labels(ids: Column, masked: list[int]) -> Column:
    return F.transform(ids, lambda x: F.when(x.isin(*masked), -100).otherwise(x))


def model_map(df: DataFrame, prompt: str, complete: Callable[[list[str]], list[str]], id_col: str = "id") -> DataFrame:
    """Rows (id, generation, finish_reason) by a model client that maps a list of prompts to texts, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = complete(batch["prompt"].tolist())
            yield pd.DataFrame({"id": batch["id"], "generation": texts, "finish_reason": ["stop"] * len(texts)})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(prompt).alias("prompt")).mapInPandas(run, f"id {kind}, generation string, finish_reason string")


def zip_longest(left: DataFrame, right: DataFrame, at: str) -> DataFrame:
    """Two sequences by position; the shorter one is filled with null."""
    return left.join(right, at, "full")


def pick_message(c: Column, salt: str, *key: Column) -> Column:
    """One element of an array, null from an empty one."""
    return F.when(F.size(c) > 0, F.try_element_at(c, R.pick(F.greatest(F.size(c), F.lit(1)), salt, *key).cast("int") + 1))


def favoured(c: Column) -> Column:
    """An array whose first two elements count twice in a draw."""
    return F.concat(c, F.slice(c, 1, 2))


def images_of(messages: Column) -> Column:
    """The image parts of all messages (arrays of struct<role, content: array<struct<type, ...>>>)."""
    return F.filter(F.flatten(F.transform(messages, lambda m: m["content"])), lambda p: p["type"] == "image")
