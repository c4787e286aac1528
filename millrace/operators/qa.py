"""Question rows: counts of nodes, associations with distractors, consistency with negatives. All draws are functions of (salt, row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import constants as K
from millrace.functions import stablerand as R
from millrace.functions import templates as T
from millrace.functions import text as X
from millrace.operators.split import placed

#: (gold, hard) of the questions that a row can get; consistency has each of them for every subject.
PERSONA = [(True, False), (False, False)]
CAPTION = [(True, False), (False, False), (True, True), (False, True)]
CONSISTENCY = [(True, False), (False, False), (False, True)]


def template_key(category: Column, lang: Column) -> Column:
    """The language, or the category for languages of many diagrams; general diagrams share one key."""
    key = F.when(lang.isin(*K.BY_CATEGORY), category).otherwise(lang)
    return F.when(key.isin(*K.UML_KEYS), F.lit("uml")).otherwise(key)


def worded(options: list[str], salt: str, keys: list[Column], **values: Column) -> Column:
    """One of the texts, filled in."""
    return F.element_at(F.array(*(X.fill(t, **values) for t in options)), R.pick(len(options), salt, *keys).cast("int") + 1)


def is_terse(keys: list[Column]) -> Column:
    """Every third question asks for the bare answer."""
    return R.pick(3, "terse", *keys) == 0


def node_questions(df: DataFrame, nodes: str, id_col: str, templates: dict[str, list[str]] | None = None, answers: list[str] | None = None) -> DataFrame:
    """Rows (id, subject, gold_answer, user, assistant, chosen): one question for each node kind that is there and isn't silent, one of them chosen. Charts and tables are called so; languages without templates get no questions."""
    templates = templates or T.STRUCTURAL
    rows = df.select(id_col, "category_key", "lang_key", F.explode(nodes).alias("subject", "gold_answer")).where((F.col("gold_answer") > 0) & ~F.col("subject").isin(*K.SILENT_NODES))
    key = F.when((F.col("subject") == "sequences") & (F.col("lang_key") == "fasta"), "fasta_seq").otherwise(template_key(F.col("category_key"), F.col("lang_key")))
    listed = F.create_map(*(x for k, v in templates.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    rows = rows.withColumn("asked", F.try_element_at(listed, key)).where("asked IS NOT NULL")
    draw = [F.col(id_col), F.col("subject")]
    text = F.element_at("asked", R.pick(F.size("asked"), "template", *draw).cast("int") + 1)
    text = F.when(F.col("category_key").isin("chart", "table"), F.replace(text, F.lit("diagram"), F.col("category_key"))).otherwise(text)
    count = F.col("gold_answer").cast("string")
    said = worded(answers or T.ANSWERS["structural"], "said", draw, cnt=count, component=F.col("subject"))
    one = F.row_number().over(Window.partitionBy(id_col).orderBy(R.key("one", *draw))) == 1
    return rows.select(
        id_col,
        "subject",
        "gold_answer",
        F.concat(F.replace(text, F.lit("{component}"), F.col("subject")), F.when(is_terse(draw), T.COUNT_FORMAT).otherwise("")).alias("user"),
        F.when(is_terse(draw), count).otherwise(said).alias("assistant"),
        one.alias("chosen"),
    )


def options(rows: DataFrame, contrary: DataFrame, pool: DataFrame, salt: str, excluded: DataFrame | None = None) -> DataFrame:
    """Rows (id, variant, options) with ``need`` options from distinct categories, none equal to the gold value, in drawn order.

    ``rows``: (id, variant, category, value, need, hard, domain); ``contrary``: (category, other); ``pool``:
    (category, value); ``excluded``: (other, domain), categories that rows of a domain don't draw from. A hard row
    takes one option from its own category. Each category's values are numbered once in hashed order and counted;
    a draw is a number, so a row joins just one candidate a category (the next number serves where the drawn value
    equals the gold one), never the whole pool. Rows whose categories can't give that many options are left out.
    """
    values = pool.select("category", "value").where("value IS NOT NULL").distinct()
    numbered = placed(values.withColumn("_o", R.key("pool", F.col("value"))), ["category"], "_o", "at").withColumn("at", F.col("at") - 1).drop("_o")
    sizes = numbered.groupBy("category").agg(F.count("*").alias("size"))
    others = contrary.join(F.broadcast(sizes).withColumnRenamed("category", "other"), "other")
    drawn = rows.join(F.broadcast(others), "category")  # contrary lists and sizes have a row a category pair
    if excluded is not None:
        drawn = drawn.join(F.broadcast(excluded), ["other", "domain"], "left_anti")
    mine = ["id", "variant"]
    rank = F.row_number().over(Window.partitionBy(*mine).orderBy(R.key(salt, *map(F.col, mine), F.col("other"))))
    columns = [*mine, "value", "need", "other", "size", "rank"]
    drawn = drawn.withColumn("rank", rank).where(F.col("rank") <= F.col("need") - F.col("hard").cast("int")).select(*columns)
    own = rows.where("hard AND need > 0").join(F.broadcast(sizes), "category").select(*mine, "value", "need", F.col("category").alias("other"), "size", F.col("need").alias("rank"))
    drawn = drawn.unionByName(own)
    at = R.pick(F.col("size"), salt + "at", *map(F.col, mine), F.col("other"))
    tries = drawn.withColumn("try", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("at", F.pmod(at + F.col("try"), F.col("size")))
    found = tries.join(numbered.select(F.col("category").alias("other"), "at", F.col("value").alias("option")), ["other", "at"]).where("option <> value")
    first = found.groupBy(*mine, "rank", "need").agg(F.min_by("option", "try").alias("option"))
    mixed = F.array_sort(F.collect_list(F.struct(R.key(salt + "mix", *map(F.col, mine), F.col("option")).alias("k"), F.col("option").alias("v"))))
    return first.groupBy(*mine, "need").agg(mixed.alias("options")).where(F.size("options") == F.col("need")).select(*mine, F.col("options.v").alias("options"))


def variants(rows: DataFrame, kinds: list[tuple[bool, bool]], chosen_only: bool, salt: str, twice: int = 0) -> DataFrame:
    """Adds variant, gold, hard and chosen: a row for each kind, or the chosen one only. The first ``twice`` kinds count twice in the draw."""
    n = len(kinds)
    draw = R.pick(n + twice, salt, F.col("id"))
    draw = F.when(draw >= n, draw - n).otherwise(draw).cast("int")
    which = draw if chosen_only else F.explode(F.array(*map(F.lit, range(n))))
    pick = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in kinds)), F.col("variant") + 1)
    return rows.withColumn("variant", which).withColumns({"gold": pick(0), "hard": pick(1), "chosen": F.col("variant") == draw})


def association(rows: DataFrame, contrary: DataFrame, pool: DataFrame, subject: str, excluded: DataFrame | None = None, questions: list[str] | None = None, answers: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows (id, variant, user, assistant, difficulty, subject, options, answer_idx, gold_answer, chosen): which of four options belongs to the row, or none.

    ``rows``: those of ``variants`` with (id, category, name, value, domain)."""
    answers = answers or T.ANSWERS
    rows = rows.withColumn("need", F.when(F.col("gold"), 3).otherwise(4))
    found = rows.join(options(rows, contrary, pool, subject, excluded), ["id", "variant"])
    draw = [F.lit(subject), F.col("id"), F.col("variant")]
    place = R.pick(4, "place", *draw)
    listed = F.when(F.col("gold"), with_gold(F.col("options"), F.col("value"), place)).otherwise(F.col("options"))
    found = found.withColumns({"options": listed, "answer_idx": F.when(F.col("gold"), place.cast("int")).otherwise(-1), "gold_answer": F.when(F.col("gold"), letter(place)).otherwise("NONE")})
    values = {"answer": F.col("gold_answer"), "subject": F.lit(subject), "category": X.singular(F.col("name"))}
    said = F.when(F.col("gold"), worded(answers["association"], "said", draw, **values)).otherwise(worded(answers["none"], "said", draw, **values))
    short = F.when(F.col("gold"), F.col("gold_answer")).otherwise("None")
    lettered = {x: F.get("options", F.lit(i)) for i, x in enumerate("abcd")}
    user = X.fill(T.ASSOCIATION, question=worded(questions or T.QUESTIONS[subject], "asked", draw), format=F.when(is_terse(draw), T.LETTER_FORMAT).otherwise(""), **lettered)
    return found.select("id", "variant", user.alias("user"), F.when(is_terse(draw), short).otherwise(said).alias("assistant"), difficulty(F.col("gold"), F.col("hard")).alias("difficulty"), F.lit(subject).alias("subject"), "options", "answer_idx", "gold_answer", "chosen")


def consistency(rows: DataFrame, contrary: DataFrame, pool: DataFrame, subject: str, questions: list[str] | None = None, answers: dict[str, list[str]] | None = None) -> DataFrame:
    """Those columns, for whether a text is the row's own: the gold text, one of a contrary category (easy) or another of its own category (hard)."""
    rows = rows.withColumns({"need": F.when(F.col("gold"), 0).otherwise(1), "domain": F.lit("")})
    found = rows.join(options(rows, contrary, pool, subject), ["id", "variant"], "left").withColumn("shown", F.when(F.col("gold"), F.col("value")).otherwise(F.get("options", F.lit(0)))).where("shown IS NOT NULL")
    draw = [F.lit(subject), F.col("id"), F.col("variant")]
    answer = F.when(F.col("gold"), "Yes").otherwise("No")
    said = worded((answers or T.ANSWERS)["consistency"], "said", draw, answer=answer, subject=F.lit(subject), neg=F.when(F.col("gold"), "").otherwise("not "), category=X.singular(F.col("name")))
    user = X.fill(T.CONSISTENCY, question=worded(questions or T.QUESTIONS[subject], "asked", draw), subject=F.lit(subject.capitalize()), text=F.col("shown"), format=F.when(is_terse(draw), T.WORD_FORMAT).otherwise(""))
    level = F.when(F.col("hard"), "high").otherwise("low")
    return found.select("id", "variant", user.alias("user"), F.when(is_terse(draw), answer).otherwise(said).alias("assistant"), level.alias("difficulty"), F.lit(subject).alias("subject"), F.array("shown").alias("options"), F.col("gold").cast("int").alias("answer_idx"), answer.alias("gold_answer"), "chosen")


def with_gold(options: Column, gold: Column, place: Column) -> Column:
    return F.array_insert(options, place.cast("int") + 1, gold)


def letter(place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, K.LETTERS)), place.cast("int") + 1)


def difficulty(gold: Column, hard: Column) -> Column:
    return F.when(~hard, "low").when(gold, "medium").otherwise("high")
