"""The dataset's stages over files: ``run(name, spark, paths, options)``.

Each stage reads JSON lines with given schemas, applies the operators, and writes JSON lines. Stages that ask a
model take a client as ``options["complete"]``, a function from a list of prompts to a list of texts. Rendering,
fine-tuning and public benchmarks are done by external tools and have no stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import image
from millrace.functions import stablerand as R
from millrace.functions import templates as T
from millrace.functions import text as X
from millrace.functions.lineage import cut as saved
from millrace.functions.tokens import first_model_tokens
from millrace.operators import assign, cluster, dedup, evaluate, filters, generate, qa, split, stats, vector
from millrace.sources import io

TEXT = "id string, text string"
PERSONA = "id string, persona string, finish_reason string"
EMBEDDED = "id string, persona string, embedding array<float>"
INPUT = "struct<id:string,id_compl:string,category_key:string,category_name:string,lang_key:string,lang_name:string,code_instruct:string,complexity:string,persona:struct<id:string,persona:string>,domain:string>"
GENERATION = f"input {INPUT}, generation string, finish_reason string"
RENDERED = f"input {INPUT}, code string, problem string, description string, answer string, path_img_1 string, path_img_2 string, image_hash string, size struct<width:bigint,height:bigint>, statistics string"
REFINED = f"id string, input {INPUT}, category_key string, category_name string, lang_key string, lang_name string, domain string, path_img string, path_img_1 string, code string, problem string, answer string, description string, caption string, llm_user string, llm_assistant string, statistics string"
SUBJECTS = ("problem", "description")
ANSWERS = "type string, category_key string, difficulty string, answer string, generation string, stop string"
TRAIN = ["id", "type", "user", "assistant", "category_name", "category_key", "lang_key", "lang_name", "domain", "difficulty", "path_img", "code"]

STAGES: dict[str, tuple[str, Callable[[SparkSession, dict, dict], None]]] = {}


def stage(name: str, help_: str):
    def add(f):
        STAGES[name] = (help_, f)
        return f

    return add


def run(name: str, spark: SparkSession, paths: dict, options: dict | None = None) -> None:
    if name not in STAGES:
        raise KeyError(f"no stage {name!r}; there are {', '.join(STAGES)}")
    STAGES[name][1](spark, paths, options or {})


def _complete(options: dict) -> Callable[[list[str]], list[str]]:
    if "complete" not in options:
        raise ValueError("this stage needs a model client: options['complete']")
    return options["complete"]


def _limited(rows: DataFrame, options: dict, order: str = "id") -> DataFrame:
    rows = generate.skip_take(rows, order, options.get("start_index"), options.get("end_index"))
    return generate.accepted(rows, "prompt", order, options.get("max_samples"))


def _asked(rows: DataFrame, options: dict) -> DataFrame:
    """Rows with generation and finish_reason; the whole row goes through the model's client, so ids may repeat or be null."""
    rows = _limited(rows, options)
    whole = rows.select(F.struct(*(f"`{c}`" for c in rows.columns)).alias("id"), "prompt")
    return generate.model_map(whole, "prompt", _complete(options)).select("id.*", "generation", "finish_reason")


@stage("personas generate", "persona candidates from texts")
def personas_generate(spark, paths, options):
    texts = io.read_jsonl(spark, paths["input"], TEXT)
    stripped, most = X.strip(F.col("text")), options.get("tokens", 4000)
    cut = first_model_tokens(stripped, most, options["tokenizer"]) if "tokenizer" in options else X.first_tokens(stripped, most)
    rows = texts.select("id", F.when(cut != "", X.fill(options.get("template", "Who would write this?\n{text}"), text=cut)).otherwise("").alias("prompt"))
    out = _asked(rows, options).where("finish_reason = 'stop'").select("id", X.after_tag(X.strip(F.col("generation")), "</think>").alias("persona"))
    io.write_jsonl(out, paths["output"])


@stage("personas query", "search queries for each category")
def personas_query(spark, paths, options):
    cat = io.with_terms(io.catalogue(spark, spark.read.text(paths["categories"], wholetext=True).first()[0]))
    template = options.get("template", "Give search queries for {name}: {terms}")
    rows = cat.select(F.col("category_key").alias("id"), X.fill(template, name=F.col("name"), terms=F.col("terms_semantic")).alias("prompt"))
    body = X.braces(X.after_tag(F.col("generation"), "</think>"))
    found = _asked(rows, options).where("finish_reason = 'stop'").select(F.col("id").alias("category_key"), F.from_json(F.coalesce(F.get_json_object(body, "$.queries.queries"), F.get_json_object(body, "$.queries"), X.brackets(F.col("generation"))), "array<string>").alias("search_queries"), F.lit(0).alias("pos"))
    io.write_jsonl(generate.upsert(cat, found, "category_key", "search_queries", "pos"), paths["output"])


@stage("personas dedup", "near-equal personas dropped, the first kept")
def personas_dedup(spark, paths, options):
    rows = io.read_jsonl(spark, paths["input"], PERSONA)
    numbered = saved(io.in_order(rows, "doc_id"), "personas", result=True)  # ids may repeat
    kept = dedup.greedy_keep_first(numbered.select("doc_id", F.col("persona").alias("text")), *options.get("similarity", (9, 10)))
    flagged = numbered.join(kept, "doc_id", "left").withColumn("kept", F.coalesce("kept", F.lit(True))).drop("doc_id")
    io.write_jsonl(flagged.where("kept").drop("kept"), paths["output"])
    io.write_jsonl(flagged.where("NOT kept").drop("kept"), paths["removed"])


@stage("personas cluster", "projection and density clusters of embedded personas")
def personas_cluster(spark, paths, options):
    rows = io.read_jsonl(spark, paths["input"], EMBEDDED)
    flat = cluster.project(saved(io.in_order(rows, "n"), "personas", result=True), "embedding", 2)  # ids may repeat
    points = flat.select(F.col("n").alias("id"), F.col("projection")[0].alias("x"), F.col("projection")[1].alias("y"))
    labels = cluster.dbscan(points, options.get("eps", 0.11), options.get("least", 20)).withColumnRenamed("id", "n")
    io.write_jsonl(flat.join(labels, "n").drop("n", "embedding"), paths["output"])


@stage("personas filter", "personas to categories by vector search")
def personas_filter(spark, paths, options):
    corpus = io.read_jsonl(spark, paths["input"], EMBEDDED).select("id", "persona", vector.normalized(F.col("embedding")).alias("vec"))
    asked = io.read_jsonl(spark, paths["queries"], "topic string, query string, pos int, embedding array<float>")
    limits = vector.sticky_threshold(asked, "pos", "query", sticky=options.get("sticky", True))
    queries = limits.select(F.col("pos").alias("query_id"), "topic", "threshold", vector.normalized(F.col("embedding")).alias("qvec"))
    hits = vector.top_k(vector.scores(corpus.drop("persona"), queries), options.get("top_k", 50_000)).where("score >= threshold")
    found = assign.topic_stats(hits.select("id", "topic", "score"))
    good = assign.is_candidate(F.col("matches"), F.col("mean_score"), F.lit(options.get("min_matches", 2)), F.lit(options.get("min_score", 0.65)))
    ranked = assign.assigned(found.where(good), options.get("cut", 50_000)).join(corpus.select("id", "persona"), "id")
    domains = options.get("domains") or [""]
    fanned = assign.fan_out(ranked.where("chosen"), domains, min(10, len(domains)), "domain", F.lit(bool(options.get("domains"))))
    idx = F.row_number().over(Window.partitionBy("topic").orderBy("rank", "dom_pos"))
    io.write_routes(fanned.withColumn("idx", idx).withColumnRenamed("topic", "category"), "category", paths["output"])
    minor = ranked.where("NOT chosen").select("id", "topic").unionAll(found.where(~good).select("id", "topic"))
    io.write_jsonl(minor.select(F.concat(F.lit("min_"), "id").alias("id"), F.col("topic").alias("category")), paths["minor"])


@stage("dataset generate", "samples from personas, languages and complexities")
def dataset_generate(spark, paths, options):
    personas = io.read_jsonl(spark, paths["input"], "id string, idx string, category string, persona string, domain string")
    langs = io.read_jsonl(spark, paths["languages"], "category_key string, lang_key string, language string, code_instruct string, category_name string")
    rows = generate.expand(personas.withColumnRenamed("category", "category_key").withColumnRenamed("id", "persona_id"), langs, options.get("max_per_category"))
    rows = rows.join(F.broadcast(langs), ["category_key", "lang_key"])
    template = options.get("template", "As {persona}, state a problem of {complexity} complexity on {category}{domain} and solve it in {lang}.")
    prompt = X.fill(template, persona=F.col("persona"), complexity=F.col("complexity"), category=F.col("category_name"), lang=F.col("language"), domain=X.optional(F.col("domain")))
    kept = F.struct("id", "id_compl", "category_key", "category_name", "lang_key", F.col("language").alias("lang_name"), "code_instruct", "complexity", F.struct(F.col("persona_id").alias("id"), "persona").alias("persona"), "domain")
    raw = _asked(rows.select("id", prompt.alias("prompt"), kept.alias("input")), options).drop("prompt", "id")
    stop = F.col("finish_reason").eqNullSafe(F.lit("stop"))
    io.write_jsonl(raw.where(stop).select("input", *(c.alias(k) for k, c in generate.post_process(F.col("generation")).items())), paths["output"])
    io.write_jsonl(raw.where(~stop), paths["not_stop"])


def keyed(df: DataFrame) -> DataFrame:
    names = ("category_key", "category_name", "lang_key", "lang_name", "complexity")
    return filters.with_keys(df.withColumns({n: F.coalesce(F.col(f"input.{n}"), F.lit("None")) for n in names}))


#: Reasons of the quality cascade in the order in which they are judged.
STEPS = ["allow", "blank", "stats", "ratio", "copy", "image", "colour", "copy_image"]


@stage("dataset filter", "quality cascade with reasons, caps on copies, statistics of every step")
def dataset_filter(spark, paths, options):
    limits = io.read_jsonl(spark, paths["limits"], "category_key string, lang_key string, max_node string, max_thresh double, min_node string, min_thresh double")
    rows = keyed(io.read_jsonl(spark, paths["input"], RENDERED)).join(F.broadcast(limits), ["category_key", "lang_key"], "left")
    nodes = filters.node_counts(F.col("statistics"), F.col("lang_key"))
    gate = filters.stats_gate(nodes, F.col("category_key"), F.col("lang_key"), F.col("code"), *(F.col(c) for c in ("max_node", "max_thresh", "min_node", "min_thresh")))
    second = (F.col("lang_key") != "vienna") | X.nonblank(F.col("path_img_2"))
    rules = [
        ("allow", filters.is_allowed(F.col("category_key"), F.col("lang_key"))),
        ("blank", X.nonblank(F.col("code"))),
        ("stats", gate),
        ("ratio", filters.ratio_ok(F.col("size.width"), F.col("size.height"), F.col("category_key"))),
    ]
    rows = rows.withColumn("reason", filters.first_fail(rules))
    order = F.coalesce(F.col("input.id"), F.lit(""))

    def capped(df: DataFrame, key: Column, n: int, name: str) -> DataFrame:
        marked = filters.first_of_key(df.withColumn("_content", key), ["cat_lang", "_content", F.col("reason").isNull()], [order, "path_img_1"], F.concat_ws(":", order, "path_img_1"), n)
        return marked.withColumn("reason", F.when(F.col("reason").isNull() & ~F.col("keep"), name).otherwise(F.col("reason"))).drop("keep", "_place", "_content")

    rows = capped(rows, F.md5(X.squash(F.col("code"))), options.get("max_dups_code", 3), "copy")
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & ~second, "image").otherwise(F.col("reason")))
    if "images" in paths:  # the folder of the rendered pictures
        rows = io.with_file(rows, "path_img_1", image.examined(io.read_pictures(spark, paths["images"])), paths["images"])
        broken = F.when(F.col("_found.width").isNull(), "image").when(F.col("_found.colour") != "normal", "colour")
        rows = rows.withColumns({"reason": F.coalesce("reason", broken), "image_hash": F.coalesce("_found.image_hash", "image_hash")}).drop("_found")
    pictured = F.coalesce("image_hash", F.md5("path_img_1"))
    rows = saved(capped(rows, pictured, options.get("max_dups_img", 3), "copy_image"), "judged")
    limits_ = [c for c in limits.columns if c not in ("category_key", "lang_key")]
    io.write_jsonl(rows.where("reason IS NULL").drop("reason", *limits_), paths["output"])
    io.write_routes(rows.where("reason IS NOT NULL").drop(*limits_), "reason", paths["removed"])
    keys = ["category_key", "cat_lang", "cat_lang_compl"]
    io.write_jsonl(stats.counts_by(rows.where("reason IS NULL"), keys), paths["statistics"])
    if "steps" in paths:  # what is left after each step, a folder a step
        gone = {f"after_{step}": F.sum(F.coalesce(~F.col("reason").isin(*STEPS[: i + 1]), F.lit(True)).cast("bigint")) for i, step in enumerate(STEPS)}
        left = F.explode(F.array(F.struct(F.lit("input").alias("step"), F.col("n").alias("left")), *(F.struct(F.lit(step).alias("step"), F.col(f"after_{step}").alias("left")) for step in STEPS)))
        counts = stats.counts_by(rows, keys, **gone).select("key", "value", left.alias("s"))
        io.write_routes(counts.select("s.step", "key", "value", F.col("s.left").alias("n")).where("n > 0 OR key = 'total'"), "step", paths["steps"])
    if "images" in paths and "rejected" in paths:
        pictures = rows.where("reason IN ('ratio', 'image', 'colour', 'copy_image') AND path_img_1 IS NOT NULL").select("reason", "path_img_1")
        io.copy_pictures(pictures, "path_img_1", "reason", paths["images"], paths["rejected"])


@stage("dataset score", "verdicts of a judge, routed to true, false, null, fail and not_stop")
def dataset_score(spark, paths, options):
    rows = io.read_jsonl(spark, paths["input"], RENDERED).withColumn("id", F.col("input.id"))
    template = options.get("template", "Problem: {problem}\nAnswer: {answer}\nCode: {code}\nSay 'correct:' and 'explanation:'.")
    raw = _asked(rows.withColumn("prompt", X.fill(template, problem=F.col("problem"), answer=F.col("answer"), code=F.col("code"))), options)
    said = X.after_tag(F.col("generation"), "</think>")
    scored = raw.withColumns({"score_correct": X.section(said, "correct:", "explanation:", True, reverse=True), "score_explanation": X.section(said, "explanation:", "correct:", True, reverse=True)})
    io.write_routes(scored.withColumn("route", filters.score_route(F.col("finish_reason"), F.col("score_correct"))).drop("prompt", "generation"), "route", paths["output"])


@stage("dataset split", "refinement subsets by quotas")
def dataset_split(spark, paths, options):
    for kind, sizes, over, full in (("qa", (4000, 1000, 1000), ["quantum_qasm", "mol_smiles"], ["dna_vienna", "chess_fen"]), ("ps", (2000, 2000, 2000), options.get("ps_overlapping", []), ["chess_fen"])):
        if kind not in paths:
            continue
        rows = evaluate.with_molecules(keyed(io.read_jsonl(spark, paths[kind], RENDERED)), F.col("lang_key")).withColumn("id", F.col("input.id"))
        has = F.size(filters.node_counts(F.col("statistics"), F.col("lang_key"))) > 0
        out = split.quota_split(rows, "cat_lang", "id", options.get(f"{kind}_sizes", sizes), over, full, (F.col("cat_lang") == "chart_plotly") & has, options.get("reserve", 2000), kind)
        io.write_routes(out, "bucket", f"{paths['output']}/{kind}")


def _sectioned(spark, paths, options, names: dict[str, tuple[str, str]], template: str) -> None:
    rows = io.read_jsonl(spark, paths["input"], RENDERED).withColumn("id", F.col("input.id"))
    raw = _asked(rows.withColumn("prompt", X.fill(options.get("template", template), problem=F.col("problem"), description=F.col("description"), code=F.col("code"))), options)
    said = X.after_tag(F.col("generation"), "</think>")
    out = raw.where("finish_reason = 'stop'").withColumns({k: X.section(said, a, b, True, reverse=True) for k, (a, b) in names.items()})
    io.write_jsonl(out.drop("prompt", "generation", "finish_reason"), paths["output"])


@stage("dataset qa", "detail questions and answers")
def dataset_qa(spark, paths, options):
    _sectioned(spark, paths, options, {"llm_user": ("User:", "Assistant:"), "llm_assistant": ("Assistant:", "User:")}, "Ask about a detail of this and answer. User: ... Assistant: ...\n{description}\n{code}")


@stage("dataset caption", "captions")
def dataset_caption(spark, paths, options):
    _sectioned(spark, paths, options, {"caption": ("Caption:", "\x00")}, "Describe this. Caption: ...\n{description}\n{code}")


def _source(spark, path, kind: str) -> DataFrame:
    """Rows of a refinement subset with the training columns, numbered by _row as ids may repeat."""
    rows = io.read_jsonl(spark, path, REFINED)
    given = {c: F.coalesce(c, F.col(f"input.{c}")) for c in ("id", "category_key", "category_name", "lang_key", "lang_name", "domain")}
    given |= {"path_img": F.coalesce("path_img", "path_img_1"), "type": F.lit(kind), "difficulty": F.col("input.complexity")}
    rows = rows.withColumn("given_domain", F.col("input.domain")).withColumns(given)
    rows = rows.withColumn("domain", F.coalesce(F.col("domain"), filters.domain(F.col("category_key"), F.col("lang_key"))))
    return saved(rows.withColumn("_row", F.monotonically_increasing_id()), kind)


def _training(rows: DataFrame, user: Column, assistant: Column) -> DataFrame:
    return rows.withColumns({"user": user, "assistant": assistant}).select(*TRAIN)


def _questions(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows with the question found for each of them."""
    return rows.drop("difficulty").join(found.select(F.col("id").alias("_row"), "user", "assistant", "difficulty"), "_row").select(*TRAIN)


def assembled(spark, paths: dict, options: dict) -> tuple[list[tuple[str, DataFrame]], DataFrame | None]:
    """(name and training rows of each subset that ``paths`` has; rows that no structural question fits)."""
    words = {k: {**getattr(T, k.upper()), **options.get(k, {})} for k in ("questions", "answers")}
    read = lambda role, kind: _source(spark, paths[role], kind) if role in paths else None
    draw = [F.col("id"), F.col("_row")]
    out: list[tuple[str, DataFrame]] = []
    for role, kind, user, assistant in (("qa_problem", "qa_problem", "problem", "answer"), ("llm_qa", "qa_detail", "llm_user", "llm_assistant")):
        if rows := read(role, kind):
            out.append((role, _training(rows, F.col(user), F.col(assistant))))
    for role, kind, asked, said in (("ps_description", "description", "describe", "description"), ("ps_caption", "captioning", "captioning", "caption")):
        if rows := read(role, kind):
            out.append((role, _training(rows, qa.worded(words["questions"][asked], "asked", draw), F.col(said))))
    if rows := read("code_translate", "code"):
        half = split.halves(rows.withColumn("_k", R.key("code", *draw)), "_k", "type").where("half = 1")
        lead = qa.worded(words["answers"]["code"], "said", draw, language=F.col("lang_name"))
        out.append(("code_translate", _training(half, qa.worded(words["questions"]["code"], "asked", draw), F.concat(lead, F.lit("\n```\n"), F.coalesce("code", F.lit("")), F.lit("\n```")))))
    left = None
    if rows := read("structural", "structural"):
        nodes = rows.withColumn("nodes", filters.node_counts(F.col("statistics"), F.col("lang_key")))
        found = saved(qa.node_questions(nodes, "nodes", "_row", options.get("structural"), words["answers"]["structural"]).where("chosen"), "asked")
        out.append(("structural", rows.join(found.select("_row", "user", "assistant"), "_row").select(*TRAIN)))
        left = rows.join(found, "_row", "left_anti")
    if not {"association_persona", "association_caption", "consistency"} & set(paths):
        return out, left
    cat = io.catalogue(spark, spark.read.text(paths["categories"], wholetext=True).first()[0])
    listed = lambda c: F.broadcast(cat.select(F.col("category_key").alias("category"), F.explode(c).alias("other")))
    excluded = cat.select(F.col("category_key").alias("other"), F.explode("exclude_domains").alias("domain"))

    def pool_rows(rows: DataFrame, value: Column) -> DataFrame:
        return rows.select(F.col("_row").alias("id"), F.col("category_key").alias("category"), F.col("category_name").alias("name"), value.alias("value"), F.col("given_domain").alias("domain"))

    for role, subject, kinds, value, contrary, but in (("association_persona", "persona", qa.PERSONA, "input.persona.persona", "contrary_personas", excluded), ("association_caption", "caption", qa.CAPTION, "caption", "contrary_categories", None)):
        if rows := read(role, "association"):
            base = pool_rows(rows, F.col(value))
            found = qa.association(qa.variants(base.where("value IS NOT NULL"), kinds, True, subject), listed(contrary), base.select("category", "value"), subject, but, words["questions"][subject], words["answers"])
            out.append((role, _questions(rows, found)))
    if rows := read("consistency", "consistency"):
        kinds = [k for k in qa.CONSISTENCY for _ in SUBJECTS]
        base = qa.variants(pool_rows(rows, F.struct(*SUBJECTS)), kinds, True, "consistency", 2)
        parts = []
        for i, subject in enumerate(SUBJECTS):
            own = base.where(F.col("variant") % len(SUBJECTS) == i).withColumn("value", F.col(f"value.{subject}"))
            pool = rows.select(F.col("category_key").alias("category"), F.col(subject).alias("value"))
            parts.append(qa.consistency(own, listed("contrary_categories"), pool, subject, words["questions"][subject], words["answers"]))
        out.append(("consistency", _questions(rows, parts[0].union(parts[1]))))
    return out, left


@stage("dataset assemble", "one training table of all question types, its halves and statistics")
def dataset_assemble(spark, paths, options):
    schema = ", ".join(f"{c} string" for c in TRAIN)
    given = paths.get("input", [])
    parts = [(str(i), io.read_jsonl(spark, p, schema).select(*TRAIN)) for i, p in enumerate([given] if isinstance(given, str) else given)]
    found, left = assembled(spark, paths, options)
    rows = None
    for name, part in parts + found:
        part = part.withColumn("_part", F.concat_ws(":", F.lit(name), "type"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("_k", R.key("42", F.col("type"), F.col("id"), F.md5(F.concat_ws(":", "user", "assistant"))))
    out = saved(split.halves(rows, "_k", "_part").drop("_part"), "train")
    io.write_jsonl(out.orderBy("_k").drop("_k", "half"), f"{paths['output']}/all")
    for n in (1, 2):
        half = out.where(F.col("half") == n)
        io.write_jsonl(half.orderBy("_k").drop("_k", "half"), f"{paths['output']}/half_{n}")
        io.write_jsonl(stats.counts_by(half, ["type", "difficulty", "domain", "category_key"]), f"{paths['output']}/statistics_{n}")
    io.write_jsonl(stats.counts_by(out, ["type", "difficulty", "domain", "category_key"]), f"{paths['output']}/statistics")
    if left is not None:
        io.write_jsonl(left.drop("_row", "given_domain"), f"{paths['output']}/no_structural")


@stage("train format", "chat rows for fine-tuning")
def train_format(spark, paths, options):
    rows = io.read_jsonl(spark, paths["input"], ", ".join(f"{c} string" for c in TRAIN))
    prompts = options.get("system_prompts", ["Answer the question about the diagram."])
    system = F.element_at(F.array(*map(F.lit, prompts)), R.pick(len(prompts), "system", F.col("id")).cast("int") + 1)
    code = X.without_block(F.col("code"), "<bpmndi:BPMNDiagram", "</bpmndi:BPMNDiagram>")
    reason = F.when(R.pick(options.get("reason_every", 2), "reason", F.col("id")) == 0, F.concat(F.coalesce("lang_name", F.lit("")), F.lit("\n"), code))
    io.write_jsonl(rows.select("id", "path_img", generate.chat(system, F.col("user"), F.col("assistant"), reason).alias("messages")), paths["output"])


@stage("eval codegen", "measures of generated code, overall, by group and by language")
def eval_codegen(spark, paths, options):
    rows = keyed(io.read_jsonl(spark, paths["input"], RENDERED)).withColumns(
        {"n_description": X.word_count(F.col("description")), "n_code": evaluate.code_size(F.col("lang_key"), F.col("code")), "pictured": X.nonblank(F.col("path_img_1")), "id_compl": F.col("input.id_compl")}
    )
    rows = saved(rows, "sized")
    columns = [c.alias(k) for k, c in evaluate.measures(F.col("n_description"), F.col("n_code"), F.col("pictured")).items()]
    total = rows.agg(*columns).withColumn("no_code", F.col("no_code") + F.greatest(F.lit(options.get("expected_total", 9600)) - F.col("n"), F.lit(0)))
    groups = rows.where(F.col("complexity").isin("low", "medium", "high") & (F.col("lang_key") != "hmm")).groupBy("complexity", "category_key", "lang_key").agg(*columns)
    for name, df in (("overall", total), ("groups", groups), ("languages", rows.groupBy("cat_lang").agg(F.round(F.avg(F.col("pictured").cast("int")), 4).alias("mean"))), ("monotone", evaluate.monotone(rows, "id_compl", "complexity", ["n_description", "n_code"]))):
        io.write_report(df.select(*io.report_row(dict(df.dtypes))), f"{paths['output']}/{name}")


@stage("eval testset", "share of right answers, overall and by type, category and difficulty")
def eval_testset(spark, paths, options):
    rows = io.read_jsonl(spark, paths["input"], ANSWERS)
    said = X.after_tag(F.col("generation"), "</think>")
    rows = rows.withColumn("ok", F.coalesce(evaluate.answer_correct(said, F.col("answer"), options.get("exact", False)), F.lit(False)).cast("int"))
    out = stats.counts_by(rows, ["type", "category_key", "difficulty"], right=F.sum("ok"), share=F.avg("ok"), not_stop=F.count_if(~F.col("stop").eqNullSafe(F.lit("stop"))))
    io.write_jsonl(out, paths["output"])
