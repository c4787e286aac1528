"""Readers and writers. Schemas are given, never inferred; every path is opened by Spark."""

from __future__ import annotations

import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X
from millrace.functions.lineage import cut, drop
from millrace.functions.position import numbered
from millrace.session import ship

DOCUMENT_ROWS = 100_000
SCHEME = "^[a-z][a-z0-9+.-]*:(//[^/]*)?(?=/)"
CATALOGUE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("category_key", "name", "group", "terms_semantic")]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("search_queries", "contrary_personas", "contrary_categories", "exclude_domains")]
)


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str | T.StructType) -> DataFrame:
    """One table of one or more JSON-lines files; ``statistics`` is best read as a string."""
    return spark.read.schema(schema).json(paths)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON document that may span lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file, through Hadoop's file systems, with what it says in UTF-8."""
    write_bytes(spark, text.encode(), path)


def _file(spark: SparkSession, path: str):
    """(Hadoop's file system, its path) of a path."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _file(spark, path)
    return system.exists(target)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder; nothing where there is none."""
    system, target = _file(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []


def put(spark: SparkSession, text: str, path: str) -> bool:
    """Makes a small file whole or not at all; False, and nothing done, where there is one already."""
    system, target = _file(spark, path)
    part = f"{target.getParent()}/.{target.getName()}.{uuid.uuid4().hex}"
    write_text(spark, text, part)
    done = not system.exists(target) and system.rename(_file(spark, part)[1], target)
    if not done:
        system.delete(_file(spark, part)[1], False)
    return done


def ensure_folder(spark: SparkSession, path: str) -> None:
    system, target = _file(spark, path)
    system.mkdirs(target)


def prepend_line(spark: SparkSession, path: str, line: str) -> None:
    """Puts a line before the first of a small file."""
    old = spark.read.text(path, wholetext=True).first()
    write_text(spark, f"{line}\n{old[0] if old else ''}", path)


def remove_files(spark: SparkSession, folder: str, suffix: str) -> int:
    """Deletes the files of a folder whose names end so; how many there were."""
    system, target = _file(spark, folder)
    found = [s.getPath() for s in (system.listStatus(target) if system.exists(target) else []) if s.isFile() and s.getPath().getName().endswith(suffix)]
    return sum(system.delete(f, False) for f in found)


def write_bytes(spark: SparkSession, data: bytes, path: str) -> None:
    system, target = _file(spark, path)
    out = system.create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_document(df: DataFrame, path: str) -> None:
    """A result of at most DOCUMENT_ROWS rows as one file with one JSON document, indented by 4, non-ASCII kept; more rows are an error."""
    rows = df.select(F.to_json(F.struct(*(f"`{c}`" for c in df.columns)), {"ignoreNullFields": "false"})).limit(DOCUMENT_ROWS + 1).collect()
    if len(rows) > DOCUMENT_ROWS:
        raise ValueError(f"a document holds at most {DOCUMENT_ROWS} rows; write JSON lines instead")
    write_text(df.sparkSession, json.dumps([json.loads(r[0]) for r in rows], indent=4, ensure_ascii=False), path)


def read_config(spark: SparkSession, path: str) -> dict:
    """Options of a stage from a YAML (if PyYAML is there) or JSON file."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("reading YAML needs PyYAML; JSON options need nothing") from e
        return yaml.safe_load(text) or {}
    return json.loads(text)


def with_file(rows: DataFrame, path: str, files: DataFrame, folder: str) -> DataFrame:
    """The rows with ``_found``, the columns of ``files`` (path, ...) but its path, or null: of the file at the same place below ``folder``, else (the folder may have moved) of the only file there with that name."""
    system, target = _file(rows.sparkSession, folder)
    root = re.sub(SCHEME, "", system.makeQualified(target).toString()).rstrip("/")

    def below(c: str) -> Column:
        return F.regexp_replace(F.regexp_replace(c, SCHEME, ""), f"^\\Q{root}\\E/+", "")

    def name(c: str) -> Column:
        return F.element_at(F.split(c, "/"), -1)

    values = F.struct(*(c for c in files.columns if c != "path"))
    files = cut(files.select(below("path").alias("_below"), name("path").alias("_name"), values.alias("_value")), "files", result=True)
    alone = files.groupBy("_name").agg(F.count("*").alias("_n"), F.first("_value").alias("_only")).where("_n = 1").drop("_n")
    asked = rows.withColumns({"_below": below(path), "_name": name(path)})
    met = asked.join(files.drop("_name"), "_below", "left").join(alone, "_name", "left")
    return met.select(*(met[f"`{c}`"] for c in rows.columns), F.coalesce("_value", "_only").alias("_found"))


def measure_files(spark: SparkSession, paths: DataFrame, folder: str, path_col: str = "path") -> DataFrame:
    """Rows (path, lines, characters) of every path asked for: lines that aren't blank, characters of the stripped text; 0 where there is no such file. Files are matched as by ``with_file``."""
    text = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    files = text.select(F.col("_metadata.file_path").alias("path"), X.line_count(F.col("value")).cast("long").alias("lines"), X.char_count(F.col("value")).cast("long").alias("characters"))
    asked = with_file(paths.select(F.col(path_col).alias("path")), "path", files, folder)
    return asked.select("path", *(F.coalesce(f"_found.{c}", F.lit(0).cast("long")).alias(c) for c in ("lines", "characters")))


def _arrow_file(path: str):
    """(Arrow's file system, its path) of a path with or without a scheme."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def copy_pictures(rows: DataFrame, path_col: str, group: str, folder: str, out: str) -> DataFrame:
    """Copies the files that rows (path, group) name to ``out``/group/place below ``folder``; rows (source, target), one a file and group. Files are matched as by ``with_file``; what isn't there is left out, and so are empty files, which Spark doesn't list.

    The executors copy, each file under a name of its own first and then renamed, so a task that runs again replaces a
    copy by an equal one, and a task that dies leaves no part of a file among the copies.
    """
    spark = rows.sparkSession
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("path").alias("source"))
    found = with_file(rows.select(path_col, group), path_col, listed, folder).where("_found IS NOT NULL").select(F.col(group).alias("group"), "_found.source").distinct()
    system, root = _file(spark, folder)
    root = re.sub(SCHEME, "", system.makeQualified(root).toString()).rstrip("/")
    system, target = _file(spark, out)
    to = system.makeQualified(target).toString().rstrip("/")
    ship(spark)

    def copy(batches):
        for batch in batches:
            targets = []
            for kind, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = re.sub(SCHEME, "", source).removeprefix(root).lstrip("/")
                goal = f"{to}/{kind}/{place}"
                (there, origin), (here, final), (_, part) = _arrow_file(source), _arrow_file(goal), _arrow_file(f"{to}/_parts/{uuid.uuid4().hex}")
                for name in (final, part):
                    here.create_dir(name.rsplit("/", 1)[0], recursive=True)
                with there.open_input_stream(origin) as data, here.open_output_stream(part) as sink:
                    while chunk := data.read(1 << 20):
                        sink.write(chunk)
                here.move(part, final)
                targets.append(goal)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(targets, pa.string())], ["source", "target"])

    done = cut(found.mapInArrow(copy, "source string, target string"), "copies", result=True)
    drop(spark, f"{to}/_parts")
    return done


def in_order(rows: DataFrame, place: str) -> DataFrame:
    """Rows read from files with their ``place``, from 0, in the order of the files' names and of the lines."""
    where = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()}
    return numbered(rows.select("*", *(c.alias(n) for n, c in where.items())), [], list(where), place).drop(*where)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, height, width, channels, data) of decoded image files (PNG, JPEG and what else the JVM reads); a file that can't be decoded has a height of -1."""
    rows = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    return rows.select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data")


def catalogue(spark: SparkSession, text: str) -> DataFrame:
    """The category catalogue from the text of its JSON document {key: {...}}: a few hundred rows at most."""
    rows = [{"category_key": k, **{f.name: v.get(f.name, (v.get("benchmark") or {}).get(f.name)) for f in CATALOGUE.fields[1:]}} for k, v in json.loads(text).items()]
    return spark.createDataFrame(rows, CATALOGUE)


def category_queries(cat: DataFrame) -> DataFrame:
    """A row for each search query of each category; absent and empty lists give none."""
    return cat.select("category_key", F.posexplode("search_queries").alias("pos", "query"))


def with_terms(cat: DataFrame) -> DataFrame:
    return cat.where(F.col("terms_semantic").isNotNull())


def statistics_text(stats: str):
    """Statistics as JSON text, {} by default."""
    return F.coalesce(F.to_json(stats), F.lit("{}"))


def write_routes(df: DataFrame, route: str, path: str) -> None:
    """One folder for each route."""
    df.write.mode("overwrite").partitionBy(route).json(path)


def report_row(columns: dict[str, str]):
    """Columns as strings with a decimal comma and four digits for a ``;``-separated report."""
    return [X.decimal_comma(F.col(c)).alias(c) if kind == "double" else F.col(c).cast("string").alias(c) for c, kind in columns.items()]


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)
