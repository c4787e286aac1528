"""A bounded remote table as a stream or a batch: a data source that reads pages of rows by their numbers.

The source knows how many rows there are and fetches any range of them, so an offset is a row number, every page of a
batch is a task of its own, and a page that is read again gives the same rows. Two kinds of stores are built in: HTTP
services that answer ``info`` and ``rows`` (``http://...``), and folders of Parquet files by revision and split on any
file system that Arrow reads (everything else). Pages are fetched by executors only; the driver asks for the number of
rows and, for folders, reads the files' footers.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from millrace.session import ship
from millrace.sources import io

NAME = "millrace_pages"
PAGE_ROWS = 1000
BATCH_ROWS = 10_000
TRIES = 4
WAIT_S = 0.2
#: A folder's page is decoded so many rows at a time, from so large a buffer: what a task holds doesn't grow with a file's row groups.
STEP_ROWS = 128
BUFFER_BYTES = 2**20


class HttpStore:
    """GET {url}/info gives {"rows": n, "schema": ddl}; GET {url}/rows?offset=i&length=n gives n rows as JSON lines. ``revision`` and ``split`` are passed on. A failed or short answer is asked for again TRIES times."""

    def __init__(self, url: str, options: dict):
        self.url, self.asked = url.rstrip("/"), {k: options[k] for k in ("revision", "split") if k in options}

    def _get(self, name: str, **more) -> str:
        url = f"{self.url}/{name}?{urllib.parse.urlencode(self.asked | more)}"
        for turn in range(TRIES):
            try:
                with urllib.request.urlopen(url, timeout=60) as answer:
                    return answer.read().decode()
            except (urllib.error.URLError, ConnectionError, TimeoutError) as e:
                if turn == TRIES - 1 or (isinstance(e, urllib.error.HTTPError) and e.code < 500):
                    raise
                time.sleep(WAIT_S * 2**turn)
        raise AssertionError

    def rows(self) -> int:
        return int(json.loads(self._get("info"))["rows"])

    def schema(self) -> str:
        return json.loads(self._get("info"))["schema"]

    def page(self, start: int, end: int, schema: StructType) -> Iterator[tuple]:
        for turn in range(TRIES):
            lines = [x for x in self._get("rows", offset=start, length=end - start).split("\n") if x]
            if len(lines) == end - start:
                break
            time.sleep(WAIT_S * 2**turn)
        else:
            raise OSError(f"{self.url}: {len(lines)} rows instead of {end - start} from row {start} on")
        for line in lines:
            row = json.loads(line)
            yield tuple(row.get(n) for n in schema.names)


class FolderStore:
    """Parquet files in {path}, or in {path}/{revision}/{split} as far as these are given; rows are numbered in the order of file names."""

    def __init__(self, path: str, options: dict):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.system, self.root = system, "/".join([root.rstrip("/"), *(options[k] for k in ("revision", "split") if k in options)])

    def _groups(self) -> list[tuple[str, int, int]]:
        """(file, row group, rows) in order."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        info = self.system.get_file_info(self.root)
        files = [info] if info.is_file else self.system.get_file_info(fs.FileSelector(self.root))
        out = []
        for f in sorted(x.path for x in files if x.is_file and x.path.endswith(".parquet")):
            meta = pq.read_metadata(f, filesystem=self.system)
            out += [(f, g, meta.row_group(g).num_rows) for g in range(meta.num_row_groups)]
        return out

    def rows(self) -> int:
        return sum(n for *_, n in self._groups())

    def schema(self) -> StructType:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(pq.read_schema(self._groups()[0][0], filesystem=self.system).remove_metadata())

    def page(self, start: int, end: int, schema: StructType) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        at = 0
        for path, group, n in self._groups():
            if at < end and at + n > start:
                with self.system.open_input_file(path) as f:
                    here = at
                    for batch in pq.ParquetFile(f, buffer_size=BUFFER_BYTES).iter_batches(STEP_ROWS, row_groups=[group], columns=schema.names, use_threads=False):
                        a, b = max(start - here, 0), min(end - here, batch.num_rows)
                        if a < b:
                            yield batch.slice(a, b - a).select(schema.names)
                        here += batch.num_rows
                        if here >= end:
                            break
            at += n


def store(options: dict):
    path = options["path"]
    return (HttpStore if path.startswith(("http://", "https://")) else FolderStore)(path, options)


@dataclass
class Page(InputPartition):
    start: int
    end: int


class _Reader:
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema_, self.page_rows = dict(options), schema, int(options.get("pagerows", PAGE_ROWS))

    def pages(self, start: int, end: int) -> list[Page]:
        return [Page(i, min(i + self.page_rows, end)) for i in range(start, end, self.page_rows)]

    def read(self, partition: Page) -> Iterator:
        return store(self.options).page(partition.start, partition.end, self.schema_)


class PageReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Page]:
        return self.pages(0, store(self.options).rows()) or [Page(0, 0)]


class PageStreamReader(_Reader, DataSourceStreamReader):
    """A batch ends ``batchRows`` after the last. Where a stream begins is only told once its first batch has an end, so ``resume`` says it; without it that batch goes to the end of the table."""

    def __init__(self, options: dict, schema: StructType):
        super().__init__(options, schema)
        self.step = int(options.get("batchrows", BATCH_ROWS))
        self.at = int(options["resume"]) if "resume" in options else None

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        rows = store(self.options).rows()
        return {"row": rows if self.at is None else min(max(rows, self.at), self.at + self.step)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.at = end["row"]
        return self.pages(start["row"], end["row"])


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str | StructType:
        return store(self.options).schema()

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options, schema)

    def streamReader(self, schema: StructType) -> PageStreamReader:
        return PageStreamReader(self.options, schema)


def _options(spark: SparkSession, revision: str | None, split: str | None, page_rows: int) -> dict:
    ship(spark)
    spark.dataSource.register(PageSource)
    return {"pageRows": page_rows} | {k: v for k, v in (("revision", revision), ("split", split)) if v is not None}


def read_pages(spark: SparkSession, path: str, revision: str | None = None, split: str | None = None, page_rows: int = PAGE_ROWS) -> DataFrame:
    """The whole table, a task a page."""
    return spark.read.format(NAME).options(**_options(spark, revision, split, page_rows)).load(path)


def reached(spark: SparkSession, checkpoint: str) -> int:
    """The row at which the last batch planned by a stream with this checkpoint ends, 0 for a new one."""
    names = [n for n in io.names(spark, f"{checkpoint}/offsets") if n.isdigit()]
    if not names:
        return 0
    lines = spark.read.text(f"{checkpoint}/offsets/{max(names, key=int)}", wholetext=True).first()[0].split("\n")
    return int(json.loads(lines[2])["row"])


def stream_pages(spark: SparkSession, path: str, checkpoint: str, revision: str | None = None, split: str | None = None, page_rows: int = PAGE_ROWS, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """The table as a stream of batches of ``batch_rows`` rows that goes on where the one with this checkpoint stopped."""
    options = _options(spark, revision, split, page_rows) | {"batchRows": batch_rows}
    return spark.readStream.format(NAME).options(**options | {"resume": reached(spark, checkpoint)}).load(path)
