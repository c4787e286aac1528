"""A paged remote table as a stream, a sink that holds each batch once, and duplicates across batches."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.sources import pages
from millrace.streaming import ledger


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("hub")
    (root / "r1" / "train").mkdir(parents=True)
    at = 0
    for i, n in enumerate((30, 1, 44)):
        rows = pa.table({"id": list(range(at, at + n)), "text": [None if j % 9 == 0 else f"row {j}" for j in range(at, at + n)], "more": [[j] for j in range(n)]})
        pq.write_table(rows, root / "r1" / "train" / f"part-{i}.parquet", row_group_size=13)
        at += n
    return str(root)


@pytest.fixture
def service():
    """100 rows; every third request fails and every fourth answer is cut short."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            asked = {k: v[0] for k, v in parse_qs(url.query).items()}
            seen.append((url.path, asked))
            if len(seen) % 3 == 0:
                self.send_error(503)
                return
            if url.path == "/t/info":
                body = json.dumps({"rows": 100, "schema": "id long, text string"})
            else:
                at, n = int(asked["offset"]), int(asked["length"])
                n -= len(seen) % 4 == 0
                body = "".join(json.dumps({"id": i, "text": f"é {i}\\n" if i % 7 else None}) + "\n" for i in range(at, at + n))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/t", seen
    server.shutdown()


def test_pages_of_a_folder(spark, folder):
    rows = pages.read_pages(spark, folder, "r1", "train", page_rows=7)
    assert rows.rdd.getNumPartitions() == 11 and dict(rows.dtypes)["more"] == "array<bigint>"
    assert sorted(r["id"] for r in rows.collect()) == list(range(75))
    assert rows.where("text IS NULL").count() == 9


def test_pages_of_a_service(spark, service):
    url, seen = service
    rows = pages.read_pages(spark, url, "main", page_rows=30).collect()
    assert sorted((r["id"], r["text"]) for r in rows) == [(i, f"é {i}\\n" if i % 7 else None) for i in range(100)]
    assert all(a["revision"] == "main" for _, a in seen) and {int(a["offset"]) for p, a in seen if p == "/t/rows"} == {0, 30, 60, 90}


def test_a_service_that_stays_away_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(pages, "WAIT_S", 0.0)
    with pytest.raises(Exception, match="refused|URLError"):
        pages.HttpStore("http://127.0.0.1:9", {}).rows()


class Killed(Exception):
    pass


@pytest.mark.parametrize("when", ["before the entry", "after the entry"])
def test_a_killed_stream_gives_each_row_once(spark, folder, tmp_path, monkeypatch, when):
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    real, calls = ledger.Ledger.commit, []

    def commit(self, key, name):
        calls.append(key)
        if len(calls) == 3 and when == "before the entry":
            raise Killed(key)
        done = real(self, key, name)
        if len(calls) == 3:
            raise Killed(key)
        return done

    def start():
        return ledger.drain(pages.stream_pages(spark, folder, marks, "r1", "train", page_rows=4, batch_rows=10), out, marks, lambda rows: rows.withColumn("n", F.length("text")))

    monkeypatch.setattr(ledger.Ledger, "commit", commit)
    with pytest.raises(Exception, match="Killed"):
        start()
    sink = ledger.Ledger(spark, out)
    done = sink.read("id long").count()
    assert done == (20 if when == "before the entry" else 30)
    start()
    rows = sink.read("id long, text string, n int").collect()
    assert sorted(r["id"] for r in rows) == list(range(75)) and len(sink.folders()) == 8
    assert all(r["n"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    assert sink.sweep() == (1 if when == "before the entry" else 0) and sink.read("id long").count() == 75
    before = sorted(sink.folders())
    start()
    assert sorted(sink.folders()) == before


def test_a_restart_keeps_batches_bounded(spark, folder, tmp_path):
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    query = pages.stream_pages(spark, folder, marks, "r1", "train", batch_rows=20).writeStream.format("json").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    at = pages.reached(spark, marks)
    assert 0 < at <= 20
    sink = ledger.drain(pages.stream_pages(spark, folder, marks, "r1", "train", batch_rows=20), str(tmp_path / "more"), marks)
    assert sorted(r["id"] for r in sink.read("id long").collect()) == list(range(at, 75)) and len(sink.folders()) == -(-(75 - at) // 20)


def test_two_streams_share_a_sink(spark, folder, tmp_path):
    for name in "ab":
        sink = ledger.drain(pages.stream_pages(spark, folder, str(tmp_path / name), "r1", "train", batch_rows=50), str(tmp_path / "out"), str(tmp_path / name))
    assert sorted(r["id"] for r in sink.read("id long").collect()) == sorted([*range(75)] * 2)


def test_an_empty_ledger(spark, tmp_path):
    sink = ledger.Ledger(spark, str(tmp_path / "none"))
    assert sink.read("id long").count() == 0 and sink.sweep() == 0


def test_a_page_of_a_large_row_group_comes_in_small_steps(tmp_path):
    """What a task holds of a folder's page doesn't grow with the row group."""
    pq.write_table(pa.table({"i": list(range(5000)), "text": ["x" * 50] * 5000}), tmp_path / "a.parquet")
    store = pages.FolderStore(str(tmp_path), {})
    found = list(store.page(1100, 2100, store.schema()))
    assert [x for b in found for x in b.column(0).to_pylist()] == list(range(1100, 2100))
    assert max(b.num_rows for b in found) <= 128 and max(b.get_total_buffer_size() for b in found) < 50_000
