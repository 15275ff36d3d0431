"""An event log over HTTP as a stream: stop, restart, reset, and events that are too young."""

import json
import threading
import time
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from usagemill import schemas
from usagemill.sources.cursor import CursorReader, Log, UnknownCursor, read_event_log


class Server:
    """A log of events that a test adds to, or cuts at the front."""

    def __init__(self):
        self.events, self.asked = [], []
        log = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                q = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
                log.asked.append(q)
                ids = [e["metadata"]["guid"] for e in log.events]
                after = q.get("after_guid")
                if after is not None and after not in ids:
                    self.send_error(404)
                    return
                at = ids.index(after) + 1 if after else 0
                body = json.dumps({"resources": log.events[at : at + int(q["results-per-page"])]}).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.http.server_port}/v2/app_usage_events"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()

    def add(self, n, at=None):
        for _ in range(n):
            i = len(self.asked_ids())
            self.events.append({"metadata": {"guid": f"g{i}", "created_at": at or 1_000_000 + i}, "entity": {"state": "STARTED", "app_guid": f"app{i % 3}", "instance_count": i}})
            self.made = i

    def asked_ids(self):
        return range(getattr(self, "made", -1) + 1)


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()


def run(spark, server, tmp_path, **options):
    """Starts the stream where it stopped, takes what there is, and stops it; all guids so far."""
    stream = read_event_log(spark, server.url, schemas.APP_EVENT, page=4, minAgeMs=1000, **options)
    q = stream.select("metadata.guid", "metadata.created_at", "entity.instance_count").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    return sorted(int(r.guid[1:]) for r in rows)


def test_stop_restart_and_reset(spark, server, tmp_path):
    server.add(10)
    assert run(spark, server, tmp_path) == list(range(10))
    assert run(spark, server, tmp_path) == list(range(10))  # nothing new
    server.add(7)
    assert run(spark, server, tmp_path) == list(range(17))
    assert server.asked[-1]["after_guid"] == "g16"
    # The log drops its front, and with it the event that the stream stood at: it starts over, and what comes again is told by id.
    server.add(3)
    server.events = server.events[18:]
    again = run(spark, server, tmp_path)
    assert again == [*range(17), 18, 19]
    server.add(1)
    assert run(spark, server, tmp_path) == [*range(17), 18, 19, 20]
    server.events = [e | {"metadata": e["metadata"] | {"guid": e["metadata"]["guid"]}} for e in server.events[:2]]
    assert sorted(run(spark, server, tmp_path)) == [*range(17), 18, 18, 19, 19, 20]
    rows = spark.read.parquet(str(tmp_path / "out")).dropDuplicates(["guid"])
    assert rows.count() == 20 and rows.where(F.col("instance_count") == 20).count() == 1


def test_young_events_wait(server):
    server.add(3)
    server.add(1, at=int(time.time() * 1000) + 60_000)
    server.add(2)
    reader = CursorReader(Log({"url": server.url}), {"page": "10", "minAgeMs": "1000"})
    rows, end = reader.read(reader.initialOffset())
    assert [r[0] for r in rows] == ["g0", "g1", "g2"] and end == {"time": 1_000_002, "guid": "g2"}
    rows, same = reader.read(end)
    assert list(rows) == [] and same == end


def test_a_batch_is_read_again_as_it_was(server):
    server.add(9)
    reader = CursorReader(Log({"url": server.url}), {"page": "2", "pages": "3", "minAgeMs": "1000"})
    rows, end = reader.read(reader.initialOffset())
    first = list(rows)
    assert [r[0] for r in first] == [f"g{i}" for i in range(6)]
    server.add(5)
    assert list(reader.readBetweenOffsets(reader.initialOffset(), end)) == first
    assert list(reader.readBetweenOffsets(end, end)) == []
    server.events = server.events[3:]
    assert [r[0] for r in reader.readBetweenOffsets({"time": 0, "guid": "g1"}, end)] == ["g3", "g4", "g5"]  # what is left of it
    server.events = server.events[5:]
    with pytest.raises(ValueError, match="no event g5"):
        list(reader.readBetweenOffsets({"time": 0, "guid": "g1"}, end))
    with pytest.raises(UnknownCursor):
        reader.log.after("g1", 5)
