"""Event logs behind a cursor, as streams: an interface that gives the events after one with a known id.

The offset is the time and id of the last event taken. A page is read in order, up
to the first event that is younger than ``min_age_ms``, as the log's order settles
only then. Where the log does not know the id any more, the stream starts over from
the log's beginning; what comes again is told by id further on (``dedup_messages``).
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

#: Events of a request, and requests of a batch at most.
PAGE, PAGES = 500, 20
#: An event that is younger waits.
MIN_AGE_MS = 60_000


class UnknownCursor(Exception):
    """The log does not know the id that it was asked to go on from."""


class Log:
    """A log over HTTP: ``<url>?after_guid=<id>&results-per-page=<n>`` gives ``{"resources": [{"metadata": {"guid", "created_at"}, "entity": ...}]}``, and 400 or 404 for an unknown id."""

    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.token = options["url"], options.get("token")

    def after(self, guid: str, n: int) -> list[tuple[str, int, str]]:
        """(id, time in ms, JSON) of up to n events after one (from the first on, if it is empty), in the log's order."""
        query = {"results-per-page": n} | ({"after_guid": guid} if guid else {})
        request = urllib.request.Request(f"{self.url}?{urllib.parse.urlencode(query)}", headers={"Authorization": f"bearer {self.token}"} if self.token else {})
        try:
            with urllib.request.urlopen(request, timeout=60) as response:
                found = json.load(response)["resources"]
        except urllib.error.HTTPError as e:
            if guid and e.code in (400, 404):
                raise UnknownCursor(guid) from e
            raise
        return [(x["metadata"]["guid"], int(x["metadata"]["created_at"]), json.dumps(x)) for x in found]


class CursorReader(SimpleDataSourceStreamReader):
    def __init__(self, log: Log, options: dict[str, str]) -> None:
        self.log = log
        self.page, self.pages = int(options.get("page", PAGE)), int(options.get("pages", PAGES))
        self.min_age = int(options.get("minAgeMs", MIN_AGE_MS))
        self.first = {"time": -1, "guid": options.get("afterGuid", "")}

    def initialOffset(self) -> dict:
        return self.first

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end, oldest = [], start, time.time() * 1000 - self.min_age
        try:
            found = self.log.after(start["guid"], self.page)
        except UnknownCursor:
            end, found = {"time": -1, "guid": ""}, self.log.after("", self.page)
        for left in reversed(range(self.pages)):
            ripe = [e for i, e in enumerate(found) if all(t <= oldest for _, t, _ in found[: i + 1])]
            rows += ripe
            if ripe:
                end = {"time": ripe[-1][1], "guid": ripe[-1][0]}
            if len(ripe) < self.page or not left:
                break
            found = self.log.after(end["guid"], self.page)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same events again, after a restart; from the log's beginning, where that was started over from or the id has gone since."""
        at, last = start["guid"], end["guid"]
        while at != last:
            try:
                found = self.log.after(at, self.page)
            except UnknownCursor:
                at, found = "", self.log.after("", self.page)
            if not found:
                raise ValueError(f"the log has no event {last} any more")
            for event in found:
                yield event
                at = event[0]
                if at == last:
                    return

    def commit(self, end: dict) -> None:
        pass


class EventCursor(DataSource):
    """``spark.readStream.format("event_cursor")`` with url and, if need be, token, page, pages, minAgeMs and afterGuid; for another kind of log override ``log``."""

    @classmethod
    def name(cls) -> str:
        return "event_cursor"

    def schema(self) -> str:
        return "guid string, created_at long, event string"

    def log(self) -> Log:
        return Log(dict(self.options))

    def simpleStreamReader(self, schema: StructType) -> CursorReader:
        return CursorReader(self.log(), dict(self.options))


def read_event_log(spark: SparkSession, url: str, schema: StructType, **options: str | int) -> DataFrame:
    """A stream of the log's events with the columns of ``schema`` (``schemas.APP_EVENT`` or ``SERVICE_EVENT``)."""
    spark.dataSource.register(EventCursor)
    reader = spark.readStream.format("event_cursor").option("url", url)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load().select(F.from_json("event", schema).alias("e")).select("e.*")
