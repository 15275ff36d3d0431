"""WARC records in ZIP-packaged archives: a writer, and a reader that never extracts.

The writer's archives hold ``archive/data.warc.gz``, stored and not deflated (one
gzip member a record, as WARC readers expect), and ``indexes/index.cdxj`` (sorted
lines of a reversed host and path, a time, and JSON with the record's offset,
length and file). The reader takes any ZIP: it checks and parses the end record,
the ZIP64 end record and the central directory, locates the stored ``*.warc`` and
``*.warc.gz`` members and the ``*.cdxj`` or ``*.cdx`` indexes (deflated or gzipped ones
too), and reads single records by byte range; records of a member that no index
names are found by one pass over it. A deflated archive member has no byte
ranges: it raises an error, as do files that are cut off.

Of pages with equal payloads, the one of the largest id is a ``response``; the
others are ``revisit`` records that refer to it and keep the HTTP header, and
with it the full payload's length.

Semantics for odd input: a null payload is empty, and empty payloads count as
equal; a null url is written as no WARC-Target-URI; rows that repeat the largest
id with an equal payload are responses too; a null id is never the largest, and
is a response only where its payload has no other id; an empty table makes no
archive and an empty result; payloads are written whole, very long ones alone.
Only the columns named are read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, remove, scratch_path

#: An archive is closed once its records reach this size.
ARCHIVE_BYTES = 64 << 20
#: Bytes of an index read at once.
INDEX_BYTES = 1 << 20
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payload digests of several pages that are broadcast at most (some 60 bytes each).
MAX_BROADCAST_DIGESTS = 500_000
#: Pages of one payload that one task joins at most, where digests are too many to broadcast.
MAX_COPIES = 10_000
#: Bytes of archives that one task reads, about.
TASK_BYTES = 32 << 20
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# ---- records


def make_record(page_id: int | None, url: str | None, payload: bytes, date: str, refers_to: int | None) -> bytes:
    """A response or revisit record as bytes, without compression."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_REVISIT}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URL_SAFE = "".join(map(chr, range(33, 127)))


def surt(url: str) -> str:
    """The sort key of a url: host labels from the last one, then path and query, in lower case."""
    rest = url.split("://", 1)[-1].lower()
    host, slash, path = rest.partition("/")
    return ",".join(reversed(host.split("@")[-1].split(":")[0].split("."))) + ")/" + path if slash or host else rest


@dataclass
class Record:
    header: dict[str, str]  # names in lower case
    http: dict[str, str]
    payload: bytes

    @staticmethod
    def parse(data: bytes) -> Record:
        head, end, rest = data.partition(b"\r\n\r\n")
        if not head.startswith(b"WARC/") or not end:
            raise ValueError(f"not a WARC record: {head[:40]!r}")
        header = _fields(head)
        size = int(header["content-length"])
        if len(rest) < size:
            raise ValueError("the record is cut off")
        block = rest[:size]
        if not header.get("content-type", "").startswith("application/http"):
            return Record(header, {}, block)
        http, _, payload = block.partition(b"\r\n\r\n")
        return Record(header, _fields(http), payload)


def _fields(head: bytes) -> dict[str, str]:
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, colon, value in lines if colon}


def _page(urn: str | None) -> int | None:
    """The id in a record's name; others' records have none."""
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


# ---- ZIP


class StoredZip:
    """Writes a ZIP of stored members front to back, with ZIP64 fields throughout."""

    def __init__(self, out: io.RawIOBase) -> None:
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """The sizes follow the data, in a descriptor."""
        self.name, self.start, self.crc, self.size = name.encode(), self.at, 0, 0
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 8, 0, 0, 33, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(self.name), 20) + self.name + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, data: bytes) -> None:
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        self._put(data)

    def end(self) -> None:
        self._put(struct.pack("<IIQQ", 0x08074B50, self.crc, self.size, self.size))
        self.members.append((self.name, self.start, self.crc, self.size))

    def close(self) -> None:
        at = self.at
        for name, start, crc, size in self.members:
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 8, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 28, 0, 0, 0, 0, 0xFFFFFFFF) + name + struct.pack("<HHQQQ", 1, 24, size, size, start))
        length, n, end = self.at - at, len(self.members), self.at
        self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, length, at))
        self._put(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), 0xFFFFFFFF, 0xFFFFFFFF, 0))


# The columns of classic index lines without a header, by their number.
CDX_LETTERS = {11: "NbamskrMSVg", 9: "NbamskrVg"}


class ZipRanges:
    """The members of a ZIP file, found through its directory and read by range."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        tail_at = max(0, size - 65557)
        tail = self._read(tail_at, size - tail_at)
        # An end record is one whose comment reaches the end of the file.
        end = len(tail)
        while (end := tail.rfind(b"PK\x05\x06", 0, end)) >= 0:
            if end + 22 <= len(tail) and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail):
                break
        if end < 0:
            raise ValueError("no end record: not a ZIP file, or cut off")
        _, _, _, _, n, length, at, _ = struct.unpack_from("<IHHHHIIH", tail, end)
        locator = end - 20
        if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
            where = struct.unpack_from("<Q", tail, locator + 8)[0]
            wide = self._read(where, 56)
            if wide[:4] != b"PK\x06\x06" or len(wide) < 56:
                raise ValueError("broken ZIP64 end record")
            n, length, at = struct.unpack_from("<QQQ", wide, 32)
        #: Of each member: where its data begins, its packed size, and whether it is stored.
        self.members: dict[str, tuple[int, int, bool]] = {}
        directory, pos = self._read(at, length), 0
        for _ in range(n):
            if len(directory) < pos + 46 or directory[pos : pos + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            _, _, _, _, method, _, _, _, packed, size, n_name, n_extra, n_note, _, _, _, start = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, pos)
            name = directory[pos + 46 : pos + 46 + n_name].decode("utf-8", "replace")
            extra = directory[pos + 46 + n_name : pos + 46 + n_name + n_extra]
            pos += 46 + n_name + n_extra + n_note
            size, packed, start = self._wide(extra, size, packed, start)
            head = self._read(start, 30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError(f"{name}: broken local header")
            self.members[name] = start + 30 + sum(struct.unpack_from("<HH", head, 26)), packed, method == 0

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """Values that are all ones stand in the ZIP64 extra field, in order."""
        at, out = 0, list(values)
        while at + 4 <= len(extra):
            tag, length = struct.unpack_from("<HH", extra, at)
            if tag == 1:
                pos = at + 4
                for i, v in enumerate(out):
                    if v == 0xFFFFFFFF:
                        out[i] = struct.unpack_from("<Q", extra, pos)[0]
                        pos += 8
            at += 4 + length
        return out

    def _read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def archives(self) -> list[str]:
        found = [n for n in self.members if n.lower().endswith((".warc", ".warc.gz"))]
        for n in found:
            if not self.members[n][2]:
                raise ValueError(f"{n}: a deflated archive member has no byte ranges")
        return found

    def indexes(self) -> list[str]:
        return [n for n in self.members if n.lower().endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz"))]

    def _parts(self, name: str) -> Iterator[bytes]:
        """A member's bytes, a part at a time; deflated and gzipped ones are inflated, of the latter all gzip members one after the other."""
        start, size, stored = self.members[name]
        deflated = None if stored else zlib.decompressobj(-15)
        gzipped = zlib.decompressobj(31) if name.lower().endswith(".gz") else None
        fresh = True  # no gzip member has begun
        for at in range(0, size, INDEX_BYTES):
            part = self._read(start + at, min(INDEX_BYTES, size - at))
            if deflated:
                part = deflated.decompress(part)
            if not gzipped:
                yield part
            while gzipped and part:
                yield gzipped.decompress(part)
                fresh, part = gzipped.eof, gzipped.unused_data
                if fresh:
                    gzipped = zlib.decompressobj(31)
        if deflated and not deflated.eof or gzipped and not fresh:
            raise ValueError(f"{name} is cut off")

    def lines(self, name: str) -> Iterator[str]:
        """The lines of a text member."""
        rest = b""
        for part in self._parts(name):
            *full, rest = (rest + part).split(b"\n")
            yield from (x.decode("utf-8", "replace") for x in full)
        if rest:
            yield rest.decode("utf-8", "replace")

    def range(self, name: str, offset: int, length: int) -> bytes:
        start, size, _ = self.members[name]
        if offset < 0 or length < 0 or offset + length > size:
            raise ValueError("range beyond the member")
        return self._read(start + offset, length)

    def _entries(self, index: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of the lines of an index: those with JSON, and classic ones by their header's letters (file g, offset V, length S)."""
        letters: list[str] | None = None
        for line in self.lines(index):
            told = line.find("{")
            if told >= 0:
                entry = json.loads(line[told:])
                found = entry.get("filename", ""), entry.get("offset"), entry.get("length")
            elif line.lstrip().startswith("CDX "):
                letters = line.split()[1:]
                continue
            else:
                fields = line.split()
                by = dict(zip(letters or CDX_LETTERS.get(len(fields), ""), fields, strict=False))
                found = by.get("g", ""), by.get("V"), by.get("S")
            if str(found[1]).isdigit() and str(found[2]).isdigit():
                yield str(found[0]), int(found[1]), int(found[2])

    def records(self) -> Iterator[tuple[str, int, int]]:
        """(member, offset, length) of every record, once: by the indexes, and by a pass over what no index covers."""
        archives = self.archives()
        by_file = {n.rsplit("/", 1)[-1]: n for n in archives}
        told: dict[str, dict[int, int]] = {n: {} for n in archives}
        for index in self.indexes():
            for file, offset, length in self._entries(index):
                member = by_file.get(file.rsplit("/", 1)[-1]) or (archives[0] if len(archives) == 1 else None)
                if member is not None:
                    told[member].setdefault(offset, length)
        for member in archives:
            passed, at = self._gzipped if member.lower().endswith(".gz") else self._plain, 0
            for offset, length in sorted(told[member].items()):
                if offset > at:
                    yield from ((member, a, n) for a, n in passed(member, at, offset))
                yield member, offset, length
                at = max(at, offset + length)
            yield from ((member, a, n) for a, n in passed(member, at, self.members[member][1]))

    def _gzipped(self, name: str, low: int, high: int) -> Iterator[tuple[int, int]]:
        """The gzip members between two places."""
        start = self.members[name][0]
        began, z = low, zlib.decompressobj(31)
        for at in range(low, high, 1 << 16):
            part = self._read(start + at, min(1 << 16, high - at))
            end = at + len(part)
            while part:
                z.decompress(part)
                part = z.unused_data
                if z.eof:
                    yield began, end - len(part) - began
                    began, z = end - len(part), zlib.decompressobj(31)
        if began < high:
            raise ValueError(f"{name} is cut off")

    def _plain(self, name: str, low: int, high: int) -> Iterator[tuple[int, int]]:
        """The records between two places of a member that is not compressed."""
        at = low
        while at < high:
            head, end, _ = self.range(name, at, min(1 << 16, high - at)).partition(b"\r\n\r\n")
            if not end:
                raise ValueError(f"{name} is cut off")
            n = len(head) + 4 + int(_fields(head)["content-length"]) + 4
            yield at, min(n, high - at)
            at += n


# ---- Spark


def _index_line(row: dict, payload: bytes, date: str, offset: int, length: int) -> bytes:
    url = f"urn:page:{row['page_id']}" if row["url"] is None else quote(row["url"], safe=_URL_SAFE)
    told = {"url": url, "digest": f"sha1:{payload_digest(payload)}", "mime": "text/html" if row["refers_to"] is None else "warc/revisit", "status": "200", "offset": offset, "length": length, "filename": WARC_MEMBER.rsplit("/", 1)[-1]}
    return f"{surt(url)} {''.join(c for c in date if c.isdigit())} {json.dumps(told)}\n".encode()


def _writer(folder: str, date: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)
        out = zipped = None

        def finish() -> pa.RecordBatch:
            zipped.end()
            zipped.begin(INDEX_MEMBER)
            for line in sorted(index):
                zipped.write(line)
            zipped.end()
            zipped.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64()), pa.array([zipped.at], pa.int64())], names=["archive", "records", "bytes"])

        for batch in batches:
            for row in batch.to_pylist():
                if zipped is None:
                    # A name of its own for every attempt: a retried or doubled task never writes to a file that another one has open.
                    name, index = f"{uuid.uuid4().hex}.zip", []
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(f"{top}/{name}")
                    zipped = StoredZip(out)
                    zipped.begin(WARC_MEMBER)
                payload = row["payload"] or b""
                record = make_record(row["page_id"], row["url"], payload, date, row["refers_to"])
                gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = gz.compress(record) + gz.flush()
                index.append(_index_line(row, payload, date, zipped.size, len(packed)))
                zipped.write(packed)
                if zipped.size >= archive_bytes:
                    yield finish()
                    zipped = None
        if zipped is not None:
            yield finish()

    return write


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every page as a record into ZIP archives below ``folder``; gives the manifest (archive, records, bytes).

    Payloads of at least ``least_bytes`` bytes are deduplicated. Only archives
    in the manifest count: those that failed or doubled attempts left are removed.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.encode(html, "utf-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.when(F.length("payload") >= least_bytes, F.unhex(F.sha1("payload"))))
    # Only payloads that several ids share need to meet their response, and only their digests travel for that.
    several = cut(rows.where("digest IS NOT NULL").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    digests, copies = several.agg(F.count("*"), F.sum("n")).first()
    if digests <= MAX_BROADCAST_DIGESTS:
        told = rows.join(F.broadcast(several), "digest", "left")
    else:
        # So many copies that no more than MAX_BROADCAST_DIGESTS payloads have them; the others shuffle.
        many = F.col("n") > max(MAX_COPIES, copies // MAX_BROADCAST_DIGESTS)
        marked = rows.join(F.broadcast(several.where(many).withColumnRenamed("first", "_first")), "digest", "left")
        told = marked.where("n IS NOT NULL").withColumn("first", F.col("_first")).drop("_first", "n").unionByName(marked.where("n IS NULL").drop("_first", "n").join(several.where(~many).drop("n"), "digest", "left"))
    refers: Column = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    told = told.select("page_id", "url", "payload", refers.alias("refers_to"))
    manifest = f"{folder}/manifest"
    told.mapInArrow(_writer(f"{folder}/archives", date, archive_bytes), "archive string, records long, bytes long").write.parquet(manifest)
    written = spark.read.parquet(manifest)
    there = find_archives(spark, f"{folder}/archives") if written.head(1) else None
    if there is not None:
        name = F.element_at(F.split("archive", "/"), -1)
        for r in there.select("archive", name.alias("n")).join(written.select(name.alias("n")), "n", "left_anti").toLocalIterator():
            remove(spark, r["archive"])
    return written


def find_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The ZIP files of a folder as a manifest (archive, bytes)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{zip,wacz}").load(folder).select(F.col("path").alias("archive"), F.col("length").alias("bytes"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """Reads archives back: page_id, url, payload_bytes, payload_digest, record_type, refers_to, archive, member, offset, length.

    Every archive's directory and index are read first, and the records that
    they name are then dealt out as byte ranges. Records of others have no
    page_id; a revisit without an HTTP length has no payload_bytes.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                store, path = _open(archive)
                with store.open_input_file(path) as f:
                    records = ZipRanges(f).records()
                    while found := list(islice(records, 50_000)):
                        yield pa.RecordBatch.from_arrays([pa.array([archive] * len(found), pa.string()), *(pa.array([x[i] for x in found], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64())))], names=["archive", "member", "offset", "length"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        held = file = zipped = None
        for batch in batches:
            out = []
            for archive, member, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != held:
                    if file is not None:
                        file.close()
                    store, path = _open(archive)
                    held, file = archive, store.open_input_file(path)
                    zipped = ZipRanges(file)
                data = zipped.range(member, offset, length)
                r = Record.parse(zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data)
                revisit = r.header.get("warc-type") == "revisit"
                algorithm, _, digest = r.header.get("warc-payload-digest", "").partition(":")
                if algorithm.lower() != "sha1":
                    digest = None if revisit else payload_digest(r.payload)
                elif not revisit and payload_digest(r.payload) != digest:
                    raise ValueError(f"{archive} at {offset}: the payload is not what its digest says")
                size = int(r.http["content-length"]) if revisit and r.http.get("content-length", "").isdigit() else None if revisit else len(r.payload)
                out.append((_page(r.header.get("warc-record-id")), r.header.get("warc-target-uri"), size, digest, r.header.get("warc-type"), _page(r.header.get("warc-refers-to")), archive, member, offset, length))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(kind)], schema=kind)
        if file is not None:
            file.close()

    spark = manifest.sparkSession
    total = manifest.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes") if "bytes" in manifest.columns else F.lit(0).alias("bytes")).first()
    cores = spark.sparkContext.defaultParallelism
    ranges = manifest.select("archive").repartition(max(1, min(total["n"], 64 * cores)), "archive").mapInArrow(index, "archive string, member string, offset long, length long")
    dealt = ranges.repartition(max(cores, (total["bytes"] or 0) // TASK_BYTES), "archive", "member", F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("archive", "member", "offset")
    return dealt.mapInArrow(records, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, member string, offset long, length long")


def archive_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")
