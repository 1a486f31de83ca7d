"""WARC archives: a writer that leaves equal payloads out, and a salvage reader.

Writer: payloads are digested by SQL functions; of equal payloads of DEDUP_BYTES or more the one with the largest page_id is a
response, the others revisit it and carry no payload. Only thin rows (id, digest) are grouped by digest; the pages
themselves are joined by page. Each task writes archives of about ARCHIVE_BYTES to the shared folder, one gzip member
for each record, under names of its own attempt; only archives of committed tasks are in the manifest.

Reader: streams an archive (gzip members or plain) and checks each record: member checksum and end, version line, header,
content length, record end and payload digest. After a failed check it searches for the next place where a valid member or
version line begins, goes on from there, and logs the bytes in between as a quarantined gap with the reason. A payload may hold
version lines: a record is read to its announced end and judged there. Memory is bounded by the largest record; a wrong length
inside a member holds that member's rest, up to that length. In a member of several records the search goes on in the decompressed
bytes, and a gap's reason tells its place there. A record found by it counts only if a version line or the member's end
follows, since a damaged page may quote records.

Defined cases: null html is an empty payload; null url is an empty target; null page_id is written as a response that nothing refers
to; repeated rows are a record each, and all rows of a group's largest page_id are responses; an empty table gives no archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

DEDUP_BYTES, ARCHIVE_BYTES, CHUNK = 1000, 8 << 20, 1 << 16
MANIFEST = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
RECORDS = pa.schema([("archive", pa.string()), ("status", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
RECORDS_DDL = "archive string, status string, start bigint, end bigint, reason string, headers map<string, string>, payload binary"
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
VERSION_LINE = re.compile(rb"WARC/1\.\d\r\n[!-9;-~]+:")  # and the first header
NO_ID = "none"
READ_BYTES = 64 << 20  # of archives in a reading task


def urn(page_id: int | None) -> str:
    return f"<urn:page:{NO_ID if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    """The page of an id that urn() made; None for others, as foreign archives have them."""
    found = re.fullmatch(r"<urn:page:(-?\d{1,19})>", name or "")
    return int(found[1]) if found and -(1 << 63) <= int(found[1]) < 1 << 63 else None


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, sha1: bytes, size: int, refers: int | None) -> bytes:
    """One record. sha1 and size are those of the full payload, which a revisit leaves out."""
    target = "".join(ch for ch in url or "" if ch not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers)}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


class Bad(Exception):
    """A failed check. size: that of the record, if it ends where it announces, else 0. past: place in the archive up to which
    version lines have been read already, in a member's stored blocks."""

    def __init__(self, reason: str, size: int = 0, past: int = 0):
        super().__init__(reason)
        self.size, self.past = size, past


def head(data: bytes, at: int = 0, seen: int = 0) -> tuple[dict[str, str], int, int] | None:
    """Headers and places where the payload of the record that begins at `at` begins and ends; None if more data is needed. The first
    `seen` bytes are known to hold no header's end. A header may have any length."""
    if len(data) - at < len(VERSION):
        if VERSION.startswith(data[at:]):
            return None
        raise Bad("no version line")
    if not data.startswith(VERSION, at):
        raise Bad("no version line")
    end = data.find(b"\r\n\r\n", max(at, seen - 3))
    if end < 0:
        return None
    headers: dict[str, str] = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name.strip() != name:
            raise Bad("malformed header")
        headers[name.decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("Content-Length", "")
    if not (length.isascii() and length.isdigit()):
        raise Bad("no content length")
    return headers, end + 4, end + 4 + int(length)


def parsed(data: bytes, got: tuple[dict[str, str], int, int], at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record that begins at `at`, whose head() is known and which is wholly there."""
    headers, start, stop = got
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Bad("no record end after the content")
    payload = bytes(memoryview(data)[start:stop])
    digest = headers.get("WARC-Payload-Digest", "")
    if headers.get("WARC-Type") != "revisit" and digest.startswith("sha1:") and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest[5:]:
        raise Bad("payload digest differs", stop + 4 - at)
    return headers, payload, stop + 4


def cut_off(data: bytes, got: tuple | None) -> Bad:
    """Why the record that begins the data, after which there is no more, isn't complete."""
    return Bad("content length passes the next record" if got and data.find(b"\r\n\r\n" + VERSION, got[1]) >= 0 else "record is cut off")


class Unpacked:
    """The decompressed bytes of the member at `at`: held from byte `begin` on; `broken` tells why there are no more, unless the
    member ended well."""

    def __init__(self, bytes_at, at: int):
        self.bytes_at, self.place, self.z = bytes_at, at, zlib.decompressobj(31)
        self.held, self.begin, self.broken = bytearray(), 0, None

    def has(self, n: int) -> bool:
        """Whether n bytes are held, after reading on for them."""
        while len(self.held) < n and not self.z.eof and not self.broken:
            some, before = self.bytes_at(self.place, CHUNK), self.z.copy()
            self.place += len(some)
            try:
                self.held += self.z.decompress(some)
            except zlib.error as e:
                self.broken = f"member: {e}"
                with contextlib.suppress(zlib.error):  # what comes before the error
                    self.place -= len(some)
                    for i in range(len(some)):
                        self.place += 1
                        self.held += before.decompress(some[i : i + 1])
            if not some:
                self.broken = "member is cut off"
        return len(self.held) >= n

    def drop(self, n: int) -> None:
        self.begin += min(n, len(self.held))
        del self.held[:n]

    def to_version(self) -> bool:
        """Goes to the next version line, if there is one."""
        while True:
            i = self.held.find(VERSION)
            self.drop(i if i >= 0 else max(0, len(self.held) - len(VERSION) + 1))
            if i < 0:
                if not self.has(len(self.held) + 1):
                    return False
            else:
                self.has(CHUNK)
                if VERSION_LINE.match(self.held):
                    return True
                self.drop(1)

    def record(self) -> tuple[dict[str, str], bytes, int]:
        """The record that begins here. Its header is read once, then the bytes that it announces."""
        known, seen = None, 0
        while (known := head(self.held, seen=seen)) is None:
            seen = len(self.held)
            if not self.has(seen + 1):
                raise cut_off(self.held, None)
        if not self.has(known[2] + 4):
            raise cut_off(self.held, known)
        return parsed(self.held, known)


class Salvager:
    """Records and gaps of one archive, read through a seekable file."""

    def __init__(self, f, size: int):
        self.f, self.size, self.known = f, size, {}

    def bytes_at(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def find(self, what: bytes, at: int) -> int:
        """Next place of `what` at or after `at`; the archive's size if there is none. A place found before is remembered, so that
        gap after gap the archive is searched once."""
        asked, found = self.known.get(what, (0, -1))
        if asked <= at <= found:
            return found
        self.known[what] = at, self.searched(what, at)
        return self.known[what][1]

    def searched(self, what: bytes, at: int) -> int:
        while at < self.size:
            some = self.bytes_at(at, CHUNK + len(what) - 1)
            i = some.find(what)
            if i >= 0:
                return at + i
            at += CHUNK
        return self.size

    def member(self, at: int):
        """("record", headers, payload) of each record of the member and ("gap", first byte, end, reason) between them, in
        decompressed bytes; then ("end", where the member ends). A record is held back until more data follows or the
        member's checksum is found good; the last of several needs its own checks only."""
        u, last, seen, lost, reason = Unpacked(self.bytes_at, at), None, 0, None, None
        while u.has(1) and (lost is None or u.to_version()):
            try:
                headers, payload, end = u.record()
                u.has(end + len(VERSION))
                if lost is not None and not VERSION.startswith(u.held[end : end + len(VERSION)]):
                    raise Bad("not followed by a record")
            except Bad as e:
                if lost is None:
                    lost, reason = u.begin, str(e)
                u.drop(e.size or 1)
                continue
            if last:
                yield "record", *last
            if lost is not None:
                yield "gap", lost, u.begin, reason
            last, lost = (headers, payload), None
            seen += 1
            u.drop(end)
        if not seen:
            raise Bad(u.broken or reason or "empty member")
        if last and (not u.broken or seen > 1 or lost is not None):
            yield "record", *last
        elif u.broken:
            raise Bad(u.broken)
        if u.broken:
            raise Bad(f"{reason if lost is not None else u.broken}; bytes before {u.begin if lost is None else lost} of the member were read", past=u.place)
        if lost is not None:
            yield "gap", lost, u.begin + len(u.held), reason
        yield "end", u.place - len(u.z.unused_data)

    def plain(self, at: int):
        held, place, known, seen = bytearray(), at, None, 0
        while known is None:
            some = self.bytes_at(place, CHUNK)
            place += len(some)
            held += some
            known = head(held, seen=seen)
            if known is None and not some:
                raise Bad("record is cut off")
            seen = len(held)
        end = known[2] + 4
        if at + end > self.size:
            raise Bad("content length passes the end of the archive")
        if self.bytes_at(at + end - 4, 4) != b"\r\n\r\n":
            raise Bad("no record end after the content")
        headers, payload, end = parsed(self.bytes_at(at, end), known)
        return headers, payload, at + end

    def begins(self, at: int) -> bool:
        """Whether a valid member or version line begins here."""
        head = self.bytes_at(at, CHUNK)
        if head.startswith(MAGIC):
            try:
                return zlib.decompressobj(31).decompress(head, len(VERSION)).startswith(VERSION)
            except zlib.error:
                return False
        return VERSION_LINE.match(head) is not None

    def items(self):
        """("record", start, end (None in a member), None, headers, payload) and ("gap", start, end (None in a member), reason, None, None) in order."""
        at = 0
        while at < self.size:
            start = at
            try:
                head = self.bytes_at(at, len(VERSION))
                if head.startswith(MAGIC):
                    for kind, *got in self.member(at):
                        if kind == "record":
                            yield "record", start, None, None, *got
                        elif kind == "gap":
                            yield "gap", start, None, f"{got[2]}; bytes {got[0]} to {got[1]} of the member", None, None
                        else:
                            at = got[0]
                elif head == VERSION:
                    headers, payload, end = self.plain(at)
                    yield "record", start, end, None, headers, payload
                    at = end
                else:
                    raise Bad("neither a member nor a version line")
            except Bad as e:
                nxt = start + 1
                while True:
                    nxt = min(self.find(MAGIC, nxt), self.find(VERSION, max(nxt, e.past)))
                    if nxt >= self.size or self.begins(nxt):
                        break
                    nxt += 1
                yield "gap", start, nxt, str(e), None, None
                at = nxt


def opened(path: str):
    fs, inner = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
    return fs, inner


def read_archives(archives: DataFrame) -> DataFrame:
    """archives(path) -> a row per record and per quarantined gap, with its place in the archive."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, inner = opened(path)
                size = fs.get_file_info(inner).size
                with fs.open_input_file(inner) as f:
                    rows, held = [], 0
                    for status, start, end, reason, headers, payload in Salvager(f, size).items():
                        rows.append((path, status, start, end, reason, list(headers.items()) if headers else None, payload))
                        held += len(payload or b"") + 500
                        if held > c.GROUP_BYTES:
                            yield c.rows_of(RECORDS, list(zip(*rows)))
                            rows, held = [], 0
                    if rows:
                        yield c.rows_of(RECORDS, list(zip(*rows)))

    return archives.select("path").mapInArrow(run, RECORDS_DDL)


def written(folder: str, archive_bytes: int):
    def run(batches):
        task = TaskContext.get()
        fs, inner = opened(folder)
        fs.create_dir(inner, recursive=True)
        out, held, number, size, records = None, [], 0, 0, 0

        def close():
            nonlocal out, number, size, records
            out.close()
            held.append((f"{folder}/{name(number)}", size, records))
            out, number, size, records = None, number + 1, 0, 0

        name = lambda k: f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{k:04d}.warc.gz"
        for batch in batches:
            cols = [batch.column(x).to_pylist() for x in ("page_id", "url", "payload", "digest", "payload_bytes", "refers_to")]
            for page_id, url, payload, digest, n, refers in zip(*cols):
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = record("response" if refers is None else "revisit", page_id, url, payload or b"", bytes.fromhex(digest), n, refers)
                data = z.compress(raw) + z.flush()
                out = out or fs.open_output_stream(f"{inner}/{name(number)}", compression=None)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= archive_bytes:
                    close()
        if out:
            close()
        if held:
            yield c.rows_of(MANIFEST, list(zip(*held)))

    return run


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """pages(page_id, url, html) -> manifest(path, bytes, records) of the archives, which are written when this returns."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    thin = pages.filter(f"payload_bytes >= {DEDUP_BYTES} and page_id is not null").select("page_id", "digest").distinct().withColumn("h", F.xxhash64("digest"))
    heads = c.cut(thin.groupBy("h", "digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1"), "op4-heads")
    again = c.join_counted(thin, heads, ["h", "digest"], "n", ["refers_to"], ["page_id"]).filter("page_id <> refers_to").drop("h")
    records = pages.join(again, ["page_id", "digest"], "left")
    records = records.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    made = records.select("page_id", "url", "payload", "digest", "payload_bytes", "refers_to").mapInArrow(written(folder, archive_bytes), "path string, bytes bigint, records bigint")
    return c.cut(made, "op4-manifest")


def archive_parts(manifest: DataFrame) -> int:
    """Tasks that read the archives: by the archives' bytes, not by the manifest's."""
    return c.parts_by(manifest.agg(F.sum("bytes")).first()[0], READ_BYTES, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def query(spark, sf_dir: str) -> DataFrame:
    folder = f"{c.shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    manifest = write_archives(c.table(spark, sf_dir, "pages"), folder)
    read = read_archives(manifest.repartition(archive_parts(manifest), "path"))
    return digests(read, whole=True)


def digests(read: DataFrame, whole: bool = False) -> DataFrame:
    """A row for each page read back: response digests and lengths come from the payload itself, those of revisits from their headers.
    whole: a gap is an error, as in archives just written."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        for batch in batches:
            out = []
            for status, reason, headers, payload in zip(*(batch.column(x).to_pylist() for x in ("status", "reason", "headers", "payload"))):
                if status != "record":
                    if whole:
                        raise ValueError(f"an archive just written has a gap: {reason}")
                    continue
                h = dict(headers)
                if h["WARC-Type"] == "response":
                    n, sha1 = len(payload), hashlib.sha1(payload).hexdigest()
                else:
                    n, sha1 = int(h["X-Payload-Length"]), base64.b32decode(h["WARC-Payload-Digest"][5:]).hex()
                out.append((page_of(h["WARC-Record-ID"]), n, sha1, h["WARC-Type"], page_of(h.get("WARC-Refers-To"))))
            if out:
                yield c.rows_of(schema, list(zip(*out)))

    return read.select("status", "reason", "headers", "payload").mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN h.head <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN h.head <> p.page_id THEN h.head END AS refers_to
FROM p LEFT JOIN h ON p.payload_digest = h.payload_digest AND p.payload_bytes >= 1000
"""
