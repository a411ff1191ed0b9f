"""WARC archives: written from a table of pages, and read back with salvage of damaged ones.

Writing: each task writes archives of up to ``ARCHIVE_BYTES``, one gzip member per record. An
archive has a name of its own for every attempt of a task, and the list of archives that Spark
commits names the attempts that count; what a lost executor leaves behind is in no list.
Of equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest id is a response,
the others are revisit records, which hold no payload and refer to it.

Reading: one task per archive reads it in windows, so only one record is held. A record
counts if its member, or its lines, length and end, and all its digests are right. After a failed
check the reader looks for the next place where a gzip member or a version line starts and
a whole record follows, goes on there, and reports the bytes in between as a gap with
the reason. Where the frame of a record is sound and only its content is not, the search
starts behind the frame, so records inside a payload are not taken for records of the archive.

Defined cases: a null payload is an empty one; a null or empty url has no Target-URI; control
characters and blanks of urls are percent-encoded; a null id counts as the largest and is read back as null;
rows that repeat the smallest id of a payload are responses too; payloads of any length are
whole, one at a time; an empty table gives no archive; other columns are not written, so their
names do not matter; a member with several records is reported as a gap; a
revisit whose response is lost has a null size.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from contentloom.operators.skew import salted_join
from contentloom.session import materialize, scratch_path

MIN_REVISIT = 100
ARCHIVE_BYTES = 256 << 20
# Bytes read from an archive at a time, and rows of about so many bytes sent on at a time.
WINDOW, SEND = 1 << 20, 8 << 20
# Bytes of a member unpacked at a time; what lies behind its end is copied, so they are few.
STEP = 1 << 14
MAX_HEADER = 1 << 16
# Lists of repeated payloads up to this size are sent to the pages.
SEND_BYTES = 16 << 20
# Copies of one payload that one task may take.
COPIES = 50_000
DATE = "2000-01-01T00:00:00Z"
# Fixed values of the format.
END, MAGIC, VERSION = b"\r\n\r\n", b"\x1f\x8b\x08", b"WARC/"
STARTS = re.compile(re.escape(MAGIC) + b"|" + VERSION)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "archive string, offset long, length long, kind string, reason string, type string, record_id string, target string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def typed(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``id``, ``url``, ``body``, its SHA-256 ``digest`` in hex and, for revisits, ``first``: the id of the response."""
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("body")).withColumn("digest", F.sha2("body", 256))
    long = rows.where(F.octet_length("body") >= MIN_REVISIT).select("id", "digest")
    copies = materialize(long.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first"), "copies")
    few = copies.count() * 128 <= SEND_BYTES
    met = rows.join(F.broadcast(copies), "digest", "left") if few else salted_join(rows, copies, ["digest"], ["id", "url"], task_rows=COPIES, measure=long)
    return met.withColumn("first", F.when(F.col("id").isNull() | (F.col("id") > F.col("first")), F.col("first")))


def _head(fields: list[tuple[str, str]]) -> bytes:
    return "".join(["WARC/1.1\r\n", *[f"{k}: {v}\r\n" for k, v in fields], "\r\n"]).encode()


def record(id: int | None, url: str | None, body: bytes, digest: str, first: int | None, date: str = DATE) -> bytes:
    """A response record, or a revisit record if ``first`` is given."""
    lines = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = lines if first is not None else lines + body
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    refers = [] if first is None else [("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", PROFILE)]
    return _head([
        ("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if id is None else id}>"), ("WARC-Date", date),
        *([("WARC-Target-URI", target)] if target else []), *refers, ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]) + block + END


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(pages: DataFrame, root: str, compress: bool = True, limit: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Write what ``typed`` returns; gives the list of archives: ``archive``, ``bytes``, ``records``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)
        out, name, size, n = None, "", 0, 0
        for batch in batches:
            for r in (row for cut in range(0, batch.num_rows, 64) for row in batch.slice(cut, 64).to_pylist()):
                data = record(r["id"], r["url"], r["body"].encode(), r["digest"], r["first"], date)
                data = member(data) if compress else data
                if out is not None and size + len(data) > limit:
                    out.close()
                    yield _row(root, name, size, n)
                    out = None
                if out is None:
                    store.create_dir(folder)
                    name = f"{uuid.uuid4().hex}.warc" + (".gz" if compress else "")
                    out, n = store.open_output_stream(f"{folder}/{name}", compression=None), 0
                    body = f"software: contentloom\r\nformat: WARC File Format 1.1\r\n".encode()
                    info = _head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body)))]) + body + END
                    info = member(info) if compress else info
                    out.write(info)
                    size = len(info)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield _row(root, name, size, n)

    return materialize(pages.select("id", "url", "body", "digest", "first").mapInArrow(make, "archive string, bytes long, records long"), "archives")


def _row(root: str, name: str, size: int, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"archive": [f"{root}/{name}"], "bytes": [size], "records": [n]})


class Damage(Exception):
    """A check that failed; ``resume`` is where the search for the next record starts."""

    def __init__(self, reason: str, resume: int):
        super().__init__(reason)
        self.reason, self.resume = reason, resume


def _same_digest(given: str, data: bytes) -> bool:
    """Whether a labelled digest, in hex or base32, fits; unknown algorithms are not checked."""
    name, _, value = given.strip().partition(":")
    if name.lower() not in ("sha1", "sha256", "md5"):
        return True
    found = hashlib.new(name.lower(), data)
    return value.lower() == found.hexdigest() or value.upper().rstrip("=") == base64.b32encode(found.digest()).decode().rstrip("=")


class Archive:
    """The records and gaps of one archive, read through a window."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def bytes(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at``, fewer at the end."""
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, WINDOW))
        return self.held[at - self.at:at - self.at + n]

    def some(self, at: int, least: int = 1) -> memoryview:
        """What is at hand from ``at`` on, read anew if that is less than ``least`` bytes."""
        if at >= self.size:
            return memoryview(b"")
        if not self.at <= at <= self.at + len(self.held) - min(least, self.size - at):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(WINDOW)
        return memoryview(self.held)[at - self.at:]

    def parts(self) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str]]:
        """Start, end, header fields (none for a gap), block and, for gaps, the reason."""
        at = 0
        while at < self.size:
            try:
                end, fields, block = self.one(at)
            except Damage as bad:
                start, reason, at = at, bad.reason, bad.resume
                while (at := self.candidate(at)) < self.size:
                    try:
                        end, fields, block = self.one(at)
                        break
                    except Damage as again:
                        at = again.resume
                yield start, at, None, b"", reason
                if at >= self.size:
                    return
            yield at, end, fields, block, ""
            at = end

    def candidate(self, at: int) -> int:
        """The next place from ``at`` on where a member or a version line may start; the size if there is none."""
        while at < self.size:
            end = at + len(self.some(at, len(VERSION)))
            found = STARTS.search(self.held, at - self.at)
            if found:
                return self.at + found.start()
            if end >= self.size:
                break
            at = end - len(VERSION) + 1
        return self.size

    def one(self, at: int) -> tuple[int, dict[str, str], bytes]:
        """The record that starts here: its end, fields and block."""
        start = self.bytes(at, len(VERSION))
        if start.startswith(MAGIC):
            end, data = self._member(at)
            fields, head = self._fields(data, end)
            n = self._length(fields, end)
            if len(data) != head + n + len(END) or not data.endswith(END):
                raise Damage("member and record differ in length", end)
            block = data[head:head + n]
        elif start == VERSION:
            data = self.bytes(at, MAX_HEADER)
            fields, head = self._fields(data, at + 1)
            n = self._length(fields, at + 1)
            end = at + head + n + len(END)
            if end > self.size:
                raise Damage("record ends behind the archive", at + 1)
            if self.bytes(end - len(END), len(END)) != END:
                raise Damage("no end of record", at + 1)
            block = self.bytes(at + head, n)
        else:
            raise Damage("no record starts here", at + 1)
        if not _same_digest(fields.get("warc-block-digest", ""), block):
            raise Damage("block digest differs", end)
        if fields["warc-type"] != "revisit" and not _same_digest(fields.get("warc-payload-digest", ""), payload_of(fields, block)):
            raise Damage("payload digest differs", end)
        return end, fields, block

    def _member(self, at: int) -> tuple[int, bytes]:
        unpack, out, here, known = zlib.decompressobj(31), [], at, 0
        most = None
        while not unpack.eof:
            data = self.some(here)[:STEP]
            if not data:
                raise Damage("member ends behind the archive", at + 1)
            here += len(data)
            while data and not unpack.eof:
                try:
                    out.append(unpack.decompress(data, WINDOW))
                except zlib.error:
                    raise Damage("damaged member", at + 1) from None
                data = unpack.unconsumed_tail
                known += len(out[-1])
                if most is None and known:
                    head = b"".join(out)
                    out = [head]
                    if not head.startswith(VERSION[:len(head)]):
                        raise Damage("member holds no record", at + 1)
                    if END in head or known > MAX_HEADER:
                        fields, size = self._fields(head, at + 1)
                        most = size + self._length(fields, at + 1) + len(END)
                if most is not None and known > most:
                    raise Damage("member is longer than its record", at + 1)
        return here - len(unpack.unused_data), b"".join(out)

    @staticmethod
    def _fields(data: bytes, resume: int) -> tuple[dict[str, str], int]:
        """Header fields and where the block starts."""
        end = data.find(END, 0, MAX_HEADER)
        if end < 0 or not re.match(rb"WARC/\d+\.\d+\r\n", data):
            raise Damage("no header", resume)
        text = data[:end].decode("utf-8", "replace")
        lines = re.sub(r"\r\n[ \t]+", " ", text).split("\r\n")[1:]
        named = [x.partition(":") for x in lines]
        fields = {k.lower(): v.strip() for k, _, v in named}
        # Half a header before a whole one would pass for a longer one otherwise.
        names = [k.lower() for k, _, _ in named if k.lower() != "warc-concurrent-to"]
        if not all(sep and re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", k) for k, sep, _ in named) or len(names) != len(set(names)):
            raise Damage("bad header line", resume)
        if "warc-type" not in fields or "warc-record-id" not in fields:
            raise Damage("header without type or id", resume)
        return fields, end + len(END)

    @staticmethod
    def _length(fields: dict[str, str], resume: int) -> int:
        n = fields.get("content-length", "")
        if not re.fullmatch(r"[0-9]{1,15}", n):
            raise Damage("no length", resume)
        return int(n)


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """A block without the header of its HTTP message."""
    if fields.get("content-type", "").replace(" ", "").startswith("application/http"):
        return block.partition(END)[2]
    return block


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All records and gaps of the archives named in ``archive``.

    ``kind`` is ``record`` or ``gap``; ``offset`` and ``length`` are its bytes in the archive. ``payload_digest``
    is bare SHA-256 in hex: computed, but for revisits as the record gives it.
    """
    kinds = pa.schema([(c, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for c, t in (x.split() for x in FIELDS.split(", "))])

    def rows(name: str) -> Iterator[dict]:
        store, path = fs.FileSystem.from_uri(name)
        with store.open_input_file(path) as file:
            for start, end, fields, block, reason in Archive(file, file.size()).parts():
                own = {"archive": name, "offset": start, "length": end - start, "kind": "record" if fields else "gap", "reason": reason or None}
                if fields:
                    own |= {"type": fields["warc-type"], "record_id": fields["warc-record-id"], "target": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to")}
                    if fields["warc-type"] == "revisit":
                        given = fields.get("warc-payload-digest", "")
                        own |= {"payload_digest": given.partition(":")[2] if given.lower().startswith("sha256:") else None}
                    else:
                        data = payload_of(fields, block)
                        own |= {"payload_digest": hashlib.sha256(data).hexdigest(), "payload_bytes": len(data), "payload": data if payloads else None}
                yield own

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                for own in rows(name):
                    held.append(own)
                    size += 512 + len(own.get("payload") or b"")
                    if size > SEND:
                        yield pa.RecordBatch.from_pylist(held, schema=kinds)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kinds)

    listed = archives.select("archive")
    return listed.repartition(max(1, listed.count())).mapInArrow(make, FIELDS)


def resolved(records: DataFrame) -> DataFrame:
    """Response and revisit records as pages: ``id``, payload size and digest, type and the id ``first`` that a revisit refers to."""
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    pages = records.where("kind = 'record' AND type IN ('response', 'revisit')").select(number("record_id").alias("id"), "payload_bytes", "payload_digest", "type", number("refers_to").alias("first"))
    whole = pages.where("type = 'response'").select(F.col("id").alias("first"), "payload_digest", F.col("payload_bytes").alias("of_response")).distinct()
    again = salted_join(pages.where("type = 'revisit'").drop("payload_bytes"), whole, ["first", "payload_digest"], ["id"])
    return pages.where("type <> 'revisit'").unionByName(again.withColumnRenamed("of_response", "payload_bytes"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back; the records are written once as a table without their payloads."""
    archives = write(typed(pages), scratch_path(pages.sparkSession, "warc"))
    return resolved(materialize(read(archives, payloads=False), "records"))
