"""WARC archives: written with one gzip member a record, read back by a sequential reader that checks every digest."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.batches import as_bytes, cut, partitions, shared_folder, tidied

#: Bytes that a reader takes at once, of an archive and of what it unpacks; a header may have as many.
READ_BYTES = 1 << 16
#: Bytes after which a task starts another archive.
ROLL_BYTES = 256_000_000
#: A payload of more than this share of all pages is hot: there are at most as many hot payloads as its inverse, which go to all tasks.
HOT_SHARE = 1 / 1000
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
END = b"\r\n\r\n"


class CorruptArchive(ValueError):
    """An archive that breaks off, or whose framing or digests are wrong."""


def digest(data: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, payload_digest: str, serial: str = "") -> str:
    """The id of a record; one without a serial is what revisits of that payload refer to."""
    return f"<urn:page:{'none' if page_id is None else page_id}:{payload_digest}{':' if serial else ''}{serial}>"


def record(kind: str, page_id: int | None, serial: str, uri: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP head alone, with the digest and length of the full payload."""
    head, own = HTTP_HEAD % len(payload), digest(payload)
    block = head if kind == "revisit" else head + payload
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, own, serial)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        *([("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))] if uri else []),
        ("WARC-Payload-Digest", f"sha1:{own}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("X-Payload-Length", str(len(payload))),
        *([("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, own))] if kind == "revisit" else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + END) + z.flush()


class _Member:
    """A gzip member, unpacked bit by bit; `left` holds bytes of the archive that were read but not used yet."""

    def __init__(self, stream: BinaryIO, left: bytes):
        self.stream, self.left, self.z, self.ready = stream, left, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Unpacks up to READ_BYTES more; False at the member's end."""
        while not self.z.eof:
            self.left = self.left or self.stream.read(READ_BYTES)
            if not self.left:
                raise CorruptArchive("the archive ends within a member")
            try:
                got = self.z.decompress(self.left, READ_BYTES)
            except zlib.error as e:
                raise CorruptArchive(str(e)) from None
            self.left = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                self.ready += got
                return True
        return False

    def head(self, what: str) -> bytes:
        """Everything before an empty line, which is passed over."""
        while END not in self.ready:
            if len(self.ready) > READ_BYTES or not self.more():
                raise CorruptArchive(f"the {what} does not end")
        head, _, self.ready = self.ready.partition(END)
        return head

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in parts."""
        while n:
            if not self.ready and not self.more():
                raise CorruptArchive("Content-Length leads beyond the end of the record")
            part, self.ready = self.ready[:n], self.ready[n:]
            n -= len(part)
            yield part

    def close(self) -> bytes:
        """What of the archive follows; the member must hold two line ends and nothing else now."""
        while len(self.ready) <= len(END) and self.more():
            pass
        if self.ready != END:
            raise CorruptArchive("Content-Length does not lead to the end of the record")
        return self.left


def _number(fields: dict[str, str], name: str) -> int:
    value = fields.get(name, "")
    if not re.fullmatch("[0-9]+", value):
        raise CorruptArchive(f"{name} is no number: {value!r}")
    return int(value)


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def scan(stream: BinaryIO, keep: bool = False) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(header fields in lower case, block if it is to be kept, length of the payload) of each record of an archive, in order.

    Members are unpacked READ_BYTES at a time and framed by Content-Length as they come, so that a record of any length takes
    little memory unless its block is kept. Two line ends must follow the block; the digests of block and payload, the
    payload's length in the record's header and that in the HTTP head must be those found. A revisit has no payload of its
    own: its HTTP head, which the block's digest covers, says how long it is. Anything else raises CorruptArchive.
    """
    left = b""
    while left or (left := stream.read(READ_BYTES)):
        member = _Member(stream, left)
        first, *lines = member.head("record's header").decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise CorruptArchive("a member does not start with a WARC header")
        fields = _fields(lines)
        block, payload, held, kept, size, head = hashlib.sha1(), hashlib.sha1(), b"", [], 0, None
        for part in member.take(_number(fields, "content-length")):
            block.update(part)
            if keep:
                kept.append(part)
            if head is None:
                held += part
                if END in held:
                    text, _, part = held.partition(END)
                    head, held = _fields(text.decode("utf-8", "replace").split("\r\n")[1:]), b""
                elif len(held) > READ_BYTES:
                    raise CorruptArchive("the HTTP head does not end")
            if head is not None:
                payload.update(part)
                size += len(part)
        left = member.close()
        said = lambda h: f"sha1:{base64.b32encode(h.digest()).decode()}"
        if fields.get("warc-block-digest") != said(block):
            raise CorruptArchive("the block's digest is wrong")
        if head is None:
            raise CorruptArchive("the HTTP head does not end")
        if fields.get("warc-type") == "revisit":
            if size:
                raise CorruptArchive("a revisit holds a payload")
            size = _number(head, "content-length")
        elif fields.get("warc-payload-digest") != said(payload):
            raise CorruptArchive("the payload's digest is wrong")
        if {_number(head, "content-length"), _number(fields, "x-payload-length")} != {size}:
            raise CorruptArchive("the payload's length is wrong")
        yield fields, b"".join(kept), size


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an archive, in order; see scan()."""
    return ((fields, block) for fields, block, _ in scan(stream, keep=True))


def _store(folder: str) -> tuple[object, str]:
    """The file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    if folder.startswith("file:") or "://" not in folder:
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def write(pages: DataFrame, folder: str, *, least: int = 0, roll: int = ROLL_BYTES, id_column: str = "page_id", uri_column: str = "url", payload_column: str = "html") -> None:
    """Writes a record for each page to archives in folder, which driver and executors must share, and a table that names them.

    Of pages with equal payloads of at least `least` bytes the one with the largest id is a response, the others are
    revisits that refer to it; shorter ones are all responses. A null payload is empty. Pages without an id are responses;
    so is each of several rows with the same, largest id: the first of them in a task has the record id that revisits name
    (rows of one id and payload that are dealt to several tasks are copies of one record and share it).

    The payloads go through one shuffle, by their digest. The at most 1 / HOT_SHARE payloads that many pages share go to all
    tasks instead (digest and id), and their pages are dealt evenly. A task starts another archive after `roll` bytes.
    An archive counts once the table `manifest` names it, which Spark commits when all tasks are done; what attempts that
    failed left behind is never read.
    """
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(uri_column).cast("string").alias("uri"), F.coalesce(F.col(payload_column), F.lit("")).alias("payload")).withColumn("key", F.sha2("payload", 256))
    counted = rows.where(F.octet_length("payload") >= least).groupBy("key").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1")
    counted = cut(counted)
    most = max(1000.0, pages.count() * HOT_SHARE)
    hot = counted.where(F.col("n") > most).select("key", F.col("last").alias("hot_last"))
    cold = counted.where(F.col("n") <= most).select(F.col("key").alias("deal"), "last")
    n = partitions(pages)
    even = F.concat(F.lit("even "), F.xxhash64("id", "uri", F.monotonically_increasing_id()).cast("string"))
    dealt = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left").withColumn("deal", F.when(F.col("hot"), even).otherwise(F.col("key")))
    joined = dealt.repartition(n, "deal").join(cold.repartition(n, "deal").hint("shuffle_hash"), "deal", "left").withColumn("last", F.coalesce("hot_last", "last"))
    joined = joined.select("id", "uri", "payload", F.when(F.col("id") < F.col("last"), F.col("last")).alias("refers_to"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, (store, path) = TaskContext.get(), _store(folder)
        out, done, n, held, serial, before = None, [], 0, 0, 0, None

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((name(), n, held))
                out = None

        name = lambda: f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):05d}.warc.gz"
        for b in batches:
            for page_id, uri, payload, refers_to, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if out is None:
                    store.create_dir(path, recursive=True)
                    out, n, held = store.open_output_stream(f"{path}/{name()}", compression=None), 0, 0
                named = refers_to is None and page_id is not None and (page_id, key) != before
                before = (page_id, key) if refers_to is None else before
                put = record("response" if refers_to is None else "revisit", page_id, "" if named else f"{task.partitionId()}-{serial}", uri, payload, refers_to)
                out.write(put)
                n, held, serial = n + 1, held + len(put), serial + 1
                if held >= roll:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [[]] * 3, (pa.string(), pa.int64(), pa.int64()))], ["name", "records", "bytes"])

    joined.sortWithinPartitions("id", "key", "uri").mapInArrow(tidied(run), "name string, records long, bytes long").write.parquet(f"{folder}/manifest")


def read(spark, folder: str) -> DataFrame:
    """A row for each record of the archives that folder's manifest names: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Archives are opened by path and read from start to end, a bit at a time, each by one task; one that is damaged, or does
    not hold as many records as were written, fails the query.
    """
    number = re.compile(r"<urn:page:(-?\d+)")
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        send = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))
        for b in batches:
            for name, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, found = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for fields, _, size in scan(stream):
                        own, other = number.match(fields["warc-record-id"]), number.match(fields.get("warc-refers-to", ""))
                        rows.append((int(own[1]) if own else None, size, fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], int(other[1]) if other else None))
                        found += 1
                        if len(rows) >= 10_000:
                            yield send(rows)
                            rows = []
                if found != records:
                    raise CorruptArchive(f"{name} holds {found} records, not {records}")
                if rows:
                    yield send(rows)

    manifest = spark.read.parquet(f"{folder}/manifest")
    return manifest.select("name", "records").repartition(max(1, manifest.count())).mapInArrow(tidied(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes pages to a new folder below the shared one (or to the one given) and returns what the reader finds there.

    An empty table writes no archive and gives no rows. A folder that was not given goes when the driver ends.
    """
    spark = pages.sparkSession
    to = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    if folder is None:
        path = spark._jvm.org.apache.hadoop.fs.Path(to)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
    write(pages, to, **options)
    return read(spark, to)
