"""WARC archives: one gzip member per record, written and read as streams."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm._store import scratch_path, stored

#: Payloads from this size on are stored once; later records of the same payload revisit it.
REVISIT_BYTES = 1000
#: Compressed bytes that the reader takes at a time.
READ_BYTES = 1 << 18
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    """A record that breaks the format or doesn't match its digest."""


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", _digest(block)), ("Content-Length", str(len(block)))]) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 1) -> bytes:
    """A gzip member with the response record of a page, or a revisit record that names the response's page."""
    target = "".join(c for c in url or "" if c.isprintable()).strip()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", _digest(payload)),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("X-Refers-To-Page", str(refers_to))]
    head = _HEAD % len(payload)
    return _record(fields, head + (payload if refers_to is None else b""), level)


class _Inflater:
    """Decompresses a stream of gzip members, a member at a time, without holding the archive."""

    def __init__(self, source):
        self._source, self._raw, self._plain = source, b"", b""
        self._member = None

    def more_members(self) -> bool:
        """Move to the next member, if there is one."""
        if not self._raw:
            self._raw = self._source.read(READ_BYTES)
        self._plain, self._member = b"", zlib.decompressobj(31)
        return bool(self._raw)

    def _fill(self) -> bool:
        if self._member.eof:
            return False
        if not self._raw:
            self._raw = self._source.read(READ_BYTES)
            if not self._raw:
                raise ArchiveError("the archive ends within a record")
        try:
            self._plain += self._member.decompress(self._raw)
        except zlib.error as e:
            raise ArchiveError(f"broken gzip member: {e}") from e
        self._raw = self._member.unused_data
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self._plain.find(mark)) < 0:
            if not self._fill():
                raise ArchiveError("a record without an end of its header")
        out, self._plain = self._plain[: at + len(mark)], self._plain[at + len(mark) :]
        return out

    def exactly(self, n: int) -> bytes:
        parts, have = [self._plain], len(self._plain)
        self._plain = b""
        while have < n:
            if not self._fill():
                raise ArchiveError("a record is shorter than its content length")
            parts.append(self._plain)
            have += len(self._plain)
            self._plain = b""
        data = b"".join(parts)
        self._plain = data[n:]
        return data[:n]

    def at_end(self) -> bool:
        while not self._plain and self._fill():
            pass
        return not self._plain


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and verified block of each record, in order."""
    stream = _Inflater(source)
    while stream.more_members():
        lines = stream.until(b"\r\n\r\n").decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ArchiveError("not a WARC record")
        fields = {}
        for line in lines[1:]:
            name, colon, value = line.partition(":")
            if colon:
                fields[name.strip().lower()] = value.strip()
        try:
            length = int(fields["content-length"])
        except (KeyError, ValueError) as e:
            raise ArchiveError("a record without a content length") from e
        block = stream.exactly(length)
        if stream.exactly(4) != b"\r\n\r\n" or not stream.at_end():
            raise ArchiveError("a record is longer than its content length")
        if fields.get("warc-block-digest", "") not in ("", _digest(block)):
            raise ArchiveError("block digest differs")
        yield fields, block


def payload_of(fields: dict[str, str], block: bytes) -> bytes | None:
    """The verified payload of a response; None for a revisit."""
    if fields.get("warc-type") != "response":
        return None
    payload = block.partition(b"\r\n\r\n")[2]
    if fields.get("warc-payload-digest", "") not in ("", _digest(payload)):
        raise ArchiveError("payload digest differs")
    return payload


def with_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Columns ``page_id``, ``url``, ``html`` and ``refers_to`` (null for responses).

    Of pages with equal payloads of REVISIT_BYTES or more, the largest id is the
    response.  Digests are grouped with map-side combination; only those that
    occur more than once are joined back, as an equi-join whose hot digests
    adaptive execution can split.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"), html.alias("html"))
    long = F.octet_length("html") >= REVISIT_BYTES
    # short payloads get keys of their own, which meet nothing and spread over partitions
    keyed = rows.withColumn("key", F.when(long, F.sha1(F.col("html").cast("binary"))).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "html"))))
    copies = keyed.where(long).groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL")
    found = keyed.join(copies.select("key", "last"), "key", "left")
    refers = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return found.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, **columns) -> DataFrame:
    """Write one archive per partition; returns the manifest (``file``, ``records``).

    A task's archive has a name of its own, and the manifest (stored as Parquet)
    names only those of tasks that finished; an archive that a lost executor
    left behind is never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, records = None, 0
        for batch in batches:
            if batch.num_rows and sink is None:
                files, root = pafs.FileSystem.from_uri(path)
                files.create_dir(root, recursive=True)
                name = f"{uuid.uuid4().hex}.warc.gz"
                sink = files.open_output_stream(f"{root}/{name}", compression=None)
            for page_id, url, html, refers_to in zip(*batch.columns, strict=True):
                sink.write(page_record(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py()))
                records += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"], "records": pa.array([records], pa.int64())})

    return stored(with_revisits(pages, **columns).mapInArrow(run, "file string, records long"), "warc_manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row per record: ``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` and ``html`` (null for revisits)."""
    files_ = manifest.select("file").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "file")
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())]
    )

    def rows(file: str) -> Iterator[dict]:
        files, root = pafs.FileSystem.from_uri(file)
        with files.open_input_stream(root, compression=None) as source:
            for fields, block in read_records(source):
                payload = payload_of(fields, block)
                length = int(fields["x-payload-length"])
                if payload is not None and len(payload) != length:
                    raise ArchiveError("payload length differs")
                number = lambda name: int(fields[name]) if name in fields else None
                yield {
                    "page_id": number("x-page-id"),
                    "url": fields.get("warc-target-uri"),
                    "payload_bytes": length,
                    "payload_digest": base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex(),
                    "record_type": fields["warc-type"],
                    "refers_to": number("x-refers-to-page"),
                    "html": None if payload is None else payload.decode(),
                }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for file in batch.column(0).to_pylist():
                for row in rows(file):
                    held.append(row)
                    size += row["payload_bytes"] + 200
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return files_.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def round_trip(spark: SparkSession, pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write ``pages`` as archives and return what reading them back gives.

    A null html is an empty payload.  A null ``page_id`` is written without one
    and revisits the named page of the same payload, if any; rows that repeat
    the response's id are responses too.  Very long pages are read whole, one
    at a time.  An empty table writes nothing and gives an empty result; other
    columns are ignored.
    """
    return read_archives(write_archives(pages, path or scratch_path(spark, "warc"), **columns))
