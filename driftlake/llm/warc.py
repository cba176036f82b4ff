"""WARC archives whose records are compressed one by one with a dictionary made from them."""

from __future__ import annotations

import base64
import hashlib
import io
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.llm.shared import new_path, written

MAGIC = 0x184D2A5D
#: Records that a writer holds back to make its dictionary from, and their bytes at most; its size; bytes after which an archive is closed.
TRAIN_RECORDS, TRAIN_BYTES, DICT_BYTES, ARCHIVE_BYTES = 2000, 4 << 20, 64 << 10, 256 << 20
LEAST_REVISIT = 1000
#: Repeated payloads up to which their table (some 100 bytes a row) is broadcast.
BROADCAST_ROWS = 200_000
#: Schemes of Hadoop's file systems that the Python workers know by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """id, url, payload, n, digest, record_type, refers_to for every page.

    Of records with equal payloads of at least `least` bytes (null: empty), those with the largest id are responses, the others revisit it.
    Payloads are told apart by SHA-1, another hash and length. Without any id among them all are responses; repeated rows are alike. Only
    digests are shuffled: those that repeat, one row each, are counted and broadcast while they are BROADCAST_ROWS at most; more are met by a join of the pages that can
    be split where one payload holds many rows.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    keyed = rows.withColumns({"n": F.octet_length("payload").cast("long"), "digest": F.sha1("payload"), "other": F.xxhash64("payload")})
    keys = ["digest", "other", "n"]
    repeated = keyed.where(F.col("n") >= least).groupBy(*keys).agg(F.max("id").alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    first, _ = written(repeated, "repeated")
    joined = keyed.join(F.broadcast(first) if first.count() <= BROADCAST_ROWS else first, keys, "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.select("id", "url", "payload", "n", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page}:{digest}'.encode()).digest(), version=3)}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record. Control characters and blanks in a URL are percent-encoded; a null one is about:blank."""
    uri = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "about:blank")
    head = HTTP % len(payload)
    block = head if kind == "revisit" else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        lines.append(f"Page-Id: {page}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]):
    """A Zstandard dictionary made from records; where they are too few for training, their own last bytes; None without records."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, records)
    except zstandard.ZstdError:
        raw = b"".join(records)[-DICT_BYTES:]
        return zstandard.ZstdCompressionDict(raw, zstandard.DICT_TYPE_RAWCONTENT) if raw else None


def _file_system(uri: str):
    """File system and path for the workers: local folders, S3 (s3a too), gs, abfs, hdfs (which needs libhdfs on every machine) and dbfs (by its mount)."""
    from pyarrow import fs

    if uri.startswith("dbfs:/"):
        return fs.LocalFileSystem(), "/dbfs/" + uri.removeprefix("dbfs:").lstrip("/")
    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def write_archives(records: DataFrame, uri: str) -> DataFrame:
    """Writes the rows of decided() under uri and returns file, records, bytes of every archive.

    Each partition is one or more files: a leading skippable frame with the dictionary, made from the first records of the partition
    and compressed itself, then one frame per record. A lost task is run again and writes files of other names; only those
    in the table that is returned, which Spark commits once, count. Memory: a batch of rows, and the records for the dictionary.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, root = _file_system(uri)
        fs.create_dir(root, recursive=True)
        held: list[bytes] = []
        found: list[tuple[str, int, int]] = []
        tool, lead, out, name, count = None, b"", None, "", 0

        def start():
            nonlocal tool, lead
            d = dictionary(held)
            tool = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=True) if d else zstandard.ZstdCompressor(level=3)
            if d:
                packed = zstandard.ZstdCompressor(level=19).compress(d.as_bytes())
                lead = MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed

        def close():
            nonlocal out
            if out is not None:
                size = out.tell()
                out.close()
                found.append((name, count, size))
                out = None

        def put(data: bytes):
            nonlocal out, name, count
            if out is None:
                name, count = f"{root}/{uuid.uuid4().hex}.warc.zst", 0
                out = fs.open_output_stream(name, compression=None)
                out.write(lead)
            out.write(tool.compress(data))
            count += 1
            if out.tell() >= ARCHIVE_BYTES:
                close()

        size = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "payload", "digest", "record_type", "refers_to")]
            for values in zip(*columns, strict=True):
                page, url, payload, digest, kind, refers_to = (v.as_py() for v in values)
                data = record(page, url, payload, digest, kind, refers_to)
                if tool:
                    put(data)
                    continue
                held.append(data)
                size += len(data)
                if len(held) >= TRAIN_RECORDS or size >= TRAIN_BYTES:
                    start()
                    for x in held:
                        put(x)
                    held = []
        if held:
            start()
            for x in held:
                put(x)
        close()
        if found:
            files, counts, sizes = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["file", "records", "bytes"])

    sent = records.select("id", "url", F.col("payload").cast("binary").alias("payload"), "digest", "record_type", "refers_to")
    return written(sent.mapInArrow(write, "file string, records long, bytes long"), "archives")[0]


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.decode().partition(":")
            head[key.lower()] = value.strip()
        yield head, stream.read(int(head["content-length"]))


def open_archive(f) -> io.BufferedReader:
    """The records of an archive as one stream; its leading frame gives the dictionary."""
    import zstandard

    head = f.read(8)
    d = None
    if int.from_bytes(head[:4], "little") == MAGIC:
        raw = f.read(int.from_bytes(head[4:], "little"))
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            raw = zstandard.ZstdDecompressor().decompress(raw)
        d = zstandard.ZstdCompressionDict(raw)
    else:
        f.seek(0)
    tool = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()
    return io.BufferedReader(tool.stream_reader(f, read_across_frames=True), 1 << 20)


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(files: DataFrame, uri: str, payload: bool = True) -> DataFrame:
    """Every record of the archives in files (column file), with its payload if asked for (revisits: null). A response's payload is checked against its digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(uri)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, size = [], 0
                with fs.open_input_file(name) as f:
                    for head, block in parse(open_archive(f)):
                        http, _, body = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        kind = head["warc-type"]
                        n = int(http.rpartition(b"Content-Length: ")[2])
                        if kind == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != n):
                            raise ValueError(f"{name}: a payload does not have its digest")
                        page, first = head.get("page-id"), head.get("refers-to-page-id")
                        rows.append((page and int(page), head["warc-target-uri"], n, digest, kind, first and int(first), body if payload and kind == "response" else None))
                        size += len(body) if payload else 0
                        if len(rows) >= 5000 or size >= 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # A number of partitions that is named stays: the table of files is tiny, what each stands for is not.
    return files.select("file").repartition(max(1, files.count()), "file").mapInArrow(read, READ)


def archived(pages: DataFrame, **kwargs) -> tuple[DataFrame, str]:
    """Writes pages to a fresh folder in the shared one; the table of archives and the folder."""
    uri = new_path(pages.sparkSession, "warc")
    if uri.startswith("/"):
        uri = "file://" + os.path.abspath(uri)
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return write_archives(decided(pages, **kwargs), uri), uri
