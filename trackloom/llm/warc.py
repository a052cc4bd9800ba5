"""WARC archives of pages: written with their index, read back by coalesced byte ranges.

* ``write_archives`` decides which pages are responses and which revisit an equal payload,
  writes one record per page, each a gzip member of its own, and returns the index: archive,
  offset, length, type, url and payload digest of every record.
* ``read_records`` takes any rows of an index, sorts them by place, joins neighbouring byte
  ranges into few large reads and cuts the records out of them. Only index rows are moved.

Archives are written by the tasks through Arrow's file systems, under the folder of
``spark.checkpoint.dir`` or a folder of the caller's. Every attempt of a task writes files of
new names and the index is a table that Spark commits, so a lost or repeated task leaves at
most files that no index row names.

Cases: a null payload is empty. Of equal payloads of at least ``REVISIT_BYTES`` bytes the
rows with the smallest id are responses, the others revisits that refer to it; null ids are
never the smallest unless all are null, and then all are responses. Repeated rows have a
record each. A null address has no target field and is null when read back; control
characters and spaces in an address are written as %XX and come back so. Nothing is cut
from long payloads. An empty table gives an empty index. Other columns are never looked at.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.sources.tables import materialize, shared_folder

REVISIT_BYTES = 100
ARCHIVE_BYTES = 1 << 30
GAP = 1 << 16
RUN_BYTES = 8 << 20
BATCH_BYTES = 16 << 20
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
# The library's own name of a page in record ids.
PAGE_URN = "<urn:trackloom:page:"

INDEX = "archive string, offset long, length long, page_id {id}, url string, record_type string, payload_digest string"
RECORD = "page_id {id}, url string, record_type string, payload_digest string, payload_bytes long, refers_to {id}, payload string"
_FIELDS = {
    "archive": pa.string(), "offset": pa.int64(), "length": pa.int64(), "url": pa.string(),
    "record_type": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.string(),
}


def _batch(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    arrays = [pa.array(list(c), _FIELDS.get(n, id_type)) for c, n in zip(columns, names, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)


def _address(url: str) -> bytes:
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode())


def _page_urn(page_id) -> bytes:
    return f"{PAGE_URN}{quote('' if page_id is None else str(page_id), safe='')}>".encode()


def _record(kind: bytes, fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    lines = [VERSION, b"WARC-Type: " + kind, *(name + b": " + value for name, value in fields)]
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, date: str = DATE) -> bytes:
    """The record of one page: a response with its payload, or a revisit of the page ``refers_to`` without it."""
    fields = [
        (b"WARC-Record-ID", _page_urn(page_id)),
        (b"WARC-Date", date.encode()),
        (b"WARC-Payload-Digest", b"sha256:" + digest.encode()),
    ]
    if url is not None:
        fields.insert(1, (b"WARC-Target-URI", _address(url)))
    kind, block, content = b"response", HTTP_HEAD + payload, b"application/http; msgtype=response"
    if refers_to is not None:
        fields += [
            (b"WARC-Refers-To", _page_urn(refers_to)),
            (b"WARC-Profile", PROFILE),
            (b"X-Payload-Length", b"%d" % len(payload)),  # a revisit has no payload to measure
        ]
        kind, block = b"revisit", HTTP_HEAD
    return _record(kind, [*fields, (b"Content-Type", content)], block)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (type and version included) and block of one record; a damaged one is an error."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    fields = dict(line.decode().split(": ", 1) for line in lines)
    size = int(fields.get("Content-Length", -1))
    if not mark or version != VERSION or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return fields, rest[:size]


def _writer(folder: str, names: list[str], id_type: pa.DataType, archive_bytes: int, date: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        out, archive, at = None, None, 0
        for batch in batches:
            rows = []
            for page_id, url, html, digest, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                page_id, url, refers_to, digest = page_id.as_py(), url.as_py(), refers_to.as_py(), digest.as_py()
                payload = html.as_buffer()
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    archive, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{archive}", compression=None)
                    info = _record(
                        b"warcinfo",
                        [(b"WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>".encode()), (b"WARC-Date", date.encode()),
                         (b"WARC-Filename", archive.encode()), (b"Content-Type", b"application/warc-fields")],
                        b"format: WARC File Format 1.1\r\n",
                    )
                    at += out.write(gzip.compress(info, 1, mtime=0))
                record = page_record(page_id, url, payload.to_pybytes(), digest, refers_to, date)
                length = out.write(gzip.compress(record, 1, mtime=0))
                kind = "response" if refers_to is None else "revisit"
                rows.append((f"{folder}/{archive}", at, length, page_id, url, kind, digest))
                at += length
            yield _batch(rows, names, id_type)
        if out is not None:
            out.close()

    return write


def _absolute(folder: str) -> str:
    return folder if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:/", folder) else f"file://{folder}"


def write_archives(
    df: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write a record for every row of ``df`` and return their index (written, so the archives stand).

    Payloads move once, to meet the digests that occur more than once; those grow with the
    table, so they are never broadcast, and a hot digest is divided by the adaptive skew join.
    """
    spark = df.sparkSession
    folder = _absolute(folder or f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}")
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root)
    kind = df.schema[id_col].dataType
    payload = F.coalesce(df[payload_col].cast("string"), F.lit(""))
    pages = df.select(
        df[id_col].alias("page_id"),
        df[url_col].cast("string").alias("url"),
        payload.cast("binary").alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    shared = materialize(
        pages.where(F.octet_length("payload") >= revisit_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first_id is not null")
        .select("digest", "first_id")
    )
    decided = pages.join(shared.hint("merge"), "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"),
    )
    schema = INDEX.format(id=kind.simpleString())
    names = [part.split()[0] for part in schema.split(", ")]
    id_type = _arrow_type(df, id_col)
    return materialize(decided.mapInArrow(_writer(folder, names, id_type, archive_bytes, date), schema))


def _arrow_type(df: DataFrame, id_col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[id_col].dataType)


def byte_runs(offsets: np.ndarray, lengths: np.ndarray, gap: int = GAP, run_bytes: int = RUN_BYTES) -> list[tuple[int, int]]:
    """Groups [i, j) of sorted byte ranges, each read at once: gaps up to ``gap``, ``run_bytes`` unless one record is longer."""
    runs, start = [], 0
    for i in range(1, len(offsets) + 1):
        if i < len(offsets):
            hole = offsets[i] - (offsets[i - 1] + lengths[i - 1])
            if hole <= gap and offsets[i] + lengths[i] - offsets[start] <= run_bytes:
                continue
        runs.append((start, i))
        start = i
    return runs if len(offsets) else []


def _reader(names: list[str], id_type: pa.DataType, gap: int, run_bytes: int, payloads: bool) -> Callable:
    def rows_of(data: bytes, offsets, lengths, base: int, expected: list) -> Iterator[tuple]:
        for at, length, (page_id, digest) in zip(offsets, lengths, expected, strict=True):
            fields, block = parse_record(zlib.decompress(data[at - base : at - base + length], 31))
            kind = fields["WARC-Type"]
            named = fields["WARC-Payload-Digest"].removeprefix("sha256:")
            refers_to = fields.get("WARC-Refers-To")
            payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
            size = len(payload) if payload is not None else int(fields["X-Payload-Length"])
            if fields["WARC-Record-ID"].encode() != _page_urn(page_id) or named != digest or (
                payload is not None and hashlib.sha256(payload).hexdigest() != digest
            ):
                raise ValueError(f"record at {at} is not the one of the index")
            target = refers_to and unquote(refers_to.removeprefix(PAGE_URN).removesuffix(">"))
            if target is not None and pa.types.is_integer(id_type):
                target = int(target)
            text = payload.decode() if payloads and payload is not None else None
            yield page_id, fields.get("WARC-Target-URI"), kind, named, size, target, text

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, system, file = None, None, None
        for batch in batches:
            archives = batch.column("archive").to_pylist()
            offsets, lengths = (np.asarray(batch.column(c)) for c in ("offset", "length"))
            expected = list(zip(batch.column("page_id").to_pylist(), batch.column("payload_digest").to_pylist(), strict=True))
            borders = [0, *(i for i in range(1, len(archives)) if archives[i] != archives[i - 1]), len(archives)]
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                if a == b:
                    continue
                if archives[a] != opened:
                    if file is not None:
                        file.close()
                    system, path = fs.FileSystem.from_uri(archives[a])
                    opened, file = archives[a], system.open_input_file(path)
                rows, held = [], 0
                for i, j in byte_runs(offsets[a:b], lengths[a:b], gap, run_bytes):
                    base = int(offsets[a + i])
                    data = file.read_at(int(offsets[a + j - 1] + lengths[a + j - 1]) - base, base)
                    for row in rows_of(data, offsets[a + i : a + j], lengths[a + i : a + j], base, expected[a + i : a + j]):
                        rows.append(row)
                        held += len(row[-1] or "")
                        if held > BATCH_BYTES:
                            yield _batch(rows, names, id_type)
                            rows, held = [], 0
                yield _batch(rows, names, id_type)
        if file is not None:
            file.close()

    return read


def read_records(
    index: DataFrame, gap: int = GAP, run_bytes: int = RUN_BYTES, payloads: bool = True
) -> DataFrame:
    """page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload of the records that ``index`` names.

    Rows of an index are range-partitioned by their place, so that a task reads neighbouring
    records. Every payload is checked against its digest. A revisit has no payload of its
    own; with ``payloads=False`` none is returned.
    """
    schema = RECORD.format(id=index.schema["page_id"].dataType.simpleString())
    names = [part.split()[0] for part in schema.split(", ")]
    places = index.select("archive", "offset", "length", "page_id", "payload_digest")
    return (
        places.repartitionByRange("archive", "offset")
        .sortWithinPartitions("archive", "offset")
        .mapInArrow(_reader(names, _arrow_type(index, "page_id"), gap, run_bytes, payloads), schema)
    )


def archive_pages(df: DataFrame, **options) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives of ``df``."""
    return read_records(write_archives(df, **options), payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
