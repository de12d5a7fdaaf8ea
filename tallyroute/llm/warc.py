"""WARC archives of pages: a writer, and a sequential reader that trusts nothing.

Every record is a gzip member of its own. The reader inflates archives
incrementally, frames each record by its Content-Length and checks its block and
payload digests. Pages with a payload already recorded become revisit records,
which carry headers and digest but no payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from ..session import new_path
from .common import join_groups, key_bitmap, map_batches, saved, text_of, with_maybe

CHUNK = 1 << 16
# a new archive is begun after so many compressed bytes
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
_PREFIX = "urn:page:"
_DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe(value: str) -> str:
    """Header text: control characters and per cent signs as per cent codes."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def _plain(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def record(page_id: object, url: str | None, payload: bytes, refers_to: object, revisit: bool) -> bytes:
    """One WARC record: HTTP headers, and the payload unless it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_PREFIX}{page_id}>",
        f"WARC-Date: {_DATE}", "Content-Type: application/http;msgtype=response",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, f"WARC-Target-URI: {_safe(url)}")
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{_PREFIX}{refers_to}>",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write_archives(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, size, records, done = None, "", 0, 0, []
        try:
            for batch in batches:
                for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:
                        # a fresh name per attempt: only files whose task committed are listed
                        name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    member = gzip_member(record(page_id, url, html.encode("utf-8"), refers_to, revisit))
                    out.write(member)
                    size, records = size + len(member), records + 1
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        done.append((name, size, records))
                        out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append((name, size, records))
        columns = list(zip(*done)) if done else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["archive", "bytes", "records"]
        )
    return run


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload_bytes: int = 0
    payload_digest: str = ""
    payload: bytes | None = None


class _Member:
    """The inflated bytes of one gzip member, read on demand from the stream's chunks."""

    def __init__(self, chunks: "_Chunks") -> None:
        self._chunks, self._inflate, self._held = chunks, zlib.decompressobj(31), b""

    def _more(self) -> bool:
        while not self._inflate.eof:
            data = self._inflate.unconsumed_tail or self._chunks.take()
            if not data:
                raise ValueError("an archive ends inside a record")
            made = self._inflate.decompress(data, CHUNK)
            if self._inflate.eof:
                self._chunks.give_back(self._inflate.unused_data)
            if made:
                self._held += made
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while (at := self._held.find(mark)) < 0:
            if not self._more():
                raise ValueError("a record has no end of headers")
        out, self._held = self._held[:at], self._held[at + len(mark) :]
        return out

    def pieces(self, size: int) -> Iterator[bytes]:
        while size:
            if not self._held and not self._more():
                raise ValueError("a record is shorter than its Content-Length")
            piece, self._held = self._held[:size], self._held[size:]
            size -= len(piece)
            yield piece

    def rest(self) -> bytes:
        while self._more():
            pass
        return self._held


class _Chunks:
    def __init__(self, stream) -> None:
        self._stream, self._held = stream, b""

    def take(self) -> bytes:
        if self._held:
            out, self._held = self._held, b""
            return out
        return self._stream.read(CHUNK)

    def give_back(self, data: bytes) -> None:
        self._held = data

    def ended(self) -> bool:
        if not self._held:
            self._held = self._stream.read(CHUNK)
        return not self._held


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def read_records(stream, with_payload: bool = False) -> Iterator[Record]:
    """Every record of an archive in order, in bounded memory unless ``with_payload``.

    Raises ValueError on a record that breaks its framing or its digests.
    """
    chunks = _Chunks(stream)
    while not chunks.ended():
        member = _Member(chunks)
        headers = _fields(member.until(b"\r\n\r\n"))
        length, block, payload = int(headers["content-length"]), hashlib.sha1(), hashlib.sha1()
        head, body, size, kept = b"", False, 0, []
        for piece in member.pieces(length):
            block.update(piece)
            if not body:
                head += piece
                head, mark, piece = head.partition(b"\r\n\r\n")
                body = bool(mark)
                if not body:
                    continue
            payload.update(piece)
            size += len(piece)
            if with_payload:
                kept.append(piece)
        if member.rest() != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")
        name = lambda digest: "sha1:" + base64.b32encode(digest.digest()).decode()
        revisit = headers["warc-type"] == "revisit"
        if name(block) != headers["warc-block-digest"]:
            raise ValueError("a block does not match its digest")
        if not revisit and name(payload) != headers["warc-payload-digest"]:
            raise ValueError("a payload does not match its digest")
        http = _fields(head)
        yield Record(
            headers, http, int(http["content-length"]) if revisit else size,
            headers["warc-payload-digest"].removeprefix("sha1:"), None if revisit or not with_payload else b"".join(kept),
        )


_READ = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary"


def _read_archives(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        names = [f.split()[0] for f in _READ.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for r in read_records(stream, with_payload):
                        own = lambda key: (v := r.headers.get(key)) and v.strip("<>").removeprefix(_PREFIX)
                        uri = r.headers.get("warc-target-uri")
                        rows.append((
                            own("warc-record-id"), None if uri is None else _plain(uri), r.payload_bytes,
                            r.payload_digest, r.headers["warc-type"], own("warc-refers-to"), r.payload,
                        ))
                        held += len(r.payload or b"")
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)
    return run


def _local_uri(folder: str) -> str:
    return folder if re.match(r"[a-z0-9]+:", folder) else f"file://{folder}"


def write_warc(
    pages: DataFrame, folder: str | None = None, id_column: str = "page_id", url_column: str = "url",
    html_column: str = "html", least_revisit: int = 0,
) -> tuple[str, DataFrame]:
    """Archives of all ``pages`` in ``folder`` (default: the shared one) and their list (archive, bytes, records).

    Of equal payloads of at least ``least_revisit`` bytes the page with the
    largest id is the response and the others revisit it; rows repeated with
    that id are responses too. A null payload is empty, a null url has no
    target, a null id stands last among its equals. Pages with a payload of
    their own are written in place; only rows with equals meet in a shuffle, and
    hot payloads do not.
    """
    spark = pages.sparkSession
    folder = _local_uri(folder or new_path(spark, "warc"))
    html = text_of(html_column)
    digest = F.sha1(html.cast("binary"))
    size = F.octet_length(html)
    groups = pages.select(F.col(id_column).alias("id"), digest.alias("digest"), size.alias("size"))
    groups = groups.groupBy("digest", "size").agg(F.max("id").alias("response"), F.count("*").alias("n"))
    groups = saved(groups.filter(f"n > 1 and size >= {least_revisit}").select("digest", "response", "n"), "payloads")
    rows = pages.select(
        F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), html.alias("html"), digest.alias("digest")
    )
    marked = with_maybe(rows, [F.col("digest")], key_bitmap(groups.select("digest")), "maybe")
    names = ["id", "url", "html", "refers_to", "revisit"]
    none = F.lit(None).cast(pages.schema[id_column].dataType)
    lone = marked.filter("not maybe")
    shared = marked.filter("maybe").drop("maybe")
    alone = shared.join(groups, "digest", "left_anti")
    single = lone.select("id", "url", "html").unionByName(alone.select("id", "url", "html"))
    single = single.select("id", "url", "html", none.alias("refers_to"), F.lit(False).alias("revisit"))
    joined = join_groups(shared, groups, "digest", "n")
    joined = joined.select(
        "id", "url", "html", F.col("response").alias("refers_to"), (~F.col("id").eqNullSafe(F.col("response"))).alias("revisit")
    )
    done = single.select(names).unionByName(joined.select(names))
    listed = saved(map_batches(done, _write_archives(folder), "archive string, bytes bigint, records bigint"), "archives")
    return folder, listed


def read_warc(folder: str, archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record.

    Archives are read one after the other by as many tasks as the list has
    files; ids come back as text. A broken record fails the read.
    """
    files = max(1, archives.count())
    tasks = min(files, 4 * archives.sparkSession.sparkContext.defaultParallelism + files // 8)
    listed = archives.select("archive").repartition(tasks)
    return map_batches(listed, _read_archives(folder, with_payload), _READ)


def id_of(text: Column, kind: str) -> Column:
    """A page id read back from its record's name."""
    return F.when(text == "None", None).otherwise(text).cast(kind)
