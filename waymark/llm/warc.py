"""WARC archives written and read in parallel as chunked record tables.

On both sides a payload goes to and from Python as rows (record, chunk number, bytes)
with a running SHA-1 and length; no Python process ever holds a whole one. A first pass over
the chunks gives each payload's digest, which the archive's headers need before the
payload. A writer task then streams chunk rows into archive files in the shared
folder, checks the digest that it was told, and returns a manifest row per file; only
files named in the committed manifest are ever read, so files of failed or repeated
attempts don't count. A reader task streams a file in blocks into chunk rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.store import lookup_join, materialise, shared_path

CHUNK_BYTES = 1 << 20
BLOCK_BYTES = 1 << 18
FILE_BYTES = 64 << 20
_FLUSH_BYTES = 4 << 20
#: Fixed values of the format.
_VERSION = b"WARC/1.1\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, bytes long, records long"
CHUNKS = (
    "record_id long, record_type string, refers_to long, uri string, declared_bytes long, declared_digest string, "
    "chunk int, start long, data binary, chunk_bytes long, running_bytes long, running_digest string, last boolean"
)


def bare_base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _urn(row_id: int | None) -> str:
    return "<urn:row:none>" if row_id is None else f"<urn:row:{row_id}>"


def _row_of(urn: str | None) -> int | None:
    return None if urn is None or urn == "<urn:row:none>" else int(urn[9:-1])


def _heads(row_id: int | None, uri: str | None, size: int, digest: str, first: int | None, revisit: bool) -> bytes:
    """The WARC and HTTP headers of a record whose payload has ``size`` bytes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(row_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_urn(first)}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else size)}",
    ]
    return _VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _chunk_rows(rows: DataFrame, chunk_bytes: int, body: str = "payload") -> DataFrame:
    """A row per chunk of the binary column ``body``, at least one: ``chunk`` (from 0), ``data``, ``last``; a row's chunks stay together, in order."""
    count = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(body), F.lit(0)) / chunk_bytes)).cast("int")
    spread = rows.withColumn("chunks", count).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    data = F.substring(F.col(body), F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))
    return spread.withColumns({"data": data, "last": F.col("chunk") + 1 == F.col("chunks")}).drop(body, "chunks")


_KEY = ["h1", "h2", "size"]


def _digests(records: DataFrame, chunk_bytes: int) -> DataFrame:
    """id, key of the payload and bare hex SHA-1 of every record, from the running digest of its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha1()
        for batch in batches:
            ends, found = [], []
            for i, (data, last) in enumerate(zip(batch.column(4), batch.column(5).to_pylist(), strict=True)):
                sha.update(data.as_buffer() or b"")
                if last:
                    ends.append(i)
                    found.append(sha.hexdigest())
                    sha = hashlib.sha1()
            pick = pa.array(ends, pa.int64())
            yield pa.record_batch([*(batch.column(i).take(pick) for i in range(4)), pa.array(found, pa.string())], names=["id", *_KEY, "sha1"])

    chunks = _chunk_rows(records.select("id", *_KEY, "payload"), chunk_bytes).select("id", *_KEY, "data", "last")
    return chunks.mapInArrow(run, "id long, h1 long, h2 long, size long, sha1 string")


def write_archives(
    rows: DataFrame,
    id_col: str,
    uri_col: str,
    payload_col: str,
    min_revisit_bytes: int = 0,
    folder: str | None = None,
    chunk_bytes: int = CHUNK_BYTES,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write one record per row; returns the manifest (path, bytes, records), stored.

    The payload is binary, or a string taken as UTF-8; null is empty. Of equal
    payloads of at least ``min_revisit_bytes``, the row with the smallest id is the
    response and the others revisit it; rows repeated with that same id are all
    responses, and so are rows with a null id that only equal each other. A very long
    payload is one value of its row, but Python sees it in chunks only; a record larger than ``file_bytes``
    has a file of its own. An empty table gives an empty manifest. Ids are cast to long, other
    columns are ignored, whatever their names. The folder must be one that every
    executor can write (default: in the shared folder).
    """
    spark = rows.sparkSession
    folder = folder or shared_path(spark, "archives")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    records = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload")
    ).withColumns({"h1": F.xxhash64("payload"), "h2": F.crc32("payload"), "size": F.octet_length("payload").cast("long")})
    digests = materialise(_digests(records, chunk_bytes), "digests")
    firsts = (
        digests.where(F.col("size") >= min_revisit_bytes).groupBy("sha1").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .select("sha1", F.when(F.col("n") > 1, F.col("first")).alias("first"))
    )
    known = digests.groupBy(*_KEY).agg(F.min("sha1").alias("sha1")).join(firsts, "sha1", "left")
    joined = lookup_join(records, materialise(known, "known"), _KEY, "left")
    revisit = (
        F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")) & (F.col("size") >= min_revisit_bytes)
    )
    ready = joined.select(
        "id", "uri", "sha1", "size", F.when(revisit, F.col("first")).alias("first"),
        revisit.alias("revisit"), F.when(~revisit, F.col("payload")).alias("payload"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        prefix = f"part-{task.partitionId():06d}-{uuid.uuid4().hex[:12]}"
        done: list[tuple[str, int, int]] = []
        out, size, count, sha = None, 0, 0, hashlib.sha1()
        for batch in batches:
            ids, uris, sha1s, sizes, firsts_, revisits, chunks, lasts = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 5, 6, 8))
            bodies = batch.column(7)
            for i, row_id in enumerate(ids):
                if not chunks[i]:
                    if out is not None and size >= file_bytes:
                        out.close()
                        done.append((name, size, count))
                        out = None
                    if out is None:
                        name = f"{prefix}-{len(done):04d}.warc"
                        out, size, count = store.open_output_stream(f"{root}/{name}"), 0, 0
                    head = _heads(row_id, uris[i], sizes[i], bare_base32(sha1s[i]), firsts_[i], revisits[i])
                    out.write(head)
                    size += len(head) + 4
                    sha = hashlib.sha1()
                if not revisits[i]:
                    body = bodies[i].as_buffer() or b""
                    sha.update(body)
                    out.write(body)
                    size += len(body)
                if lasts[i]:
                    if not revisits[i] and sha.hexdigest() != sha1s[i]:
                        raise ValueError(f"the payload of {row_id} hasn't the digest that its header declares")
                    out.write(b"\r\n\r\n")
                    count += 1
        if out is not None:
            out.close()
            done.append((name, size, count))
        yield pa.record_batch(
            [pa.array([f"{folder}/{d[0]}" for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
            names=["path", "bytes", "records"],
        )

    spread = _chunk_rows(ready, chunk_bytes).select("id", "uri", "sha1", "size", "first", "revisit", "chunk", "data", "last")
    return materialise(spread.mapInArrow(write, MANIFEST), "manifest")


class _Stream:
    """Bytes of one archive, read block by block."""

    def __init__(self, raw, block: int):
        self._raw, self._block, self._kept, self._at = raw, block, b"", 0

    def _more(self) -> bool:
        more = self._raw.read(self._block)
        self._kept, self._at = self._kept[self._at :] + more, 0
        return bool(more)

    def head(self) -> bytes | None:
        """Up to the next empty line; None at the end of the file."""
        while (end := self._kept.find(b"\r\n\r\n", self._at)) < 0:
            if not self._more():
                if self._kept.strip():
                    raise ValueError("the archive ends inside a header")
                return None
        found = self._kept[self._at : end]
        self._at = end + 4
        return found

    def take(self, most: int) -> bytes:
        if self._at == len(self._kept) and not self._more():
            raise ValueError("the archive ends inside a record")
        found = self._kept[self._at : self._at + most]
        self._at += len(found)
        return found


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _records(stream: _Stream, chunk_bytes: int) -> Iterator[tuple]:
    while (head := stream.head()) is not None:
        warc = _fields(head)
        length = int(warc["content-length"])
        http_head = stream.head() if warc.get("content-type", "").startswith("application/http") else b""
        left = length - (len(http_head) + 4 if http_head else 0)
        declared = int(_fields(http_head).get("content-length", left)) if http_head else left
        common = (
            _row_of(warc.get("warc-record-id")), warc["warc-type"], _row_of(warc.get("warc-refers-to")), warc.get("warc-target-uri"),
            declared, warc.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        )
        sha, start, chunk = hashlib.sha1(), 0, 0
        while True:
            parts, size = [], 0
            while size < min(chunk_bytes, left):
                parts.append(part := stream.take(min(chunk_bytes, left) - size))
                size += len(part)
            data = b"".join(parts)
            sha.update(data)
            left -= size
            yield (*common, chunk, start, data, size, start + size, base64.b32encode(sha.digest()).decode(), left == 0)
            start, chunk = start + size, chunk + 1
            if not left:
                break
        if stream.head() not in (b"", None):
            raise ValueError("a record isn't followed by an empty line")


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of the manifest's archives.

    One row per chunk, at least one per record: its number and start, its bytes (null
    without ``with_data``), and the payload's length and bare base32 SHA-1 up to its
    end; ``last`` marks the row whose running values are the whole payload's.
    """
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    names = [part.split()[0] for part in CHUNKS.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(types)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, root = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(root) as raw:
                    for row in _records(_Stream(raw, BLOCK_BYTES), chunk_bytes):
                        rows.append(row if with_data else (*row[:8], None, *row[9:]))
                        held += row[9]
                        if held >= _FLUSH_BYTES or len(rows) >= 4096:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(read, CHUNKS)


def record_digests(chunks: DataFrame, strict: bool = False) -> DataFrame:
    """One row per record from the rows marked ``last``: sizes, digests, type, reference, intact.

    A revisit has no payload of its own; its length and digest are those it
    declares. ``intact`` says that a response's bytes have the digest and length
    that it declares; with ``strict`` a record that isn't intact is an error. An empty
    table gives an empty result.
    """
    stored = F.col("record_type") != "revisit"
    found = chunks.where("last").select(
        "record_id",
        F.when(stored, F.col("running_bytes")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(stored, F.col("running_digest")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
        "uri",
        (~stored | ((F.col("running_digest") == F.col("declared_digest")) & (F.col("running_bytes") == F.col("declared_bytes")))).alias("intact"),
    )
    broken = F.concat(F.lit("record "), F.coalesce(F.col("record_id").cast("string"), F.lit("none")), F.lit(" hasn't the digest or length that it declares"))
    return found.where(F.when(F.col("intact"), True).otherwise(F.raise_error(broken).cast("boolean"))) if strict else found


def payloads(chunks: DataFrame) -> DataFrame:
    """Whole payloads (record_id, payload) of responses, for those who need them in one piece."""
    parts = F.array_sort(F.collect_list(F.struct("chunk", "data")))
    joined = F.aggregate(parts, F.lit("").cast("binary"), lambda a, c: F.concat(a, c["data"]))
    return chunks.where("record_type = 'response'").groupBy("record_id").agg(joined.alias("payload"))
