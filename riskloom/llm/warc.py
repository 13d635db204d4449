"""WARC archives as a chunked record table.

A record of a payload of at most `CHUNK` bytes is one row. An oversized one is a run of rows (archive, record, chunk
number): chunk 0 holds the WARC header block, the following ones at most `CHUNK` bytes of payload each, the last one
the two line ends that close a record. The bytes of a record's rows in order are the WARC record, so exporting an
archive is joining bytes (`export`). Each row carries the digest
of the payload up to and with its chunk, taken incrementally; a reader that streams the rows in order (`read`) never
holds an oversized record, checks every such digest, and the last one against the header's. Only rows of oversized
records are shuffled for that.

Of records with equal payloads of at least `least` bytes the one with the largest page id is the response and holds
the payload, the others are revisits that name it; smaller ones are all responses. Equality is that of SHA-256 and
length. Null payloads count as empty, null page ids are smaller than all others. Rows that repeat a response's page
id and payload are responses like it. Every row of the table yields one record, an empty table none. Copies meet
combined before the shuffle; a payload of a third of all rows is one small row on the deciding side of a join.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskloom.llm.rows import table
from riskloom.session import scratch_path

CHUNK = 256 * 1024
DATE = "2020-01-01T00:00:00Z"
_CLOSE = b"\r\n\r\n"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # name space of URLs
CHUNKS = "archive int, record string, chunk long, whole boolean, data binary, digest string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, sha256: str) -> str:
    """Name of a record, the same wherever it is made."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{sha256}')}>"


def header(kind: str, name: str, page_id, url: str | None, n_bytes: int, digest: str, refers: tuple | None) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {n_bytes}",
    ]
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {refers[0]}")
        lines.append(f"X-Refers-To-Page: {refers[1]}")
    lines += ["Content-Type: text/html", f"Content-Length: {n_bytes if kind == 'response' else 0}"]
    return "\r\n".join(lines).encode() + _CLOSE


def chunk_rows(archive: int, page_id, url, payload: bytes, sha256: str, last_id, duplicated: bool):
    """The rows of one record; slices of the payload, one at a time."""
    revisit = duplicated and page_id != last_id
    digest = hashlib.sha1()
    view = memoryview(payload)
    for at in range(0, len(view), CHUNK):
        digest.update(view[at : at + CHUNK])
    full = base32(digest.digest())
    refers = (record_id(last_id, sha256), last_id) if revisit else None
    record = uuid.uuid4().hex
    kind = "revisit" if revisit else "response"
    head = header(kind, record_id(page_id, sha256), page_id, url, len(view), full, refers)
    if revisit or len(view) <= CHUNK:
        yield archive, record, 0, True, head + (b"" if revisit else bytes(view)) + _CLOSE, full
        return
    yield archive, record, 0, False, head, ""
    chunk, digest = 1, hashlib.sha1()
    for at in range(0, len(view), CHUNK):
        part = view[at : at + CHUNK]
        digest.update(part)
        yield archive, record, chunk, False, part, base32(digest.digest())
        chunk += 1
    yield archive, record, chunk, False, _CLOSE, full


def write(pages: DataFrame, folder: str, least: int = 0) -> None:
    """Write one record per row of `pages` (page_id, url, html) to the chunk table in `folder`."""
    payload = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.octet_length(payload).alias("n"), F.sha2(payload, 256).alias("sha256"))
    groups = rows.groupBy("sha256", "n").agg(F.max("page_id").alias("last_id"), (F.count("*") > 1).alias("more"))
    decided = rows.join(groups, ["sha256", "n"]).select(
        "page_id", "url", "html", "sha256", "last_id", (F.col("more") & (F.col("n") >= least)).alias("duplicated")
    )
    arrow = to_arrow_schema(T._parse_datatype_string(CHUNKS))

    def cut(batches):
        from pyspark import TaskContext

        archive = TaskContext.get().partitionId()
        out, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, sha256, last_id, duplicated = (c[i] for c in batch.columns)
                body = html.as_buffer().to_pybytes() if len(html.as_buffer()) <= CHUNK else html.as_buffer()
                for row in chunk_rows(archive, page_id.as_py(), url.as_py(), body, sha256.as_py(), last_id.as_py(), duplicated.as_py()):
                    out.append(row)
                    size += len(row[4])
                    if size >= 4 * CHUNK:
                        yield _batch(out, arrow)
                        out, size = [], 0
        if out:
            yield _batch(out, arrow)

    decided.mapInArrow(cut, CHUNKS).write.option("compression", "zstd").parquet(folder)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """What each record of the archives says, after checking the payload that is there against its digests."""
    stored = spark.read.schema(CHUNKS).parquet(folder)
    ordered = stored.where("not whole").select("record", "chunk", "data", "digest").repartition("record").sortWithinPartitions("record", "chunk")
    arrow = to_arrow_schema(T._parse_datatype_string(RECORD))

    def parse_whole(batches):
        for batch in batches:
            out = []
            for record, data in zip(*(c.to_pylist() for c in batch.columns)):
                end = data.index(_CLOSE) + len(_CLOSE)
                fields, payload = _fields(data[:end]), data[end : -len(_CLOSE)]
                if not data.endswith(_CLOSE):
                    raise ValueError(f"record {record}: no end after its payload")
                out.append(_record(record, fields, hashlib.sha1(payload), len(payload)))
            if out:
                yield _batch(out, arrow)

    def parse(batches):
        now, fields, running, n = None, {}, None, 0
        for batch in batches:
            out = []
            for record, chunk, data, digest in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk == 0:
                    if now is not None:
                        raise ValueError(f"record {now} has no end")
                    now, fields, running, n, due = record, _fields(data), hashlib.sha1(), 0, 1
                    continue
                if record != now or chunk != due:
                    raise ValueError(f"record {record}: chunk {chunk} out of place")
                due += 1
                if n < int(fields["Content-Length"]):
                    running.update(data)
                    n += len(data)
                    if base32(running.digest()) != digest:
                        raise ValueError(f"record {record}: chunk {chunk} is damaged")
                    continue
                if data != _CLOSE:
                    raise ValueError(f"record {record}: no end after its payload")
                out.append(_record(now, fields, running, n))
                now = None
            if out:
                yield _batch(out, arrow)
        if now is not None:
            raise ValueError(f"record {now} has no end")

    small = stored.where("whole").select("record", "data").mapInArrow(parse_whole, RECORD)
    return small.unionAll(ordered.mapInArrow(parse, RECORD))


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:] if line)


def _record(name: str, fields: dict[str, str], running, n: int) -> tuple:
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if int(fields["Content-Length"]) != n or (kind == "response" and base32(running.digest()) != digest):
        raise ValueError(f"record {name}: payload and header differ")
    number = lambda text: int(text) if text else None
    return number(fields["X-Page-ID"]), int(fields["X-Payload-Length"]), digest, kind, number(fields.get("X-Refers-To-Page", ""))


def export(spark: SparkSession, folder: str, archive: int, sink) -> int:
    """Append the records of one archive to the binary file `sink`, chunk by chunk; number of bytes written.

    Rows are fetched partition by partition; what stands in memory is one of them.
    """
    rows = spark.read.schema(CHUNKS).parquet(folder).where(F.col("archive") == archive)
    rows = rows.repartitionByRange("record", "chunk").sortWithinPartitions("record", "chunk").select("data")
    return sum(sink.write(r["data"]) for r in rows.toLocalIterator())


def op7_warc(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder)


OP7_SQL = """
  WITH digested AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
  ranked AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS last_id FROM digested)
  SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INTEGER), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1,
      1)), '') AS payload_digest,
    CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> last_id THEN last_id END AS refers_to
  FROM ranked"""
