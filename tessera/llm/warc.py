"""WARC archives: a writer (one gzip member a record, revisits for repeated
payloads) and a sequential reader (incremental decompression, content-length
framing, digest verification)."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Stash, bounded_batches, scratch_path

# The record format of WARC 1.1.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcConfig:
    """``least_bytes``: payloads from this size on are revisited when they
    repeat.  ``archive_bytes``: an archive is closed beyond this size.
    ``date``: the date written, so that archives are the same on every run.
    ``read_bytes``: compressed bytes read at a time."""

    least_bytes: int = 0
    archive_bytes: int = 64 << 20
    date: str = "2024-01-01T00:00:00Z"
    read_bytes: int = 1 << 18


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- records -----------------------------------------------------------------------

def page_urn(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = [VERSION, b"WARC-Type: " + kind.encode()]
    lines += [f"{k}: {v}".encode() for k, v in headers]
    lines += [b"WARC-Block-Digest: sha1:" + base32_sha1(block).encode(), b"Content-Length: %d" % len(block)]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None,
                revisit: bool, cfg: WarcConfig) -> bytes:
    """The response record of a page, or its revisit: the HTTP head without
    the payload, whose digest and length stay on record."""
    head = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
            % len(payload))
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else page_urn(page_id)
    headers = [("WARC-Record-ID", f"<{page_urn(page_id)}>"), ("WARC-Date", cfg.date),
               ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
               ("Content-Type", "application/http; msgtype=response")]
    if not revisit:
        return record("response", headers, head + payload)
    headers += [("WARC-Refers-To", f"<{page_urn(refers_to)}>"), ("WARC-Profile", REVISIT_PROFILE)]
    return record("revisit", headers, head)


# --- sequential reader ----------------------------------------------------------------

@dataclass
class Record:
    """``offset``: of its gzip member in the archive; ``problem``: None when
    framing and digests hold."""

    offset: int
    headers: dict[str, str]
    block: bytes = b""
    problem: str | None = None
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def read_records(stream, read_bytes: int = 1 << 18) -> Iterator[Record]:
    """The records of a gzip stream, in order, holding one at a time.

    Each member is decompressed piece by piece; what is left over begins the
    next.  A member that is cut off, does not inflate, or whose framing is
    broken gives a record with a problem; reading goes on at the next member
    where its beginning is known, otherwise ends.
    """
    pending, offset = b"", 0
    while True:
        if not pending:
            pending = stream.read(read_bytes)
            if not pending:
                return
        unpack = zlib.decompressobj(31)
        plain, used = bytearray(), 0
        problem = None
        while not unpack.eof:
            if not pending:
                pending = stream.read(read_bytes)
                if not pending:
                    problem = "archive ends inside a member"
                    break
            try:
                plain += unpack.decompress(pending)
            except zlib.error as error:
                problem = f"member does not inflate: {error}"
                break
            used += len(pending) - len(unpack.unused_data)
            pending = unpack.unused_data
        found = _frame(bytes(plain), offset)
        found.problem = problem or found.problem
        yield found
        if problem:
            return
        offset += used


def _frame(raw: bytes, offset: int) -> Record:
    """A record from a member's bytes: version line, headers, exactly
    Content-Length bytes, two line ends."""
    end = raw.find(b"\r\n\r\n")
    lines = raw[:max(end, 0)].split(b"\r\n")
    found = Record(offset, {})
    for line in lines[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found.headers[name.strip().lower()] = value.strip()
    length = found.headers.get("content-length", "")
    if end < 0 or not lines[0].startswith(b"WARC/") or not length.isdigit():
        found.problem = "no record header"
        return found
    found.block = raw[end + 4:end + 4 + int(length)]
    if len(found.block) != int(length) or raw[end + 4 + int(length):] != b"\r\n\r\n":
        found.problem = "content length does not frame the block"
    elif (declared := found.headers.get("warc-block-digest")) and declared != "sha1:" + base32_sha1(found.block):
        found.problem = "block digest differs"
    elif found.headers.get("content-type", "").startswith("application/http"):
        head, _, found.payload = found.block.partition(b"\r\n\r\n")
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.decode("latin-1").partition(":")
            found.http[name.strip().lower()] = value.strip()
        if found.headers.get("warc-type") == "response":
            if found.headers.get("warc-payload-digest") != "sha1:" + base32_sha1(found.payload):
                found.problem = "payload digest differs"
            elif found.http.get("content-length") != str(len(found.payload)):
                found.problem = "payload length differs"
    return found


# --- the operators ----------------------------------------------------------------------

_MANIFEST = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("records", T.LongType()),
    T.StructField("bytes", T.LongType())])
_RECORD = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()),
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("refers_to", T.StringType()),
    T.StructField("payload", T.BinaryType()), T.StructField("problem", T.StringType())])


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_archives(spark: SparkSession, pages: DataFrame, path: str, cfg: WarcConfig = WarcConfig(),
                   id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page as a WARC record under ``path`` (a shared folder) and
    return the manifest (archive, records, bytes).

    Of the pages with one payload of ``cfg.least_bytes`` or more, the largest
    page_id is the response and the others revisit it; smaller payloads are
    all responses.  A null html is an empty payload; a null page_id is lower
    than any other and revisits them; rows that repeat the response's page_id
    are responses too; an empty table writes no archive.  A task writes
    under a name of its own and renames when the archive is complete, so a
    task that runs again replaces it by the same bytes.
    """
    bounded_batches(spark)
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        html.alias("payload")).withColumn("sha1", F.sha1("payload"))
    shared = (rows.where(F.octet_length("payload") >= cfg.least_bytes).groupBy("sha1")
              .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
              .where("n > 1 and first is not null").select("sha1", "first"))
    marked = rows.join(shared, "sha1", "left").select(
        "page_id", "url", "payload", "first",
        (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = _place(path)
        store.create_dir(base, recursive=True)
        done, out = [], None

        def close():
            nonlocal out
            stream, draft, final, records, size = out
            stream.close()
            store.move(draft, f"{base}/{final}")
            done.append((f"{path}/{final}", records, size))
            out = None

        for batch in batches:
            for page_id, url, payload, first, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"pages-{task.partitionId():06d}-{len(done):04d}.warc.gz"
                    draft = f"{base}/.{name}.{task.taskAttemptId()}"
                    out = [store.open_output_stream(draft, compression=None), draft, name, 0, 0]
                    info = record("warcinfo", [("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", cfg.date),
                                               ("Content-Type", "application/warc-fields")], b"format: WARC 1.1\r\n")
                    out[0].write(info)
                    out[4] += len(info)
                member = page_record(page_id, url, payload or b"", first, revisit, cfg)
                out[0].write(member)
                out[3] += 1
                out[4] += len(member)
                if out[4] >= cfg.archive_bytes:
                    close()
        if out is not None:
            close()
        if done:
            archive, records, size = zip(*done)
            yield pa.RecordBatch.from_arrays(
                [pa.array(archive), pa.array(records, pa.int64()), pa.array(size, pa.int64())],
                names=_MANIFEST.fieldNames())

    # written once here: the manifest must not be computed again by a later action
    return Stash(spark, "warc-manifest").keep(marked.mapInArrow(write, _MANIFEST))


def read_archives(manifest: DataFrame, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """Every record but the archives' own info, read sequentially: one task
    reads an archive from its beginning, one record in memory at a time.
    ``payload_bytes`` and ``payload_digest`` are those of the full payload,
    also for a revisit, whose ``payload`` is empty; ``problem`` tells what
    does not hold."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                store, path = _place(archive)
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream, cfg.read_bytes):
                        kind = r.headers.get("warc-type")
                        if kind == "warcinfo" and r.problem is None:
                            continue
                        size = r.http.get("content-length")
                        digest = r.headers.get("warc-payload-digest")
                        rows.append((archive, r.offset, r.headers.get("warc-record-id"), kind,
                                     r.headers.get("warc-target-uri"), digest and digest.removeprefix("sha1:"),
                                     int(size) if size and size.isdigit() else None,
                                     r.headers.get("warc-refers-to"), r.payload, r.problem))
                        held += len(r.payload)
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return manifest.select("archive").mapInArrow(read, _RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_RECORD.fieldNames())


def archive_round_trip(spark: SparkSession, pages: DataFrame, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and
    return (page_id, payload_bytes, payload_digest, record_type, refers_to,
    problem) for every record."""
    manifest = write_archives(spark, pages, scratch_path(spark, "warc"), cfg)
    spread = manifest.repartition(max(1, manifest.count()))  # one archive a task
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")
    return read_archives(spread, cfg).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"), "problem")
