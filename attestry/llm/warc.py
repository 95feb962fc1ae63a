"""WARC archives: written with revisits and segments, read back by reassembly.

Equal payloads are known by digest and length; the record with the largest id is the response and the others become
revisits that name it. A record longer than a segment is cut: its first segment is followed by continuation records
that name it as their origin, whatever file they land in. Bodies are framed as chunked transfers. A file is part of
the archive once its name is in the manifest, which only successful tasks add to.

Reading yields one row a WARC record. Those of a segmented record are grouped by origin, put in order of their
segment numbers and joined as they stream by; the last one's total length is verified, and the chunk framing decoded.
"""

from __future__ import annotations

import base64
import gzip
import io
import uuid
from collections.abc import Iterator
from hashlib import sha1, sha256

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import store, texts

SEGMENT_BYTES = 32 << 10  # of a record's block
FILE_BYTES = 64 << 20
FRAME_BYTES = 8 << 10  # of a chunk of the transfer
COPIES = 4096  # repeated rows that are dealt out together
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed by the format
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORD = "record_id string, record_type string, target_uri string, page_id long, payload_digest string, refers_to string, content_type string, origin_id string, segment_number int, total_length long, block binary, problem string"
DECODED = "record_id string, record_type string, target_uri string, page_id long, payload_digest string, refers_to string, payload binary, payload_bytes long, problem string"


def base32(digest: str | bytes) -> str:
    """Upper-case base32 of a digest, given in hex or as bytes."""
    return base64.b32encode(bytes.fromhex(digest) if isinstance(digest, str) else digest).decode()


def _urn(key: str, copy: int) -> str:
    return f"<{uuid.UUID(bytes=sha256(f'{key}:{copy}'.encode()).digest()[:16]).urn}>"


def framed(payload: bytes, size: int = FRAME_BYTES) -> bytes:
    """The payload as a chunked transfer."""
    cut = (payload[k : k + size] for k in range(0, len(payload), size))
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in cut) + b"0\r\n\r\n"


def unframed(body: bytes) -> bytes:
    """The payload of a chunked transfer; extensions and trailers are skipped. ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without size")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        if not size:
            return b"".join(out)
        at = end + 2
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk shorter than its size")
        out.append(body[at : at + size])
        at += size + 2


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record as it stands in a file; fields without value are left out, line ends in values percent-encoded."""
    lines = ["WARC/1.1"] + [f"{k}: {v.replace(chr(13), '%0D').replace(chr(10), '%0A')}" for k, v in fields if v is not None]
    lines += [f"WARC-Block-Digest: sha1:{base32(sha1(block).digest())}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def segments(fields: list[tuple[str, str | None]], key: str, copy: int, block: bytes, size: int) -> Iterator[bytes]:
    """A record, or its first segment and the continuations."""
    own = _urn(key, copy)
    if len(block) <= size:
        yield warc_record([("WARC-Record-ID", own), *fields], block)
        return
    cut = [block[k : k + size] for k in range(0, len(block), size)]
    yield warc_record([("WARC-Record-ID", own), *fields, ("WARC-Segment-Number", "1")], cut[0])
    for n, part in enumerate(cut[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", _urn(f"{key}:{n}", copy)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n))]
        yield warc_record(more + [("WARC-Segment-Total-Length", str(len(block)) if n == len(cut) else None)], part)


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _expanded(rows: DataFrame) -> DataFrame:
    """A row for each copy from ``from_copy`` to ``n - 1``, large numbers dealt out in parts."""
    spark = rows.sparkSession
    parts = rows.where("from_copy < n").withColumn("low", F.explode(F.sequence("from_copy", F.col("n") - 1, F.lit(COPIES).cast("long"))))
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return parts.withColumn("copy", F.explode(F.sequence("low", F.least(F.col("low") + COPIES - 1, F.col("n") - 1))))


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """The records to write: ``key``, ``copy``, ``page_id``, ``url``, ``sha1``, ``target`` (the response's key) and ``payload``,
    both of which only one kind has.

    Payloads of ``least`` bytes or more that are equal share one response, that of the largest id; among rows of
    the same id that of the largest URL, among equal rows the first copy. Shorter payloads are all responses.
    Payload bytes move once, one copy of equal rows; all decisions are made on digests.
    """
    url, payload = F.col(f"`{url_col}`").cast("string"), F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "sha2": F.sha2("payload", 256), "bytes": F.octet_length("payload")})
    named = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(" "), "sha2", F.lit(" "), F.coalesce(F.concat(F.lit("="), "url"), F.lit("")))
    rows = rows.withColumn("key", F.substring(F.sha2(named, 256), 1, 32))
    marks = store.stored(rows.groupBy("key", "page_id", "url", "sha1", "sha2", "bytes").agg(F.count(F.lit(1)).alias("n")), "marks")
    same = ["sha1", "sha2", "bytes"]
    best = marks.where(F.col("bytes") >= least).groupBy(*same).agg(F.max(F.struct("page_id", "url", "key"))["key"].alias("target"))
    judged = marks.join(best, same, "left")
    again = judged.where("target is not null").withColumn("from_copy", F.when(F.col("key") == F.col("target"), 1).otherwise(0).cast("long"))
    again = _expanded(again).select("key", "copy", "page_id", "url", "sha1", "target", F.lit(None).cast("binary").alias("payload"))
    first = judged.where("target is null or key = target").select("key", "page_id", "url", "sha1", F.when(F.col("target").isNull(), F.col("n")).otherwise(1).alias("n"), F.lit(0).cast("long").alias("from_copy"))
    bodies = rows.groupBy("key").agg(F.first("payload").alias("payload")).join(first, "key")
    # More than one copy of a payload is written only where it is shorter than ``least``.
    bodies = bodies.withColumn("copy", F.explode(F.sequence("from_copy", F.col("n") - 1))) if least else bodies.withColumn("copy", F.col("from_copy"))
    return bodies.select("key", "copy", "page_id", "url", "sha1", F.lit(None).cast("string").alias("target"), "payload").unionByName(again)


def write_archives(records: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES, level: int = 6) -> DataFrame:
    """Write planned records, gzip by record; returns the stored manifest, one row a file with ``file`` and ``records``.

    A record's payload is in memory once; a file is closed at the first record that ends past ``file_bytes``, so
    segments of a record may be in two files. No records give no files.
    """
    texts.small_batches(records.sparkSession)

    def run(batches):
        system, place = _place(folder)
        system.create_dir(place, recursive=True)
        out = name = None
        count = written = 0
        done = []
        for batch in batches:
            for key, copy, page, url, digest, target, payload in zip(*(batch[c] for c in ("key", "copy", "page_id", "url", "sha1", "target", "payload"))):
                key, copy, page, url = key.as_py(), copy.as_py(), page.as_py(), url.as_py()
                revisit = target.is_valid
                fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Page-ID", None if page is None else str(page))]
                fields += [("WARC-Payload-Digest", f"sha1:{base32(digest.as_py())}"), ("Content-Type", "application/http; msgtype=response")]
                if revisit:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(target.as_py(), 0))]
                for piece in segments(fields, key, copy, HTTP if revisit else HTTP + framed(payload.as_py()), segment_bytes):
                    if out is None:
                        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        out = system.open_output_stream(f"{place}/{name}", compression=None)
                    made = gzip.compress(piece, level, mtime=0)
                    out.write(made)
                    count, written = count + 1, written + len(made)
                    if written >= file_bytes:
                        out.close()
                        done.append((name, count))
                        out, count, written = None, 0, 0
        if out is not None:
            out.close()
            done.append((name, count))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["file", "records"])

    return store.stored(records.mapInArrow(run, "file string, records long"), "manifest")


def parsed(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Fields (names in lower case), block and what is wrong, of each record of a file."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            yield {}, b"", "no WARC record"
            return
        fields: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = fields.get("content-length", "")
        if not length.isdigit():
            yield fields, b"", "no length"
            return
        block = stream.read(int(length))
        problem = "cut off" if len(block) < int(length) else None
        stated = fields.get("warc-block-digest", "")
        if problem is None and stated.startswith("sha1:") and stated[5:] != base32(sha1(block).digest()):
            problem = "block digest differs"
        yield fields, block, problem


def _whole_number(value: str | None) -> int | None:
    return int(value) if value is not None and value.lstrip("-").isdigit() else None


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """One row a WARC record of the files that the manifest names, gzip by record or as a whole, or plain.

    A file that is cut off or no archive ends with a row that says so in ``problem``.
    """
    spark = manifest.sparkSession

    def run(batches):
        system, place = _place(folder)
        held, size = [], 0

        def flushed():
            columns = list(zip(*held)) or [[]] * 12
            kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 4 + [pa.int32(), pa.int64(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in RECORD.split(", ")])

        for batch in batches:
            for name in batch["file"].to_pylist():
                with system.open_input_file(f"{place}/{name}") as file:
                    raw = gzip.GzipFile(fileobj=file) if name.endswith(".gz") else file
                    for fields, block, problem in parsed(io.BufferedReader(raw, 1 << 18)):
                        get = fields.get
                        held.append((get("warc-record-id"), get("warc-type"), get("warc-target-uri"), _whole_number(get("warc-page-id")), (get("warc-payload-digest") or "").removeprefix("sha1:") or None, get("warc-refers-to"),
                                     get("content-type"), get("warc-segment-origin-id"), _whole_number(get("warc-segment-number")), _whole_number(get("warc-segment-total-length")), block, problem))
                        size += len(block)
                        if size >= texts.BLOCK_BYTES or len(held) >= texts.BATCH_ROWS:
                            yield flushed()
                            held, size = [], 0
        yield flushed()

    files = manifest.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return files.mapInArrow(run, RECORD)


def payload_of(content_type: str | None, block: bytes) -> bytes:
    """The payload of a whole block; ValueError if its transfer framing is broken."""
    if not (content_type or "").startswith("application/http"):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    chunked = any(line.lower().startswith(b"transfer-encoding:") and b"chunked" in line.lower() for line in head.split(b"\r\n"))
    return unframed(body) if chunked else body


class _Decoded:
    """Decoded records, gathered to batches of bounded bytes."""

    def __init__(self, keep: bool) -> None:
        self.keep, self.rows, self.size = keep, [], 0

    def add(self, first: dict, block: bytes, problem: str | None) -> None:
        payload, digest = None, first["payload_digest"]
        if problem is None and first["record_type"] != "revisit":
            try:
                payload = payload_of(first["content_type"], block)
                found = base32(sha1(payload).digest())
                if digest not in (None, found):
                    problem = "payload digest differs"
                digest = found
            except ValueError as broken:
                problem = str(broken)
        n = None if payload is None else len(payload)
        self.rows.append((first["record_id"], first["record_type"], first["target_uri"], first["page_id"], digest, first["refers_to"], payload if self.keep else None, n, problem))
        self.size += len(block)

    def full(self) -> bool:
        return self.size >= texts.BLOCK_BYTES or len(self.rows) >= texts.BATCH_ROWS

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * 9
        kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 2 + [pa.binary(), pa.int64(), pa.string()]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in DECODED.split(", ")])


def _single(keep: bool):
    def run(batches):
        out = _Decoded(keep)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch[c][k].as_py() for c in batch.schema.names}
                out.add(row, row["block"], row["problem"])
                if out.full():
                    yield out.batch()
        yield out.batch()

    return run


def joined_segments(rows: Iterator[dict]) -> Iterator[tuple[dict, bytes, str | None]]:
    """First segment, whole block and what is wrong, of each run of rows with the same ``origin``, in order of their numbers.

    A segment that is there twice counts once.
    """
    first: dict | None = None
    origin, parts, last, problem, total = None, [], 0, None, None

    def ended():
        length = sum(map(len, parts))
        wrong = problem or ("first segment missing" if first["segment_number"] != 1 else "last segment missing" if total is None else "total length differs" if total != length else None)
        return first, b"".join(parts), wrong

    for row in rows:
        if first is None or row["origin"] != origin:
            if first is not None:
                yield ended()
            first, origin, parts, last, problem, total = row, row["origin"], [], row["segment_number"] - 1, None, None
        if row["segment_number"] == last:
            continue
        if row["segment_number"] != last + 1:
            problem = problem or "segment missing"
        parts.append(row["block"])
        last, problem = row["segment_number"], problem or row["problem"]
        total = row["total_length"] if row["total_length"] is not None else total
    if first is not None:
        yield ended()


def _reassembled(keep: bool):
    def run(batches):
        out = _Decoded(keep)
        rows = ({c: batch[c][k].as_py() for c in batch.schema.names} for batch in batches for k in range(batch.num_rows))
        for first, block, problem in joined_segments(rows):
            row = first | {"record_id": first["origin"]}
            out.add(row, block, problem)
            if out.full():
                yield out.batch()
        yield out.batch()

    return run


def reassemble(records: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Whole records: ``payload`` (null unless kept), ``payload_bytes`` and ``payload_digest`` of the decoded payload.

    Records without segments are decoded where they are. Segments go by origin, in order of their numbers, and one
    record is in memory at a time. What cannot be decoded is returned without payload and says why in ``problem``:
    missing segments, a wrong total length, broken chunks, a digest that differs. Revisits have no payload of their own.
    """
    spark = records.sparkSession
    texts.small_batches(spark)
    part = F.col("segment_number").isNotNull()
    whole = records.where(~part).mapInArrow(_single(keep_payload), DECODED)
    cut = records.where(part).withColumn("origin", F.coalesce("origin_id", "record_id"))
    cut = cut.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "origin").sortWithinPartitions("origin", "segment_number")
    return whole.unionByName(cut.mapInArrow(_reassembled(keep_payload), DECODED))


def resolved(decoded: DataFrame) -> DataFrame:
    """Responses and revisits with ``payload_bytes`` and ``refers_to`` (an id) of the response that a revisit names.

    A revisit whose response is not there, or has another digest, has a ``problem``.
    """
    out = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "problem"]
    responses = decoded.where("record_type = 'response'")
    names = responses.where("problem is null").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("to_bytes"), F.col("payload_digest").alias("to_digest"))
    again = decoded.where("record_type = 'revisit'").join(names, "refers_to", "left")
    wrong = F.when(F.col("to_digest").isNull(), "response missing").when(F.col("to_digest") != F.col("payload_digest"), "digest differs from the response")
    again = again.select("page_id", "record_type", F.col("to_bytes").alias("payload_bytes"), "payload_digest", F.col("to_page").alias("refers_to"), F.coalesce("problem", wrong).alias("problem"))
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*out).unionByName(again.select(*out))


def archive_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, **options) -> DataFrame:
    """Write a record for each row and return the manifest.

    A null payload is empty, a null URL or id is left out of the record; rows without id rank before all others.
    Repeated rows are a record each, all but one of them revisits. An empty table has no files; other columns of the
    input are not read.
    """
    return write_archives(planned(pages, id_col, url_col, payload_col, least), folder, **options)


def op12_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = store.shared(spark, "archive")
    manifest = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    decoded = store.stored(reassemble(read_records(manifest, folder), keep_payload=False), "decoded")
    return resolved(decoded).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
