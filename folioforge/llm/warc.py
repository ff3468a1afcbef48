"""Operator 3: WARC archives, written and read back sequentially.

Writing: equal payloads are found by their SHA-1 digest (an aggregate of digests; no payload
moves for it). The smallest id of a digest is the response, all others are revisits without a
payload. A bitmap of the revisits' ids leaves all other payloads where they are. Each record
is one gzip member; members follow each other in archives of about ARCHIVE_BYTES. Archives are
the rows of a table in the shared folder, written by Spark's committer, so that a lost executor
or a task run twice leaves no broken archive; put_files() makes .warc.gz files of them.

Reading: archives are read where they lie, from their first byte to their last. Members are
inflated piece by piece, records are framed by their Content-Length, and each payload's digest
is checked.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import cut, maybe_in, new_table, prepare, table

ARCHIVE_BYTES, INFLATE_BYTES, ROW_GROUP_BYTES = 8 << 20, 1 << 18, 32 << 20
LEVEL = 5
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, uri: str, payload: bytes, digest: str, headers: Iterable[tuple[str, str]] = ()) -> bytes:
    """One record. A response holds an HTTP message with the payload; a revisit only its header."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    body = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload if kind == "response" else http + b"\r\n"
    unique = hashlib.sha1(f"{kind} {uri} {digest} {list(headers)}".encode()).hexdigest()
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{unique[:8]}-{unique[8:12]}-{unique[12:16]}-{unique[16:20]}-{unique[20:32]}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest_of(body)}")]
    if kind == "revisit":
        head.append(("WARC-Profile", PROFILE))
    head += [*headers, ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    lines = "".join(f"{k}: {one_line(v)}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + END


def one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def member(data: bytes) -> bytes:
    """One gzip member."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


@dataclass
class Record:
    headers: dict[str, str]
    body: bytes
    sound: bool

    @property
    def payload(self) -> bytes:
        """What follows the HTTP header of an HTTP message; else the body."""
        if not self.headers.get("content-type", "").startswith("application/http"):
            return self.body
        return self.body.partition(END)[2]


class WarcError(ValueError):
    pass


def inflate(chunks: Iterable[bytes]) -> Iterator[bytes | None]:
    """The members' bytes, a piece at a time; None after each member. Plain bytes pass as they are."""
    z, began, plain = None, False, False
    for chunk in chunks:
        if not began and chunk:
            began, plain = True, not chunk.startswith(b"\x1f")
        if plain:
            yield chunk
            continue
        while chunk:
            z = z or zlib.decompressobj(31)
            try:
                out = z.decompress(chunk, INFLATE_BYTES)
            except zlib.error as e:
                raise WarcError(f"a member can't be inflated: {e}") from e
            if out:
                yield out
            if z.eof:
                chunk, z = z.unused_data, None
                yield None
            else:
                chunk = z.unconsumed_tail
                if not chunk and not out:
                    break
    while z is not None:
        out = z.decompress(b"", INFLATE_BYTES) if not z.eof else b""
        if not out:
            raise WarcError("the archive ends inside a member")
        yield out


def read_records(chunks: Iterable[bytes]) -> Iterator[Record]:
    """The records of one archive, given as pieces of its bytes in order.

    Only the record in hand is held. Raises WarcError on bad framing; a wrong digest makes
    a record that isn't sound.
    """
    held, need, head = bytearray(), None, None
    for piece in inflate(chunks):
        if piece is None:
            if held.strip() or head is not None:
                raise WarcError("a member ends inside a record")
            held.clear()
            continue
        held += piece
        while True:
            if head is None:
                start = 0
                while held[start : start + 2] == b"\r\n":
                    start += 2
                at = held.find(END, start)
                if at < 0:
                    break
                head = parse_head(bytes(held[start:at]))
                if not head.get("content-length", "").isdigit():
                    raise WarcError("a record has no Content-Length")
                need = int(head["content-length"])
                del held[: at + 4]
            if len(held) < need + 4:
                break
            if held[need : need + 4] != END:
                raise WarcError("a record doesn't end where its Content-Length says")
            body = bytes(held[:need])
            del held[: need + 4]
            made, head = Record(head, body, True), None
            made.sound = sound(made)
            yield made
    if held.strip() or head is not None:
        raise WarcError("the archive ends inside a record")


def parse_head(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise WarcError("a record doesn't start with its version")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def sound(r: Record) -> bool:
    """Whether the digests that a record states are those of what it holds."""
    stated = [(r.headers.get("warc-block-digest"), r.body)]
    if r.headers.get("warc-type") == "response":
        stated.append((r.headers.get("warc-payload-digest"), r.payload))
    return all(digest_of(data) == want[5:] for want, data in stated if want and want.startswith("sha1:"))


def _digests(batches):
    for b in batches:
        got = [digest_of(x or b"") for x in b.column("payload").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got), pa.array([len(x or b"") for x in b.column("payload").to_pylist()], pa.int64())], names=["id", "digest", "size"])


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Rows (id, digest, first) of the pages that are revisits, given (id, payload): first has the same payload."""
    told = pages.mapInArrow(_digests, "id long, digest string, size long")
    firsts = told.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    return told.where(F.col("size") >= least_bytes).join(firsts.select("digest", "first"), "digest").where("id is null or id <> first").select("id", "digest", "first").distinct()


def _archives(batches):
    """Rows (id, uri, payload, digest, first) -> archives. A digest is there for revisits only."""
    import uuid

    buffer = bytearray()

    def out():
        made = pa.RecordBatch.from_arrays([pa.array([f"part-{uuid.uuid4().hex}.warc.gz"]), pa.array([bytes(buffer)], pa.binary())], names=["archive", "bytes"])
        buffer.clear()
        return made

    for b in batches:
        for row in b.to_pylist():
            payload = row["payload"] or b""
            kind = "revisit" if row["digest"] is not None else "response"
            headers = [("X-Page-Id", "" if row["id"] is None else str(row["id"])), ("X-Payload-Length", str(len(payload)))]
            if kind == "revisit":
                headers.append(("WARC-Refers-To-Page-Id", str(row["first"])))
            buffer += member(record(kind, row["uri"] or "", payload, row["digest"] or digest_of(payload), headers))
            if len(buffer) >= ARCHIVE_BYTES:
                yield out()
    if buffer:
        yield out()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> str:
    """Writes a record for each row of pages to the archive table at path.

    Null payloads are empty payloads, null addresses empty ones; rows that repeat give a
    record each; of rows with equal payloads and ids, all with the smallest id are responses.
    Payloads of under least_bytes are always responses; a null id's page is a revisit where a
    page with an id has its payload; no rows give an empty table; other columns are not looked
    at.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).alias("uri"), F.col(payload_col).cast("binary").alias("payload"))
    again = cut(roles(rows.select("id", "payload"), least_bytes))
    told = rows.withColumn("maybe", maybe_in(again.select("id")).column(F.col("id")))
    fields = ["id", "uri", "payload", "digest", "first"]
    sure = told.where("not maybe").select("id", "uri", "payload", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("first"))
    # a null id could stand for several payloads, so that the digest is compared as well
    other = again.withColumnRenamed("id", "own_id")
    rest = told.where("maybe").join(other, F.col("id").eqNullSafe(F.col("own_id")) & (_base32_sha1(F.col("payload")) == F.col("digest")), "left")
    archives = sure.select(*fields).union(rest.select(*fields)).mapInArrow(_archives, "archive string, bytes binary")
    archives.write.option("compression", "none").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return path


def _base32_sha1(payload):
    """SHA-1 of a payload in base32, by built-in functions: each five hex digits are four base32 digits."""
    digest = F.sha1(F.coalesce(payload, F.lit(b"")))
    chars = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    groups = []
    for g in range(0, 40, 5):
        number = F.conv(F.substring(digest, g + 1, 5), 16, 10).cast("int")
        groups += [F.substring(chars, F.shiftright(number, s).bitwiseAND(F.lit(31)) + F.lit(1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*groups)


RECORDS = "archive string, type string, uri string, page_id long, payload_length long, payload_digest string, refers_to long, payload binary, sound boolean"


def _read_parts(batches):
    """Rows (archive, bytes), an archive each -> RECORDS."""
    schema = pa.schema([("archive", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()), ("payload_length", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("sound", pa.bool_())])
    held, size = [], 0
    for name, data in ((a.as_py(), d.as_buffer()) for b in batches for a, d in zip(b.column("archive"), b.column("bytes"), strict=True)):
        view = memoryview(data)
        for r in read_records(bytes(view[i : i + INFLATE_BYTES]) for i in range(0, len(view), INFLATE_BYTES)):
            h, payload = r.headers, r.payload
            number = lambda k, h=h: int(h[k]) if h.get(k, "").lstrip("-").isdigit() else None
            revisit = h.get("warc-type") == "revisit"
            length = number("x-payload-length") if revisit else len(payload)
            held.append((name, h.get("warc-type"), h.get("warc-target-uri"), number("x-page-id"), length, (h.get("warc-payload-digest") or "").removeprefix("sha1:"), number("warc-refers-to-page-id"), None if revisit else payload, r.sound))
            size += len(payload)
            if len(held) >= 256 or size >= 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """RECORDS of the archive table at path. A record whose digests are wrong has sound = false; bad framing fails the job."""
    return prepare(spark).read.schema("archive string, bytes binary").parquet(path).mapInArrow(_read_parts, RECORDS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """RECORDS of .warc and .warc.gz files, of any store that Spark reads; a file at a time in a task."""
    files = prepare(spark).read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    return files.select(F.col("path").alias("archive"), F.col("content").alias("bytes")).mapInArrow(_read_parts, RECORDS)


def put_files(spark: SparkSession, path: str, folder: str) -> int:
    """Makes .warc.gz files, in a folder of the driver's, of the archive table at path, one at a time; returns how many."""
    import os

    n = 0
    for row in spark.read.schema("archive string, bytes binary").parquet(path).toLocalIterator():
        with open(os.path.join(folder, row.archive), "wb") as f:
            f.write(row.bytes)
        n += 1
    return n


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archives(table(spark, sf_dir, "pages"), new_table(prepare(spark), "warc"), least_bytes=0)
    out = read_archives(spark, path)
    checked = F.when(F.col("sound"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("digest mismatch in "), "archive")))
    return out.select("page_id", F.col("payload_length").alias("payload_bytes"), checked.alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
g AS (SELECT h, min(page_id) AS m FROM p GROUP BY h)
SELECT page_id, octet_length(b) AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(p.h, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = m THEN NULL ELSE m END AS refers_to
FROM p JOIN g USING (h)
"""
