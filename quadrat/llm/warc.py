"""WARC: monolithic gzip archives, their normaliser, and reading by a sidecar offset index.

``write_monolithic`` lets Spark's text writer make one gzip stream per task, each a whole file of records. ``normalise``
opens such a stream in its task, inflates it once, from front to end and a block at a time, and rewrites every record as a
gzip member of its own; the place of each member goes to a sidecar index (file, offset, length, headers). A task holds a
block and a record, however large the archive is. ``read_records`` then opens members by that index alone.
``write_revisits`` writes revisit records, which name the response that they repeat, to archives of their own. Output files get their final name only once they are whole, from a name of the task attempt's own, so
a lost executor's task can run again.

Paths are those of a store that driver and executors share; files are written through pyarrow's file systems, which know
file://, hdfs:// and s3:// paths.

Defined results: a null payload is an empty one; equal payloads make one response, of the largest id, and revisits, if they
have at least ``min_bytes`` bytes; repeated rows of one id are one record each, the id's response is counted once, and all
rows of the response's id are responses; a null id is never a revisit; an empty table gives no records; payloads are kept whole, of any length that a
string of Spark holds; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm.common import shared_dir

CRLF = "\r\n"
BLOCK = 1 << 20
#: Index rows that a task sends on at once.
INDEX_ROWS = 4096
LEVEL = 4
FIXED_DATE = "2026-01-01T00:00:00Z"


def _page(id_: Column) -> Column:
    return F.concat(F.lit("<urn:quadrat:page:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(">"))


def record_text(id_: Column, uri: Column | None, payload: Column, kind: str = "response", more: tuple[Column | str, ...] = ()) -> Column:
    """A record without the CRLF CRLF that ends it; ``more`` are further header lines."""
    length = F.octet_length(payload).cast("string")
    target = [] if uri is None else [F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(uri, F.lit("")), r"[\r\n]", "%0A"))]
    head = ["WARC/1.1", f"WARC-Type: {kind}", F.concat(F.lit("WARC-Record-ID: "), _page(id_)), f"WARC-Date: {FIXED_DATE}", *target, *more, "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), length)]
    parts = [x if isinstance(x, Column) else F.lit(x) for x in head]
    return F.concat(F.concat_ws(CRLF, *parts), F.lit(CRLF + CRLF), payload)


def write_monolithic(pages: DataFrame, at: str, id_col: str = "page_id", uri: str = "url", payload: str = "html") -> None:
    """Write every page as a response record; each task's records are one gzip stream under ``at``."""
    body = F.coalesce(F.col(payload), F.lit(""))
    pages.select(record_text(F.col(id_col), F.col(uri), body).alias("value")).write.option("compression", "gzip").option("lineSep", CRLF + CRLF).text(at)


class RecordStream:
    """Records from pieces of an inflated archive: feed() yields (raw record, headers, start of the payload)."""

    def __init__(self) -> None:
        self.held = bytearray()
        self.head: dict[str, str] | None = None
        self.body = self.need = 0

    def feed(self, data: bytes):
        self.held += data
        while True:
            if self.head is None:
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                lines = self.held[:end].decode("utf-8").split(CRLF)
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no WARC record here: {lines[0][:40]!r}")
                self.head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                self.body = end + 4
                self.need = self.body + int(self.head["content-length"]) + 4
            if len(self.held) < self.need:
                return
            record = bytes(self.held[: self.need])
            if record[-4:] != b"\r\n\r\n":
                raise ValueError("a record doesn't end where its length says")
            del self.held[: self.need]
            head, self.head = self.head, None
            yield record, head, self.body

    def close(self) -> None:
        if self.held or self.head is not None:
            raise ValueError("the archive ends within a record")


def inflate(blocks):
    """Inflate a gzip stream of one or more members, block by block; one that is cut off is an error."""
    z, begun = zlib.decompressobj(31), False
    for b in blocks:
        more = True
        while b or (more and begun):  # a full block may leave bytes behind though all input is taken
            begun = True
            out = z.decompress(b, BLOCK)
            if out:
                yield out
            b, more = z.unconsumed_tail, len(out) == BLOCK
            if z.eof:
                b, begun = z.unused_data, False
                z = zlib.decompressobj(31)
    if begun:
        raise ValueError("the archive is cut off")


def member(record: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _store(at: str):
    fs, path = pafs.FileSystem.from_uri(at if "://" in at else re.sub(r"^(\w+):/+", r"\1:///", at))
    return fs, path


INDEX_SCHEMA = "archive string, offset long, length long, record_id string, uri string, record_type string, payload_start long, payload_bytes long"


def rewrite_archive(source: str, at: str):
    """Rewrite one archive with a member per record under ``at``; yields lists of index rows, the last once the file has its name."""
    name = re.sub(r"\.(txt\.)?gz$", "", source.rsplit("/", 1)[1]) + ".warc.gz"
    own, path = _store(source)
    fs, folder = _store(at)
    fs.create_dir(folder, recursive=True)
    tmp = f"{folder}/_{uuid.uuid4().hex}.tmp"
    rows, offset, stream = [], 0, RecordStream()
    with own.open_input_stream(path, compression=None) as archive, fs.open_output_stream(tmp, compression=None) as out:
        for block in inflate(iter(lambda: archive.read(BLOCK), b"")):
            for record, head, body in stream.feed(block):
                m = member(record)
                out.write(m)
                rows.append((f"{at}/{name}", offset, len(m), head["warc-record-id"], head.get("warc-target-uri"), head["warc-type"], body, int(head["content-length"])))
                offset += len(m)
                if len(rows) >= INDEX_ROWS:
                    yield rows
                    rows = []
    stream.close()
    if fs.get_file_info(f"{folder}/{name}").type != pafs.FileType.NotFound:  # an earlier attempt's, with the same bytes
        fs.delete_file(f"{folder}/{name}")
    fs.move(tmp, f"{folder}/{name}")
    yield rows


def normalise(spark: SparkSession, source: str, at: str) -> DataFrame:
    """Rewrite the archives under ``source`` with a member per record under ``at``; the sidecar index is a table beside them."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")  # contents stay where they are

    def rewrite(batches):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for b in batches:
            for path in b.column(0).to_pylist():
                for rows in filter(None, rewrite_archive(path, at)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX_SCHEMA.split(", ")])

    archives.mapInArrow(rewrite, INDEX_SCHEMA).write.parquet(f"{at}/index")
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{at}/index")


def read_records(index: DataFrame) -> DataFrame:
    """Open every member that the index names: record_id, payload_bytes, payload_sha1 (bytes), checked against the index."""

    def read(batches):
        opened, name = None, None
        for b in batches:
            ids, sizes, digests = [], [], []
            for archive, offset, length, rid, start, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if archive != name:
                    if opened:
                        opened.close()
                    fs, path = _store(archive)
                    opened, name = fs.open_input_file(path), archive
                record = zlib.decompress(opened.read_at(length, offset), 31)
                payload = memoryview(record)[start : start + size]
                if len(record) != start + size + 4:
                    raise ValueError(f"{archive} at {offset}: the index doesn't fit the member")
                ids.append(rid)
                sizes.append(len(payload))
                digests.append(hashlib.sha1(payload).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())], ["record_id", "payload_bytes", "payload_sha1"])
        if opened:
            opened.close()

    ordered = index.select("archive", "offset", "length", "record_id", "payload_start", "payload_bytes")
    return ordered.mapInArrow(read, "record_id string, payload_bytes long, payload_sha1 binary")


def base32_sha1(digest: Column) -> Column:
    """Upper-case base32 of 20 bytes, by groups of five bits."""
    bits = F.concat(*(F.lpad(F.conv(F.substring(F.hex(digest), 10 * i + 1, 10), 16, 2), 40, "0") for i in range(4)))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return F.concat(*(F.substring(F.lit(letters), F.conv(F.substring(bits, 5 * i + 1, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(32)))


def resolve_revisits(records: DataFrame, id_col: str = "page_id", min_bytes: int = 0) -> DataFrame:
    """page, payload_bytes, payload_digest, record_type and refers_to of every record.

    The largest id of each payload is a count by key, combined before the shuffle; the join back is on the payload, whose hot
    keys Spark splits.
    """
    largest = records.groupBy(F.col("payload_sha1").alias("k_sha1"), F.col("payload_bytes").alias("k_bytes")).agg(F.max(id_col).alias("k_id"))
    own = records.join(largest, (records["payload_sha1"] == largest["k_sha1"]) & (records["payload_bytes"] == largest["k_bytes"]), "left")
    again = (F.col("payload_bytes") >= min_bytes) & (F.col(id_col) < F.col("k_id"))
    return own.select(id_col, "payload_bytes", "payload_sha1", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("k_id")).alias("refers_to"))


def write_revisits(resolved: DataFrame, at: str, id_col: str = "page_id") -> None:
    """Write the revisits among ``resolve_revisits``' rows as records without payload that name their response and its digest."""
    more = (F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.concat(F.lit("WARC-Refers-To: "), _page(F.col("refers_to"))), F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.col("payload_sha1"))))
    own = resolved.where("record_type = 'revisit'")
    own.select(record_text(F.col(id_col), None, F.lit(""), "revisit", more).alias("value")).write.option("compression", "gzip").option("lineSep", CRLF + CRLF).text(at)


def archive_pages(pages: DataFrame, id_col: str = "page_id", uri: str = "url", payload: str = "html", min_bytes: int = 0, at: str | None = None) -> DataFrame:
    """Write pages to monolithic archives, normalise them, read them back by the index, and tell responses from revisits."""
    spark = pages.sparkSession
    at = at or f"{shared_dir(spark)}/quadrat/warc-{uuid.uuid4().hex}"
    write_monolithic(pages, f"{at}/monolithic", id_col, uri, payload)
    index = normalise(spark, f"{at}/monolithic", f"{at}/normal")
    kind = pages.schema[id_col].dataType.simpleString()
    records = read_records(index).withColumn(id_col, F.regexp_extract("record_id", "page:(.*)>", 1).try_cast(kind)).drop("record_id")
    return resolve_revisits(records, id_col, min_bytes)


def digest_text(sha1: bytes) -> str:
    """The same as ``base32_sha1``, outside Spark."""
    return base64.b32encode(sha1).decode()
