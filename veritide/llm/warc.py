"""WARC archives: a Python data source that writes record-wise gzip members and reads headers first.

Each record is a gzip member of its own, whose extra field "sl" holds the member's compressed and
uncompressed length, as the format's annex on compression proposes.  A reader inflates a member until the
header ends and seeks over the rest unless the record is wanted.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    WriterCommitMessage,
)

from veritide.llm.shared import new_path, read, ship, store_of

#: Columns of the source; each is a header, but for payload.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "payload_length": "x-payload-length",
}
SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_length long, payload binary"
DIGEST = "sha256:"
#: Fixed values of the archive format.
VERSION, END, DATE = "WARC/1.1", "\r\n\r\n", "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC, EXTRA, SKIP = b"\x1f\x8b\x08", 4, b"sl\x08\x00"


def record_id(kind: str, key) -> F.Column:
    return F.concat(F.lit(f"<urn:{kind}:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(">"))


def with_duplicates(pages: DataFrame, id_col: str, payload_col: str, least: int) -> DataFrame:
    """(_id, _uri, _payload, _digest, _size, _first): _first is the smallest id with an equal payload, if that is another.

    Only ids and digests are shuffled by digest, combined first; payloads move once, by their own id.
    """
    small = pages.select(
        F.col("_id"), F.sha2(F.col("_payload"), 256).alias("_digest"), F.octet_length("_payload").cast("long").alias("_size")
    )
    long = small.where(F.col("_size") >= least)
    first = long.groupBy("_digest").agg(F.min("_id").alias("_first")).withColumnRenamed("_digest", "_d")
    again = (
        long.join(first, (F.col("_digest") == F.col("_d")) & (F.col("_id") != F.col("_first")))
        .groupBy(F.col("_id").alias("_i"), F.col("_d"))
        .agg(F.min("_first").alias("_first"))
    )
    own = pages.withColumn("_digest", F.sha2(F.col("_payload"), 256)).withColumn(
        "_size", F.octet_length("_payload").cast("long")
    )
    return own.join(again, (F.col("_id") == F.col("_i")) & (F.col("_digest") == F.col("_d")), "left").drop("_i", "_d")


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "html",
    least: int = 100,
) -> None:
    """Write one WARC record for each row, a gzip member each, in files that only a finished job puts in place.

    Of rows with equal payloads of at least ``least`` bytes, that with the smallest id becomes a response
    and the others revisits that name it; smaller payloads are always responses.  A null payload is
    empty; a null URI leaves its header out; line breaks in a URI become %0A and %0D.  Rows that repeat
    with their id are all responses, and so are rows without id, whose record id says null; no other
    record refers to them.  An empty table writes no records.
    """
    rows = pages.select(
        F.col(id_col).alias("_id"),
        F.replace(F.replace(F.col(uri_col).cast("string"), F.lit("\n"), F.lit("%0A")), F.lit("\r"), F.lit("%0D")).alias("_uri"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("_payload"),
    )
    rows = with_duplicates(rows, id_col, payload_col, least)
    revisit = F.col("_first").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    head = F.concat(
        F.lit(VERSION),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id("page", F.col("_id"))),
        line("WARC-Date", F.lit(DATE)),
        F.when(F.col("_uri").isNull(), "").otherwise(line("WARC-Target-URI", F.col("_uri"))),
        line("WARC-Payload-Digest", F.concat(F.lit(DIGEST), F.col("_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id("page", F.col("_first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("X-Payload-Length", F.col("_size").cast("string")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("_size").cast("string"))),
        F.lit(END),
    )
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("_payload"))
    spark = pages.sparkSession
    ship(spark)
    spark.dataSource.register(WarcSource)
    rows.select(head.alias("head"), body.alias("body")).write.format("warc").mode("append").save(path)


def member(head: bytes, body: bytes) -> bytes:
    """One record as a gzip member with its lengths; a member too long for them has none."""
    whole = head + body + END.encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = packer.compress(whole) + packer.flush()
    tail = zlib.crc32(whole).to_bytes(4, "little") + (len(whole) & 0xFFFFFFFF).to_bytes(4, "little")
    size = 10 + 2 + len(SKIP) + 8 + len(data) + 8
    if max(size, len(whole)) >= 1 << 32:
        return MAGIC + bytes(5) + b"\x00\xff" + data + tail
    skip = SKIP + size.to_bytes(4, "little") + len(whole).to_bytes(4, "little")
    return MAGIC + bytes([EXTRA]) + bytes(4) + b"\x00\xff" + len(skip).to_bytes(2, "little") + skip + data + tail


@dataclass
class Part(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    """Each task writes a file of its own below ``_temporary``; the commit moves the files of the tasks that count."""

    def __init__(self, options: dict):
        self.path, self.job = options["path"], uuid.uuid4().hex

    def _place(self):
        store, root = store_of(self.path)
        return store, root, f"{root}/_temporary-{self.job}"

    def write(self, iterator):
        store, _, here = self._place()
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        for b in iterator:
            if not b.num_rows:
                continue
            if out is None:
                store.create_dir(here, recursive=True)
                out = store.open_output_stream(f"{here}/{name}", compression=None)
            for head, body in zip(b.column(0), b.column(1), strict=True):
                out.write(member(head.as_py().encode(), body.as_py()))
        if out is not None:
            out.close()
        return Part(None if out is None else name)

    def commit(self, messages):
        store, root, here = self._place()
        store.create_dir(root, recursive=True)
        for m in messages:
            if m is not None and m.name:
                store.move(f"{here}/{m.name}", f"{root}/{m.name}")
        self.abort(messages)

    def abort(self, messages):
        from pyarrow import fs

        store, _, here = self._place()
        if store.get_file_info(here).type == fs.FileType.Directory:
            store.delete_dir(here)


def parse_headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def records(stream, wanted, payload: bool):
    """(headers, payload or None) of the records that ``wanted`` accepts by their headers; other payloads are skipped unread."""
    while True:
        first = stream.readline()
        if not first:
            return
        if first in (b"\r\n", b"\n"):
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins here: {first[:40]!r}")
        lines = [first.rstrip(b"\r\n")]
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            lines.append(line.rstrip(b"\r\n"))
        headers = parse_headers(b"\r\n".join(lines))
        size = int(headers.get("content-length", "0"))
        if payload and wanted(headers):
            body = stream.read(size)
            if len(body) != size:
                raise EOFError(f"record {headers.get('warc-record-id')} ends early")
            yield headers, body
        else:
            stream.seek(size, io.SEEK_CUR)
            if wanted(headers):
                yield headers, None


def skip_lengths(stream) -> tuple[int, int] | None:
    """(compressed, uncompressed) length of the member whose fixed header was read; None without the extra field."""
    n = int.from_bytes(stream.read(2), "little")
    extra = stream.read(n)
    while len(extra) >= 4:
        size = int.from_bytes(extra[2:4], "little")
        if extra[:4] == SKIP:
            return int.from_bytes(extra[4:8], "little"), int.from_bytes(extra[8:12], "little")
        extra = extra[4 + size :]
    return None


def member_records(stream, wanted, payload: bool):
    """As ``records``, of a gzipped archive: from members with lengths only headers are inflated unless their payload is wanted."""
    while True:
        begin = stream.tell()
        fixed = stream.read(10)
        if not fixed:
            return
        if fixed[:3] != MAGIC:
            raise ValueError(f"no gzip member begins at byte {begin}")
        lengths = skip_lengths(stream) if fixed[3] == EXTRA else None
        if lengths is None:  # another writer's archive: inflate all that follows
            stream.seek(begin)
            yield from records(gzip.GzipFile(fileobj=stream), wanted, payload)
            return
        end = begin + lengths[0]
        inflate, text = zlib.decompressobj(-15), b""
        while (cut := text.find(END.encode())) < 0 and not inflate.eof:
            more = stream.read(min(512, end - stream.tell()))
            if not more:
                raise EOFError(f"the record at byte {begin} ends early")
            text += inflate.decompress(more)
        if not text.startswith(b"WARC/") or cut < 0:
            raise ValueError(f"no WARC record in the member at byte {begin}")
        headers = parse_headers(text[:cut])
        if wanted(headers):
            body = None
            if payload:
                rest = stream.read(end - stream.tell())
                text += inflate.decompress(rest) + inflate.flush()
                tail = (inflate.unused_data or rest)[-8:]
                if len(text) != lengths[1] or zlib.crc32(text).to_bytes(4, "little") != tail[:4]:
                    raise EOFError(f"record {headers.get('warc-record-id')} is broken")
                body = text[cut + 4 : cut + 4 + int(headers.get("content-length", "0"))]
            yield headers, body
        stream.seek(end)


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class WarcReader(DataSourceReader):
    """Plans partitions of whole files, takes = and IN on header columns, and reads headers first."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.target = int(options.get("partitionbytes", str(128 << 20)))
        self.accept: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADERS and column != "payload_length" and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.accept[column] = self.accept.get(column, values) & values
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, root = store_of(self.path)
        infos = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((i.path, i.size) for i in infos if i.is_file and i.base_name[0] not in "._")
        groups, size = [[]], 0
        for name, n in files:
            if groups[-1] and size + n > self.target:
                groups.append([])
                size = 0
            groups[-1].append(name)
            size += n
        return [Files(g) for g in groups]

    def _wanted(self, headers: dict) -> bool:
        return all(headers.get(HEADERS[c]) in values for c, values in self.accept.items())

    def read(self, partition):
        store, _ = store_of(self.path)
        rows, size = [], 0
        for name in partition.names:
            with store.open_input_file(name) as raw, io.BufferedReader(raw, 1 << 16) as stream:
                parse = member_records if name.endswith(".gz") else records
                for headers, body in parse(stream, self._wanted, self.payload):
                    values = [headers.get(h) for h in HEADERS.values()]
                    values[-1] = None if values[-1] is None else int(values[-1])
                    rows.append((*values, body))
                    size += len(body or b"")
                    if len(rows) >= 1000 or size >= 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    cols = zip(zip(*rows, strict=True), kinds, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in cols], [*HEADERS, "payload"])


class WarcSource(DataSource):
    """``format("warc")``: options path, payload (false: headers only), partitionBytes (of compressed files to a task).

    Reads plain and gzipped archives, of this writer and others.  A file is never split.  An empty folder
    gives no rows; a broken record raises.  Writes rows of (head string, body binary), as ``write_warc`` makes them.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    size = re.match(r"\d+", spark.conf.get("spark.sql.files.maxPartitionBytes"))
    unit = {"k": 10, "m": 20, "g": 30}.get(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("bB")[-1:].lower(), 0)
    rows = spark.read.format("warc").option("payload", str(payload).lower())
    return rows.option("partitionBytes", str(int(size[0]) << unit)).load(path)


def archived_pages(archive: DataFrame) -> DataFrame:
    """The contract's columns: sizes and digests of responses come from the payloads that were read."""
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    whole = F.col("record_type") == "response"
    return archive.where(F.col("record_type").isin("response", "revisit")).select(
        number("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.substring("payload_digest", len(DIGEST) + 1, 64)).alias("payload_digest"),
        "record_type",
        F.when(~whole, number("refers_to")).alias("refers_to"),
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(read(spark, sf_dir, "pages"), path)
    return archived_pages(read_warc(spark, path))
