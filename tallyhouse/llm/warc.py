"""WARC archives: a deterministic sharded writer and a reader.

Records are ordered by page_id over the whole archive and files are closed by compressed size alone: record after record goes into
file number (compressed bytes before it) div roll_bytes. The bytes before it are a running sum over ranges of the ids, so no task has to
see the records before its own, and where the ranges lie makes no difference. Dates, record ids and gzip headers hold nothing that varies, so
a rerun writes the same bytes.

Steps: each page becomes a compressed response record where it lies; narrow rows (id, digest, size) find the pages
with equal payloads (same SHA-256 and length), of which the largest page_id keeps the response and the others become revisit records that name it;
narrow rows are range-sorted and summed up; compressed records go to their files, one shuffle.

Commit: tasks write under temporary names that each attempt has for itself; what a task wrote is a
row of a table in the shared folder, so of a task that ran twice one attempt counts. A second
job renames those files, and the manifest table is written last: an archive without manifest is not
complete, and what no manifest row names was left by a lost task or an earlier archive and is deleted. An older manifest is removed before the first file is renamed. Readers take
the files that the manifest names, and refuse a path without one unless it is said to be a foreign archive.

Every file begins with a warcinfo record (its bytes don't count for roll_bytes). Response records hold an HTTP message, revisit records its head alone, whose
Content-Length tells the payload's length. Fields that start with X-Page are ours; the reader takes foreign archives as well, where they are null.

Tasks write through pyarrow.fs, which takes file, s3, gs, abfs or hdfs addresses. On read,
a file is one row, which roll_bytes bounds (one record can exceed it).

Defined cases: a null html is an empty payload; a null url is written as an empty target and read back as null;
a null page_id never owns a payload that others revisit (its record is a response if no page of the group has
an id); rows that share the largest page_id of a group are all responses; repeated rows give repeated
records; an empty table gives an archive with an empty manifest; further columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import bounded_batches, materialise, new_path, parts

ROLL_BYTES = 16 << 20
#: Payloads under this many bytes are always stored.
MIN_REVISIT_BYTES = 0
#: Narrow rows of a range; compressed bytes that one task writes to files.
RANGE_ROWS, TASK_BYTES = 500_000, 256 << 20
#: Names of files that a reader broadcasts.
MOST_BROADCAST = 100_000
_DATE = "2024-01-01T00:00:00Z"
MANIFEST = "seq bigint, name string, temporary string, records bigint, bytes bigint, sha256 string"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
BUILT = "page_id bigint, url string, print binary, n bigint, digest string, size bigint, record binary"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}')}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", f"sha1:{_digest(block)}"), ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def build_record(page_id: int | None, url: str | None, payload: bytes | None, refers_to: int | None = None, digest: str = "", length: int = 0) -> bytes:
    """One record, not compressed: a response with its payload, or, without one, a revisit of a payload of that digest and length."""
    revisit = payload is None
    if not revisit:
        digest, length = _digest(payload), len(payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", _DATE)]
    fields += [("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        fields.append(("X-Page-Id", page_id))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Page-Refers-To", refers_to)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    return _record([*fields, ("Content-Type", "application/http; msgtype=response")], http + (payload or b""))


def build_info(name: str) -> bytes:
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, name)), ("WARC-Date", _DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return _record(fields, b"format: WARC File Format 1.1\r\n")


def compress_record(record: bytes) -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0, filename="") as f:
        f.write(record)
    return out.getvalue()


def _fields(stream: io.BufferedReader) -> dict[str, str]:
    out = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def parse_archive(content: bytes) -> Iterator[tuple]:
    """Rows of RECORDS from the bytes of one archive file, compressed or not; checks the digests and lengths that there are. Other types of records are passed over."""
    raw = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw, 1 << 20)
    while first := stream.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a record: {first[:40]!r}")
        fields = _fields(stream)
        size = int(fields["content-length"])
        block = stream.read(size)
        said = fields.get("warc-block-digest", "")
        if len(block) != size or (said.startswith("sha1:") and said != f"sha1:{_digest(block)}"):
            raise ValueError(f"damaged record {fields.get('warc-record-id')}")
        if (kind := fields.get("warc-type")) not in ("response", "revisit"):
            continue
        body, length = block, None
        if fields.get("content-type", "").startswith("application/http"):
            http = io.BufferedReader(io.BytesIO(block))
            http.readline()
            length = _fields(http).get("content-length")
            body = http.read()
        number = lambda x: int(x) if x and x.isdigit() or x and x[0] == "-" and x[1:].isdigit() else None
        revisit = kind == "revisit"
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or (None if revisit else _digest(body))
        yield number(fields.get("x-page-id")), fields.get("warc-target-uri") or None, number(length) if revisit else len(body), digest, kind, number(fields.get("x-page-refers-to")), None if revisit else body


def _open(address: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(address if "://" in address or address.startswith("file:") else f"file://{address}")


def build_records(pages: DataFrame) -> DataFrame:
    """BUILT: each page as a compressed response record, with the SHA-256 and length of its payload."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads = b.column(2).to_pylist()
            made = [compress_record(build_record(i, u, x)) for i, u, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), payloads, strict=True)]
            more = [pa.array([hashlib.sha256(x).digest() for x in payloads], pa.binary()), pa.array([len(x) for x in payloads], pa.int64()), pa.array([_digest(x) for x in payloads], pa.string()), pa.array([len(x) for x in made], pa.int64()), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *more], names=["page_id", "url", "print", "n", "digest", "size", "record"])

    return rows.mapInArrow(run, BUILT)


def revisits(narrow: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """(row, page_id, size, record) of the rows of narrow (row, page_id, url, print, n, digest) that repeat the payload of a larger page_id."""
    some = narrow.where((F.col("n") >= min_revisit_bytes) & F.col("print").isNotNull())
    owners = some.groupBy("print", F.col("n").alias("length")).agg(F.max("page_id").alias("owner"), F.count("*").alias("pages")).where("pages > 1 AND owner IS NOT NULL").drop("pages").withColumnRenamed("print", "of")
    named = some.join(owners, (F.col("print") == F.col("of")) & (F.col("n") == F.col("length"))).where(~F.col("page_id").eqNullSafe(F.col("owner")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, page, url, owner, digest, n = (c.to_pylist() for c in b.columns)
            made = [compress_record(build_record(p, u, None, o, d, k)) for p, u, o, d, k in zip(page, url, owner, digest, n, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in made], pa.int64()), pa.array(made, pa.binary())], names=["row", "page_id", "size", "record"])

    return named.select("row", "page_id", "url", "owner", "digest", "n").mapInArrow(run, "row bigint, page_id bigint, size bigint, record binary")


def place_records(sizes: DataFrame, roll_bytes: int) -> DataFrame:
    """(row, seq, place): the file of each row of sizes (row, page_id, print, url, size) and where its record begins in the whole archive.

    Order: page_id (null first), SHA-256 of the payload, url. Records equal in all three are equal, so their order makes no difference.
    """
    order = [F.col("page_id").asc_nulls_first(), F.col("print").asc(), F.col("url").asc_nulls_first(), F.col("row").asc()]
    count = parts(sizes.sparkSession, sizes.count(), RANGE_ROWS)
    ranged = materialise(sizes.repartitionByRange(count, *order).withColumn("range", F.spark_partition_id()), "warc-ranges")
    totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"))
    # a row a range
    before = totals.select(F.col("range").alias("of"), (F.sum("bytes").over(Window.orderBy("range")) - F.col("bytes")).alias("start"))
    inside = ranged.withColumn("upto", F.sum("size").over(Window.partitionBy("range").orderBy(*order)) - F.col("size"))
    placed = inside.join(F.broadcast(before), F.col("range") == F.col("of")).withColumn("place", F.col("start") + F.col("upto"))
    return placed.select("row", F.expr(f"place div {int(roll_bytes)}").alias("seq"), "place")


def write_warc(pages: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) under path, a folder that all machines share; returns the manifest.

    Files: <path>/part-<seq>.warc.gz, numbered in order, and the table <path>/_manifest, written last.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    built = materialise(build_records(pages).withColumn("row", F.monotonically_increasing_id()), "warc-built")
    again = materialise(revisits(built.drop("record", "size"), min_revisit_bytes), "warc-revisits")
    short = again.select(F.col("row").alias("again"), F.col("size").alias("short"))
    sizes = built.select("row", "page_id", "print", "url", "size").join(short, F.col("row") == F.col("again"), "left")
    placed = materialise(place_records(sizes.select("row", "page_id", "print", "url", F.coalesce("short", "size").alias("size")), roll_bytes), "warc-placed")
    instead = again.select(F.col("row").alias("again"), F.col("record").alias("short"))
    at = placed.withColumnRenamed("row", "of")
    records = built.select("row", "record").join(at, F.col("row") == F.col("of")).join(instead, F.col("row") == F.col("again"), "left").select("seq", "place", F.coalesce("short", "record").alias("record"))
    last = placed.agg(F.max("place")).first()[0] or 0
    # a file is written by one task; a task has files of TASK_BYTES or so
    dealt = records.repartition(parts(spark, last, TASK_BYTES), "seq").sortWithinPartitions("seq", "place")
    temporary = f"{path}/_temporary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(temporary)
        fs.create_dir(folder, recursive=True)
        made: list[tuple] = []
        out, at, name, count, size, digest = None, None, "", 0, 0, None

        def put(record: bytes) -> None:
            nonlocal size
            out.write(record)
            digest.update(record)
            size += len(record)

        def close() -> None:
            if out is not None:
                out.close()
                made.append((at, f"part-{at:010d}.warc.gz", name, count, size, digest.hexdigest()))

        for b in batches:
            for seq, record in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if seq != at:
                    close()
                    at, name, count, size, digest = seq, f"{uuid.uuid4().hex}.warc.gz", 0, 0, hashlib.sha256()
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                    put(compress_record(build_info(f"part-{at:010d}.warc.gz")))
                put(record)
                count += 1
        close()
        columns = list(zip(*made, strict=True)) if made else [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["seq", "name", "temporary", "records", "bytes", "sha256"])

    written = materialise(dealt.mapInArrow(run, MANIFEST), "warc-written")

    # from here on the older archive of this path is no more
    _delete(spark, f"{path}/_manifest")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(path)
        for b in batches:
            for name, temp in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if fs.get_file_info(f"{folder}/_temporary/{temp}").type != pafs.FileType.NotFound:
                    if fs.get_file_info(f"{folder}/{name}").type != pafs.FileType.NotFound:
                        fs.delete_file(f"{folder}/{name}")
                    fs.move(f"{folder}/_temporary/{temp}", f"{folder}/{name}")
                elif fs.get_file_info(f"{folder}/{name}").type == pafs.FileType.NotFound:
                    raise FileNotFoundError(f"{path}/{name}")
            yield b

    renamed = materialise(written.mapInArrow(rename, MANIFEST), "warc-renamed")
    # files of an earlier archive that had more of them: their numbers come after the last one's
    _delete_from(spark, path, renamed.agg(F.max("seq")).first()[0])
    renamed.write.parquet(f"{path}/_manifest")
    _delete(spark, temporary)
    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _delete_from(spark: SparkSession, path: str, last: int | None) -> None:
    """Remove the files of an archive whose number is over `last`, or all of them; their names follow from their numbers, without gaps that matter."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in system.listStatus(at) if system.exists(at) else []:
        name = found.getPath().getName()
        if name.startswith("part-") and name.endswith(".warc.gz") and (last is None or int(name[5:15]) > last):
            system.delete(found.getPath(), False)


def read_warc(spark: SparkSession, path: str, foreign: bool = False) -> DataFrame:
    """RECORDS of the files that the manifest under path names; a revisit's payload is null, its digest and length are the full payload's.

    Without a manifest the archive is not complete: an error. foreign: read every archive file under path, whoever wrote it. A file
    that the manifest names but that is not there, or has another length, is an error as well.
    """
    bounded_batches(spark)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(path)
    if foreign:
        files = found.select("content")
    else:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest/_SUCCESS")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            raise FileNotFoundError(f"no manifest under {path}: not a complete archive")
        named = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest").select("name", F.col("bytes").alias("said"))
        file = F.regexp_extract("path", "([^/]+)$", 1)
        there = found.select(file.alias("file"), "length")  # their contents aren't read for this
        lost = named.join(there, (F.col("name") == F.col("file")) & (F.col("said") == F.col("length")), "left_anti").select("name").limit(1).collect()
        if lost:
            raise FileNotFoundError(f"missing or cut off: {path}/{lost[0]['name']}")
        # a name a file of ROLL_BYTES or so: some MB for a hundred thousand
        few = named.select(F.col("name").alias("of"))
        few = F.broadcast(few) if few.count() <= MOST_BROADCAST else few
        files = found.join(few, file == F.col("of"), "left_semi").select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for b in batches:
            for content in b.column(0):
                rows: list[tuple] = []
                size = 0
                for r in parse_archive(content.as_py()):
                    rows.append(r)
                    size += len(r[6] or b"")
                    if len(rows) >= 500 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(run, RECORDS)


def archive_round_trip(pages: DataFrame, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write pages as an archive in the shared folder and read its records back, without payloads."""
    path = new_path(pages.sparkSession, "warc")
    if write_warc(pages, path, roll_bytes).limit(1).count() == 0:
        return pages.sparkSession.createDataFrame([], RECORDS).drop("payload")
    return read_warc(pages.sparkSession, path).drop("payload")
