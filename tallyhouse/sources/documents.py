"""A sink for whole documents: calendars, maps, site maps, API answers.

A document is one file: a head (kind 0), entries (kind 1) with a separator between them, a foot (kind 2). Entries are sorted by ranges of their order and joined to compressed
pieces of PIECE bytes where they are sorted; the rows that the sink gets (document, kind, size, packed) are such pieces. They come dealt by document and
sorted, so a task writes its documents piece by piece, never holds one, and reads them compressed. What is written is hashed block by block as well, so that many tasks can check one document. Tasks write under temporary names; the commit renames them and then writes the list of
documents, so readers of the list see all of a write or nothing of it; an abort, or the next commit, removes what a failed task left.

A document is one file, so one task writes it however long it is; what can outgrow that is to be dealt to several documents, as site_map_documents does.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

HEAD, ENTRY, FOOT = 0, 1, 2
LIST = "documents.json"
#: Bytes of a piece that entries are joined to, and of a block that is checked at once.
PIECE, BLOCK = 1 << 20, 16 << 20


def _open(address: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(address if ":" in address.split("/")[0] else f"file://{address}")


@dataclass
class Written(WriterCommitMessage):
    #: document, temporary name, entries, bytes, sha256, sha256 of each block
    files: list[tuple[str, str, int, int, str, list[str]]]


class DocumentSink(DataSource):
    """spark.write.format("documents") with the options path and separator."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], self.options.get("separator", ""), int(self.options.get("block", BLOCK)))


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str, separator: str, block: int):
        self.path, self.separator, self.block, self.job = path.rstrip("/"), separator.encode(), block, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = _open(f"{self.path}/_temporary-{self.job}")
        fs.create_dir(folder, recursive=True)
        files: list[tuple[str, str, int, int, str, list[str]]] = []
        out, at, name, entries, size, digest, blocks = None, None, "", 0, 0, None, []

        def put(data: bytes) -> None:
            nonlocal size
            out.write(data)
            digest.update(data)
            while data:
                if size % self.block == 0:
                    blocks.append(hashlib.sha256())
                some = data[: self.block - size % self.block]
                blocks[-1].update(some)
                size += len(some)
                data = data[len(some) :]

        def close() -> None:
            if out is not None:
                out.close()
                files.append((at, name, entries, size, digest.hexdigest(), [x.hexdigest() for x in blocks]))

        for batch in iterator:
            for document, kind, n, length, packed in zip(*(batch.column(c).to_pylist() for c in ("document", "kind", "n", "length", "packed")), strict=True):
                if document != at:
                    close()
                    at, name, entries, size, digest, blocks = document, uuid.uuid4().hex, 0, 0, hashlib.sha256(), []
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                if kind == ENTRY:
                    if entries:
                        put(self.separator)
                    entries += n
                put(pa.decompress(packed, length, "zstd", asbytes=True) if length else b"")
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = _open(self.path)
        fs.create_dir(folder, recursive=True)
        files = sorted(f for m in messages if m for f in m.files)
        if len({f[0] for f in files}) != len(files):
            self.abort(messages)
            raise ValueError("rows of one document came in several tasks: deal them by document")
        for document, name, *_ in files:
            target = f"{folder}/{document}"
            fs.create_dir(target.rpartition("/")[0], recursive=True)
            if fs.get_file_info(target).type != pafs.FileType.NotFound:
                fs.delete_file(target)
            fs.move(f"{folder}/_temporary-{self.job}/{name}", target)
        with fs.open_output_stream(f"{folder}/.{self.job}") as out:
            out.write(json.dumps([{"document": d, "entries": n, "bytes": b, "sha256": h, "block": self.block, "blocks": x} for d, _, n, b, h, x in files]).encode())
        if fs.get_file_info(f"{folder}/{LIST}").type != pafs.FileType.NotFound:
            fs.delete_file(f"{folder}/{LIST}")
        fs.move(f"{folder}/.{self.job}", f"{folder}/{LIST}")
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            if info.base_name.startswith("_temporary-"):
                fs.delete_dir(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = _open(f"{self.path}/_temporary-{self.job}")
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)


def write_documents(entries: DataFrame, frames: DataFrame, order: list[str], path: str, separator: str = "", block: int = BLOCK) -> None:
    """Write a file for each row of frames (document, head, foot) with its entries (document, text and the columns of `order`) between head and foot."""
    spark = entries.sparkSession
    spark.dataSource.register(DocumentSink)
    kinds = frames.select("document", F.explode(F.array(F.struct(F.lit(HEAD).alias("kind"), F.col("head").alias("text")), F.struct(F.lit(FOOT).alias("kind"), F.col("foot").alias("text")))).alias("x")).select("document", "x.*")
    # ranges, and not documents, are what tasks sort: a long document is dealt to several of them
    body = entries.select("document", F.lit(ENTRY).alias("kind"), *order, "text").repartitionByRange("document", *order).sortWithinPartitions("document", *order)
    rows = _packed(body, order, separator).unionByName(_packed(kinds, [], separator), allowMissingColumns=True)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    rows.repartition("document").sortWithinPartitions("document", "kind", *order).select("document", "kind", "n", "length", "packed").write.format("documents").option("path", path).option("separator", separator).option("block", block).mode("append").save()


def _packed(rows: DataFrame, order: list[str], separator: str) -> DataFrame:
    """Sorted rows (document, kind, *order, text) as compressed pieces (document, kind, *order of the first row, n, length, packed)."""
    between = separator.encode()
    keys = rows.select("document", "kind", *order).schema
    schema = StructType([*keys.fields, StructField("n", IntegerType()), StructField("length", IntegerType()), StructField("packed", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, of, held, size = None, None, [], 0

        def close() -> pa.RecordBatch:
            data = between.join(held)
            tail = [pa.array([len(held)], pa.int32()), pa.array([len(data)], pa.int32()), pa.array([pa.compress(data, "zstd", asbytes=True)], pa.binary())]
            return pa.RecordBatch.from_arrays([*first, *tail], names=[*keys.names, "n", "length", "packed"])

        for b in batches:
            columns = [b.column(c) for c in keys.names]
            for k, (document, kind, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("document", "kind", "text")), strict=True)):
                if held and (size >= PIECE or of != (document, kind)):
                    yield close()
                    held, size = [], 0
                if not held:
                    first, of = [c.slice(k, 1) for c in columns], (document, kind)
                held.append((text or "").encode())
                size += len(held[-1]) + len(between)
        if held:
            yield close()

    return rows.mapInArrow(run, schema)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(document, text): the files that the list of documents names; an error without a list."""
    listed = spark.read.text(f"{path}/{LIST}", wholetext=True).select(F.explode(F.from_json("value", "array<struct<document: string, bytes: bigint, sha256: string>>")).alias("d")).select("d.*")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "content")
    top = path.rstrip("/").rpartition("/")[2]
    name = F.regexp_extract("file", f"/{top}/(.*)$", 1)
    found = listed.join(files.withColumn("of", name), F.col("document") == F.col("of"), "left")
    whole = F.when(F.sha2(F.coalesce("content", F.lit(b"")), 256) == F.col("sha256"), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("damaged or missing: "), "document")))
    return found.select("document", whole.alias("text"))


def check_documents(spark: SparkSession, path: str) -> DataFrame:
    """(document, bytes, sha256) of the files that the list of documents names, read back whole; an error for a damaged or missing one.

    Blocks are read and compared by many tasks. If all are what was written, so is the document, and the hash that its writer has taken is its own.
    """
    spec = "array<struct<document: string, bytes: bigint, sha256: string, block: bigint, blocks: array<string>>>"
    listed = spark.read.text(f"{path}/{LIST}", wholetext=True).select(F.explode(F.from_json("value", spec)).alias("d")).select("d.*")
    blocks = listed.select("document", "bytes", "sha256", "block", F.posexplode_outer("blocks").alias("k", "expected")).repartition("document", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for document, size, sha256, block, k, expected in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, file = _open(f"{path.rstrip('/')}/{document}")
                if fs.get_file_info(file).size != size:
                    raise ValueError(f"damaged or missing: {document}")
                if k is not None:
                    with fs.open_input_file(file) as f:
                        if hashlib.sha256(f.read_at(min(block, size - k * block), k * block)).hexdigest() != expected:
                            raise ValueError(f"damaged or missing: {document}")
            yield b.select(["document", "bytes", "sha256"])

    return blocks.mapInArrow(run, "document string, bytes bigint, sha256 string").distinct()


CRLF = "\r\n"
#: Lines around the events of a calendar, and the most addresses of a site map. Fixed values of those formats.
CALENDAR_HEAD = ("BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//Listings//Feeds//EN", "CALSCALE:GREGORIAN", "METHOD:PUBLISH")
URLS = 50_000


def calendar_frame(name: Column) -> Column:
    """The head of a calendar with the name that subscribers see."""
    return F.concat(F.lit(CRLF.join(CALENDAR_HEAD) + f"{CRLF}X-WR-CALNAME:"), name, F.lit(f"{CRLF}X-WR-TIMEZONE:America/Chicago{CRLF}"))


def xml_text(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def site_map_documents(paths: DataFrame, base: str, modified: str, path: str, most: int = URLS) -> None:
    """Site maps of at most `most` addresses each (paths: path, distinct) and the index that names them.

    Which map an address is in follows from its hash, so that a new page changes one map; maps are as many as fill them to half on average.
    """
    n = max(1, -(-2 * paths.count() // most))
    dealt = paths.withColumn("k", F.pmod(F.xxhash64("path"), F.lit(n)))
    entry = F.concat(F.lit("<url><loc>"), xml_text(F.concat(F.lit(base), "path")), F.lit(f"</loc><lastmod>{modified}</lastmod></url>\n"))
    name = F.concat(F.lit("sitemap-"), F.lpad(F.col("k").cast("string"), 6, "0"), F.lit(".xml"))
    maps = dealt.select(name.alias("document"), entry.alias("text"), "path")
    xml = '<?xml version="1.0" encoding="UTF-8"?>\n'
    space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    frames = maps.select("document").distinct()
    index = frames.select(F.lit("sitemap.xml").alias("document"), F.concat(F.lit(f"<sitemap><loc>{base}/"), "document", F.lit(f"</loc><lastmod>{modified}</lastmod></sitemap>\n")).alias("text"), F.col("document").alias("path"))
    heads = frames.select("document", F.lit(f"{xml}<urlset {space}>\n").alias("head"), F.lit("</urlset>\n").alias("foot"))
    top = paths.sparkSession.createDataFrame([("sitemap.xml", f"{xml}<sitemapindex {space}>\n", "</sitemapindex>\n")], "document string, head string, foot string")
    write_documents(maps.unionByName(index), heads.unionByName(top), ["path"], path)
