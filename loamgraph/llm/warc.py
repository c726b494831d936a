"""WARC archives and a two-level capture index."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import ceil
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pa_fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_values, shared_folder, stored

ARCHIVE_BYTES = 32 << 20
BLOCK_LINES = 1024
#: Captures in one sorted partition of the index.
INDEX_LINES = 1 << 20
SEPARATOR = "\r\n\r\n"
#: Records made from compressed payloads at once.
RECORDS = 256

CAPTURE = "page_id long, url string, key string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """The host's labels reversed, then the path and query: captures of a site sort together."""
    try:
        parts = urlsplit(url or "")
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return f"!)/{url}"
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + tail


def target(url: str | None) -> str:
    """The url as a header field holds it: without line breaks."""
    return re.sub(r"[\r\n]", "%0A", url or "")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _rows(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """page_id, url, row_key, digest (SHA-1 in hex), size, payload."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    # Rows without an id are spread by their url.
    key = F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("none"), F.pmod(F.xxhash64("url"), F.lit(1024)).cast("string")))
    return rows.select("page_id", "url", key.alias("row_key"), F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"), "payload")


def _packed(rows: DataFrame) -> DataFrame:
    """rows with the payload compressed, as `packed`."""
    names = [c for c in rows.columns if c != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=10).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(map(pack, byte_values(batch.column(len(names)))), pa.binary())], [*names, "packed"])

    return rows.select(*names, "payload").mapInArrow(run, rows.select(*names).schema.add("packed", "binary"))


def _record(page_id: int | None, url: str | None, digest: str, size: int, best: int | None, payload: bytes) -> str:
    """A record but for the blank lines after it. A header field holds no line breaks."""
    again = best is not None
    fields = [
        ("WARC-Type", "revisit" if again else "response"),
        ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"),
        ("WARC-Target-URI", target(url)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"),
    ]
    if again:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{best}>"), ("X-Payload-Length", str(size))]
    fields += [("Content-Type", "text/html"), ("Content-Length", str(0 if again else size))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n" + ("" if again else payload.decode("utf-8"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> str:
    """Writes a WARC record per row under folder, in archives of about ARCHIVE_BYTES.

    Of equal payloads of at least min_bytes the largest id is a
    response, the others are revisits that name it; smaller ones are all
    responses. Equal payloads meet as digests, aggregated before the shuffle; payloads move
    once, compressed, spread by digest and id. Records are valid UTF-8, so Spark's text
    writer commits them, with the records' closing blank lines as its separator.
    """
    spark = pages.sparkSession
    rows = _rows(pages, id_col, url_col, payload_col)
    keys = stored(rows.select("page_id", "row_key", "digest", "size"))
    archives = ceil((keys.agg(F.sum(F.col("size") + 512)).first()[0] or 1) / ARCHIVE_BYTES)
    best = keys.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = keys.join(best, "digest").where("best is not null and (page_id is null or page_id <> best)").select("digest", "row_key", "best").distinct()
    left = _packed(rows).repartition(archives, "digest", "row_key")
    both = left.join(revisits.repartition(archives, "digest", "row_key"), ["digest", "row_key"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, RECORDS):
                part = batch.slice(at, RECORDS)
                rows = zip(*(part.column(i).to_pylist() for i in range(6)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([_record(i, u, d, n, b, b"" if b is not None else unpack(p)) for i, u, d, n, b, p in rows], pa.string())], ["value"])

    records = both.select("page_id", "url", "digest", "size", "best", "packed").mapInArrow(run, "value string")
    records.write.option("lineSep", SEPARATOR).option("compression", "none").text(folder)
    _rename(spark, folder)
    return folder


def _fs(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _rename(spark: SparkSession, folder: str) -> None:
    fs, path = _fs(spark, folder)
    for status in fs.listStatus(path(folder)):
        name = status.getPath().getName()
        if name.startswith("part-"):
            fs.rename(status.getPath(), path(folder, re.sub(r"^part-(\d+).*?(-c\d+)?\.txt$", r"capture-\1\2.warc", name)))


def parse_records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header, block) of each record; damage raises ValueError."""
    at = 0
    while at < len(content):
        head = content.find(b"\r\n\r\n", at)
        if head < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in content[at:head].decode("utf-8").split("\r\n")[1:])
        start = head + 4
        end = start + int(fields["Content-Length"])
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has a wrong length")
        yield at, end + 4 - at, fields, content[start:end]
        at = end + 4


def _number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _capture(at: tuple[int, int, dict[str, str], bytes], name: str) -> tuple:
    """CAPTURE of a record; a response's size and digest are taken from its bytes."""
    offset, length, fields, block = at
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(fields.get("X-Payload-Length", len(block)))
    if fields["WARC-Type"] == "response" and base32_sha1(block) != digest:
        raise ValueError(f"{name}: the payload at byte {offset} isn't what its digest says")
    url = fields["WARC-Target-URI"]
    return _number(fields["WARC-Record-ID"]), url, url_key(url), size, digest, fields["WARC-Type"], _number(fields.get("WARC-Refers-To")), name, offset, length


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in CAPTURE.split(", ")])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record, with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield _captures([_capture(at, name.rsplit("/", 1)[-1]) for at in parse_records(content.as_py())])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(folder)
    return files.select("path", "content").mapInArrow(run, CAPTURE)


def build_index(captures: DataFrame, folder: str) -> str:
    """Sorts captures by key into compressed blocks under folder/blocks, with a sparse directory of them in folder/directory.

    The index is in parts of about INDEX_LINES captures, each a range of keys.
    """
    captures = stored(captures)
    parts = ceil(captures.count() / INDEX_LINES) or 1
    ordered = captures.repartitionByRange(parts, "key", "page_id", "archive", "offset").sortWithinPartitions("key", "page_id", "archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in _then_none(batches):
            if batch is not None and batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            while n >= BLOCK_LINES or (batch is None and n):
                table = pa.Table.from_batches(held)
                block, rest = table.slice(0, BLOCK_LINES), table.slice(BLOCK_LINES)
                held, n = rest.to_batches(), rest.num_rows
                keys = block.column("key").to_pylist()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, block.schema) as out:
                    out.write_table(block)
                yield pa.RecordBatch.from_arrays([pa.array([keys[0]]), pa.array([keys[-1]]), pa.array([len(keys)], pa.int32()), pa.array([zlib.compress(sink.getvalue().to_pybytes())])], ["first_key", "last_key", "lines", "block"])

    ordered.mapInArrow(run, "first_key string, last_key string, lines int, block binary").withColumns({"block_id": F.monotonically_increasing_id(), "part": F.spark_partition_id()}).write.parquet(f"{folder}/blocks")
    blocks = captures.sparkSession.read.parquet(f"{folder}/blocks")
    blocks.select("part", "first_key", "last_key", "block_id", "lines").write.parquet(f"{folder}/directory")
    return folder


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _block(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zlib.decompress(data)).read_all()


def _found(keys: list[str], table: pa.Table, key: str) -> pa.Table:
    """A block's captures of a key, by binary search."""
    at = bisect_left(keys, key)
    return table.slice(at, bisect_right(keys, key) - at)


def look_up(spark: SparkSession, index: str, urls: DataFrame) -> DataFrame:
    """The captures (CAPTURE) of every distinct url (url), in tasks side by side.

    Upper level: the key ranges of the index's parts, a row for a million captures, send each asked key to the parts that may hold it. Lower level: a
    part's task searches its directory for the key's blocks, opens these alone, and searches them. Parts and blocks are bounded, a key
    with many captures is asked of each of its parts.
    """
    ranges = spark.read.parquet(f"{index}/directory").groupBy("part").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).collect()
    ranges = sorted((r["low"], r["high"], r["part"]) for r in ranges)
    low, high = [r[0] for r in ranges], [r[1] for r in ranges]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, keys = [], []
            for key in {url_key(target(u)) for u in batch.column(0).to_pylist()}:
                own = ranges[bisect_left(high, key) : bisect_right(low, key)]
                parts += [r[2] for r in own]
                keys += [key] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(keys, pa.string())], ["part", "key"])

    asked = urls.select("url").mapInArrow(keyed, "part int, key string").distinct()
    blocks = spark.read.parquet(f"{index}/blocks").select("part", "first_key", "last_key", "block_id", "block")

    def search(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        blocks = blocks.sort_by("block_id")
        first, last = blocks.column("first_key").to_pylist(), blocks.column("last_key").to_pylist()
        wanted: dict[int, list[str]] = {}
        for key in asked.column("key").to_pylist():
            for i in range(bisect_left(last, key), bisect_right(first, key)):
                wanted.setdefault(i, []).append(key)
        out = [_captures([])]
        for i, keys in wanted.items():
            table = _block(blocks.column("block")[i].as_py())
            own = table.column("key").to_pylist()
            for key in keys:
                out += _found(own, table, key).to_batches()
        return pa.Table.from_batches(out)

    return asked.groupBy("part").cogroup(blocks.groupBy("part")).applyInArrow(search, CAPTURE)


def read_captures(captures: DataFrame, archives: str) -> DataFrame:
    """CAPTURE of each capture's record itself, by range reads of its archive where the task runs: the folder is one that all executors reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pa_fs.FileSystem.from_uri(archives if "://" in archives or archives.startswith("file:") else os.path.abspath(archives))
        for batch in batches:
            rows, name, source = [], None, None
            places = batch.select(["archive", "offset", "length"]).to_pylist()
            for at in sorted(places, key=lambda r: (r["archive"], r["offset"])):
                if at["archive"] != name:
                    name = at["archive"]
                    source = store.open_input_file(f"{folder}/{name}")
                (_, length, fields, block), *more = parse_records(source.read_at(at["length"], at["offset"]))
                if more or length != at["length"]:
                    raise ValueError(f"{name}: no single record at byte {at['offset']}")
                rows.append(_capture((at["offset"], length, fields, block), name))
            yield _captures(rows)

    return captures.mapInArrow(run, CAPTURE)


class CaptureIndex:
    """Point look-ups from the driver: a look-up reads the directory's rows around its key, few blocks, and byte ranges."""

    def __init__(self, spark: SparkSession, index: str, archives: str):
        self.spark, self.index, self.archives = spark, index, archives

    def find(self, url: str) -> list[dict]:
        key = url_key(target(url))
        near = self.spark.read.parquet(f"{self.index}/directory").where((F.col("first_key") <= key) & (F.col("last_key") >= key)).select("block_id").collect()
        if not near:
            return []
        found = self.spark.read.parquet(f"{self.index}/blocks").where(F.col("block_id").isin([r.block_id for r in near])).select("block").orderBy("block_id").collect()
        out = []
        for row in found:
            table = _block(bytes(row.block))
            out += _found(table.column("key").to_pylist(), table, key).to_pylist()
        return out

    def read(self, capture: dict) -> tuple[dict[str, str], bytes]:
        """Header and block of a capture, by a range read."""
        fs, path = _fs(self.spark, self.archives)
        stream = fs.open(path(self.archives, capture["archive"]))
        try:
            stream.seek(capture["offset"])
            data = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, capture["length"]))
        finally:
            stream.close()
        _, _, fields, block = next(parse_records(data))
        return fields, block


def archive_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes archives and their index, then looks up every page's url, and returns what its records say.

    Null html is an empty payload, a null url an empty one (its key sorts first), a null
    id stays null and is never referred to; rows that repeat the response's id and payload are
    responses too. Other columns are ignored; an empty table leaves empty
    archives and index.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, f"{folder}/archives", min_bytes=min_bytes)
    build_index(read_archives(spark, f"{folder}/archives"), f"{folder}/index")
    found = look_up(spark, f"{folder}/index", pages.select(F.col("url").cast("string").alias("url")))
    return read_captures(found, f"{folder}/archives")
