"""WARC archives: sharded, the same bytes for the same table, each payload once.

1. Narrow rows (id, digest, size) tell which record of equal payloads is the response; the others are revisits
   that name it. Only digests of several rows are joined, to rows without their payload; the names found go with
   the records through the exchange, so that payloads move once.
2. Records are ordered by id. Boundaries of ranges of equal bytes come from exact counts (splitters.find), so
   they depend on the table alone; one exchange brings a range together, which a task sorts and writes.
3. A record is a gzip member of its own. Headers, lengths and digests are made anew from the payload, dates
   and identifiers from what the record holds. A file is closed once it has `file_bytes` compressed bytes.
4. Files are written under names that no other attempt uses, and listed with size and digest in a manifest,
   which Spark commits: of attempts that ran twice only one is listed. commit() renames what is listed, and may
   be run again where it was cut off; then a mark is set, and what nobody lists is removed.

records() reads archives back: it takes the files of the manifest, checks each one's digest and each record's
length, block and payload digests, and fails where one doesn't hold.

Files are reached through pyarrow's file systems: the folder may be a path or an address that those know.

Defined results: a null html is an empty payload; payloads under SMALL bytes are never revisits; rows that
share the smallest id of a payload are all responses; a null id is larger than any other, and where a payload
has no other id all its rows are responses; a null url gives a record without target; signs that a header can't
hold are percent-coded; repeated rows are records of their own, rows of one id are ordered by digest and url;
an empty table gives a manifest without files; other columns are not looked at. Ids that differ by 2**42 or
more are ranged by their leading bits first. A record must fit in a task's memory, a file need not.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import shared_folder
from . import splitters
from .common import batch_of, cut, text_bytes

#: Bytes from which equal payloads are revisits.
SMALL = 100
#: Payload bytes of a range, ranges at least, compressed bytes from which a file is closed.
RANGE_BYTES, LEAST_RANGES, FILE_BYTES = 1 << 30, 96, 256 << 20
#: How far a range's boundary may be off, as a part of a range.
TOLERANCE = 0.25
#: Bytes that a record counts for beside its payload.
ROW_BYTES = 600
#: Records have no date of their own in the tables.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST, DONE, PENDING = "manifest", "DONE", "pending"
_FILE_COLUMNS = "range int, number int, pending string, name string, records long, bytes long, digest string"
#: Tasks that rename or read files, at most.
MOST_TASKS = 20_000
_KEY_BITS, _TIE_BITS = 42, 20
_READ = 1 << 18


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


# Records.


def record_id(page_id: int | None, digest: str) -> str:
    """The same name for the same page and payload."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{digest}'.encode()).digest()[:16], version=5)}>"


def coded(url: str) -> str:
    return re.sub(r"[^\x21-\x7E]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A record before compression; a revisit if it refers to another."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": DATE, "WARC-Target-URI": coded(url) if url else None,
        "WARC-Profile": PROFILE if revisit else None, "WARC-Refers-To": record_id(refers_to, digest) if revisit else None, "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Page-Id": page_id, "Refers-To-Page-Id": refers_to, "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
    }
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    head: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def payload_bytes(self) -> int:
        """Of the whole payload, which a revisit doesn't hold."""
        return int(re.search(rb"\r\nContent-Length: (\d+)", self.block.partition(b"\r\n\r\n")[0])[1])


def parsed(member: bytes) -> Record:
    """A record, checked against its own header."""
    top, _, rest = member.partition(b"\r\n\r\n")
    first, *lines = top.decode().split("\r\n")
    head = dict(line.split(": ", 1) for line in lines)
    found = Record(head, rest[: int(head["Content-Length"])])
    sound = first == "WARC/1.1" and rest[len(found.block) :] == b"\r\n\r\n" and head["WARC-Block-Digest"] == f"sha256:{hashlib.sha256(found.block).hexdigest()}"
    if sound and head["WARC-Type"] == "response":
        sound = found.payload_bytes == len(found.payload) and head["WARC-Payload-Digest"] == f"sha256:{hashlib.sha256(found.payload).hexdigest()}"
    if not sound:
        raise ValueError(f"record {head.get('WARC-Record-ID')} doesn't hold what its header says")
    return found


# Writing.


def sort_key(low: int, high: int) -> Column:
    """The leading bits of the id's place among ids from low to high (null: last), shifted to leave room for tie()."""
    spread = max((high - low).bit_length() - _KEY_BITS, 0)
    place = F.coalesce(F.shiftright(F.col("page_id") - F.lit(low), spread), F.lit((high - low >> spread) + 1))
    return F.shiftleft(place.cast("long"), _TIE_BITS)


def tie() -> Column:
    """Bits of what else a record holds, and some of the row's place, so that rows of one id can be parted."""
    return F.pmod(F.xxhash64("url", "digest"), F.lit(1 << _TIE_BITS - 8)) * 256 + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(256))


def revisits(rows: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the records that refer to another, from rows (page_id, size, digest)."""
    shared = rows.filter(F.col("size") >= SMALL).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = cut(shared.filter("n > 1 and first is not null").select("digest", "first"))
    later = rows.join(shared, "digest").filter("page_id is null or page_id > first")
    return later.select("page_id", "digest", F.col("first").alias("refers_to")).distinct()


def write(pages: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, least_ranges: int = LEAST_RANGES, file_bytes: int = FILE_BYTES) -> None:
    """Archives of pages (page_id, url, html) in a new folder that all machines share, with their manifest; not committed yet."""
    spark = pages.sparkSession
    ends = pages.agg(F.min(F.col("page_id").cast("long")), F.max(F.col("page_id").cast("long"))).first()
    place = sort_key(*(int(x) if x is not None else 0 for x in ends))
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_bytes("html").alias("payload"))
    whole = whole.withColumn("digest", F.sha2("payload", 256)).withColumn("key", place + tie())
    rows = cut(whole.select("page_id", "digest", F.octet_length("payload").cast("long").alias("size"), "key"))
    weights = rows.select("key", (F.col("size") + ROW_BYTES).alias("weight"))
    total = weights.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    ranges = splitters.find(weights, max(least_ranges, -(-total // range_bytes)), TOLERANCE)
    bounds = spark.sparkContext.broadcast(ranges.bounds)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, keys.to_numpy(), side="right").astype(np.int32))

    # A revisit's reference goes to each range that may hold its record, before it: payloads are exchanged once and joined to nothing.
    parts = revisits(rows).withColumn("place", place).withColumn("last", range_of(F.col("place") + (1 << _TIE_BITS) - 1))
    names = parts.select(F.explode(F.sequence(range_of("place"), "last")).alias("range"), "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers_to")
    placed = whole.select(range_of("key").alias("range"), "page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("refers_to"))
    order = ["range", F.asc_nulls_last("page_id"), "digest", F.asc_nulls_last("refers_to"), "url"]
    _filed(names.unionByName(placed).repartition("range").sortWithinPartitions(*order), folder, file_bytes).write.parquet(f"{folder}/{MANIFEST}")


def _filed(ordered: DataFrame, folder: str, file_bytes: int) -> DataFrame:
    """A row of the manifest for each file that a task has written."""
    schema = pa.schema([("range", pa.int32()), ("number", pa.int32()), *((c, pa.string()) for c in ("pending", "name")), *((c, pa.int64()) for c in ("records", "bytes")), ("digest", pa.string())])

    class File:
        def __init__(self, where: int, number: int):
            self.where, self.number, self.records, self.bytes, self.sum = where, number, 0, 0, hashlib.sha256()
            self.system, top = opened(folder)
            self.pending = f"{PENDING}/{where:08d}-{number:05d}-{uuid.uuid4().hex}"
            self.system.create_dir(f"{top}/{PENDING}", recursive=True)
            self.out = self.system.open_output_stream(f"{top}/{self.pending}")

        def add(self, raw: bytes) -> None:
            squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = squeeze.compress(raw) + squeeze.flush()
            self.out.write(member)
            self.sum.update(member)
            self.records, self.bytes = self.records + 1, self.bytes + len(member)

        def closed(self) -> pa.RecordBatch:
            self.out.close()
            row = (self.where, self.number, self.pending, f"{self.where:08d}-{self.number:05d}.warc.gz", self.records, self.bytes, self.sum.hexdigest())
            return batch_of(schema, [[x] for x in row])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, named, target = None, None, None
        for batch in batches:
            where, ids, urls, digests, refers = (batch.column(c).to_pylist() for c in ("range", "page_id", "url", "digest", "refers_to"))
            payloads = batch.column("payload")
            for k, at in enumerate(where):
                if refers[k] is not None:  # no record, but what those of this id and digest refer to
                    named, target = (ids[k], digests[k]), refers[k]
                    continue
                if file is not None and (file.where != at or file.bytes >= file_bytes):
                    yield file.closed()
                    file = File(at, file.number + 1 if file.where == at else 0)
                file = file or File(at, 0)
                file.add(record(ids[k], urls[k], payloads[k].as_py(), digests[k], target if named == (ids[k], digests[k]) else None))
        if file is not None:
            yield file.closed()

    return ordered.mapInArrow(run, _FILE_COLUMNS)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_FILE_COLUMNS).parquet(f"{folder}/{MANIFEST}")


def dealt(files: DataFrame) -> DataFrame:
    """The manifest's rows, a task for each up to MOST_TASKS: their number is set, since by their few bytes all would be given to one."""
    return files.repartition(max(1, min(files.count(), MOST_TASKS)))


def commit(spark: SparkSession, folder: str) -> None:
    """Gives the listed files their names, then sets the mark; files that were renamed before are left as they are."""
    files = manifest(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(folder)
        for batch in batches:
            for pending, name, size in zip(*(batch.column(c).to_pylist() for c in ("pending", "name", "bytes")), strict=True):
                if system.get_file_info(f"{top}/{name}").type == fs.FileType.NotFound:
                    system.move(f"{top}/{pending}", f"{top}/{name}")
                if system.get_file_info(f"{top}/{name}").size != size:
                    raise ValueError(f"{name} has not the size that the manifest says")
            yield batch.select(["name"])

    dealt(files.select("pending", "name", "bytes")).mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()
    system, top = opened(folder)
    with system.open_output_stream(f"{top}/{DONE}") as out:
        out.write(b"")
    if system.get_file_info(f"{top}/{PENDING}").type != fs.FileType.NotFound:
        system.delete_dir(f"{top}/{PENDING}")


# Reading.


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unzip, own = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            own.append(unzip.decompress(chunk))
            if not unzip.eof:
                break
            yield b"".join(own)
            chunk, unzip, own = unzip.unused_data, zlib.decompressobj(31), []
    if any(own):
        raise ValueError("a file ends within a record")


def records(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """file, url, page_id, payload_bytes, payload_digest, record_type, refers_to (and the payload, null for revisits) of every record of committed archives."""
    system, top = opened(folder)
    if system.get_file_info(f"{top}/{DONE}").type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{folder} is not committed")
    columns = [("file", pa.string()), ("url", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(columns + [("payload", pa.binary())] * payloads)

    def row(name: str, r: Record) -> tuple:
        number = lambda k: int(r.head[k]) if k in r.head else None
        head = (name, r.head.get("WARC-Target-URI"), number("Page-Id"), r.payload_bytes, r.head["WARC-Payload-Digest"].removeprefix("sha256:"), r.head["WARC-Type"], number("Refers-To-Page-Id"))
        return (*head, r.payload if r.head["WARC-Type"] == "response" else None) if payloads else head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(folder)
        for batch in batches:
            for name, digest, n in zip(*(batch.column(c).to_pylist() for c in ("name", "digest", "records")), strict=True):
                whole, seen, held, weight = hashlib.sha256(), 0, [], 0

                def chunks(source, whole=whole) -> Iterator[bytes]:
                    while chunk := source.read(_READ):
                        whole.update(chunk)
                        yield chunk

                with system.open_input_stream(f"{top}/{name}", compression=None) as source:
                    for member in members(chunks(source)):
                        held.append(row(name, parsed(member)))
                        seen, weight = seen + 1, weight + (len(member) if payloads else 500)
                        if weight > 4 << 20:
                            yield batch_of(schema, zip(*held, strict=True))
                            held, weight = [], 0
                if held:
                    yield batch_of(schema, zip(*held, strict=True))
                if whole.hexdigest() != digest or seen != n:
                    raise ValueError(f"{name} is not the file that the manifest lists")

    kinds = "file string, url string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return dealt(manifest(spark, folder).select("name", "digest", "records")).mapInArrow(run, kinds)


def archived(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from archives of all pages; the archives are removed."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark.sparkContext)}/lattica-warc-{uuid.uuid4().hex}"
    write(pages, folder)
    commit(spark, folder)
    found = cut(records(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    system, top = opened(folder)
    system.delete_dir(top)
    return found


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN size >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM p)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN first END AS refers_to FROM f"""
