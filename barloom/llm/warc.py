"""WARC archives of web pages, compressed record by record with a Zstandard dictionary of their own.

An archive (.warc.zst) begins with a skippable frame that holds a dictionary, trained on the archive's first records;
each record follows as a frame of its own, so that any of them can be read alone. A page whose payload another page with
a smaller id has too is a revisit record, which keeps the headers only. The archives are a Spark data source,
"warc_zst": tasks write to a folder of their attempt, and only the committed attempts' archives are moved into place.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from barloom.llm.common import shared_folder, table

#: Payloads with fewer bytes are never revisited. Records of a dictionary's training and of an archive, bytes.
LEAST, TRAIN_BYTES, ARCHIVE_BYTES = 100, 8 << 20, 1 << 30
#: Repeated payloads that are broadcast at most (their digests, ids and addresses), and salts of a shuffled join.
BROADCAST_ROWS, SALTS = 100_000, 16
#: Largest dictionary, compression level. Date of records, as pages have none.
DICTIONARY_BYTES, LEVEL, DATE = 112_640, 3, "1970-01-01T00:00:00Z"
#: Magic numbers of the format: a skippable frame with a dictionary; profile of revisits by payload. Fixed values.
SKIPPABLE, PROFILE = 0x184D2A5D, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ZSTD, _SPACE = b"\x28\xb5\x2f\xfd", uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")
SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, payload binary"


def record_id(page_id: int | None, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}:{kind}')}>"


def _field(value: str) -> str:
    """A header's value: control characters and blanks would end it."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, kind: str, payload: bytes | None, size: int, digest: str, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """A WARC/1.1 record. A revisit's block is the HTTP header alone, which still tells the payload's length."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if kind == "response":
        block += payload or b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, kind)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_field(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest, 'response')}", f"Refers-To-Page-Id: {refers_to}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_field(refers_url)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parsed(raw: bytes) -> tuple:
    """A row of SCHEMA of a record's bytes; one whose payload has another digest than it says raises."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    f = _fields(head)
    block = rest[: int(f["content-length"])]
    if not head.startswith(b"WARC/1.") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"not a whole WARC record: {head[:200]!r}")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, number = f["warc-payload-digest"].removeprefix("sha256:"), lambda x: None if x is None else int(x)
    if f["warc-type"] == "response":
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {f['warc-record-id']} has another digest")
        size = len(payload)
    else:
        size, payload = int(_fields(http)["content-length"]), None
    return number(f.get("page-id")), f.get("warc-target-uri"), f["warc-type"], size, digest, number(f.get("refers-to-page-id")), f["warc-record-id"], payload


def trained(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of a sixteenth of the records' size, or none if there are too few to learn from."""
    size = sum(map(len, records))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 16)), records, level=LEVEL)
    except zstandard.ZstdError:
        return None


def archive(records: Iterator[bytes], train_bytes: int = TRAIN_BYTES) -> Iterator[bytes]:
    """An archive's frames: the dictionary of the first records, then each record. No more than train_bytes of records
    and one more are held. Too few records to learn from have no dictionary frame."""
    first, size = [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if size >= train_bytes:
            break
    learned = trained(first)
    if learned is not None:
        held = zstandard.compress(learned.as_bytes(), 19)
        yield struct.pack("<II", SKIPPABLE, len(held)) + held
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=learned, write_checksum=True)
    else:
        packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
    for group in (first, records):
        for r in group:
            yield packer.compress(r)


def frames(file, piece: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, one after the other; the file is read in pieces. A file that ends in a frame raises."""
    data = file.read(8)
    unpacker = zstandard.ZstdDecompressor()
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        held = file.read(struct.unpack("<I", data[4:])[0])
        held = zstandard.decompress(held) if held.startswith(_ZSTD) else held
        unpacker, data = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)), b""
    while data := data or file.read(piece):
        one, parts = unpacker.decompressobj(), []
        while True:
            parts.append(one.decompress(data))
            if one.eof:
                data = one.unused_data
                break
            data = file.read(piece)
            if not data:
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)


@dataclass
class _Done(WriterCommitMessage):
    names: list[str]
    folder: str


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class WarcZst(DataSource):
    """format("warc_zst") with a path that pyarrow's file systems know. Written columns: page_id, url, record_type,
    payload (binary), payload_bytes, payload_digest, refers_to, refers_url. Read columns: SCHEMA, payload only with the
    option payload=true, else null."""

    @classmethod
    def name(cls) -> str:
        return "warc_zst"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), overwrite)


class WarcWriter(DataSourceArrowWriter):
    """A task's archives go to {path}/_temporary/{job}/{attempt}; commit() moves those of the attempts that count, and
    an attempt that was lost or repeated leaves nothing behind."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.train_bytes, self.archive_bytes = int(options.get("train_bytes", TRAIN_BYTES)), int(options.get("archive_bytes", ARCHIVE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, root = _opened(self.path)
        names, folder = [], f"{root}/_temporary/{self.job}/{uuid.uuid4().hex}"

        def all_records() -> Iterator[bytes]:
            for batch in iterator:
                columns = [batch[c].to_pylist() for c in ("page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to", "refers_url")]
                for row in zip(*columns):
                    yield record(*row)

        def some(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
            size = len(first)
            yield first
            while size < self.archive_bytes and (r := next(rest, None)) is not None:
                size += len(r)
                yield r

        records = all_records()
        while (first := next(records, None)) is not None:
            if not names:
                fs.create_dir(folder, recursive=True)
            names.append(f"{self.job}-{TaskContext.get().partitionId():06d}-{len(names):04d}.warc.zst")
            with fs.open_output_stream(f"{folder}/{names[-1]}", compression=None) as out:
                for frame in archive(some(first, records), self.train_bytes):
                    out.write(frame)
        return _Done(names, folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _opened(self.path)
        fs.create_dir(root, recursive=True)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".warc.zst")] if self.overwrite else []
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{m.folder}/{name}", f"{root}/{name}")
        for path in old:
            fs.delete_file(path)
        self._clear(fs, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/_temporary/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_temporary/{self.job}")


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], options.get("payload", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        fs, root = _opened(self.path)
        return [_Archive(f.path) for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".warc.zst")] or [_Archive("")]

    def read(self, partition: _Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in SCHEMA.split(", ")])
        fs, _ = _opened(self.path)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

        with fs.open_input_stream(partition.path, compression=None) as file:
            for raw in frames(file):
                row = parsed(raw)
                rows.append(row if self.payload else (*row[:-1], None))
                size += len(raw) if self.payload else 200
                if size > 1 << 20:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """What to archive of each row of pages, in the columns that "warc_zst" writes.

    Of the rows with equal payloads of `least` bytes or more, those with the smallest id are responses and the others
    revisit it; all shorter ones are responses. Rows that repeat the smallest id are responses too; a null id is never
    the smallest, and where a payload has only null ids all its rows are responses. A null payload counts as empty.
    Other columns are not read. The ids of repeated payloads are broadcast if they are few, else joined by digest and
    salt, so that copies of one payload are spread over tasks.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    groups = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest")
    firsts = groups.agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    if firsts.limit(broadcast_rows + 1).count() <= broadcast_rows:
        joined = rows.join(F.broadcast(firsts), "payload_digest", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", salt).join(salted, ["payload_digest", "salt"], "left").drop("salt")
    again = F.col("first").isNotNull() & F.coalesce(F.col("page_id") > F.col("first"), F.lit(True))
    return joined.select(
        "page_id",
        "url",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(~again, F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(again, F.col("first")).alias("refers_to"),
        F.when(again, F.col("first_url")).alias("refers_url"),
    )


def write_archives(records: DataFrame, path: str, mode: str = "append", **options: int) -> None:
    """Writes records() to a folder of archives; mode "overwrite" replaces those that are there."""
    records.sparkSession.dataSource.register(WarcZst)
    records.write.format("warc_zst").mode(mode).options(**options).save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of all archives in a folder, verified against their digests; none give no rows."""
    spark.dataSource.register(WarcZst)
    return spark.read.format("warc_zst").option("payload", str(payload).lower()).load(path)


def op13_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back, one row a record. Nulls, repeated rows and empty tables as in
    records(); the archives stay in the shared folder, as the result reads them."""
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(records(table(spark, sf_dir, "pages")), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p),
r AS (SELECT *, payload_bytes >= {LEAST} AND first IS NOT NULL AND (page_id IS NULL OR page_id > first) AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN again THEN first END AS refers_to
FROM r
"""
