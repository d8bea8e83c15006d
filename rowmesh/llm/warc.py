"""WARC archives as seekable Zstandard bundles.

Each bundle is a run of independent Zstandard frames, every frame holding a group of whole WARC records, and a footer: a
seek table in a skippable frame (per frame its compressed and decompressed size, then the number of frames, a descriptor
and the closing magic number), so any reader of the format can seek. Beside it lies an index table that maps each record
identifier to (bundle, frame's offset and size, record's offset and size in the decompressed frame).

Records of equal payload: the one of the largest page id is a response with the payload, the others are revisits that
keep the response headers, the payload's digest and the identifier that they refer to. Every row's record has an
identifier of its own, made of the page id and the row's number in the writing, so repeated and null page ids stay apart.

Archives are written and read through Arrow's file systems: any URI that they know, shared by all executors.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmesh.llm.frame import only, shared_dir, table, written

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Decompressed bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME = 1 << 20
BUNDLE = 1 << 28
LEVEL = 6
#: Compressed bytes that a task reads back, about.
READ = 1 << 23
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 0
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, record_id string, bundle string, frame_offset long, frame_bytes long, record_offset long, record_bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _system(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:"))


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{row}>"


def _page(uri: str) -> int | None:
    page = uri.strip("<>").split(":")[2]
    return None if page == "none" else int(page)


def record(page_id: int | None, row: int, url: str | None, payload: bytes, refers_to: tuple[int | None, int] | None) -> bytes:
    """One WARC/1.1 record; refers_to, a page id and row, makes it a revisit, whose block is the response header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    target = "".join(c for c in (url or "") if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id(page_id, row)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {target}"] if target else []
    head += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Block-Digest: sha1:{digest32(block)}"]
    head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(*refers_to)}"] if refers_to else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(path: str) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, from the footer alone."""
    system, path = _system(path)
    with system.open_input_file(path) as f:
        f.seek(f.size() - 9)
        n, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table: {path}")
        each = 12 if flags & 0x80 else 8
        f.seek(f.size() - 9 - each * n)
        raw, out, at = f.read(each * n), [], 0
        for i in range(n):
            c, d = struct.unpack_from("<II", raw, each * i)
            out.append((at, c, d))
            at += c
        return out


class Bundle:
    """Writes one archive under a name of its own attempt; it takes its final name once it is whole."""

    def __init__(self, folder: str, name: str) -> None:
        self.final = os.path.join(folder, name)
        self.system, self.at_final = _system(self.final)
        self.part = f"{self.at_final}.{uuid.uuid4().hex}.part"
        self.file = self.system.open_output_stream(self.part)
        self.codec = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True)
        self.at, self.frames, self.open, self.size, self.index = 0, [], [], 0, []

    def add(self, page_id: int | None, row: int, raw: bytes) -> None:
        self.open.append((page_id, row, self.size, raw))
        self.size += len(raw)
        if self.size >= FRAME:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            packed = self.codec.compress(b"".join(r for *_, r in self.open))
            self.file.write(packed)
            self.frames.append((len(packed), self.size))
            self.index += [(p, record_id(p, n), self.final, self.at, len(packed), o, len(r)) for p, n, o, r in self.open]
            self.at += len(packed)
            self.open, self.size = [], 0

    def close(self) -> list[tuple]:
        self.close_frame()
        self.file.write(seek_table(self.frames))
        self.file.close()
        self.system.move(self.part, self.at_final)
        return self.index


def read_record(raw: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of one record; a revisit has no payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if "sha1:" + digest32(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload), digest32(payload)) != (size, digest):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    refers = _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return _page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"], refers, payload if fields["WARC-Type"] == "response" else None


def read_at(path: str, frame_offset: int, frame_bytes: int, record_offset: int, record_bytes: int) -> tuple:
    """One record, by its place in the index: reads and expands its frame alone."""
    data = zstandard.ZstdDecompressor().decompress(_read(path, frame_offset, frame_bytes))
    return read_record(data[record_offset : record_offset + record_bytes])


def plan_records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Rows (page_id, url, html, row) with revisit, top and top_row, the response's page id and row. Only numbers and digests
    are compared; what is found is joined back by row. Rows that repeat the response's page id and payload are responses
    too; revisits refer to the first of them. Null ids rank below all others; null html is empty."""
    rows = written(only(pages, "page_id", "url", "html").withColumn("row", F.monotonically_increasing_id()), "pages")
    body = F.coalesce("html", F.lit(""))
    narrow = rows.where(F.octet_length(body) >= revisit_bytes).select("page_id", "row", F.sha2(body, 256).alias("sha"))
    tops = narrow.groupBy("sha").agg(F.max(F.struct("page_id", (-F.col("row")).alias("row"))).alias("t"))
    later = narrow.join(tops, "sha").where(~F.col("page_id").eqNullSafe(F.col("t.page_id"))).select("row", F.lit(True).alias("revisit"), F.col("t.page_id").alias("top"), (-F.col("t.row")).alias("top_row"))
    return rows.join(later, "row", "left").select("page_id", "url", body.alias("html"), "row", F.coalesce("revisit", F.lit(False)).alias("revisit"), "top", "top_row")


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes a record for every row of pages (page_id, url, html) into bundles under the folder and returns their index,
    read from its table ``index`` there. A task that is run again writes bundles of its own: names hold the attempt, and
    the index, written by Spark's commit protocol, names those of the attempt that counts. Null html is empty; repeated
    rows have a record each; an empty table gives an empty index; further columns are ignored."""
    spark = pages.sparkSession
    system, path = _system(folder)
    system.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}" if task else uuid.uuid4().hex
        bundle, number = None, 0
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("page_id", "row", "url")]
            for page_id, row, url, html, revisit, top, top_row in zip(*columns, b.column("html").cast(pa.binary()).to_pylist(), b.column("revisit").to_pylist(), b.column("top").to_pylist(), b.column("top_row").to_pylist()):
                bundle = bundle or Bundle(folder, f"pages-{stem}-{number:04d}.warc.zst")
                bundle.add(page_id, row, record(page_id, row, url, html, (top, top_row) if revisit else None))
                if bundle.at >= BUNDLE:
                    yield _batch(bundle.close(), INDEX)
                    bundle, number = None, number + 1
        if bundle:
            yield _batch(bundle.close(), INDEX)

    plan_records(pages, revisit_bytes).mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(os.path.join(folder, "index"))
    return spark.read.schema(INDEX).parquet(os.path.join(folder, "index"))


def _read(path: str, offset: int, size: int) -> bytes:
    system, path = _system(path)
    with system.open_input_file(path) as f:
        f.seek(offset)
        return f.read(size)


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that an index names, frame by frame; payload is null for revisits, or for all if not asked for. Frames
    are dealt to tasks by what they hold, not by the size of the index. An index row that is repeated gives its record
    again; an empty index gives no rows; columns beyond those of INDEX are ignored."""
    index = only(index, *[c.split()[0] for c in INDEX.split(", ")])
    frames_, held = index.groupBy("bundle", "frame_offset").agg(F.max("frame_bytes").alias("b")).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    tasks = max(1, min(frames_, max(-(-held // READ), 3 * index.sparkSession.sparkContext.defaultParallelism)))
    frames = index.repartition(tasks, "bundle", "frame_offset").groupBy("bundle", "frame_offset", "frame_bytes").agg(F.collect_list(F.struct("record_offset", "record_bytes")).alias("records"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdDecompressor()
        for b in batches:
            for path, at, size, records in zip(*[b.column(c).to_pylist() for c in ("bundle", "frame_offset", "frame_bytes", "records")]):
                data = codec.decompress(_read(path, at, size))
                rows = [read_record(data[r["record_offset"] : r["record_offset"] + r["record_bytes"]]) for r in records]
                yield _batch(rows if payloads else [(*r[:-1], None) for r in rows], RECORD)

    return frames.mapInArrow(run, RECORD)


def op6_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, repeated and large page_ids come back as they were written; an empty table gives no rows."""
    index = write_archives(table(spark, sf_dir, "pages"), os.path.join(shared_dir(spark), f"warc-{uuid.uuid4().hex}"))
    return read_archives(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
