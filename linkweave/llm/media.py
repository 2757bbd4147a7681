"""Media columns: a Spark data source over archive directories.

``write_archives`` stores payloads as 8-bit greyscale PNG images, 64 samples wide, in zip archives under the shared folder:
each task writes archives of its own under new names and reports those that it closed, and a manifest lists them; what a
failed attempt left is in no manifest. ``MediaArchive`` (format ``media_archive``) plans byte ranges over the archives
without opening them, and a range reads the members whose headers start in it, found by the archive's directory. Members
stream out in Arrow batches; a member that can't be read is tried again by its offset, alone, and after ``TRIES`` attempts
comes out with its error and no bytes.

A payload is a text's UTF-8 with bytes 0 up to a positive multiple of 64; null text counts as empty (64 bytes 0). Equal
texts have equal payloads, images and features. Repeated rows are members of their own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from linkweave.llm.common import cut, exact_id, removed, shared_dir

WIDTH = 64
#: A range reads its archive's directory, so archives hold few ranges.
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
#: Attempts at an archive or member, and seconds before the second one (doubled each time).
TRIES, PAUSE = 3, 0.2
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MANIFEST = "manifest.json"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the text in bytes, and its payload."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    """A greyscale image of 8 bits a sample whose samples are the payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of an image that ``to_png`` made; damaged chunks raise ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, head, body = 8, b"", []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, chunk = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(chunk, zlib.crc32(kind)) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        head, body = (chunk if kind == b"IHDR" else head), (body + [chunk] if kind == b"IDAT" else body)
        at += 12 + size
    width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", head)
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if (width, depth, colour) != (WIDTH, 8, 0) or lines[:, 0].any():
        raise ValueError("not an image of this kind")
    return lines[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean, deviation and a histogram of 16 classes of the samples, in whole thousandths."""
    v = np.frombuffer(payload, np.uint8)
    shares = np.bincount(v >> 4, minlength=16) * 1000 // len(v)
    mean = int(v.sum(dtype=np.int64)) * 1000 // len(v)
    square = int((v.astype(np.int64) ** 2).sum()) * 1000 // len(v)
    return f"{mean};{square};" + ",".join(map(str, shares))


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def write_archives(documents: DataFrame, folder: str) -> None:
    """Stores each row's image in zip archives under ``folder``; member names hold number, doc_id and text length."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _place(folder)
        store.create_dir(base)
        own, number, count, size, sink, archive, name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, 0, 0, None, None, ""
        for p in parts:
            for doc_id, text in zip(p["doc_id"], p["text"]):
                if archive is None:
                    name = f"{own}-{number:04d}.zip"
                    sink = store.open_output_stream(f"{base}/{name}")
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                n_bytes, payload = payload_of(text)
                image = to_png(payload)
                archive.writestr(f"{count}-{'null' if doc_id is None else doc_id}-{n_bytes}", image)
                count, size = count + 1, size + len(image)
                if size >= ARCHIVE_BYTES:
                    archive.close()
                    sink.close()
                    yield pd.DataFrame({"name": [name], "members": [count]})
                    number, count, size, archive = number + 1, 0, 0, None
        if archive is not None:
            archive.close()
            sink.close()
            yield pd.DataFrame({"name": [name], "members": [count]})

    rows = documents.select(exact_id("doc_id"), "text").mapInPandas(run, "name string, members long").collect()  # one row per archive
    store, base = _place(folder)
    store.create_dir(base)
    found = [{"name": r["name"], "members": r["members"], "bytes": store.get_file_info(f"{base}/{r['name']}").size} for r in sorted(rows)]
    with store.open_output_stream(f"{base}/{MANIFEST}") as out:
        out.write(json.dumps(found).encode())


class ByteRange(InputPartition):
    def __init__(self, name: str, start: int, stop: int):
        self.name, self.start, self.stop = name, start, stop


class MediaArchive(DataSource):
    """Format ``media_archive``; options ``path`` (a folder with a manifest) and ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary, archive string, offset long, error string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE_BYTES))))


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self) -> list[ByteRange]:
        store, base = _place(self.folder)
        with store.open_input_file(f"{base}/{MANIFEST}") as f:
            found = json.loads(f.read())
        return [ByteRange(x["name"], at, at + self.range_bytes) for x in found for at in range(0, x["bytes"], self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        store, base = _place(self.folder)
        path, rows, size = f"{base}/{part.name}", [], 0
        with opened(store, path) as source, zipfile.ZipFile(source) as archive:
            for info in archive.infolist():
                if not part.start <= info.header_offset < part.stop:
                    continue
                data, error = member(store, path, archive, info)
                _, doc_id, n_bytes = info.filename.split("-", 1)[0], *info.filename.split("-", 1)[1].rsplit("-", 1)
                rows.append((None if doc_id == "null" else int(doc_id), int(n_bytes), data, part.name, info.header_offset, error))
                size += len(data or b"")
                if size >= BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)


def opened(store: fs.FileSystem, path: str) -> pa.NativeFile:
    """An archive for reading; opening it is tried TRIES times."""
    for attempt in range(TRIES):
        try:
            return store.open_input_file(path)
        except OSError:
            if attempt == TRIES - 1:
                raise
            time.sleep(PAUSE * 2**attempt)
    raise AssertionError


def member(store: fs.FileSystem, path: str, archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
    """A member's bytes; a failed read is repeated after a pause, through a new handle at the member's own offset."""
    error = ""
    for attempt in range(TRIES):
        try:
            if attempt == 0:
                return archive.read(info), None
            with store.open_input_file(path) as again, zipfile.ZipFile(again) as fresh:
                return fresh.read(info), None
        except (OSError, zipfile.BadZipFile, zlib.error, EOFError) as e:
            time.sleep(PAUSE * 2**attempt if attempt < TRIES - 1 else 0)
            error = f"{type(e).__name__}: {e}"
    return None, error


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string()]
    names = ["doc_id", "n_bytes", "media", "archive", "offset", "error"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_bytes, media, archive, offset, error: one row per stored member."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("rangeBytes", range_bytes).load(folder)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(members: DataFrame) -> DataFrame:
    """Decodes stored members and computes digests and features (see SCHEMA); an unreadable member fails the query."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for doc_id, n_bytes, media, error in zip(p["doc_id"], p["n_bytes"].tolist(), p["media"], p["error"]):
                if media is None:
                    raise RuntimeError(f"a stored member can't be read: {error}")
                payload = from_png(media)
                out.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    rows = members.select(exact_id("doc_id"), "n_bytes", "media", "error").mapInPandas(run, SCHEMA.replace("doc_id long", "doc_id string"))
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def media_digests(documents: DataFrame) -> DataFrame:
    """Stores all documents under the shared folder, reads them back and describes what was read; then the archives go."""
    spark = documents.sparkSession
    folder = shared_dir(spark, "media")
    write_archives(documents, folder)
    out = cut(describe(read_archives(spark, folder)))
    removed(spark, folder)
    return out
