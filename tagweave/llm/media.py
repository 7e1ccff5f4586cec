"""Media columns: a Spark data source over archives of media files (operator 10).

Archives are tar files, each with an index of its members beside it. The source plans
byte ranges over the archives of a folder, streams members as Arrow batches and reads each
member by its offset, again on its own if that fails.
"""

from __future__ import annotations

import io
import json
import re
import struct
import tarfile
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "media_archive"
SCHEMA = "name string, archive string, offset long, payload binary, error string"
PNG = b"\x89PNG\r\n\x1a\n"
WIDTH = 64


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Any store that Arrow reads: local paths, file:, hdfs:, s3:, gs: and abfs: folders."""
    local = re.fullmatch(r"(?:file:(?://)?)?(/.*)", path)
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(path)


# ---- 8-bit greyscale PNG ----------------------------------------------------


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(data: bytes, level: int = 1) -> tuple[bytes, int]:
    """(PNG, length of the payload): the bytes, zeros up to a positive multiple of 64, as rows of 64 grey samples.

    The number of bytes without zeros is kept in a text chunk.
    """
    payload = data + b"\0" * ((-len(data)) % WIDTH if data else WIDTH)
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", header) + _chunk(b"tEXt", b"bytes\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b""), len(payload)


def decode_png(media: bytes) -> tuple[bytes, int]:
    """(samples, number of bytes) of a PNG as ``encode_png`` writes it; checks every chunk's CRC."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, body, n, width, height = 8, [], None, 0, 0
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, chunk = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if len(chunk) < size or zlib.crc32(kind + chunk) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", chunk)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit greyscale")
        elif kind == b"tEXt" and chunk.startswith(b"bytes\0"):
            n = int(chunk[6:])
        elif kind == b"IDAT":
            body.append(chunk)
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("rows with a PNG filter")
    samples = rows[:, 1:].tobytes()
    return samples, len(samples) if n is None else n


def features(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, and shares of eight ranges of values."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256).astype(np.float64)
    share = counts / counts.sum()
    values = np.arange(256)
    mean = float(share @ values)
    deviation = float(np.sqrt(max(0.0, share @ (values - mean) ** 2)))
    some = share[share > 0]
    entropy = float(-(some * np.log2(some)).sum())
    parts = ",".join(f"{x:.4f}" for x in share.reshape(8, 32).sum(axis=1))
    return f"mean={mean:.4f};dev={deviation:.4f};entropy={entropy:.4f};hist={parts}"


# ---- the data source --------------------------------------------------------


@dataclass
class ByteRange(InputPartition):
    archive: str
    low: int
    high: int


@dataclass
class Written(WriterCommitMessage):
    files: list


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangeBytes", str(32 << 20)))
        self.batch_bytes = int(options.get("batchBytes", str(8 << 20)))
        self.attempts = int(options.get("attempts", "3"))

    def partitions(self):
        store, root = file_system(self.path)
        kept = store.get_file_info(f"{root}/_committed")
        if kept.type == fs.FileType.Directory:  # archives of failed attempts are not in the lists
            names = []
            for info in store.get_file_info(fs.FileSelector(kept.path)):
                with store.open_input_stream(info.path) as f:
                    names += json.loads(f.read())
            infos = store.get_file_info([f"{root}/{n}" for n in sorted(names)])
        else:
            infos = sorted((i for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.path.endswith(".tar")), key=lambda i: i.path)
        out = [ByteRange(i.path, low, min(low + self.range_bytes, i.size)) for i in infos for low in range(0, i.size, self.range_bytes)]
        return out or [ByteRange("", 0, 0)]

    def members(self, store, part: ByteRange) -> list[tuple[str, int, int]]:
        """(name, offset, size) of the members that begin in the range; without an index the tar headers are walked."""
        index = f"{part.archive}.idx"
        if store.get_file_info(index).type == fs.FileType.File:
            with store.open_input_stream(index) as f:
                found = [tuple(json.loads(x)) for x in f.read().decode().splitlines()]
        else:
            with store.open_input_file(part.archive) as f, tarfile.open(fileobj=f, mode="r:") as t:
                found = [(m.name, m.offset_data, m.size) for m in t if m.isfile()]
        return [m for m in found if part.low <= m[1] < part.high]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        store, _ = file_system(self.path)
        handle, rows, held = None, [], 0
        for name, offset, size in self.members(store, part):
            payload, error = None, None
            for attempt in range(self.attempts):
                try:
                    handle = handle or store.open_input_file(part.archive)
                    payload = handle.read_at(size, offset)
                    if len(payload) != size:
                        raise OSError(f"{len(payload)} of {size} bytes")
                    error = None
                    break
                except OSError as e:
                    payload, error, handle = None, f"{type(e).__name__}: {e}", None
                    time.sleep(0.05 * attempt)
            rows.append((name, part.archive, offset, payload, error))
            held += size
            if held >= self.batch_bytes:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["name", "archive", "offset", "payload", "error"])


class ArchiveWriter(DataSourceArrowWriter):
    """Writes (name, payload) rows into one archive for each task; the job's commit lists those that count."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = file_system(self.path)
        store.create_dir(root, recursive=True)
        name, index, f, tar = f"{uuid.uuid4().hex}.tar", [], None, None
        for batch in iterator:
            if tar is None and len(batch):
                f = store.open_output_stream(f"{root}/{name}")
                tar = tarfile.open(fileobj=f, mode="w|", format=tarfile.PAX_FORMAT)
            for member, payload in zip(batch.column("name").to_pylist(), batch.column("payload").to_pylist()):
                info = tarfile.TarInfo(member)
                info.size = len(payload)
                tar.addfile(info, io.BytesIO(payload))
                size = -(-len(payload) // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE
                index.append((member, tar.offset - size, len(payload)))
        if tar is None:
            return Written([])
        tar.close()
        f.close()
        with store.open_output_stream(f"{root}/{name}.idx") as out:
            out.write("".join(json.dumps(x) + "\n" for x in index).encode())
        return Written([name])

    def commit(self, messages) -> None:
        store, root = file_system(self.path)
        store.create_dir(f"{root}/_committed", recursive=True)
        with store.open_output_stream(f"{root}/_committed/{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([n for m in messages if m for n in m.files]).encode())

    def abort(self, messages) -> None:
        store, root = file_system(self.path)
        for m in messages:
            for n in m.files if m else []:
                store.delete_file(f"{root}/{n}")


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``; options rangeBytes, batchBytes, attempts."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options)


def write_archives(media: DataFrame, path: str) -> None:
    """Append (name, payload) rows to a folder of archives."""
    media.sparkSession.dataSource.register(ArchiveSource)
    media.select("name", "payload").write.format(FORMAT).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """(name, archive, offset, payload, error): the members of all archives of a folder.

    A member that cannot be read in ``attempts`` tries has a null payload and an error, and
    the others are still read. An empty or missing folder gives no rows.
    """
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(FORMAT).options(**options).load(path)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, media, held = [], [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            names.append(f"{'none' if i is None else i}.png")
            media.append(encode_png((text.as_py() or "").encode())[0])
            held += len(media[-1])
            if held >= 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(media, pa.binary())], ["name", "payload"])
                names, media, held = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(media, pa.binary())], ["name", "payload"])


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(name, payload): each text as a PNG named after its id ('none.png' for a null id); null texts are empty."""
    return docs.select(id_col, text_col).mapInArrow(_encode, "name string, payload binary")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media, error in zip(batch.column(1), batch.column(2).to_pylist()):
            try:
                if error is not None:
                    raise ValueError(error)
                samples, n = decode_png(media.as_py())
                rows.append((samples, n, features(samples), None))
            except (ValueError, zlib.error, struct.error) as e:
                rows.append((None, None, None, str(e)))
        kinds = (pa.binary(), pa.int64(), pa.string(), pa.string())
        decoded = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *decoded], ["name", "media", "samples", "n_bytes", "feature", "error"])


def decode_media(members: DataFrame) -> DataFrame:
    """(name, media, samples, n_bytes, feature, error) of archive members; what is no such PNG gets an error instead."""
    return members.select("name", "payload", "error").mapInArrow(_decode, "name string, media binary, samples binary, n_bytes long, feature string, error string")
