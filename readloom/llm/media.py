"""Media columns: documents stored as 8-bit grey images in archives, read through a Spark data source.

``write_archives`` packs each payload as a PNG (576 samples a row) into plain tar files of the shared folder, with a
sidecar of member offsets beside each and one list of the finished archives. The data source ``media_archive`` plans byte
ranges over the archives of a directory, those of that list or else all tar files; a range holds the members that start
in it. Ranges grow with the directory, so that their number is bounded. A reader streams batches of payloads through Arrow
and retries each member by its offset, on a fresh handle, without giving up the others of its range.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import new_dir, rows_of, store, task_ids

#: Samples in a row of an image; a payload is padded to a positive multiple of it.
ROW = 576
PAD = b"\xff"
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
BATCH_BYTES = 8 << 20
#: Least bytes of a partition, and the partitions that are planned about at most: beyond their product, partitions grow.
RANGE_BYTES = 8 << 20
MAX_RANGES = 20_000
#: The list of a directory's finished archives: a line with name, bytes and members of each.
LIST = "_archives"


def padded(raw: bytes) -> bytes:
    return raw + PAD * ((-len(raw)) % ROW if raw else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG, 576 wide, filter type 0 in every row: lossless."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines, 3)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of an image of :func:`encode_png`; checks every chunk's CRC."""
    if media[:8] != PNG_MAGIC:
        raise ValueError("not a PNG")
    at, height, data = 8, 0, []
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
            if (width, depth, colour) != (ROW, 8, 0):
                raise ValueError("not of this writer's format")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, ROW + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not of this writer's format")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """64 bits, one per equal run of samples: is the run's sum above the mean run's? Then mean and variance, scaled by 1000."""
    samples = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    n, total = len(samples), int(samples.sum())
    runs = samples.reshape(64, -1).sum(axis=1)
    bits = np.packbits(runs * 64 > total).tobytes().hex()
    square = int((samples * samples).sum())
    return f"{bits}-{1000 * total // n}-{1000 * (n * square - total * total) // (n * n)}"


# --- writing -------------------------------------------------------------------------------------------------------


def write_archives(docs: DataFrame, directory: str) -> int:
    """Write all rows of ``docs`` (doc_id, text; a null text is empty) and return how many there are.

    Files are named by task attempt. Those of finished tasks are listed once all are done, so a lost executor or a task
    that runs twice leaves stray files, but no wrong rows.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = task_ids()
        fs, path = store(directory)
        fs.create_dir(path, recursive=True)
        name = f"part-{part:06d}-{attempt}.tar"
        at, offsets = 0, []
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
            for b in batches:
                for doc_id, raw in rows_of(b, "doc_id", "_raw"):
                    media = encode_png(padded(raw or b""))
                    info = tarfile.TarInfo("null.png" if doc_id is None else f"{doc_id}.png")
                    info.size = len(media)
                    member = info.tobuf(tarfile.PAX_FORMAT) + media + bytes(-len(media) % 512)
                    out.write(member)
                    offsets.append((at, len(member)))
                    at += len(member)
            out.write(bytes(1024))
        if not offsets:
            fs.delete_file(f"{path}/{name}")
            return
        with fs.open_output_stream(f"{path}/{name}.offsets", compression=None) as out:
            out.write(np.array(offsets, dtype="<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at + 1024], pa.int64()), pa.array([len(offsets)], pa.int64())], names=["name", "size", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_raw"))
    done = sorted(tuple(r) for r in rows.mapInArrow(write, "name string, size long, n long").collect())  # a row per task
    fs, path = store(directory)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{LIST}", compression=None) as out:
        out.write("".join(f"{name}\t{size}\t{n}\n" for name, size, n in done).encode())
    return sum(n for *_, n in done)


# --- reading -------------------------------------------------------------------------------------------------------


class ByteRanges(InputPartition):
    """(archive, start, end) of the ranges that a task reads."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class MediaArchives(DataSource):
    """``spark.read.format("media_archive").load(directory)``.

    Options: ``rangeBytes`` and ``maxRanges`` (least bytes of a partition, and how many there are about at most), ``retries`` (attempts per member after the first),
    ``onError`` (``fail``, or ``row``: a row with the error and no media).
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, offset long, name string, media binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.directory = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.max_ranges = int(options.get("maxRanges", MAX_RANGES))
        self.retries = int(options.get("retries", 3))
        self.on_error = options.get("onError", "fail")

    def archives(self) -> list[tuple[str, int]]:
        """(path, bytes) of the archives: those listed, or all tar files where there is no list."""
        fs, path = store(self.directory)
        if fs.get_file_info(f"{path}/{LIST}").type == pafs.FileType.File:
            with fs.open_input_file(f"{path}/{LIST}") as f:
                rows = (x.split("\t") for x in f.read().decode().splitlines())
                return [(f"{path}/{name}", int(size)) for name, size, _ in rows]
        files = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        return sorted((f.path, f.size) for f in files if f.base_name.endswith(".tar") and f.base_name[0] not in "._")

    def partitions(self) -> list[ByteRanges]:
        archives = self.archives()
        step = max(self.range_bytes, -(-sum(size for _, size in archives) // self.max_ranges))
        out, held, n = [], [], 0
        for path, size in archives:
            for a in range(0, size, step):
                held.append((path, a, min(size, a + step)))
                n += held[-1][2] - a
                if n >= step:  # small archives share a partition
                    out.append(ByteRanges(held))
                    held, n = [], 0
        return [*out, ByteRanges(held)] if held or not out else out

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("name", pa.string()), ("media", pa.binary()), ("error", pa.string())])
        fs, _ = store(self.directory)
        rows, size = [], 0
        for archive, start, end in partition.ranges:
            short = archive.rsplit("/", 1)[-1]
            for offset, length in members(fs, archive, start, end):
                name, media, error = self._member(fs, archive, offset, length)
                rows.append((short, offset, name, media, error))
                size += len(media or b"")
                if size >= BATCH_BYTES:
                    yield _batch(schema, rows)
                    rows, size = [], 0
        if rows:
            yield _batch(schema, rows)

    def _member(self, fs, archive: str, offset: int, length: int | None):
        for attempt in range(self.retries + 1):
            try:
                return (*read_member(fs, archive, offset, length), None)
            except Exception as e:  # noqa: BLE001 - any fault of the store or the member is retried, then reported
                error = e
                if attempt < self.retries:
                    time.sleep(0.05 * 2**attempt)
        if self.on_error == "fail":
            raise RuntimeError(f"{archive} at {offset}: {error}") from error
        return None, None, f"{type(error).__name__}: {error}"


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_OPEN: dict[str, tuple] = {}


def read_member(fs, archive: str, offset: int, length: int | None) -> tuple[str, bytes]:
    """(name, data) of the tar member at an offset. The handle is kept for the next member, and dropped on a fault."""
    try:
        if _OPEN.get("at", ("",))[0] != archive:
            _OPEN["at"] = archive, fs.open_input_file(archive)
        f = _OPEN["at"][1]
        if length is None:
            length = member_length(f, offset)
        block = f.read_at(length, offset)
        with tarfile.open(fileobj=io.BytesIO(block + bytes(1024))) as tar:
            info = tar.next()
            return info.name, tar.extractfile(info).read()
    except Exception:
        _OPEN.pop("at", None)
        raise


def member_length(f, offset: int) -> int:
    """Bytes of a member without a sidecar: its headers (pax ones too) and its padded data."""
    at = offset
    while True:
        head = f.read_at(512, at)
        info = tarfile.TarInfo.frombuf(head, tarfile.ENCODING, "surrogateescape")
        at += 512 + -(-info.size // 512) * 512
        if info.type not in (tarfile.XHDTYPE, tarfile.XGLTYPE, tarfile.GNUTYPE_LONGNAME, tarfile.GNUTYPE_LONGLINK):
            return at - offset


def members(fs, archive: str, start: int, end: int) -> Iterator[tuple[int, int | None]]:
    """(offset, length) of the members that start in [start, end): from the sidecar, or by walking the headers."""
    side = fs.get_file_info(f"{archive}.offsets")
    if side.type == pafs.FileType.File:
        with fs.open_input_file(f"{archive}.offsets") as f:
            at = np.frombuffer(f.read(), dtype="<i8").reshape(-1, 2)
        lo, hi = np.searchsorted(at[:, 0], [start, end])
        yield from (tuple(r) for r in at[lo:hi].tolist())
        return
    with fs.open_input_file(archive) as f:
        at = 0
        while at < end and f.read_at(512, at).strip(b"\0"):
            length = member_length(f, at)
            if at >= start:
                yield at, length
            at += length


def read_archives(spark: SparkSession, directory: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archive").options(**options).load(directory)


def media_features(media: DataFrame) -> DataFrame:
    """The digests and the feature of each stored image (columns name, media)."""
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, data in rows_of(b, "name", "media"):
                payload = decode_png(data)
                stem = name.removesuffix(".png")
                rows.append((
                    None if stem == "null" else int(stem), len(payload.rstrip(PAD)), len(payload), hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload),
                ))
            if rows:
                yield _batch(schema, rows)

    return media.select("name", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_round_trip(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Store every text of ``docs`` and compute its features from what is read back; one row per row.

    Null and empty texts are one row of padding; texts of any length are stored whole. Repeated rows and null ids are
    kept. An empty table gives no row; columns other than doc_id and text aren't read. UTF-8 has no byte 255, so the
    unpadded length is read back exactly.
    """
    directory = new_dir(spark, "media")
    write_archives(docs, directory)
    return media_features(read_archives(spark, directory))
