"""Training-order materialisation: sequences at keyed slots of fixed-stride shards.

A keyed Feistel network over the least even number of bits that holds the sequence count, with cycle-walking (applied
again until the result is below the count), permutes sequence ids: each has one global slot, computed alone from the
key, without a sort of the corpus or a table of the order. Rows are range-partitioned by slot, and each task writes
shards of ``SHARD`` slots. All sequences have one width, so slot s lies in shard s // SHARD at (s % SHARD) * stride: a
reader goes through the order sequentially and can resume at any slot.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, flush_rows, materialise, new_dir, put, rows_of, store, task_ids
from .packing import LENGTH, SEPARATOR, encoder, sequences, tokens, vocabulary_path

ROUNDS = 6
#: Sequences in a shard file, and those that a map task gathers before it sends them on (some 16 MB).
SHARD = 2048
GATHER = 8192
KEY = "readloom"


class Feistel:
    """A keyed permutation of 0 .. n-1, vectorised over unsigned 64-bit arrays."""

    def __init__(self, n: int, key: str = KEY, rounds: int = ROUNDS):
        self.n = n
        self.half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        digest = hashlib.blake2b(f"{key}/{n}".encode(), digest_size=8 * rounds).digest()
        self.keys = np.frombuffer(digest, dtype="<u8")

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)  # multiplication wraps, as is meant
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        h, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> h, x & low
        for k in keys:
            left, right = right, left ^ self._mix(right, k)
        return (left << h) | right

    def _walk(self, x, step) -> np.ndarray:
        x = np.array(x, dtype=np.uint64, ndmin=1)
        out = step(x)
        while (far := out >= self.n).any():
            out[far] = step(out[far])
        return out.astype(np.int64)

    def slot(self, ids) -> np.ndarray:
        return self._walk(ids, lambda x: self._once(x, self.keys))

    def sequence(self, slots) -> np.ndarray:
        """The inverse of :meth:`slot`."""
        h, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)

        def back(x):
            left, right = x >> h, x & low
            for k in self.keys[::-1]:
                left, right = right ^ self._mix(left, k), left
            return (left << h) | right

        return self._walk(slots, back)


def write_shards(seqs: DataFrame, n: int, directory: str, length: int, itemsize: int, key: str = KEY, shard: int = SHARD) -> DataFrame:
    """Write (sequence_id, n, ids) to shards; returns slot, sequence_id, shard, offset, n_ids of every sequence.

    Map tasks place their sequences and send them as compressed blocks, one per shard and ``GATHER`` sequences. Shards
    are dealt to tasks in runs by their number, without sampling: the permutation makes them even. A task holds the
    blocks of one shard at a time and writes it in slot order. A short last sequence is stored padded to the stride and
    keeps its own n_ids. Files are drafted under the attempt's name and moved whole, so repeated tasks are harmless.
    """
    import zstandard

    stride = length * itemsize
    block_schema = pa.schema([("shard", pa.int64()), ("slots", pa.binary()), ("seqs", pa.binary()), ("counts", pa.binary()), ("block", pa.binary())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perm, packer = Feistel(n, key), zstandard.ZstdCompressor(level=6)
        seqs, counts, ids = [], [], []

        def blocks() -> pa.RecordBatch:
            slot = perm.slot(np.array(seqs, dtype=np.int64))
            order = np.argsort(slot)
            at = slot[order] // shard
            rows = []
            for k in np.split(order, np.flatnonzero(at[1:] != at[:-1]) + 1):
                rows.append((int(slot[k[0]]) // shard, slot[k].tobytes(), np.array(seqs, dtype=np.int64)[k].tobytes(), np.array(counts, dtype=np.int64)[k].tobytes(),
                             packer.compress(b"".join(ids[i] + bytes(stride - len(ids[i])) for i in k))))
            return batch_of(block_schema, rows)

        for b in batches:
            for s, c, raw in rows_of(b, "sequence_id", "n", "ids"):
                seqs.append(s)
                counts.append(c)
                ids.append(raw)
                if len(seqs) >= GATHER:
                    yield blocks()
                    seqs, counts, ids = [], [], []
        if seqs:
            yield blocks()

    out_schema = pa.schema([(c, pa.int64()) for c in ("slot", "sequence_id", "shard", "offset", "n_ids")])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, attempt = task_ids()
        fs, path = store(directory)
        fs.create_dir(path, recursive=True)
        held: list[tuple] = []

        def shard_rows() -> Iterator[tuple]:
            number = held[0][0]
            numbers = [np.concatenate([np.frombuffer(h[k], dtype=np.int64) for h in held]) for k in (1, 2, 3)]
            data = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(h[4]), dtype=np.uint8).reshape(-1, stride) for h in held])
            order = np.argsort(numbers[0])
            draft = f"{path}/.shard-{number:08d}.{attempt}"
            with fs.open_output_stream(draft, compression=None) as out:
                out.write(data[order].tobytes())
            put(fs, draft, f"{path}/shard-{number:08d}.bin")
            for slot, seq, count in zip(*(x[order].tolist() for x in numbers), strict=True):
                yield slot, seq, number, slot % shard * stride, count

        def rows() -> Iterator[tuple]:
            nonlocal held
            for b in batches:
                for row in rows_of(b, *block_schema.names):
                    if held and row[0] != held[0][0]:
                        yield from shard_rows()
                        held = []
                    held.append(row)
            if held:
                yield from shard_rows()

        yield from flush_rows(out_schema, rows())

    sent = seqs.select("sequence_id", "n", "ids").mapInArrow(place, "shard long, slots binary, seqs binary, counts binary, block binary")
    shards = max(1, -(-n // shard))
    tasks = min(shards, int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = sent.repartitionById(tasks, F.expr(f"CAST(shard * {tasks} DIV {shards} AS INT)")).sortWithinPartitions("shard")
    return materialise(laid.mapInArrow(write, "slot long, sequence_id long, shard long, offset long, n_ids long"), "slots")


def read_slots(directory: str, first: int, last: int, length: int, dtype, shard: int = SHARD) -> Iterator[np.ndarray]:
    """The ids of slots first .. last-1 in training order, read sequentially; resume by another ``first``."""
    fs, path = store(directory)
    stride = length * np.dtype(dtype).itemsize
    while first < last:
        at, offset = divmod(first, shard)
        upto = min(last, (at + 1) * shard)
        with fs.open_input_file(f"{path}/shard-{at:08d}.bin") as f:
            f.seek(offset * stride)
            for _ in range(first, upto):
                yield np.frombuffer(f.read(stride), dtype=dtype)
        first = upto


def materialise_order(docs: DataFrame, directory: str, length: int = LENGTH, path: str | None = None, key: str = KEY, shard: int = SHARD) -> DataFrame:
    """Pack all documents, write the sequences in training order, read every slot back.

    slot, sequence_id, shard, offset (bytes), n_ids, ids_crc32 (of the n_ids ids read back, as little-endian unsigned
    32-bit): one row per sequence. Null and empty texts give their separator; an empty table gives no row.
    """
    path = path or vocabulary_path()
    kind = encoder(path).kind
    seqs, n = sequences(tokens(docs, path), path, length, SEPARATOR)
    slots = write_shards(seqs, n, directory, length, kind.itemsize, key, shard)
    schema = pa.schema([(c, pa.int64()) for c in ("slot", "sequence_id", "shard", "offset", "n_ids", "ids_crc32")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(directory)
        stride = length * kind.itemsize

        def rows() -> Iterator[tuple]:
            f = now = None
            for b in batches:
                for slot, seq, at, offset, count in rows_of(b, "slot", "sequence_id", "shard", "offset", "n_ids"):
                    if at != now:
                        f, now = fs.open_input_file(f"{root}/shard-{at:08d}.bin"), at
                    ids = np.frombuffer(f.read_at(stride, offset), dtype=kind)[:count].astype("<u4")
                    yield slot, seq, at, offset, count, zlib.crc32(ids.tobytes())

        yield from flush_rows(schema, rows())

    return slots.mapInArrow(read, "slot long, sequence_id long, shard long, offset long, n_ids long, ids_crc32 long")


def training_order(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """:func:`materialise_order` into a fresh folder, with the default length, vocabulary and key: a row per sequence.

    Repeated rows are packed as often as they occur, texts of any length whole, rows with a null id or text like others;
    an empty table gives no row; columns other than doc_id and text aren't read.
    """
    return materialise_order(docs, new_dir(spark, "shards"))
