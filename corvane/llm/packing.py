"""Packing token ids into sequences with a bounded number of open windows.

A document's ids are cut into full sequences and a rest. Each partition keeps ``open_windows`` windows: a rest goes to
the window that it fills best; if none has room, it is cut to fill the fullest window, which is emitted, and what is
left of it opens a window or is placed again. Windows still open at a partition's end are leftovers: they are merged
best-fit in groups of ``MERGE_GROUP`` partitions, by their lengths alone.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import tokens
from corvane.session import materialise, ship

LENGTH = 2048
END_ID = 1
OPEN_WINDOWS = 32
#: Partitions whose leftovers one merging task takes: so many windows of so many pieces at most.
MERGE_GROUP = 64
#: Bytes of text that are encoded at once, and of ids that are given out at once.
SLICE_BYTES = 2 << 20
#: Rests shorter than this are not cut to fill a window.
SMALLEST_CUT = 1


class OnlinePacker:
    """Pieces are (key, start, length); ``emit`` gets a window's pieces."""

    def __init__(self, capacity: int, open_windows: int) -> None:
        self.capacity, self.open_windows = capacity, open_windows
        self.room: list[tuple[int, int]] = []  # sorted (room, window)
        self.windows: dict[int, list] = {}
        self.next = 0

    def put(self, piece: tuple, length: int, cut) -> Iterator[list]:
        """Place a piece; yields windows that are emitted. ``cut(piece, n)``: its first n ids, and the others."""
        while length:
            k = bisect.bisect_left(self.room, (length, -1))
            if k < len(self.room):
                room, w = self.room.pop(k)
                self.windows[w].append(piece)
                if room == length:
                    yield self.windows.pop(w)
                else:
                    bisect.insort(self.room, (room - length, w))
                return
            if len(self.room) < self.open_windows:
                w = self.next
                self.next += 1
                self.windows[w] = [piece]
                if length == self.capacity:
                    yield self.windows.pop(w)
                else:
                    bisect.insort(self.room, (self.capacity - length, w))
                return
            room, w = self.room.pop(0)  # the fullest
            if cut and room >= SMALLEST_CUT:
                head, piece = cut(piece, room)
                self.windows[w].append(head)
                length -= room
            yield self.windows.pop(w)

    def rest(self) -> list[list]:
        return [self.windows[w] for _, w in self.room]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                     ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int32()), ("open", pa.bool_())])
_DDL = "doc_id {kind}, start bigint, length bigint, doc_tokens bigint, ids binary, sequence_id bigint, offset bigint, part int, open boolean"


def _pack_batches(batches: Iterator[pa.RecordBatch], path: str, length: int, end_id: int, open_windows: int, part: int | None = None) -> Iterator[pa.RecordBatch]:
    if part is None:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
    encoder = tokens.encoder(path)
    packer = OnlinePacker(length, open_windows)
    sequence = part << 32
    out: list[list] = [[] for _ in _SCHEMA]
    schema = _SCHEMA

    def cut(piece, n):
        doc, start, ids, total = piece
        return (doc, start, ids[:n], total), (doc, start + n, ids[n:], total)

    def emit(window: list, is_open: bool) -> None:
        nonlocal sequence
        offset = 0
        for doc, start, ids, total in window:
            for column, value in zip(out, (doc, start, len(ids), total, ids.tobytes(), sequence, offset, part, is_open), strict=True):
                column.append(value)
            offset += len(ids)
        sequence += 1

    def batch() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
        for c in out:
            c.clear()
        return done

    for whole in batches:
        schema = _SCHEMA.set(0, pa.field("doc_id", whole.schema.field(0).type))
        for b in tokens.slices(whole, SLICE_BYTES):
            ids, at = encoder.encode(b.column(1))
            ends = at.tolist()
            for doc, x, y in zip(b.column(0).to_pylist(), ends[:-1], ends[1:], strict=True):
                own = np.append(ids[x:y], np.uint32(end_id)).astype("<u4")
                total = len(own)
                full = total - total % length
                for s in range(0, full, length):
                    emit([(doc, s, own[s : s + length], total)], False)
                if full < total:
                    for window in packer.put((doc, full, own[full:], total), total - full, cut):
                        emit(window, False)
            if 4 * sum(out[2]) >= SLICE_BYTES:
                yield batch()
                pa.default_memory_pool().release_unused()
    for window in packer.rest():
        emit(window, True)
    yield batch()


def _merge_group(key, table: pa.Table, length: int) -> pa.Table:
    """Best-fit decreasing over open windows, which stay whole; one with no place keeps its own sequence."""
    sizes = sorted(zip(table.column("size").to_pylist(), table.column("sequence_id").to_pylist(), strict=True), key=lambda s: (-s[0], s[1]))
    bins: list[tuple[int, int]] = []  # sorted (room, sequence)
    used, old, new, shift = {}, [], [], []
    for size, sequence in sizes:
        k = bisect.bisect_left(bins, (size, -1))
        room, target = bins.pop(k) if k < len(bins) else (length, sequence)
        old.append(sequence)
        new.append(target)
        shift.append(used.get(target, 0))
        used[target] = used.get(target, 0) + size
        bisect.insort(bins, (room - size, target))
    return pa.table({"sequence_id": pa.array(old, pa.int64()), "target": pa.array(new, pa.int64()), "shift": pa.array(shift, pa.int64())})


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, open_windows: int = OPEN_WINDOWS,
         merge_group: int = MERGE_GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian uint32), sequence_id, offset.

    Null text is empty and gives the end id alone. Repeated rows are packed each for itself. An empty table gives no
    pieces; other columns are ignored. Sequences are at most ``length`` long; a partition holds ``open_windows``
    windows and one batch of texts at a time.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or tokens.vocabulary_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = materialise(
        docs.select("doc_id", "text").mapInArrow(lambda it: _pack_batches(it, path, length, end_id, open_windows), _DDL.format(kind=kind)), "pieces"
    )
    left = pieces.filter("open").groupBy("sequence_id").agg(F.sum("length").alias("size"), F.first("part").alias("part"))
    groups = left.withColumn("g", F.floor(F.col("part") / merge_group))
    merged = groups.groupBy("g").applyInArrow(lambda key, t: _merge_group(key, t, length), "sequence_id bigint, target bigint, shift bigint")
    closed = pieces.filter("NOT open").select("doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset")
    moved = (
        pieces.filter("open")
        .join(merged, "sequence_id")
        .select("doc_id", "start", "length", "doc_tokens", "ids", F.col("target").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    )
    return closed.unionAll(moved)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
