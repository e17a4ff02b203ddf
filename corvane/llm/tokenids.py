"""Token ids of documents as checksummed, range-coded files in ascending order of doc_id.

The files are rows of a table in the shared folder, written by Spark's committer: (file, segment, payload), a file being
what one task wrote and its segments in order. A payload is self-contained (see ``rangecoder``) and ends with a
document, so it decodes alone wherever it is read. Document offsets over all files come from the ids of each segment:
sums by file, then within a file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm import rangecoder, tokens
from corvane.session import materialise, ship

END_ID = 2
#: A segment is closed by the document that brings it to so many ids; a file's last one holds half as many to half as many again,
#: as few blocks take nearly as long as many.
SEGMENT_IDS = 1 << 21
#: Words in a worker's cache.
CACHE_WORDS = 800_000
_FILE = "file int, segment int, n_docs bigint, n_ids bigint, payload binary"


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, segment_ids: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    file, segment = TaskContext.get().partitionId(), 0
    encoder = tokens.encoder(path, CACHE_WORDS)
    docs: list = []
    lengths: list[int] = []
    held: list[np.ndarray] = []
    n = 0

    def close(k: int) -> pa.RecordBatch:
        """A segment of the first k documents held."""
        nonlocal segment, n
        ids = np.concatenate(held[:k])
        payload = rangecoder.pack_segment(docs[:k], np.array(lengths[:k]), ids)
        row = [[file], [segment], [k], [len(ids)], [payload]]
        segment, n = segment + 1, n - len(ids)
        del docs[:k], lengths[:k], held[:k]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["file", "segment", "n_docs", "n_ids", "payload"])

    for whole in batches:
        for b in tokens.slices(whole):
            ids, at = encoder.encode(b.column(1))
            ids = np.insert(ids, at[1:], np.uint32(end_id))
            at += np.arange(len(at))
            for doc, x, y in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                docs.append(doc)
                held.append(ids[x:y])
                lengths.append(y - x)
                n += y - x
                while 2 * n >= 3 * segment_ids:
                    yield close(int(np.searchsorted(np.cumsum(lengths), segment_ids)) + 1)
    if docs:
        yield close(len(docs))


def write_ids(docs: DataFrame, path: str | None = None, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode and write; the table of segments as read back.

    Null text is empty and gives the end id alone. Rows go by doc_id, nulls first, repeated ids by a hash of their
    text; repeated rows are written each. An empty table gives no segments; other columns are ignored.
    """
    ship(docs.sparkSession)
    path = path or tokens.vocabulary_path()
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return materialise(ordered.mapInArrow(lambda it: _encode_batches(it, path, end_id, segment_ids), _FILE), "token-ids")


def _decode_batches(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for file, segment, blob in zip(*[c.to_pylist() for c in b.columns], strict=True):
            doc_ids, lengths, ids = rangecoder.unpack_segment(blob)
            ends = np.cumsum(lengths)
            raw = ids.astype("<u4").tobytes()
            spans = list(zip((4 * (ends - lengths)).tolist(), (4 * ends).tolist(), strict=True))
            columns = {
                "doc_id": pa.array(doc_ids, pa.int64()),
                "n_tokens": pa.array(lengths, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(memoryview(raw)[x:y]) for x, y in spans], pa.int64()),
                "file": pa.array([file] * len(doc_ids), pa.int32()),
                "segment": pa.array([segment] * len(doc_ids), pa.int32()),
                "inside": pa.array(ends - lengths, pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array([raw[x:y] for x, y in spans], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)


def read_ids(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids (little-endian uint32).

    A damaged header or block raises an error.
    """
    ship(segments.sparkSession)
    ddl = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, file int, segment int, inside bigint" + (", ids binary" if with_ids else "")
    rows = segments.select("file", "segment", "payload").mapInArrow(lambda it: _decode_batches(it, with_ids), ddl)
    files = segments.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_file_at"))
    within = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    at = segments.select("file", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("_segment_at")).join(files, "file")
    out = rows.join(at, ["file", "segment"])
    start = (F.col("_file_at") + F.col("_segment_at") + F.col("inside")).alias("start")
    return out.select("doc_id", start, "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
