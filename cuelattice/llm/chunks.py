"""Texts in chunks that ask buckets for what the whole corpus knows of their hashes.

A chunk is a run of rows of some megabytes, compressed, checkpointed and numbered. It sends
sorted hashes to buckets, which get all that the corpus has on them, and is sent back an
answer for each in the same order. So a text is never exploded into rows, a hash that all
texts share is one entry of each chunk, and chunks and buckets have a bounded size: the
number of buckets follows the bytes of text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.textscan import SLICE_BYTES, slices

_U = np.uint64


def _packed(most: int) -> Callable:
    """Rows in compressed chunks of some bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        chunk, size = TaskContext.get().partitionId() << 32, 0

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as to:
                for part in held:
                    to.write_batch(part)
            held.clear()
            return pa.RecordBatch.from_pydict({"chunk": [chunk], "size": [size], "blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            for part in slices(batch, limit=min(most, SLICE_BYTES)):
                held.append(part)
                size += part.nbytes
                if size >= most:
                    yield flush()
                    chunk, size = chunk + 1, 0
        if held:
            yield flush()

    return run


def chunked(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(chunk, blob) of all rows, checkpointed, so that a chunk read again is the same; and their bytes. rows has a column text."""
    chunks = rows.mapInArrow(_packed(most), "chunk long, size long, blob binary").checkpoint()
    return chunks.select("chunk", "blob"), chunks.agg(F.sum("size").alias("n")).first()["n"] or 0


def rows_of(blob: bytes) -> list[pa.RecordBatch]:
    """The rows of a chunk, in slices."""
    return list(pa.ipc.open_stream(blob))


def buckets_for(size: int, each: int) -> int:
    """A power of two: buckets for some bytes of text, each with at most some of them."""
    return 1 << max(0, -(-size // each) - 1).bit_length()


def places(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the keys of each bucket begin in some sorted keys (64 bits), which their upper bits deal out; and the end."""
    edges = np.arange(1, buckets, dtype=np.uint64) << _U(64 - (buckets.bit_length() - 1)) if buckets > 1 else np.zeros(0, np.uint64)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


def heads(ordered: np.ndarray) -> np.ndarray:
    """Where each distinct value of a sorted array begins."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob, each with its bytes sorted by significance."""
    head = np.array([len(a) for a in arrays], np.uint32).tobytes()
    body = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *body]))


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    """The arrays of pack(), given their types."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    at, out = 4 * len(kinds), []
    for n, kind in zip(raw[:at].view(np.uint32).tolist(), kinds, strict=True):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).reshape(-1).view(kind))
        at += n * size
    return out


def steps(ordered: np.ndarray) -> np.ndarray:
    """The differences of sorted keys, of which cumsum makes them again; they pack better."""
    return np.diff(ordered, prepend=_U(0))


def sent(buckets: list[int], chunk: int, blobs: list[bytes]) -> pa.RecordBatch:
    """What a chunk asks of some buckets, or a bucket answers to it."""
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([chunk] * len(buckets), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "blob"])
