"""Content-defined chunking: sequential within an object, parallel across objects."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..operators.transfer import PROFILES

_FACTOR = 0x9E3779B1
_MASK = (1 << 64) - 1
_STEPS = [b * _FACTOR & _MASK for b in range(256)]
#: Fewer objects than this are faster one by one; bytes of objects that are followed at a time.
_TOGETHER, _BYTES = 12, 32 << 20


def _follow(data: memoryview, at: int, begin: int, value: int, minimum: int, average: int, maximum: int) -> list[int]:
    """Ends of the chunks of one object from `at` on, in a chunk that began at `begin` and has reached `value`."""
    ends, low = [], average - 1
    for i in range(at, len(data)):
        value = ((value << 1 & _MASK | value >> 63) + _STEPS[data[i]]) & _MASK
        size = i + 1 - begin
        if size >= minimum and (not value & low or size >= maximum):
            ends.append(i + 1)
            begin, value = i + 1, 0
    if begin < len(data):
        ends.append(len(data))
    return ends


def cuts(objects: list[bytes], minimum: int, average: int, maximum: int) -> list[list[int]]:
    """Ends of the chunks of each object.

    The rolling value is rotated left by one and gains a multiple of each byte; a chunk ends from `minimum` bytes on
    where the low bits of the value are zero, or at `maximum`; the value then starts anew. The value depends on every byte
    since the chunk's start, so an object is followed byte by byte, but many objects side by side, one byte of each
    at a time; the last few longest ones go on by themselves.
    """
    sizes = np.array([len(o) for o in objects], np.int64)
    ends: list[list[int]] = [[] for _ in objects]
    flat = np.frombuffer(b"".join(objects), np.uint8)
    first = np.cumsum(sizes) - sizes
    live = np.argsort(-sizes, kind="stable")
    live = live[sizes[live] > 0]
    value, begin, at = np.zeros(len(live), np.uint64), np.zeros(len(live), np.int64), 0
    low, factor, one, last = np.uint64(average - 1), np.uint64(_FACTOR), np.uint64(1), np.uint64(63)
    while len(live) >= _TOGETHER:
        value = (value << one | value >> last) + flat[first[live] + at].astype(np.uint64) * factor
        at += 1
        size = at - begin
        done = sizes[live] == at
        cut = ((size >= minimum) & (((value & low) == 0) | (size >= maximum))) | done
        if cut.any():
            for k in live[cut].tolist():
                ends[k].append(at)
            value[cut], begin[cut] = 0, at
            if done.any():
                live, value, begin = live[~done], value[~done], begin[~done]
    for k, v, b in zip(live.tolist(), value.tolist(), begin.tolist(), strict=True):
        ends[k] += _follow(memoryview(objects[k]), at, b, v, minimum, average, maximum)
    return ends


def chunked(objects: DataFrame, profile: tuple[int, int, int] = PROFILES["standard-v1"]) -> DataFrame:
    """(object_id, index, offset, bytes, sha256) of objects (object_id, content binary); null content gives no chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = np.cumsum(pc.fill_null(pc.binary_length(whole.column("content")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            turns = np.unique(np.concatenate([[0], np.searchsorted(lengths, np.arange(_BYTES, (lengths[-1] if len(lengths) else 0) + 1, _BYTES), "right"), [whole.num_rows]]))
            for a, b in zip(turns[:-1].tolist(), turns[1:].tolist(), strict=True):
                batch, rows = whole.slice(a, b - a), []
                contents = [c or b"" for c in batch.column("content").to_pylist()]
                for key, content, ends in zip(batch.column("object_id").to_pylist(), contents, cuts(contents, *profile), strict=True):
                    begin, view = 0, memoryview(content)
                    for i, end in enumerate(ends):
                        rows.append((key, i, begin, end - begin, hashlib.sha256(view[begin:end]).hexdigest()))
                        begin = end
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["object_id", "index", "offset", "bytes", "sha256"])

    return objects.select("object_id", "content").mapInArrow(run, "object_id string, index long, offset long, bytes long, sha256 string")
