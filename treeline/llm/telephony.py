"""Telephony audio: mu-law and A-law expansion, IMA ADPCM decoding, resampling, and WAV files around them.

A media column holds RIFF/WAVE files of one channel. G.711 bytes expand by 256-entry tables; ADPCM files are decoded with
numpy across blocks (one step of all blocks at a time, as blocks are independent); decoded audio is stored as resampled
16-bit PCM. Long audio is expanded, resampled and stored in parts of bounded size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import block_ids, staged, table
from ._words import column_bytes, slices

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 0x11
#: Coded bytes that are expanded at a time, and of which a part of stored PCM is made.
STEP = 1 << 20
#: Packing of stored audio: large pages and high levels, as PCM repeats itself over long stretches.
PACKED = {"parquet.page.size": 8 << 20, "parquet.compression.codec.zstd.level": 12}


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    step, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(step == 0, low + 8, (low + 264) << np.maximum(step - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()
# Fixed values of IMA ADPCM: step sizes by index, and the index's change by the low three bits of a code.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
SHIFTS = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """(n, size) bytes of IMA ADPCM blocks to (n, 2 * size - 7) samples: the header's sample, then two of each byte."""
    n, size = blocks.shape
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    out = np.empty((2 * size - 7, n), np.int16)
    out[0] = value
    for i in range(2 * size - 8):
        code = blocks[:, 4 + i // 2] >> 4 * (i % 2) & 15
        step = STEPS[index]
        change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + SHIFTS[code & 7], 0, len(STEPS) - 1)
        out[i + 1] = value
    return out.T


def wav(data: bytes, kind: int, rate: int, block: int = 1, fill: bytes = b"") -> bytes:
    """A one-channel WAVE file around coded bytes and what fills them up. block: bytes of a block (ADPCM) or a sample."""
    bits, size = {PCM: 16, ADPCM: 4}.get(kind, 8), len(data) + len(fill)
    per_block = 2 * block - 7 if kind == ADPCM else 1
    fmt = struct.pack("<HHIIHH", kind, 1, rate, rate * block // per_block, block, bits)
    fact = b""
    if kind != PCM:
        fmt += struct.pack("<HH", 2, per_block) if kind == ADPCM else struct.pack("<H", 0)
        fact = struct.pack("<4sII", b"fact", 4, size // block * per_block)
    head = b"WAVE" + struct.pack("<4sI", b"fmt ", len(fmt)) + fmt + fact + struct.pack("<4sI", b"data", size)
    return b"".join([b"RIFF", struct.pack("<I", len(head) + size + (size & 1)), head, data, fill, b"\0" * (size & 1)])


def read_wav(media: bytes) -> tuple[int, int, int, memoryview]:
    """(kind, rate, block, coded bytes) of a WAVE file; the bytes aren't copied."""
    media = memoryview(media)
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, found = 12, {}
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        found.setdefault(name, media[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    kind, _, rate, _, block, _ = struct.unpack_from("<HHIIHH", found[b"fmt "])
    return kind, rate, block, found[b"data"]


def expanded(coded: np.ndarray, kind: int, block: int) -> np.ndarray:
    """16-bit samples of coded bytes. A last ADPCM block that is cut short is dropped, as players do."""
    if kind == MULAW:
        return MULAW_TABLE[coded]
    if kind == ALAW:
        return ALAW_TABLE[coded]
    if kind == PCM:
        return coded[: len(coded) & ~1].view("<i2")
    if kind == ADPCM:
        return adpcm_blocks(coded[: len(coded) // block * block].reshape(-1, block)).ravel()
    raise ValueError(f"unknown WAVE kind {kind}")


def samples(media: bytes) -> tuple[np.ndarray, int]:
    """All decoded samples and the rate."""
    kind, rate, block, data = read_wav(media)
    return expanded(np.frombuffer(data, np.uint8), kind, block), rate


def resample(x: np.ndarray, rate: int, to: int, begin: int = 0, after: int | None = None) -> np.ndarray:
    """Linear interpolation between neighbours, in integers, of a stretch of audio: the samples at `to` whose left neighbour it holds.

    begin: the stretch's first place in the audio; after: the sample that follows it, none at the audio's end, where the
    last sample stands for it. Equal rates and empty audio are returned as they are.
    """
    if rate == to or not len(x):
        return x
    wide = np.append(x, x[-1] if after is None else after).astype(np.int32 if to == 2 * rate else np.int64)
    if to == 2 * rate:
        out = np.empty(2 * len(x), np.int16)
        out[::2] = x
        out[1::2] = (wide[:-1] + wide[1:]) >> 1
        return out
    first, end = -(-begin * to // rate), -(-(begin + len(x)) * to // rate)
    place = np.arange(first, end, dtype=np.int64) * rate
    i, part = place // to - begin, place % to
    return ((wide[i] * (to - part) + wide[i + 1] * part) // to).astype(np.int16)


def pcm_parts(media: bytes, to: int, step: int = STEP) -> Iterator[np.ndarray]:
    """The audio at rate `to`, in parts made of `step` coded bytes, about."""
    kind, rate, block, data = read_wav(media)
    coded, begin = np.frombuffer(data, np.uint8), 0
    unit = block if kind == ADPCM else 2 if kind == PCM else 1
    coded = coded[: len(coded) // unit * unit]
    step = max(1, step // unit) * unit
    for a in range(0, len(coded), step):
        x, after = expanded(coded[a : a + step], kind, block), expanded(coded[a + step : a + step + unit], kind, block)
        yield resample(x, rate, to, begin, int(after[0]) if len(after) else None)
        begin += len(x)


def decode_media(df: DataFrame, column: str = "media", rate: int = 16000) -> DataFrame:
    """`df` with `column` (WAVE files) replaced by files of 16-bit PCM at `rate`; null and unreadable media become null."""
    fields = df.schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, column):
                out = []
                for media in batch.column(column).to_pylist():
                    try:
                        out.append(wav(b"".join(x.astype("<i2").tobytes() for x in pcm_parts(media, rate)), PCM, rate, 2))
                    except (TypeError, ValueError, KeyError, struct.error):
                        out.append(None)
                yield batch.set_column(batch.schema.get_field_index(column), column, pa.array(out, pa.binary()))

    return df.mapInArrow(decode, fields)


def store_audio(docs: DataFrame, unit: int = 576, rate: int = 8000, to: int = 16000) -> DataFrame:
    """(rid, part, parts, doc_id, n_bytes, media, pcm), staged: each whole text as a mu-law WAVE file, one sample a byte, and that file decoded, resampled and stored as WAVE files of 16-bit PCM at rate `to`.

    Long audio has several parts of PCM; part 0 holds the media. rid numbers the rows. Null counts as empty. Bytes 255
    fill the text up to a positive multiple of `unit`. Rows are independent: repeated and null ids stay as they are; other
    columns are left out. Tasks sort their rows by text, so that copies lie side by side and are packed as such.
    """
    names, types = ["rid", "part", "parts", "doc_id", "n_bytes", "media", "pcm"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, ids = [], 0, block_ids(TaskContext.get().partitionId())

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

        for whole in batches:
            for batch in slices(whole, "text"):
                data, at = column_bytes(batch.column("text"))
                view, at = memoryview(data), at.tolist()
                for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1], at[1:], strict=True):
                    n, rid = b - a, next(ids)
                    media = wav(view[a:b], MULAW, rate, fill=b"\xff" * (max(1, -(-n // unit)) * unit - n))
                    parts = -(-len(read_wav(media)[3]) // STEP)
                    for part, x in enumerate(pcm_parts(media, to)):
                        held.append((rid, part, parts, doc_id, n, media if part == 0 else None, wav(x.astype("<i2").tobytes(), PCM, to, 2)))
                        size += 2 * len(x)
                        if size >= 4 * STEP:
                            yield close()
                            held, size = [], 0
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").sortWithinPartitions("text")
    return staged(rows.mapInArrow(pack, "rid long, part int, parts int, doc_id long, n_bytes long, media binary, pcm binary"), "audio", **PACKED)


def _energy(x: np.ndarray) -> int:
    wide = x.astype(np.int64)
    return int(np.dot(wide, wide))


def _feature(payload: np.ndarray, block: int) -> str:
    """Whole-number features: mu-law and A-law energy, peak, zero crossings, and the ADPCM reading's energy."""
    mulaw = alaw = adpcm = peak = crossings = 0
    step, low = STEP // block * block, False
    for a in range(0, len(payload), step):
        part = payload[a : a + step]
        x = MULAW_TABLE[part]
        negative = x < 0
        crossings += int(np.count_nonzero(negative[1:] != negative[:-1])) + int(a > 0 and low != negative[0])
        low = negative[-1]
        peak = max(peak, int(x.max()), -int(x.min()))
        mulaw, alaw = mulaw + _energy(x), alaw + _energy(ALAW_TABLE[part])
        adpcm += _energy(adpcm_blocks(part[: len(part) // block * block].reshape(-1, block)).ravel())
    return f"mulaw={mulaw};alaw={alaw};peak={peak};crossings={crossings};adpcm={adpcm}"


def _features(payloads: list[np.ndarray], block: int) -> list[str]:
    """_feature of each payload; the ADPCM blocks of short ones are decoded together."""
    if len(payloads) == 1:
        return [_feature(payloads[0], block)]
    blocks = adpcm_blocks(np.concatenate([p[: len(p) // block * block] for p in payloads]).reshape(-1, block)).astype(np.int64)
    energy, at, out = np.concatenate([[0], np.cumsum((blocks * blocks).sum(axis=1))]), 0, []
    for p in payloads:
        x, n = MULAW_TABLE[p], len(p) // block
        low = x < 0
        crossings = int(np.count_nonzero(low[1:] != low[:-1]))
        out.append(f"mulaw={_energy(x)};alaw={_energy(ALAW_TABLE[p])};peak={max(int(x.max()), -int(x.min()))};crossings={crossings};adpcm={int(energy[at + n] - energy[at])}")
        at += n
    return out


_FACTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_facts(stored: DataFrame, block: int = 36) -> DataFrame:
    """One row per row of the texts stored: facts of the media read back, and of the PCM read back pcm_bytes and pcm_energy (bytes and sum of squares of all samples). block: bytes of the blocks of the ADPCM reading.

    Only what is found in audio of several parts is shuffled.
    """
    facts = [c.split()[0] for c in _FACTS.split(", ")]
    names = ["rid", "doc_id", "n_bytes", *facts, "pcm_bytes", "pcm_energy"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "pcm"):
                found = [np.frombuffer(read_wav(m.as_buffer())[3], "<i2") for m in batch.column("pcm")]
                media = [memoryview(m.as_buffer()) if m.is_valid else None for m in batch.column("media")]
                payloads = [None if m is None else read_wav(m)[3] for m in media]
                features = iter(_features([np.frombuffer(p, np.uint8) for p in payloads if p is not None], block) if any(p is not None for p in payloads) else [])
                rows = [(None,) * 6 if m is None else (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), next(features)) for m, p in zip(media, payloads, strict=True)]
                kinds = [pa.string() if c.endswith("string") else pa.int64() for c in _FACTS.split(", ")]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                sums = [pa.array([x.nbytes for x in found], pa.int64()), pa.array([_energy(x) for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "doc_id", "n_bytes")), *cols, *sums], names=names)

    def each(some: DataFrame) -> DataFrame:
        return some.select("rid", "doc_id", "n_bytes", "media", "pcm").mapInArrow(describe, f"rid long, doc_id long, n_bytes long, {_FACTS}, pcm_bytes long, pcm_energy long")

    long = each(stored.where("parts > 1")).groupBy("rid", "doc_id", "n_bytes").agg(*(F.first(c, ignorenulls=True).alias(c) for c in facts), F.sum("pcm_bytes").alias("pcm_bytes"), F.sum("pcm_energy").alias("pcm_energy"))
    return each(stored.where("parts = 1")).unionByName(long).drop("rid")


def op2_telephony(spark, sf_dir: str) -> DataFrame:
    return media_facts(store_audio(table(spark, sf_dir, "documents")))
