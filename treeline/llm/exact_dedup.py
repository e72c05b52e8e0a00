"""Exact duplicates by exchange of Golomb-coded fingerprints.

1. Normalised texts are staged once, in blocks of bounded size, with a 64-bit fingerprint of each.
2. Each block sends each owner (a range of fingerprints) the sorted distinct fingerprints of its range as a Golomb-Rice
   coded message. Owners decode them and send each block a bitmap: which of its fingerprints other blocks hold too.
3. Blocks turn their bitmaps into suspects, fold equal texts of theirs, and only suspects' texts are shuffled. There,
   equal bytes make a group; a fingerprint shared by chance costs a shuffle of that text and no more.
Blocks are buckets of the staged table, so neither messages nor bitmaps move any text. A block sends one fingerprint for
all its copies of a text, so a group of any size costs an owner one fingerprint a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import Blocks, block_ids, staged, table, with_facts
from ._words import field, slices, trim

#: Rows and bytes of texts after which a block is closed.
BLOCK_ROWS, BLOCK_BYTES = 1 << 16, 8 << 20
#: Fingerprints that an owner handles, about.
OWNER_ROWS = 1 << 20
_SPACE = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def normal(text: str | None) -> bytes:
    """UTF-8 of the text with each run of ASCII white space as one space; null as empty."""
    out = (text or "").encode().translate(_SPACE)
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 values as a header (count, first value, remainder bits) and Golomb-Rice coded gaps."""
    if not len(values):
        return b""
    gaps = np.diff(values) - np.uint64(1)
    mean = int(gaps.mean()) if len(gaps) else 0
    k = max(0, mean.bit_length() - 1)
    head = np.array([len(values), values[0], k], np.uint64).tobytes()
    if not len(gaps):
        return head
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ones = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1, np.uint8)
    unary[ones] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    return head + np.packbits(np.concatenate([rest, unary])).tobytes()


def rice_decode(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    n, first, k = np.frombuffer(data, np.uint64, 3)
    n, k = int(n), int(k)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=24))
    low = bits[: (n - 1) * k].reshape(n - 1, k).astype(np.uint64)
    rest = (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    ones = np.flatnonzero(bits[(n - 1) * k :])[: n - 1]
    quotient = np.diff(ones, prepend=-1) - 1
    gaps = (quotient.astype(np.uint64) << np.uint64(k)) + rest + np.uint64(1)
    return np.concatenate([[first], first + np.cumsum(gaps, dtype=np.uint64)]).astype(np.uint64)


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, place, print, sha, row) of structs `row` (doc_id, text, ...)."""
    from pyspark import TaskContext

    ids, rows, size = block_ids(TaskContext.get().partitionId()), 0, 0
    block = next(ids)
    for whole in batches:
        for batch in slices(whole, "row.text", BLOCK_BYTES):
            texts = [normal(t) for t in field(batch, "row.text").to_pylist()]
            digests = [hashlib.sha256(t).digest() for t in texts]
            prints = np.frombuffer(b"".join(x[:8] for x in digests), np.int64)
            columns = [pa.array(np.full(len(texts), block)), pa.array(np.arange(rows, rows + len(texts))), pa.array(prints), pa.array(digests, pa.binary()), batch.column("row")]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "place", "print", "sha", "row"])
            rows, size = rows + len(texts), size + sum(map(len, texts))
            if rows >= BLOCK_ROWS or size >= BLOCK_BYTES:
                block, rows, size = next(ids), 0, 0


def _distinct(rows: pa.Table, owners: int):
    """Sorted distinct fingerprints of a block, how often each occurs, and places where each owner's range begins, with the owners."""
    prints, counts = np.unique(rows.column("print").to_numpy().view(np.uint64), return_counts=True)
    width = -(-(1 << 64) // owners)
    to = (prints // np.uint64(width)).astype(np.int64) if owners > 1 else np.zeros(len(prints), np.int64)
    cuts = np.flatnonzero(np.diff(to, prepend=-1))
    return prints, counts, cuts, to[cuts]


def _sender(owners: int):
    def send(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        prints, counts, cuts, to = _distinct(rows, owners)
        ends = np.append(cuts[1:], len(prints))
        parts = [(rice_encode(prints[a:b]), np.packbits(counts[a:b] > 1).tobytes()) for a, b in zip(cuts, ends, strict=True)]
        block = pa.array(np.full(len(cuts), key[0].as_py()))
        return pa.table({"owner": pa.array(to), "block": block, "message": pa.array([p[0] for p in parts], pa.binary()), "own": pa.array([p[1] for p in parts], pa.binary())})

    return send


def _answer(messages: pa.Table) -> pa.Table:
    """Of each message of one owner, a bitmap of the fingerprints that this or another block holds more than once, if there are any."""
    lists = [rice_decode(m) for m in messages.column("message").to_pylist()]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    values = values[counts > 1]
    out = []
    for prints, own in zip(lists, messages.column("own").to_pylist(), strict=True):
        shared = np.isin(prints, values, assume_unique=True)
        shared |= np.unpackbits(np.frombuffer(own, np.uint8), count=len(prints)).astype(bool)
        out.append(np.packbits(shared).tobytes() if shared.any() else None)
    full = pa.array([x is not None for x in out])
    return pa.table({"block": messages.column("block"), "owner": messages.column("owner"), "bitmap": pa.array(out, pa.binary())}).filter(full)


_FOLDED = "block long, place long, print long, bytes binary, least_id long, rows long"


def _folder(owners: int):
    """Texts of a block that its bitmaps mark, equal ones folded; place: that of the first row with the least id."""

    def fold(rows: pa.Table, answers: pa.Table) -> pa.Table:
        held: dict[bytes, tuple] = {}
        if answers.num_rows:
            prints, _, cuts, to = _distinct(rows, owners)
            marked = np.zeros(len(prints), bool)
            ranges = {o: (a, b) for o, a, b in zip(to.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(prints)], strict=True)}
            for owner, bitmap in zip(answers.column("owner").to_pylist(), answers.column("bitmap").to_pylist(), strict=True):
                a, b = ranges[owner]
                marked[a:b] = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=b - a).astype(bool)
            chosen = rows.filter(pa.array(np.isin(rows.column("print").to_numpy().view(np.uint64), prints[marked])))
            for block, place, print_, row in zip(*(chosen.column(c).to_pylist() for c in ("block", "place", "print", "row")), strict=True):
                text, mine = normal(row["text"]), (row["doc_id"] is None, row["doc_id"], place)
                _, first, _, n = held.get(text, (block, mine, print_, 0))
                less = not mine[0] and (first[0] or mine < first)
                held[text] = (block, mine if less else first, print_, n + 1)
        found = list(held.values())
        trim()
        columns = [[x[0] for x in found], [x[1][2] for x in found], [x[2] for x in found], list(held), [x[1][1] for x in found], [x[3] for x in found]]
        return pa.table([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(columns)], names=["block", "place", "print", "bytes", "least_id", "rows"])

    return fold


def suspects(blocks: Blocks, owners: int) -> DataFrame:
    """The texts of each block whose fingerprints occur again, there or in other blocks (_FOLDED)."""
    sent = blocks.grouped("print").applyInArrow(_sender(owners), "owner long, block long, message binary, own binary")
    answers = staged(sent.groupBy("owner").applyInArrow(_answer, "block long, owner long, bitmap binary"), "answers")
    texts = blocks.grouped("place", "print", F.struct("row.doc_id", "row.text").alias("row"))
    return texts.cogroup(answers.groupBy("block")).applyInArrow(_folder(owners), _FOLDED)


def _groups(docs: DataFrame) -> tuple[Blocks, DataFrame, int]:
    """Blocks of `docs`, groups of equal texts (sha, keep_id, group_size, and block and place of the row to keep), and the number of rows."""
    spark, packed = docs.sparkSession, docs.select(F.struct("*").alias("row"))
    fields = T.StructType.fromDDL("block long, place long, print long, sha binary").add("row", packed.schema["row"].dataType)
    blocks = Blocks(packed.mapInArrow(_block, fields), "texts")
    total = blocks.rows.count()
    owners = max(1, -(-total // OWNER_ROWS), min(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    keeper = F.min(F.struct(F.col("least_id").isNull().alias("none"), F.col("least_id").alias("id"), "block", "place")).alias("keeper")
    groups = suspects(blocks, owners).groupBy("print", "bytes").agg(keeper, F.sum("rows").alias("group_size")).where("group_size > 1")
    groups = groups.select(F.unhex(F.sha2("bytes", 256)).alias("sha"), F.col("keeper.id").alias("keep_id"), "group_size", F.col("keeper.block").alias("keep_block"), F.col("keeper.place").alias("keep_place"))
    return blocks, staged(groups, "groups"), total


def exact_classes(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space; null counts as empty. Groups are
    made by equal bytes; rows then find theirs by the bytes' SHA-256. The row with the least doc_id stays; of rows that
    repeat that id in one group, all are kept. Null doc_id: never the least unless all ids of the group are null; then
    keep_id is null and the rows are kept. The rows are staged once meanwhile: disk of about the input's size.
    """
    blocks, groups, total = _groups(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    prints = staged(blocks.rows.select("row.doc_id", "sha"), "prints")
    blocks.close()
    out = with_facts(prints, groups, "sha", "group_size", total, "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _staying(rows: pa.Table, leaving: pa.Table) -> pa.Table:
    stays = ~np.isin(rows.column("place").to_numpy(), leaving.column("place").to_numpy())
    trim()
    return pa.table({"row": rows.column("row").filter(pa.array(stays))})


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, one for each distinct normalised text: of those with the least id, or of all if none has one, a first one.

    Blocks get the places of the rows that leave; rows themselves don't move.
    """
    blocks, groups, total = _groups(docs)
    prints = staged(blocks.rows.select("block", "place", "sha"), "prints")
    leaving = with_facts(prints, groups, "sha", "group_size", total).where("block <> keep_block or place <> keep_place").select("block", "place")
    kept = blocks.grouped("place", "row").cogroup(leaving.groupBy("block")).applyInArrow(_staying, T.StructType().add("row", docs.schema))
    out = staged(kept.select("row.*"), "kept")
    blocks.close()
    return out


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_classes(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(squeezed) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS squeezed FROM documents)
WINDOW w AS (PARTITION BY squeezed)
"""
