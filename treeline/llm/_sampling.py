"""Bounded training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import staged


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 4; rows with 2 are held out. Null ids are fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4, F.lit(0))


def held_out(column: str = "doc_id"):
    return fold(column) == 2


def place(column: str = "doc_id"):
    """A uniform place of an id in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(column, F.lit("sample")), 11) / F.lit(float(1 << 53))


def sampled(ids: DataFrame, label: str, per_label: int) -> DataFrame:
    """Of `ids` (doc_id, label), distinct, about `per_label` of each label, and `_n`, how many the label has.

    Counts by label set the share of places that is kept, six standard deviations wider than needed: an id stays or goes
    by its own hash, so labels are only ever counted, never gathered, and any partitioning gives the same sample. The
    reader of the sample cuts it to `per_label` by place.
    """
    sizes = staged(ids.groupBy(label).agg(F.count("*").alias("_n")), "sizes")
    share = (per_label + 6 * per_label**0.5) / F.col("_n")
    return ids.join(sizes, label).where(place() < share)


def stretches(column: str, most: int, parts: int = 4):
    """The text, or of one longer than `most` characters, `parts` stretches of it, one from each equal part at a place by hash of the id."""
    text, size, each = F.col(column), F.length(column), most // parts
    cut = []
    for k in range(parts):
        room = F.greatest(F.floor(size / parts) - each, F.lit(0))
        at = F.floor(size / parts) * k + F.pmod(F.xxhash64("doc_id", F.lit(k)), room + 1)
        cut.append(F.substring(text, at.cast("int") + 1, F.lit(each)))
    return F.when(size <= most, text).otherwise(F.concat_ws("\n", *cut))


def first_rows(got: list, label: str, per_label: int) -> list:
    """The collected rows (with `place`) of the least places, `per_label` of each label."""
    out, seen = [], {}
    for row in sorted(got, key=lambda r: (r["place"], r["doc_id"], str(r[label]))):
        seen[row[label]] = seen.get(row[label], 0) + 1
        if seen[row[label]] <= per_label:
            out.append(row)
    return out
