"""Near-duplicate classes by b-bit MinHash.

1. Each text becomes its set of word shingles, 128 minima of random permutations, 32 band keys of four whole minima, and
   a packed signature that retains the low two bits of each minimum. Texts with equal sets fold into one node.
2. Nodes that share a band key are candidates. In each bucket the member that shares the most with others is the pivot;
   a pair passes on if its bit counts, corrected for chance agreement, estimate a similarity near the threshold.
3. What passes is confirmed on full shingle sets. Confirmed links give connected components.
4. In buckets whose members lie in several components, any link between components must share one of each text's rarest
   shingles (a prefix of its set, ordered by a sketch of frequencies, that is longer than a link may miss). Only pairs
   that do are estimated and confirmed.
Buckets are never collected: pivots come from aggregates, and pairs from equi-joins on band keys and rare shingles, where
frequent keys are joined by broadcast and texts of frequent pivots in salted copies.

What can be lost is chance alone: a pair at the threshold shares no band with probability 5.6e-11 (0.85) or 4.8e-8 (0.8), and
its estimate lies more than MARGIN too low with 1.4e-6 or 7.2e-6; more similar pairs have less, and a class that other links
hold together loses nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._store import staged, table, unstage, with_facts
from .components import connected_components

HASHES, ROWS, BITS = 128, 4, 2
BANDS = HASHES // ROWS
#: How far below the threshold an estimate may lie: over five standard errors of 128 two-bit samples.
MARGIN = 0.2
_RNG = np.random.Generator(np.random.PCG64(97))
_A = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_SIGNED = "th long, doc_id long, n_shingles long, node binary, s0 long, s1 long, s2 long, s3 long, bands array<long>"


def minima(shingles: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(out, (shingles[None, i : i + 1024] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """(n, 128) minima to (n, 4) words of 32 two-bit samples."""
    bits = W.mix(low) & np.uint64(2**BITS - 1)
    shift = np.arange(0, 64, BITS, dtype=np.uint64)
    return (bits.reshape(len(low), 4, 32) << shift).sum(axis=2, dtype=np.uint64).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    groups = low.reshape(len(low), BANDS, ROWS)
    keys = (groups * W.SHINGLE[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * W.SHINGLE[9]
    return W.mix(keys).view(np.int64)


def _signer(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text"):
                sets = W.shingle_sets(batch.column("text"), width)
                full = np.array([len(s) > 0 for s in sets], bool)
                low = np.stack([minima(s) for s in sets])
                packed, keys = pack(low), band_keys(low)
                offsets = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("th"),
                        batch.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        *(pa.array(packed[:, k]) for k in range(4)),
                        lists,
                    ],
                    names=["th", "doc_id", "n_shingles", "node", "s0", "s1", "s2", "s3", "bands"],
                )

    return sign


def _agree(a: str, b: str):
    """Of 128 two-bit samples, the number that agree."""
    differ = F.lit(0)
    for k in range(4):
        x = F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        differ = differ + F.bit_count(x)
    return F.lit(HASHES) - differ


def estimate(a: str, b: str):
    """Similarity estimated from agreeing samples, corrected for agreement by chance."""
    chance = 2.0**-BITS
    return (_agree(a, b) / F.lit(float(HASHES)) - F.lit(chance)) / F.lit(1 - chance)


def _confirmer(width: int, percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in W.slices(whole, "text_a", 2 << 20):
                sides = []
                for side in "ab":
                    ids = batch.column(side).to_pylist()
                    new = {x: i for i, x in enumerate(ids) if x not in known}
                    if new:
                        known.update(zip(new, W.shingle_sets(batch.column(f"text_{side}").take(pa.array(list(new.values()))), width), strict=True))
                    sides.append(ids)
                hold = []
                for a, b in zip(*sides, strict=True):
                    x, y = known[a], known[b]
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        hold.append(False)
                        continue
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    hold.append(100 * both >= percent * (len(x) + len(y) - both))
                if sum(map(len, known.values())) > 2_000_000:
                    known = {}
                kept = pa.array(hold, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], names=["u", "v"])

    return confirm


#: Counters of the frequency sketch: 8 MB, whatever the input. Pages of so many tasks are added up in one step of a tree.
SKETCH_BITS, FAN = 21, 64
#: Pairs of a text beyond which copies of it share the pairs out.
COPY_PAIRS = 2000


def _counter(width: int):
    """Frequencies of shingles by their leading bits, in pages of 64 K counters, with the task's number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for whole in batches:
            for batch in W.slices(whole, "text"):
                sets = W.shingle_sets(batch.column("text"), width)
                total += np.bincount(np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS), minlength=1 << SKETCH_BITS).astype(np.int64)
        pages = np.minimum(total, 2**31 - 1).astype(np.int32).reshape(-1, 1 << 16)
        full = np.flatnonzero(pages.any(axis=1))
        part = pa.array(np.full(len(full), TaskContext.get().partitionId()))
        yield pa.RecordBatch.from_arrays([part, pa.array(full, pa.int64()), pa.array([pages[i].tobytes() for i in full], pa.binary())], names=["part", "page", "counts"])

    return count


def _added(pages: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in pages["counts"])
    return pd.DataFrame({"part": [pages["part"].iloc[0] // FAN], "page": [pages["page"].iloc[0]], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})


def _sketch(texts: DataFrame, width: int) -> np.ndarray:
    """Frequencies of the texts' shingles. A task reads as many texts as there are cores for, and pages are added up in a tree."""
    out, schema = np.zeros(1 << SKETCH_BITS, np.int32), "part long, page long, counts binary"
    tasks = max(FAN, texts.sparkSession.sparkContext.defaultParallelism)
    pages = texts.coalesce(tasks).mapInArrow(_counter(width), schema)
    while tasks > 1:
        pages = pages.groupBy("page", F.floor(F.col("part") / FAN).alias("_of")).applyInPandas(_added, schema)
        tasks = -(-tasks // FAN)
    for page, counts in pages.select("page", "counts").collect():
        out[page << 16 : (page + 1) << 16] = np.frombuffer(counts, np.int32)
    return out


def _rarest(width: int, percent: int, sketch):
    """Of each text its rarest shingles: one more than a text that links may lack."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for whole in batches:
            for batch in W.slices(whole, "text"):
                picked, sizes, full = [], [], []
                for s in W.shingle_sets(batch.column("text"), width):
                    k = len(s) + (-len(s) * percent) // 100 + 1
                    picked.append(s[np.argsort(counts[s >> np.uint64(64 - SKETCH_BITS)], kind="stable")[:k]])
                    sizes.append(len(picked[-1]))
                    full.append(len(s))
                of = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
                some = batch.drop_columns(["text"]).take(of)
                place = np.concatenate([np.arange(n) for n in sizes])
                new = [np.concatenate(picked).view(np.int64), place, np.repeat(full, sizes)]
                yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array(x, pa.int64()) for x in new)], names=[*some.schema.names, "shingle", "place", "size"])

    return pick


class _Run:
    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs, self.width, self.percent = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text")), width, percent
        self.signed = staged(self.docs.mapInArrow(_signer(width), _SIGNED), "signed")
        first = [F.first(c).alias(c) for c in ("s0", "s1", "s2", "s3", "bands")]
        nodes = self.signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("th", "doc_id")).alias("row"), *first)
        self.nodes = staged(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
        self.sigs = self.nodes.select("nid", "s0", "s1", "s2", "s3")

    def texts(self, need: DataFrame) -> DataFrame:
        """(nid, text): a text of each node of `need` (nid)."""
        rows = need.join(self.nodes.select("nid", F.col("row.th").alias("k"), F.col("row.doc_id").alias("d")), "nid")
        found = self.docs.join(rows, (self.docs.th == rows.k) & self.docs.doc_id.eqNullSafe(rows.d))
        return staged(found.groupBy("nid").agg(F.min("text").alias("text")), "texts")

    def confirmed(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Of staged pairs (a, b) of nodes, those whose full sets pass.

        A text of many pairs is copied, and its pairs are dealt out to the copies by the other side, before any text moves.
        """
        total, copies = pairs.count(), {}
        for side, other in ("ab", "ba"):
            counts = staged(pairs.groupBy(side).agg(F.count("*").alias("n")).withColumn(f"of_{side}", F.ceil(F.col("n") / COPY_PAIRS)), "counts")
            pairs = with_facts(pairs, counts, side, "n", total).drop("n")
            pairs = pairs.withColumn(f"copy_{side}", F.pmod(F.xxhash64(other), F.col(f"of_{side}"))).drop(f"of_{side}")
            each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"of_{side}") - 1)).alias(f"copy_{side}")
            copies[side] = texts.join(counts, texts.nid == F.col(side)).select(side, F.col("text").alias(f"text_{side}"), each)
        for side in "ba":
            pairs = pairs.join(copies[side], [side, f"copy_{side}"])
        return staged(pairs.mapInArrow(_confirmer(self.width, self.percent), "u long, v long"), "links")

    def passing(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs whose signatures estimate enough."""
        pairs = staged(pairs.distinct(), "candidates")
        counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
        x = staged(self.sigs.join(counts, F.col("nid") == F.col("a")).select("a", "n", F.struct("s0", "s1", "s2", "s3").alias("x")), "pivot-sigs")
        y = self.sigs.select(F.col("nid").alias("b"), F.struct("s0", "s1", "s2", "s3").alias("y"))
        both = with_facts(pairs, x, "a", "n", pairs.count()).join(y, "b")
        return staged(both.where(estimate("x", "y") >= self.percent / 100 - MARGIN).select("a", "b"), "pairs")

    def roots(self) -> DataFrame:
        """Rows (node, root) of all nodes that have links."""
        buckets = self.nodes.select("nid", F.explode("bands").alias("bucket"))
        shared = staged(buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "shared")
        live = staged(with_facts(buckets, shared, "bucket", "size", self.nodes.count() * BANDS), "live")
        total = live.count()
        score = live.groupBy("nid").agg(F.sum("size").alias("score"))
        pivots = live.join(score, "nid").groupBy("bucket").agg(F.max(F.struct("score", "nid")).alias("p"), F.count("*").alias("n"))
        main = staged(pivots.select("bucket", F.col("p.nid").alias("a"), "n"), "pivots")
        texts = self.texts(live.select("nid").distinct())
        pairs = with_facts(live, main, "bucket", "n", total).where("nid <> a").select("a", F.col("nid").alias("b"))
        links = self.confirmed(self.passing(pairs), texts)
        comps = staged(connected_components(links), "roots")

        placed = live.join(comps.select(F.col("node").alias("nid"), "root"), "nid", "left").select("bucket", "nid", F.coalesce("root", "nid").alias("root"))
        placed = staged(placed, "placed")
        pivot_root = staged(main.join(comps, F.col("a") == F.col("node"), "left").select("bucket", F.coalesce("root", "a").alias("main"), "n"), "main")
        sided = staged(with_facts(placed, pivot_root, "bucket", "n", total).withColumn("out", F.col("root") != F.col("main")).drop("n"), "sided")
        mixed = staged(sided.groupBy("bucket").agg(F.max("out").alias("any"), F.count("*").alias("n")).where("any"), "mixed")
        open_ = staged(with_facts(sided, mixed, "bucket", "n", total).groupBy("nid", "root").agg(F.max("out").alias("out")), "open")
        rare = texts.join(open_, "nid")
        sketch = self.docs.sparkSession.sparkContext.broadcast(_sketch(rare, self.width))
        schema = "nid long, root long, out boolean, s0 long, s1 long, s2 long, s3 long, shingle long, place long, size long"
        rare = rare.join(self.sigs, "nid").select("text", "nid", "root", "out", "s0", "s1", "s2", "s3")
        rare = staged(rare.mapInArrow(_rarest(self.width, self.percent, sketch), schema), "rare")
        x, y = rare.where("out").alias("x"), rare.alias("y")
        # Where two texts first meet in their orders, what is left of both must suffice for a link.
        left = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
        enough = left * (100 + self.percent) >= (F.col("x.size") + F.col("y.size")) * self.percent
        near = estimate("x", "y") >= self.percent / 100 - MARGIN
        once = (F.col("x.nid") < F.col("y.nid")) | ~F.col("y.out")
        meet = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root")) & once & enough & near)
        pairs = staged(meet.select(F.col("y.nid").alias("a"), F.col("x.nid").alias("b")).distinct(), "pairs")
        links = links.union(self.confirmed(pairs, texts))
        unstage(sided)
        return staged(connected_components(links), "roots")


def near_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept, th (xxhash64 of the text).

    Two texts link if 100 * |intersection| >= percent * |union| of their sets of `width`-word shingles (A-Z count as a-z;
    fewer words: the whole sequence is the one shingle). component_id is the least doc_id reachable, and the row that has
    it is kept; repeated rows with that id are all kept. Null or blank text: empty set, linked with nothing, own
    component. Null doc_id: takes part, but is never the least unless all ids of its class are null; not kept otherwise.
    """
    run = _Run(docs, width, percent)
    named = run.nodes.select("node", "nid", "least_id").join(run.roots().select(F.col("node").alias("nid"), "root"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    named = staged(named, "named")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "root").select("node", "component_id")
    out = run.signed.select("th", "doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "th")


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that near_classes keeps, one for each class: of rows that repeat the kept id, one stays. A blank text stays."""
    classes = near_classes(docs, width, percent).where("kept").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    packed = docs.select(F.struct("*").alias("row"))
    marked = packed.select("row", "row.doc_id", F.xxhash64("row.text").alias("h"))
    kept = marked.join(classes, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_th")), "left_semi")
    return kept.dropDuplicates(["doc_id", "h"]).select("row.*")


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"), 5, 85).drop("th")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, root = doc_id AS kept
FROM (SELECT node AS doc_id, min(root) AS root FROM r GROUP BY node) LEFT JOIN n USING (doc_id)
"""
