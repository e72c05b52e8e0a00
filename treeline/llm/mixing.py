"""Mixing of sources to target weights by hash-threshold histograms.

Each row has a uniform 60-bit hash of its id and text. A source's target is met by whole repeats of all its rows plus the
rows whose hash lies below the source's threshold. Thresholds come from histograms: sizes are summed by source and the
hash's leading bits, the bucket in which the budget runs out is found, and only rows of that bucket are summed again by
the next bits, until the bits run out. No row is sorted, and no source's rows meet in one task.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import staged, table, unstage, with_facts

#: Bits of the hash, those that one histogram resolves, and rounds until all are.
HASH_BITS, ROUND_BITS, ROUNDS = 60, 10, 6


def word_count(column: str):
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """`sources` with `place`, the 0-based place of each by code point, null last; ranges are sorted apart and then offset."""
    parts = sources.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), "source")
    numbered = staged(parts.withColumn("at", F.monotonically_increasing_id()), "sources")
    part, offset, cases = F.shiftright("at", 33), 0, F.lit(0)
    for p, n in sorted(numbered.groupBy(part.alias("p")).count().collect()):
        cases, offset = F.when(part == p, F.lit(offset)).otherwise(cases), offset + n
    return numbered.withColumn("place", (cases + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("at")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) of every source of `sizes` (source, size).

    Sources by code point, null last, weigh `weights` in turn and share the total; a target stops at `most` times its
    source's size, and the excess is shared again by weight until none is above. Sums are whole numbers, so that
    reruns agree; only the level (a quotient of two of them) visits the driver.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = _ranked(sums)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * most)
    capped, level = F.lit(False), Fraction(0)
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        held, left = ranked.agg(F.coalesce(F.sum(F.when(capped, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        new = Fraction(total - held, left) if left else level
        if not left or new == level:
            break
        level = new
        # most < weight * level, in whole numbers
        capped = F.col("most").cast("decimal(38,0)") * F.lit(level.denominator).cast("decimal(18,0)") < F.col("weight").cast("decimal(18,0)") * F.lit(str(level.numerator)).cast("decimal(19,0)")
    # the quotient is taken in the last step, from whole numbers
    share = F.col("weight").cast("double") * F.lit(float(level.numerator)) / F.lit(float(level.denominator))
    return ranked.select("source", "source_size", F.when(capped, F.col("most").cast("double")).otherwise(share).alias("target"))


def _key(source: str):
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def _hashed(docs: DataFrame) -> DataFrame:
    """(row, size, hash, doc_id, source, k): rows as one column, so that no name of theirs can clash."""
    name = F.concat(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.lit("/"), F.coalesce("row.text", F.lit("")))
    key = F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    packed = docs.select(F.struct("*").alias("row"))
    return packed.select("row", word_count("row.text").alias("size"), key.alias("hash"), "row.doc_id", "row.source", _key("row.source").alias("k"))


def thresholds(rows: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, int]:
    """(k, n, source_size, target, times, low) of each source of `rows` (source, k, size, hash), and the number of rows.

    n: rows of the source; times: whole repeats; low: the hash below which a row is taken once more. Each round reads only
    the rows of the buckets in which budgets ran out, rows of equal hash as one.
    """
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    plan = targets(rows.select("source", "size"), weights, most).withColumn("k", _key("source")).drop("source").join(counts, "k")
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("times", F.least(times, F.lit(most).cast("long")))
    # `low`: rows below it are in; `need`: words still wanted from the bucket that starts there
    facts = ["k", "n", "source_size", "target", "times"]
    open_ = staged(plan.select(*facts, F.lit(0).cast("long").alias("low"), (F.col("target") - F.col("times") * F.col("source_size")).alias("need")), "plan")
    end, total, pool = F.lit((1 << 63) - 1), rows.count(), rows.where("size > 0").select("k", "size", "hash")
    for r in range(ROUNDS):
        shift = HASH_BITS - ROUND_BITS * (r + 1)
        sums = pool.groupBy("k", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        w = Window.partitionBy("k").orderBy("bucket")  # at most 2**ROUND_BITS rows of a source
        upto = sums.withColumn("upto", F.sum("words").over(w)).join(open_.select("k", "need"), "k")
        found = upto.groupBy("k").agg(F.min(F.when(F.col("upto") > F.col("need"), F.struct("bucket", "upto", "words"))).alias("c"), F.lit(True).alias("some"))
        rest = F.col("need") - (F.col("c.upto") - F.col("c.words"))
        if r < ROUNDS - 1:
            low = F.coalesce(F.shiftleft(F.col("c.bucket"), shift), end)
        else:  # a bucket is one hash: in or out, whichever is nearer
            low = F.coalesce(F.col("c.bucket") + F.when(rest * 2 > F.col("c.words"), 1).otherwise(0), end)
        done = (F.col("low") == end) | F.col("some").isNull()
        last, held = open_, pool
        new = open_.join(found, "k", "left")
        open_ = staged(new.select(*facts, F.when(done, F.col("low")).otherwise(low).alias("low"), F.when(done, F.lit(0.0)).otherwise(F.coalesce(rest, F.lit(0.0))).alias("need")), "plan")
        if r < ROUNDS - 1:
            border = with_facts(pool, open_.where(F.col("low") < end).select("k", "n", "low"), "k", "n", total)
            border = border.where(F.shiftright("hash", shift) == F.shiftright("low", shift))
            pool = staged(border.groupBy("k", "hash").agg(F.sum("size").alias("size")), "border")
        unstage(last)
        if r:
            unstage(held)
    return open_.select(*facts, "low"), total


def _repeats(size: str, hash_: str, most: int):
    more = (F.col(hash_) < F.col("low")).cast("long")
    return F.when(F.col(size) > 0, F.least(F.col("times") + more, F.lit(most).cast("long"))).otherwise(F.col("times"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): doc_id, size, source_size, target, taken, source, repeats.

    size is the number of words (null text: 0); taken is a whole multiple of it, at most `most` times. Every row is taken
    floor(target / source_size) times, and once more if its hash lies below the source's threshold: a source's taken words
    miss its target by half of the row at the threshold at most, however long that row is. Rows that repeat id and text share
    a hash, so they count as that one row. Sources of no words take nothing. Ties and reruns agree, as hashes decide.
    """
    rows = staged(_hashed(docs).select("doc_id", "size", "source", "k", "hash"), "sizes")
    plan, total = thresholds(rows, weights, most)
    out = with_facts(rows, plan, "k", "n", total)
    repeats = _repeats("size", "hash", most)
    return out.select("doc_id", "size", "source_size", "target", (repeats * F.col("size")).alias("taken"), "source", repeats.alias("repeats"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    marked = _hashed(docs)
    rows = staged(marked.select("source", "k", "size", "hash"), "sizes")
    plan, total = thresholds(rows, weights, most)
    taken = with_facts(marked, plan, "k", "n", total).select("row", _repeats("size", "hash", most).alias("n")).where("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).drop("repeats", "source")


OP6_SQL = r"""
WITH sz AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
src AS (
  SELECT source, s, 3 * s AS m, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS w
  FROM (SELECT source, sum(size)::BIGINT AS s FROM sz GROUP BY source)),
k AS (
  SELECT *, row_number() OVER o AS r, sum(s) OVER () - coalesce(sum(m) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weights
  FROM src WINDOW o AS (ORDER BY m::DOUBLE / w, source), before AS (ORDER BY m::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT r AS from_, rest, weights FROM k WHERE m * weights >= w * rest ORDER BY r LIMIT 1),
tg AS (SELECT source, s, CASE WHEN r < from_ THEN m::DOUBLE ELSE w::DOUBLE * lv.rest::DOUBLE / lv.weights::DOUBLE END AS target FROM k, lv),
tm AS (SELECT *, CASE WHEN s > 0 THEN least(floor(target / s), 3) ELSE 0 END::BIGINT AS times FROM tg),
cum AS (
  SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto
  FROM (SELECT source, h, sum(size) AS n FROM sz WHERE size > 0 GROUP BY source, h)),
low AS (
  SELECT tm.source, min(CASE WHEN upto > target - times * s THEN h + CASE WHEN (target - times * s - (upto - n)) * 2 > n THEN 1 ELSE 0 END END) AS low
  FROM tm JOIN cum ON tm.source IS NOT DISTINCT FROM cum.source GROUP BY tm.source)
SELECT doc_id, size, s AS source_size, target, size * least(times + CASE WHEN size > 0 AND (low.low IS NULL OR h < low.low) THEN 1 ELSE 0 END, 3) AS taken
FROM sz JOIN tm ON sz.source IS NOT DISTINCT FROM tm.source LEFT JOIN low ON sz.source IS NOT DISTINCT FROM low.source
"""
