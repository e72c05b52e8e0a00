"""Stateful streams: idempotent events, coalesced change hints, and an append-only journal.

Order is that of sequence and arrival numbers, never of event time. The rows that one key has within one trigger are sorted
in one task, so bound a trigger by the source's own options (maxFilesPerTrigger, maxBytesPerTrigger).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest sequence number that JSON readers keep exactly.
MAX_SEQUENCE = 2**53 - 1
_TORN = "_torn"


def _by_arrival(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values("arrival", kind="stable", ignore_index=True)


def _apply(key, frames, state):
    rows = _by_arrival(frames)
    high = state.get[0] if state.exists else None
    floor = np.iinfo(np.int64).min
    known = rows["sequence"].notna().to_numpy()
    sequence = rows["sequence"].fillna(floor).astype("int64").to_numpy()
    ready = rows["ready"].fillna(False).astype(bool).to_numpy() & known
    reached = np.maximum.accumulate(np.concatenate([[floor if high is None else high], np.where(ready, sequence, floor)]))
    late = (sequence <= reached[:-1]) | ~known
    if reached[-1] > floor:
        state.update((int(reached[-1]),))
    outcome = np.where(late, "late", np.where(ready, "applied", "held"))
    yield pd.DataFrame({"event_id": rows["event_id"], "path": [key[0]] * len(rows), "sequence": rows["sequence"], "outcome": outcome})


def applied_stream(events: DataFrame) -> DataFrame:
    """(event_id, path, sequence, outcome) of a stream of events (event_id, path, sequence, arrival, ready).

    applied: the replica is clean and the content is there (`ready`), and the sequence exceeds all applied ones of the path.
    late: it doesn't exceed them, which covers repeated deliveries too; a null sequence is late. held: not ready, a null
    too; nothing is recorded, so the event can be delivered again. The state of a path is one number.
    """
    kept = events.select("event_id", "path", "sequence", "arrival", "ready")
    return kept.groupBy("path").applyInPandasWithState(_apply, "event_id long, path string, sequence long, outcome string", "high long", "append", "NoTimeout")


#: Operations of a session that show its state to the caller, and so end what was pending.
READS = ("query", "explain", "index_status", "refresh", "subscribe", "unsubscribe")


def _hint(key, frames, state):
    subscribed, dirty, number, closed = state.get if state.exists else (False, False, 0, False)
    out = []
    rows = _by_arrival(frames)
    for kind, ok, at in zip(rows["kind"], rows["ok"], rows["arrival"], strict=True):
        if closed:
            break
        if kind in ("workspace_changed", "rescan_required"):
            if subscribed and not dirty:
                number, dirty = number + 1, True
                if number > MAX_SEQUENCE:
                    raise OverflowError("the session's event numbers are used up")
                out.append((key[0], kind, number, at))
        elif ok is not None and bool(ok):
            subscribed = True if kind == "subscribe" else False if kind == "unsubscribe" else subscribed
            dirty = False if kind in READS else dirty
            closed = kind == "shutdown"
    state.update((subscribed, dirty, number, closed))
    yield pd.DataFrame(out, columns=["session", "event", "sequence", "arrival"])


def hints(messages: DataFrame) -> DataFrame:
    """(session, event, sequence, arrival): the change hints that sessions are sent.

    `messages` (session, arrival, kind, ok): changes seen (kind workspace_changed, or rescan_required where some were lost)
    and operations with whether they succeeded. A subscribed session gets one hint, and no other until it next reads;
    unsubscribed ones get none; shutdown ends a session.
    """
    kept = messages.select("session", "arrival", "kind", "ok")
    return kept.groupBy("session").applyInPandasWithState(_hint, "session string, event string, sequence long, arrival long", "subscribed boolean, dirty boolean, number long, closed boolean", "append", "NoTimeout")


def journal(spark: SparkSession, folder: str, schema: str, stream: bool = True) -> tuple[DataFrame, DataFrame]:
    """(events, torn) of a folder of JSON lines: rows of `schema`, and the text of lines that aren't whole. Blank lines are neither."""
    lines = (spark.readStream if stream else spark.read).text(folder).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, {_TORN} string", {"columnNameOfCorruptRecord": _TORN, "mode": "PERMISSIVE"}).alias("e"))
    whole = parsed.where(F.col(f"e.{_TORN}").isNull()).select("e.*").drop(_TORN)
    return whole, parsed.where(F.col(f"e.{_TORN}").isNotNull()).select(F.col("value").alias("line"))


def first_deliveries(events: DataFrame, key: str = "event_id") -> DataFrame:
    """The first row of each key; a stream keeps each key that it saw as state, as replays may come at any time."""
    return events.dropDuplicates([key])


#: Folders that a journal is dealt out to by its keys' hashes.
SLOTS = 256


def append_new(batch: DataFrame, folder: str, key: str = "event_id") -> None:
    """Append the rows of `batch` whose keys the Parquet journal in `folder` lacks; a replayed batch adds nothing. For foreachBatch.

    The journal lies in SLOTS folders by the key's hash, and only the folders that the batch's keys fall into are read.
    """
    spark = batch.sparkSession
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")
    new = batch.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("_slot", slot)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        slots = [r["_slot"] for r in new.select("_slot").distinct().collect()]  # at most SLOTS
        held = spark.read.schema(f"{batch.schema.toDDL()}, _slot int").parquet(folder).where(F.col("_slot").isin(slots)).select("_slot", key)
        new = new.join(held, ["_slot", key], "left_anti")
    new.select(*batch.columns, "_slot").repartition("_slot").write.partitionBy("_slot").mode("append").parquet(folder)


def repaired_journal(spark: SparkSession, folder: str, schema: str, to: str, quarantine: str) -> tuple[int, int]:
    """Copy the whole lines of a journal in `folder` to `to` and the torn ones to `quarantine`; how many of each. The journal itself stays as it is."""
    whole, torn = journal(spark, folder, schema, stream=False)
    whole.write.mode("errorifexists").json(to)
    torn.write.mode("errorifexists").text(quarantine)
    return spark.read.schema(schema).json(to).count(), spark.read.text(quarantine).count()
