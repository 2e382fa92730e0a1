"""Deduplication of clicks within windows that expire, as a streaming query with state."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brindle.llm.common import discard, partitions, scratch

#: Milliseconds of an hour; a window's timer stands half an hour after its last one, so it never falls on a watermark.
HOUR, SHIFT = 3_600_000, 1_800_000
#: Hours that a window stays open for repeats, and that events may come late.
SPAN, LATE = 48, 24
#: Batches of a run, and copies that one cell of clicks, and one task that counts them, has on average at most.
BATCHES, PER_CELL, PER_TASK = 10, 20_000, 200_000
EVENT = "click_id long, hour long, hash binary, n long"
WINDOW = "click_id long, start_hour long, n_repeats long, n_conflicts long, conflict_crc long, hash binary, expired boolean, watermark long"
_OPEN = np.dtype([("id", "<i8"), ("start", "<i8"), ("repeats", "<i8"), ("conflicts", "<i8"), ("crc", "<i8"), ("hash", "S32")])
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # else each store sets several megabytes of disk aside for its logs, however little it holds
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # the stores of an executor share their buffers
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # a store takes its buffers' first blocks, an eighth of a buffer each, when it opens: stores are opened for every start, and hold little
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    # each start is one batch: a store that stayed loaded would only wait for the next query's, which is another
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def whole_bytes(hashes: np.ndarray) -> list[bytes]:
    """Hashes as bytes, zeros at their ends too."""
    return np.ascontiguousarray(hashes, "S32").view("V32").tolist()


def fold(held: np.ndarray, ids: np.ndarray, hours: np.ndarray, hashes: np.ndarray, counts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Fold sorted events into the open windows of some clicks: (closed windows, open windows, by id).

    held: open windows, one an id at most, by id; events are sorted by (id, hour, hash), counts says how often each comes. All ids take a
    step at once: each opens a window where it has none, which takes the events up to span hours after its start.
    """
    named, low = np.unique(ids, return_index=True)
    high = np.append(low[1:], len(ids))
    now = np.zeros(len(named), _OPEN)
    now["id"] = named
    opened = np.isin(named, held["id"])
    now[opened] = held[np.searchsorted(held["id"], named[opened])]
    closed, at, rank = [], low.copy(), np.arange(len(named))
    least = hours.min() if len(hours) else 0
    width = int(hours.max() - least + 1) if len(hours) else 1
    place = np.repeat(rank, high - low) * width + (hours - least)
    before = np.concatenate(([0], np.cumsum(counts)))
    left = rank
    while len(left):
        fresh_ = left[~opened[left]]
        first = at[fresh_]
        now["start"][fresh_], now["hash"][fresh_], now["repeats"][fresh_] = hours[first], hashes[first], counts[first] - 1
        now["conflicts"][fresh_] = now["crc"][fresh_] = 0
        opened[fresh_] = True
        at[fresh_] += 1
        end = np.searchsorted(place, left * width + np.clip(now["start"][left] + span - least, -1, width - 1), "right")
        end = np.maximum(end, at[left])
        now["repeats"][left] += before[end] - before[at[left]]
        sizes = end - at[left]
        rows = np.repeat(at[left] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        owner = np.repeat(left, sizes)
        unlike = hashes[rows] != now["hash"][owner]
        rows, owner = rows[unlike], owner[unlike]
        np.add.at(now["conflicts"], owner, counts[rows])
        np.add.at(now["crc"], owner, counts[rows] * np.fromiter((zlib.crc32(h.hex().encode()) for h in whole_bytes(hashes[rows])), np.int64, len(rows)))
        at[left] = end
        left = left[end < high[left]]
        closed.append(now[left])
        opened[left] = False
    kept = np.concatenate((held[~np.isin(held["id"], named)], now))
    return np.concatenate(closed) if closed else now[:0], kept[np.argsort(kept["id"], kind="stable")]


class ClickWindows(StatefulProcessor):
    """Windows of the clicks of one group: a click alone, or the clicks of a cell.

    A ValueState keeps each open window's opener, counters and sum of checksums, and the time of the group's timer, which is that of the
    window that expires first.
    """

    def __init__(self, span: int = SPAN):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("windows", "timer long, windows binary")

    def expires(self, start: Any) -> Any:
        return (start + self.span) * HOUR + SHIFT

    def load(self) -> tuple[int, np.ndarray]:
        kept = self.state.get() if self.state.exists() else None
        return (int(kept[0]), np.frombuffer(bytes(kept[1]), _OPEN).copy()) if kept else (0, np.zeros(0, _OPEN))

    def keep(self, timer: int, windows: np.ndarray, fired: int = 0) -> None:
        """Store the open windows, and move the timer; one that has just fired is removed by Spark."""
        at = int(self.expires(windows["start"].min())) if len(windows) else 0
        if timer and timer not in (at, fired):
            self.handle.deleteTimer(timer)
        if at and at != timer:
            self.handle.registerTimer(at)
        if len(windows):
            self.state.update((at, windows.tobytes()))
        else:
            self.state.clear()

    def told(self, windows: np.ndarray, watermark: int) -> pd.DataFrame:
        out = {"click_id": windows["id"], "start_hour": windows["start"], "n_repeats": windows["repeats"], "n_conflicts": windows["conflicts"], "conflict_crc": windows["crc"]}
        return pd.DataFrame(out | {"hash": whole_bytes(windows["hash"]), "expired": self.expires(windows["start"]) <= watermark, "watermark": watermark})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        parts = [p[(p["n"] > 0) & (p["hour"] * HOUR > watermark)] for p in rows]
        ids, hours, counts = (np.concatenate([p[c].to_numpy(np.int64) for p in parts]) for c in ("click_id", "hour", "n"))
        if not len(ids):
            return
        hashes = np.concatenate([np.array(p["hash"].tolist(), "S32") for p in parts])
        order = np.lexsort((hashes, hours, ids))
        timer, held = self.load()
        closed, windows = fold(held, ids[order], hours[order], hashes[order], counts[order], self.span)
        self.keep(timer, windows)
        if len(closed):
            yield self.told(closed, watermark)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        timer, held = self.load()
        over = self.expires(held["start"]) <= watermark
        self.keep(timer, held[~over], expiredTimerInfo.getExpiryTimeInMs())
        if over.any():
            yield self.told(held[over], watermark)


def click_windows(events: DataFrame, cells: int = 0, span: int = SPAN, late: int = LATE) -> DataFrame:
    """Windows (WINDOW) of a stream of events (EVENT): an event is a repeat up to span hours after its window's opener.

    A later event closes its click's window and opens another; a window also closes once the watermark, late hours behind the latest event, has passed it
    (expired is true); watermark is that at which it is told, in milliseconds. Events of the same click, hour and hash may be one row with their number n; rows with n of 0 only move the
    watermark. Events behind the watermark are dropped. Hours count from a start of the caller's and are positive.

    cells: clicks are dealt to so many groups by hash, whose windows are one state, folded together; 0 makes each click a group of
    its own. It is fixed for as long as a checkpoint is used. A group's events of one batch and its open windows are held by one task, so cells
    must grow with the input. A hash has 32 bytes; conflict_crc sums the CRC-32 of their hexadecimal form.
    """
    group = F.pmod(F.xxhash64("click_id"), F.lit(cells)) if cells else F.col("click_id")
    timed = events.withColumn("at", F.timestamp_millis(F.col("hour") * HOUR)).withWatermark("at", f"{late} hours 1 millisecond")
    grouped = timed.withColumn("cell", group).groupBy("cell")
    return grouped.transformWithStateInPandas(ClickWindows(span), outputStructType=WINDOW, outputMode="Append", timeMode="eventTime")


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def collect_garbage(spark: SparkSession) -> None:
    """Executors give back what their heaps grew by and no longer need, for what the stores take beside them."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def run_batches(events: DataFrame, n_batches: int, cells: int = 0, span: int = SPAN, late: int = LATE, tasks: int | None = None) -> DataFrame:
    """Feed events (batch int, and EVENT) batch by batch to a streaming query, started anew for each on one checkpoint: WINDOW and closed_batch, without expired and watermark.

    closed_batch is the batch in which a window closed, or after which it expired. Batches are written to a new folder of the shared one,
    each is moved into the query's source before its start, and an event far ahead in the last closes what is open after it. Empty batches start nothing.
    Spark never frees the statistics of a RocksDB that it closes, half a megabyte on 8 CPUs, so a partition opens its store once a batch, and once more at the end.
    All but the result is removed at the end. tasks: how many make the events, where they come of a shuffle; None: the session's number.
    """
    spark = events.sparkSession
    folder = scratch(spark, "clicks")
    staged, source, state, out = (f"{folder}/{x}" for x in ("staged", "source", "state", "windows"))
    with _set(spark, {"spark.sql.shuffle.partitions": str(tasks or partitions(events))}):
        events.write.partitionBy("batch").parquet(staged)
    files = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path
    files.mkdirs(path(source))

    columns = "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash binary"
    fed = [b for b in range(n_batches) if files.exists(path(f"{staged}/batch={b}"))]
    if not fed:
        discard(spark, folder)
        return spark.createDataFrame([], columns)
    for before, batch in zip([fed[0], *fed], fed, strict=False):
        files.rename(path(f"{staged}/batch={batch}"), path(f"{source}/{batch}"))
        over = F.col("expired")
        if batch == fed[-1]:
            final = spark.read.schema(EVENT).parquet(f"{source}/*").agg(F.max("hour")).first()[0] + span + late + 2
            spark.createDataFrame([(0, final, None, 0)], EVENT).coalesce(1).write.parquet(f"{source}/{n_batches}")
            over &= F.col("watermark") < (final - late) * HOUR - 1
        # what has expired before this batch did so after the one before it; what the event far ahead closes, after this one
        closed = F.when(over, F.lit(before)).otherwise(F.lit(batch)).cast("long").alias("closed_batch")
        stream = click_windows(spark.readStream.schema(EVENT).parquet(f"{source}/*"), cells, span, late)
        collect_garbage(spark)
        with _set(spark, _SETTINGS | {"spark.sql.streaming.noDataMicroBatches.enabled": str(batch == fed[-1]).lower()}):
            query = stream.select("click_id", "start_hour", closed, "n_repeats", "n_conflicts", "conflict_crc", "hash")
            query.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    for done in (staged, source, state):
        discard(spark, done)
    return spark.read.schema(columns).parquet(out)


def _micros(table: DataFrame, name: str) -> Column:
    """Microseconds since 1970; times without a zone are taken as UTC, whatever the session's zone."""
    at = F.col(name)
    if table.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(at)
    second = F.extract(F.lit("SECOND"), at) * 1_000_000
    return (F.unix_date(at.cast("date")).cast("long") * 24 + F.hour(at)) * 3_600_000_000 + F.minute(at).cast("long") * 60_000_000 + second.cast("long")


def click_copies(clicks: DataFrame) -> DataFrame:
    """The copies of clicks as events: (late_hour, click_id, hour, hash), late_hour being the hour at which a copy is fed.

    Rows without click_id or arrived_at have no copies, nor do hashes hold null fields or values that aren't finite: these are empty.
    """
    value = F.when(F.abs("value") < F.lit(float("inf")), F.floor(100 * F.col("value") + 0.5))
    sound = clicks.filter("click_id is not null and arrived_at is not null")
    arrived = _micros(clicks, "arrived_at")
    rows = sound.select(
        F.col("click_id").cast("long").alias("click_id"), F.round((arrived - F.pmod(arrived, F.lit(3_600_000_000))) / 3_600_000_000).cast("long").alias("arrived"),
        F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("client_id", "kind")), F.coalesce(value.cast("string"), F.lit("")), F.coalesce(_micros(clicks, "ts").cast("string"), F.lit("")), F.coalesce("props", F.lit("")), F.lit("")).alias("told"),
    )
    copies = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.pmod("click_id", F.lit(3)).cast("long"))))
    copies = copies.withColumn("c", F.crc32(F.concat_ws(":", F.col("click_id").cast("string"), F.col("j").cast("string"))))
    hour = F.col("arrived") + 6 * F.col("j") * (F.col("c") % 10)
    late = hour + F.floor(F.col("c") / 10) % 200
    return copies.select(late.alias("late_hour"), "click_id", hour.alias("hour"), F.unhex(F.sha2(F.concat("told", (F.col("c") % 3).cast("string")), 256)).alias("hash"))


def deduplicate_clicks(clicks: DataFrame, n_batches: int = BATCHES, cells: int | None = None, span: int = SPAN, late: int = LATE) -> DataFrame:
    """Windows of a table of clicks that is replayed as a stream in batches: click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc, hash (hexadecimal).

    clicks: click_id, ts, arrived_at, client_id, kind, value, props; other columns, whatever their names, are left out. Copies (click_copies) of equal
    click, hour and hash are counted before they are moved. Only the least and greatest hours and the number of copies go to the driver.
    cells: as in click_windows; None takes as many as keep a cell near PER_CELL copies, at least the session's shuffle partitions.

    Repeated rows and ties by hour and hash are repeats of each other. Rows without click_id or arrived_at take no part, other nulls and
    texts of any length are hashed. Negative ids are ids. An empty table gives no rows.
    """
    copies = click_copies(clicks)
    low, high, least, n = copies.agg(F.min("late_hour"), F.max("late_hour"), F.min("hour"), F.count("*")).first()
    if not n:
        low = high = least = 0
    if cells is None:
        cells = max(partitions(clicks), -(-n // PER_CELL))
    shift = 1000 - least  # hours of the stream are positive
    batch = F.floor((F.col("late_hour") - low) * n_batches / (high - low + 1)).cast("int").alias("batch")
    events = copies.select(batch, "click_id", (F.col("hour") + shift).alias("hour"), "hash").groupBy("batch", "click_id", "hour", "hash").agg(F.count("*").alias("n"))
    found = run_batches(events, n_batches, cells, span, late, max(partitions(clicks), -(-n // PER_TASK)))
    return found.withColumn("start_hour", F.col("start_hour") - shift).withColumn("hash", F.lower(F.hex("hash")))
