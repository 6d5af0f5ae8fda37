"""Work in bounded, resumable slices, with retries behind timers; and running totals kept by deltas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.events import drained, work_folder

#: The state store that timers and lists need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _store(stream: DataFrame) -> None:
    stream.sparkSession.conf.set(*STORE)


#: Gaps that one message to the state store holds.
MESSAGE = 10_000


class Lane(StatefulProcessor):
    """A lane's cursor and its open gaps. Work is told once, in the order of its arrival; what fails is told again when its time has come.

    The cursor is the number of the last piece of work, how many the lane has had, and when
    its timer stands. A gap is a piece that failed, with its attempts and the event time of
    the next try. A lane has one timer, at its earliest gap: when it rings, the gaps are read
    and written once, whatever number of them is due. Gaps are dropped after ``most`` attempts.
    """

    def __init__(self, delay_ms: int, most: int):
        self.delay, self.most = delay_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", "last long, n long, timer long")
        self.gaps = handle.getListState("gaps", "work long, attempts int, fails int, due long")

    def _told(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["lane", "work", "attempt", "outcome", "n"])

    def _wait(self, gaps: list[tuple], timer: int | None) -> int | None:
        """Adds gaps; returns where the lane's timer stands then."""
        for at in range(0, len(gaps), MESSAGE):
            self.gaps.appendList(gaps[at : at + MESSAGE])
        first = min((g[3] for g in gaps), default=timer)
        if first is None or timer is not None and timer <= first:
            return timer
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(first)
        return first

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, n, timer = self.cursor.get() if self.cursor.exists() else (-1, 0, None)
        for batch in rows:
            out, gaps = [], []
            for work, ts, fails in batch.sort_values("work")[["work", "ts", "fails"]].itertuples(index=False):
                n += 1
                last = max(last, int(work))
                out.append((key[0], int(work), 1, "failed" if fails > 0 else "done", n))
                if fails > 0:
                    gaps.append((int(work), 1, int(fails), int(ts.timestamp() * 1000) + self.delay))
            timer = self._wait(gaps, timer)
            yield self._told(out)
        self.cursor.update((last, n, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        last, n, _ = self.cursor.get()
        out, left = [], []
        for work, attempts, fails, due in sorted(map(tuple, self.gaps.get())):
            while due <= mark and attempts < self.most:  # a timer that is due already would wait for the next slice
                attempts += 1
                outcome = "done" if attempts > fails else "failed" if attempts < self.most else "dropped"
                out.append((key[0], work, attempts, outcome, n))
                due += self.delay
                if outcome != "failed":
                    attempts = self.most
            if attempts < self.most:
                left.append((work, attempts, fails, due))
        self.gaps.clear()
        self.cursor.update((last, n, self._wait(left, None)))
        yield self._told(out)


def worked(stream: DataFrame, lane: str, delay: str = "1 hour", most: int = 3, late: str = "1 hour", folder: str | None = None) -> DataFrame:
    """Rows (lane, work, attempt, outcome, n) of a stream of (lane, work, ts, fails): every piece of work once, and again while it fails.

    ``fails`` is how often a piece fails before it is done. Outcomes are done, failed and,
    after ``most`` attempts, dropped; n is the lane's count of pieces so far. A failed piece
    is tried again ``delay`` later, once the watermark has passed that. Slices are bounded
    by the files a trigger takes; a folder that is given again resumes after the last slice.
    """
    _store(stream)
    ms = int(pd.Timedelta(delay).total_seconds() * 1000)
    rows = stream.withWatermark("ts", late).select(F.col(lane).alias("lane"), F.col("work").cast("long").alias("work"), "ts", F.col("fails").cast("int").alias("fails"))
    kind = rows.schema["lane"].dataType.simpleString()
    told = rows.groupBy("lane").transformWithStateInPandas(Lane(ms, most), f"lane {kind}, work long, attempt int, outcome string, n long", "Append", "EventTime")
    return drained(told, "append", folder=folder)


class Last(StatefulProcessor):
    """Each key's last row; a change tells what it takes from one group and adds to another."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, grp string, amount long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.last.get()) if self.last.exists() else None
        now = before
        for batch in rows:
            for seq, group, amount in batch[["seq", "grp", "amount"]].itertuples(index=False):
                row = (int(seq), None if pd.isna(group) else str(group), 0 if pd.isna(amount) else int(amount))
                if now is None or row[0] > now[0]:
                    now = row
        out = []
        if now != before:
            if before is not None and before[1] is not None:
                out.append((before[1], -1, -before[2]))
            if now[1] is not None:
                out.append((now[1], 1, now[2]))
            self.last.update(now)
        yield pd.DataFrame(out, columns=["grp", "n", "amount"]).astype({"grp": object, "n": "int64", "amount": "int64"})


def deltas(stream: DataFrame, key: str, folder: str | None = None) -> str:
    """Takes all changes (key, seq, grp, amount) that are there; returns the folder of deltas by batch.

    A row with a larger seq replaces the key's row, also in another group; a null group
    deletes it. A batch adds one file of its own totals by group and touches no other, and
    a batch that is run again replaces its own. A folder that is given again resumes.
    """
    _store(stream)
    folder = folder or work_folder(stream.sparkSession)
    rows = stream.select(F.col(key).alias("key"), F.col("seq").cast("long").alias("seq"), F.col("grp").cast("string").alias("grp"), F.col("amount").cast("long").alias("amount"))
    changes = rows.groupBy("key").transformWithStateInPandas(Last(), "grp string, n long, amount long", "Append", "None")

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("grp").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount")).write.mode("overwrite").parquet(f"{folder}/deltas/batch={number}")

    changes.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return folder


def totals(spark, folder: str) -> DataFrame:
    """Rows (grp, n, amount): the deltas of all batches added up, for groups that have rows."""
    found = spark.read.schema("grp string, n long, amount long").parquet(f"{folder}/deltas")
    return found.groupBy("grp").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount")).where("n <> 0")
