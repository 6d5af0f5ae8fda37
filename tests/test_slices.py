"""Slices that stop and resume, retries after their time, and totals under updates and deletes."""

import collections
import random
import time

from pyspark.sql import functions as F

from tidemark.streaming import slices as L

WORK = "lane string, work long, ts timestamp, fails int"


def put(spark, rows, shape, at, k):
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{at}/part{k}")


def stream(spark, shape, at):
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(at)


def rows_of(k):
    """A hundred minutes of work for two lanes, a piece a minute."""
    return [(f"l{m % 2}", m, f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00", {0: 1, 10: 2, 20: 7}.get(m % 30, 0)) for m in range(100 * k, 100 * k + 100)]


def typed(spark, rows):
    return spark.createDataFrame(rows, "lane string, work long, ts string, fails int").withColumn("ts", F.to_timestamp("ts"))


def expected(rows, last, delay, most, late):
    out = []
    for lane, work, ts, fails in rows:
        minute = work
        for attempt in range(1, min(fails + 1, most) + 1):
            if attempt == 1 or minute + (attempt - 1) * delay <= last - late:
                out.append((lane, work, attempt, "done" if attempt > fails else "failed" if attempt < most else "dropped"))
    return sorted(out)


def test_slices_resume_where_they_stopped(spark, tmp_path):
    parts = [rows_of(k) for k in range(3)]
    for name, stops in (("one", [3]), ("three", [1, 2, 3])):
        at, folder, done = str(tmp_path / name), str(tmp_path / f"{name}-work"), 0
        for stop in stops:
            for k in range(done, stop):
                typed(spark, parts[k]).coalesce(1).write.parquet(f"{at}/part{k}")
            got = L.worked(stream(spark, WORK, at), "lane", "10 minutes", 3, "5 minutes", folder).collect()
            done = stop
            rows = [r for p in parts[:stop] for r in p]
            assert sorted((r.lane, r.work, r.attempt, r.outcome) for r in got) == expected(rows, 100 * stop - 1, 10, 3, 5)
        assert sorted(r.n for r in got if r.lane == "l0" and r.attempt == 1) == list(range(1, 151))


def test_totals_are_those_of_a_recount(spark, tmp_path):
    rng, at, folder = random.Random(3), str(tmp_path / "in"), str(tmp_path / "work")
    seq, state = 0, {}
    for k in range(4):
        rows = []
        for _ in range(60):
            seq += 1
            key, group = rng.randrange(25), rng.choice(("a", "b", "c", None))
            amount = rng.choice((None, rng.randrange(-5, 100)))
            rows.append((key, seq, group, amount))
            state[key] = (group, amount or 0)
        rows.append((rows[0][0], 0, "c", 999))  # late: changes nothing
        rng.shuffle(rows)
        put(spark, rows, "key long, seq long, grp string, amount long", at, k)
        if k % 2:
            assert L.deltas(stream(spark, "key long, seq long, grp string, amount long", at), "key", folder) == folder
            want = collections.defaultdict(lambda: [0, 0])
            for group, amount in state.values():
                if group is not None:
                    want[group][0] += 1
                    want[group][1] += amount
            assert {r.grp: [r.n, r.amount] for r in L.totals(spark, folder).collect()} == dict(want)
    per_batch = spark.read.option("basePath", f"{folder}/deltas").parquet(f"{folder}/deltas").groupBy("batch").count().collect()
    assert len(per_batch) >= 4 and all(r["count"] <= 3 for r in per_batch)  # a batch tells its own totals only


def test_gaps_are_read_once_a_slice_whatever_is_due(spark, tmp_path):
    """Two thousand gaps of a lane with times of their own; a timer each would read all gaps two thousand times."""
    at = str(tmp_path / "in")
    spark.range(0, 2000, numPartitions=1).selectExpr("'l' AS lane", "id AS work", "timestamp_millis(1704067200000 + id * 1000) AS ts", "CAST(id % 3 AS int) AS fails").write.parquet(f"{at}/part0")
    began = time.monotonic()
    got = L.worked(stream(spark, WORK, at), "lane", "1 second", 3, "1 second").collect()
    assert time.monotonic() - began < 60
    want = [(w, a, "done" if a > w % 3 else "failed") for w in range(2000) for a in range(1, w % 3 + 2) if a == 1 or w + a - 1 <= 1998]
    assert sorted((r.work, r.attempt, r.outcome) for r in got) == want
