"""Growth of a link graph from graded sources within a budget of reads and bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.storage import cut

# The least grade of a source, most reads and bytes of a run.
GRADE, READS, BYTES = 2, 66, 16 * 1024 * 1024


def reads(captures: DataFrame, scans: DataFrame, most_reads: int = READS, most_bytes: int = BYTES) -> DataFrame:
    """Captures (candidate, path, sha256, bytes, grade, ...) that a run reads: those not yet scanned of the best candidates that fit.

    Candidates go by grade, best first, then by key. One whose captures, scanned ones
    included, exceed the bytes that are left is passed over for good; smaller ones after it
    may still be read. The last candidate is read in part, in order of paths, where the reads
    run out. Null grades and candidates without fresh captures are not read.

    What a candidate needs is summed once. A round then takes from those that still fit the
    next ones in order, at most as many as reads are left, so the driver never holds more
    rows than the budget names, and there are at most as many rounds as reads.
    """
    known = scans.select("sha256", "path", F.lit(True).alias("__known")).distinct()
    marked = captures.join(known, ["sha256", "path"], "left").withColumn("__fresh", F.col("__known").isNull()).drop("__known")
    own = F.when(F.col("__fresh"), F.col("bytes")).otherwise(0)
    needs = marked.groupBy("candidate").agg(F.max("grade").alias("grade"), F.sum("bytes").alias("total"), F.count_if("__fresh").alias("fresh"), F.sum(own).alias("own"))
    needs = cut(needs.where((F.col("grade") >= GRADE) & (F.col("fresh") > 0) & (F.col("total") <= most_bytes)))
    taken, last, left, room = [], None, most_reads, most_bytes
    while left > 0 and room > 0:
        fits = needs.where(F.col("total") <= room)
        if last is not None:
            fits = fits.where((F.col("grade") < last["grade"]) | ((F.col("grade") == last["grade"]) & (F.col("candidate") > last["candidate"])))
        batch = fits.orderBy(F.desc("grade"), "candidate").limit(left).collect()
        for row in batch:
            if left > 0 and row["total"] <= room:
                taken.append((row["candidate"], min(left, row["fresh"])))
                left, room = left - min(left, row["fresh"]), room - row["own"]
        if not batch:
            break
        last = batch[-1]
    chosen = captures.sparkSession.createDataFrame(taken, f"candidate {dict(captures.dtypes)['candidate']}, __n long")
    place = F.row_number().over(Window.partitionBy("candidate").orderBy("path", "sha256"))
    fresh = marked.where("__fresh").join(F.broadcast(chosen), "candidate").withColumn("__place", place)
    return fresh.where(F.col("__place") <= F.col("__n")).drop("__fresh", "__n", "__place")


def grown(read: DataFrame, links: DataFrame, known: DataFrame) -> DataFrame:
    """New rows (target, path, anchor, grade, sha256) of links (path, place, target, anchor) that read captures hold to other sites.

    Assets and addresses of a replay archive are left out; of a target that a capture links
    twice the first place counts, and rows (target, path) that are known stay as they are.
    """
    found = links.join(read.select("path", F.col("url").alias("__url"), "grade", "sha256"), "path")
    found = found.where(~U.is_asset("target") & (U.bare_host("target") != U.bare_host("__url")) & (U.host("target") != "web.archive.org"))
    first = found.groupBy("target", "path").agg(F.min_by(F.struct("anchor", "grade", "sha256"), "place").alias("f"))
    return first.join(known.select("target", "path"), ["target", "path"], "left_anti").select("target", "path", "f.*")
