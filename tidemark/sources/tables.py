"""Table sources: columnar tables of a folder, and archive folders of raw captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPTURE = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()),
])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; zone-less timestamps stay as they are stored."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def captures(spark: SparkSession, folder: str, pattern: str = "*", limit_bytes: int | None = None) -> DataFrame:
    """Raw files under a folder, hidden and version-control paths left out, with a content hash.

    Files over limit_bytes come without content rather than not at all.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    files = files.where(~F.col("path").rlike(r"/\.[^/]+"))
    if limit_bytes is not None:
        files = files.withColumn("content", F.when(F.col("length") <= limit_bytes, F.col("content")))
    return files.withColumn("sha256", F.sha2("content", 256))


def capture_parts(path: F.Column) -> dict[str, F.Column]:
    """Host, 14-digit time and page path of ``websites/<host>/<time>/<path>``."""
    where = r"websites/([^/]+)/(\d{14})/(.*)$"
    return {name: F.nullif(F.regexp_extract(path, where, k + 1), F.lit("")) for k, name in enumerate(("host", "captured", "page"))}


def messages(files: DataFrame) -> DataFrame:
    """Newsgroup messages: a header block, a blank line, a body; missing headers are null."""
    text = F.decode("content", "UTF-8") if dict(files.dtypes).get("content") == "binary" else F.col("content")
    parts = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n\n", 2)
    head = lambda name: F.nullif(F.regexp_extract(parts[0], rf"(?im)^{name}:[ \t]*(.*)$", 1), F.lit(""))
    return files.select(
        "path", head("From").alias("author"), head("Newsgroups").alias("groups"), head("Subject").alias("subject"), head("Date").alias("sent"),
        F.when(F.size(parts) > 1, parts[1]).otherwise("").alias("body"),
    )


MAIL = "ygData struct<messageBody:string,subject:string,from:string,date:string,postDate:string>"


def mails(rows: DataFrame, column: str = "content") -> DataFrame:
    """Mailing-list messages in JSON; the time is date, else postDate, in epoch seconds."""
    data = F.from_json(F.col(column).cast("string"), MAIL)["ygData"]
    when = F.timestamp_seconds(F.coalesce(data["date"], data["postDate"]).try_cast("double"))
    return rows.select("path", data["from"].alias("author"), data["subject"].alias("subject"), when.alias("sent"), data["messageBody"].alias("body"))


def after(rows: DataFrame, key: str, cursor, size: int) -> DataFrame:
    """The next page of a scan in order of a unique key."""
    rows = rows if cursor is None else rows.where(F.col(key) > F.lit(cursor))
    return rows.orderBy(key).limit(size)


def seeded_sample(rows: DataFrame, key: str, seed: str, size: int) -> DataFrame:
    """A repeatable random sample: the rows whose salted digests are smallest."""
    order = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    return rows.withColumn("__order", order).orderBy("__order", key).limit(size).drop("__order")


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries with what was found: ok, altered or missing."""
    found = files.select("path", F.col("sha256").alias("found_sha256"))
    state = F.when(F.col("found_sha256").isNull(), "missing").when(F.col("found_sha256") == F.col("sha256"), "ok").otherwise("altered")
    return manifest.join(found, "path", "left").withColumn("state", state).drop("found_sha256")
