"""Version-control tree objects as a table: a Python data source that parses them in its tasks, behind pushed filters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tidemark.storage import cut

#: Modes of an entry: a tree below, files, links and other repositories.
TREE_MODE = "40000"
SCHEMA = "tree string, place int, name string, mode string, oid string"


def entries(content: bytes) -> Iterator[tuple[str, str, str]]:
    """(name, mode, oid) of a tree object's entries; raises ValueError where it is cut off."""
    at = 0
    while at < len(content):
        blank = content.find(b" ", at)
        zero = content.find(b"\0", blank)
        if blank < 0 or zero < 0 or zero + 21 > len(content):
            raise ValueError(f"a tree object is cut off at byte {at}")
        yield content[blank + 1 : zero].decode("utf-8", "replace"), content[at:blank].decode("ascii"), content[zero + 1 : zero + 21].hex()
        at = zero + 21


def entry(mode: str | Column, name: Column, oid: Column) -> Column:
    """An entry of a tree object; oid is in hex."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return F.concat(F.encode(F.concat(mode, F.lit(" "), name), "UTF-8"), F.unhex(F.lit("00")), F.unhex(oid))


def tree_oid(content: Column) -> Column:
    """The object's name: SHA-1 of its header and content."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("tree "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), content))


class _File(InputPartition):
    def __init__(self, path: str, group: int):
        super().__init__((path, group))


class _Reader(DataSourceReader):
    """A task for each row group of the files."""

    def __init__(self, path: str):
        self.path, self.wanted = path, {}

    def partitions(self) -> list[InputPartition]:
        system, folder = fs.FileSystem.from_uri(self.path)
        files = [f.path for f in system.get_file_info(fs.FileSelector(folder, recursive=True)) if f.path.endswith(".parquet")]
        groups = [_File(p, g) for p in sorted(files) for g in range(pq.ParquetFile(p, filesystem=system).num_row_groups)]
        return groups or [_File("", -1)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, group = partition.value
        if group < 0:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        trees, modes, names = (self.wanted.get(c) for c in ("tree", "mode", "name"))
        for batch in pq.ParquetFile(path, filesystem=system).iter_batches(batch_size=256, row_groups=[group], columns=["tree", "content"]):
            rows = [
                (tree, place, name, mode, oid)
                for tree, content in zip(batch["tree"].to_pylist(), batch["content"].to_pylist()) if content is not None and (trees is None or tree in trees)
                for place, (name, mode, oid) in enumerate(entries(content)) if (modes is None or mode in modes) and (names is None or name in names)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))], ["tree", "place", "name", "mode", "oid"])


class _FilteringReader(_Reader):
    """Applies conditions on tree, mode and name before rows are made."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute in (("tree",), ("mode",), ("name",)):
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f


class TreeObjects(DataSource):
    """``spark.read.format("tree_objects").load(folder)`` over Parquet files with columns tree and content.

    The folder's address is one that pyarrow can open; its files are read by the tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "tree_objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kind = _FilteringReader if self.options.get("filters") == "pushed" else _Reader
        return kind(self.options["path"])


def scan(spark: SparkSession, folder: str, pushed: bool = False) -> DataFrame:
    """The data source over a folder. With ``pushed`` its reader takes filters; Spark then keeps them with the DataFrame, so use that one for one query only."""
    spark.dataSource.register(TreeObjects)
    if pushed:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tree_objects").option("filters", "pushed" if pushed else "kept").load(folder if "://" in folder else f"file://{folder}")


def tree_entries(spark: SparkSession, folder: str, where: str | Column | None = None) -> DataFrame:
    """Rows (tree, place, name, mode, oid) of all tree objects of a folder, or of those that a condition holds for.

    Conditions on tree, mode and name are applied by the reader. What is found is written
    once, so that later filters do not meet the reader's own.
    """
    return scan(spark, folder) if where is None else cut(scan(spark, folder, pushed=True).where(where))


def listing(found: DataFrame, roots: DataFrame, most: int | None = None, depth: int = 32) -> DataFrame:
    """Rows (root, path, oid, complete): the files below each root tree, at most ``most`` of each in the order of their paths.

    roots has a column root, a tree's name. complete says that a root's listing is all of
    it. Each round joins the trees found so far with their entries; a tree that holds
    itself ends at ``depth``.
    """
    found = cut(found.select("tree", "name", "mode", "oid"))
    level = roots.select("root", F.col("root").alias("tree"), F.lit("").alias("path"))
    files: DataFrame | None = None
    for _ in range(depth):
        below = cut(level.join(found, "tree").select("root", F.concat("path", "name").alias("path"), "mode", "oid"))
        own = below.where(F.col("mode") != TREE_MODE).select("root", "path", "oid")
        files = own if files is None else files.union(own)
        level = below.where(F.col("mode") == TREE_MODE).select("root", F.col("oid").alias("tree"), F.concat("path", F.lit("/")).alias("path"))
        if level.isEmpty():
            break
    if most is None:
        return files.withColumn("complete", F.lit(True))
    # The optimizer keeps the first ``most`` of a root in each task before it deals the rest.
    order = F.row_number().over(Window.partitionBy("root").orderBy("path"))
    sizes = files.groupBy("root").agg((F.count("*") <= most).alias("complete"))
    return files.withColumn("k", order).where(F.col("k") <= most).drop("k").join(sizes, "root")
