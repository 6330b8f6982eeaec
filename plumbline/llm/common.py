"""What the operators of this subpackage share: tables, written intermediates, components, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.shipping import ship

#: The same words everywhere: runs of anything but ASCII white space (bytes.split() splits at just these bytes).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, else (in local mode alone, as in tests) an own one."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir isn't set: on a cluster it has to name a folder that all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="plumbline-")
    return _own_dirs[context.applicationId]


#: While a table is written: Spark deletes the execution's shuffle files as it ends, and Python gets so many rows at a time, whole texts among them.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation of what stands before.

    Once a table is written, the shuffle files it was made from serve nothing; they are deleted at once, so that the disk holds those of one table
    at a time. The folder itself goes with the driver's JVM.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        before = {k: self.spark.conf.get(k) for k in WRITING}
        for k, v in WRITING.items():
            self.spark.conf.set(k, v)
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        if self.count == 1:
            root, files = self._path(self.root)
            files.deleteOnExit(root)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, number: int) -> None:
        """Deletes the table written as that number; nothing that is still read may stand on it."""
        path, files = self._path(f"{self.root}/{number}")
        files.delete(path, True)


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], dict[str, pa.Array | list]], schema: str, step: int = 500) -> DataFrame:
    """mapInArrow with a function from a few rows to the columns of as many; what Python holds at once is bounded by step."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, step) for b in batches for k in range(0, b.num_rows, step)):
            out = rows(batch)
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x, pa.Array) and x.type == f.type else (x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type)) for f in arrow for x in [out[f.name]]], schema=arrow
            )

    return df.mapInArrow(run, schema)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) of longs: rows (node, root), root the smallest node of the group.

    Large-star and small-star rounds: every node is linked to the smallest node it knows until nothing changes, so a chain
    of n links takes about log n rounds, each of a few shuffles. The smallest neighbours are joined back from an
    aggregate, not gathered, so no node's neighbours meet in one task. Nodes without an edge aren't returned.
    """
    e = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    seen = None
    while True:
        number = scratch.count
        state = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select("lo", "lo").distinct())
        seen = state
        both = e.union(e.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(small, "hi").where("lo <> m").select("lo", "m")
        e = scratch.write(moved.union(small.select("hi", "m")).toDF("hi", "lo").distinct())
        scratch.drop(number)


def is_file_scan(df: DataFrame) -> bool:
    """Whether the rows are those of files, projected or filtered at most."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() in ("LogicalRelation", "Relation")


#: So many files' names are sent to every task at most; with more, names are joined by a shuffle.
MOST_FILES = 100_000


def with_row_id(scratch: Scratch, docs: DataFrame, name: str) -> DataFrame:
    """Adds a long for each row, the same at every later reading, whatever executors are there then.

    Rows of files are numbered by their file's rank among the names and their place in it, which no split of the files changes. Any other
    rows are written with their numbers once and read from there.
    """
    if not is_file_scan(docs):
        return scratch.write(docs.withColumn(name, F.monotonically_increasing_id()))
    meta = docs.metadataColumn("_metadata")
    marked = docs.select("*", meta["file_path"].alias("_plumb_file"), meta["row_index"].alias("_plumb_at"))
    rank = F.row_number().over(Window.orderBy("_plumb_file")) - 1  # a row for each file
    files = scratch.write(marked.select("_plumb_file").distinct().withColumn("_plumb_rank", rank.cast("long")))
    if files.count() <= MOST_FILES:
        files = F.broadcast(files)
    number = F.shiftleft("_plumb_rank", 40) + F.col("_plumb_at")
    return marked.join(files, "_plumb_file").select(*docs.columns, number.alias(name))


#: Rows of one key that count as many: this share of all.
HOT_SHARE = 0.005


def join_spread(rows: DataFrame, by_key: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with by_key (one row for each key, with _rows, how many of rows have it), without _rows.

    Keys with HOT_SHARE of all rows or more, of which there are 1 / HOT_SHARE at most, are sent to where the rows are; only the others' rows are dealt out by key. A null key finds nothing.
    """
    many = F.col("_rows") >= max(2, int(total * HOT_SHARE))
    hot, cold = by_key.where(many).drop("_rows"), by_key.where(~many).drop("_rows")
    there = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return there.select(*rest.columns).union(rest)


def unsigned_hex(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))
