"""Small helpers around Spark that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def release() -> None:
    """Gives memory that this worker has freed back to the machine: workers outlive their tasks, and wait beside those of other steps."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library, which has no such call
        pass


def lean(run):
    """A function over a task's batches that leaves no freed memory with its worker."""

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return leaner


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset and Spark runs in one local process, as in tests, a temporary folder serves;
    on a cluster a missing setting is an error, since executors don't share local disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master or ""
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared folder, and go on from the files.

    The shuffles that led there are needed no more, but Spark deletes their files only once the driver's garbage collection finds them
    unused; a loop of many small shuffles would pile up files until then, so it is asked for here.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    tidy(df.sparkSession)
    return out


def tidy(spark: SparkSession) -> None:
    """Has the driver collect garbage, so that shuffle files of what is done are deleted before more are made."""
    spark.sparkContext._jvm.System.gc()


def extended(df: DataFrame, **new: str) -> tuple[DataFrame, T.StructType]:
    """df without columns of the new names (in any case), and its schema with the new columns added."""
    df = df.drop(*(c for c in df.columns if c.lower() in {n.lower() for n in new}))
    return df, T.StructType([*df.schema.fields, *(T.StructField(name, T._parse_datatype_string(kind)) for name, kind in new.items())])


#: Files whose numbers are broadcast: some megabytes of paths.
FILES = 1 << 16


def numbered(docs: DataFrame, name: str = "row") -> DataFrame:
    """docs with a long that tells its rows apart, and is the same whenever they are read again.

    Rows read straight from Parquet files are numbered by their file and their place in it, however a scan is split. Rows of anything else, or of more than
    FILES files, are first written to the shared folder and numbered from there.
    """
    docs = docs.drop(name)
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    except AnalysisException:
        placed = None  # not read from files
    if placed is not None:
        files = sorted(r["_file"] for r in placed.select("_file").distinct().limit(FILES + 1).collect())
        if len(files) <= FILES:
            known = docs.sparkSession.createDataFrame([(f, k) for k, f in enumerate(files)], "_file string, _of long")
            return placed.join(F.broadcast(known), "_file").select(*docs.columns, F.expr("shiftleft(_of, 40) | _place").alias(name))
    return checkpointed(docs).withColumn(name, F.monotonically_increasing_id())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, n_bytes: int, each: int = 128 << 20) -> int:
    """Partitions for a shuffle of so many bytes: the session's number, and more where that would leave over ``each`` to one."""
    return max(shuffle_partitions(spark), -(-n_bytes // each))


#: A key with more than this share of all rows is hot: there can't be more such keys than its inverse.
HOT = 1024
#: Partial results of so many tasks, or lanes of tasks, are combined at once.
LANES = 64


def join_unique(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """rows joined to groups, which hold each key once, with ``size``, the number of its rows.

    Keys of more than a HOT-th of all rows are at most HOT, so their groups are broadcast and their rows stay where they are; all
    other keys meet in a shuffle.
    """
    most = rows.count()
    fields = [c for c in groups.columns if c not in keys]
    hot = groups.where(F.col(size) * HOT > most).select(*(F.col(k).alias(f"hot_{k}") for k in keys), F.struct(F.lit(True).alias("is"), *fields).alias("hot"))
    cold = groups.where(F.col(size) * HOT <= most).select(*keys, F.struct(F.lit(True).alias("is"), *fields).alias("cold"))
    on = [F.col(k) == F.col(f"hot_{k}") for k in keys]
    near = rows.join(F.broadcast(hot), on, "left").drop(*(f"hot_{k}" for k in keys))
    away = near.where("hot is null").join(cold, keys, how)
    here = near.where("hot is not null").withColumn("cold", F.col("hot"))
    both = here.select(*rows.columns, "cold").union(away.select(*rows.columns, "cold"))
    return both.select(*rows.columns, *(F.col("cold")[c].alias(c) for c in fields))


def in_lanes(parts: DataFrame, by: str, merge, schema: str) -> DataFrame:
    """``merge`` over the rows of each ``by``, whose schema it keeps. parts: a row of each by a task; LANES tasks are combined at once, then LANES
    of these lanes, until one is left, so no group gathers a row of every task."""
    tasks = parts.rdd.getNumPartitions()
    while tasks > LANES:
        lanes = parts.withColumn("lane", F.expr(f"spark_partition_id() div {LANES}") if "lane" not in parts.columns else F.expr(f"lane div {LANES}"))

        def some(rows: pa.Table) -> pa.Table:
            out = merge(rows.drop_columns(["lane"]))
            return out.append_column("lane", pa.array([rows["lane"][0].as_py()] * out.num_rows, pa.int64()))

        parts = lanes.groupBy(by, "lane").applyInArrow(some, f"{schema}, lane long")
        tasks = -(-tasks // LANES)
    return parts.drop("lane").groupBy(by).applyInArrow(merge, schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: (node, root), root the smallest id reached.

    Alternates the large-star and small-star steps, which keep the components and
    turn each into a star around its smallest id in few rounds. Every step is a grouped
    minimum (combined before its shuffle) and an equi-join whose large keys AQE
    may split; nothing gathers at the driver but one checksum a round.
    Self-loops and repeated edges are allowed; no edges give no rows.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        # large-star: each node hands its larger neighbours its smallest neighbour
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: each node hands its smaller neighbours, and itself, the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(least, "a")
        now = checkpointed(
            down.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        )
        check = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if check == seen:
            break
        seen = check
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
