"""What the operators share: tables, the shared folder, ranks without a global sort."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts that go to Python at once, in bytes; the setting's default of 64 MB is kept several times over by either side.
ARROW_BYTES = "8m"


def prepare(spark: SparkSession) -> None:
    """Sends the code to the executors, and bounds Arrow batches by bytes unless the session does so itself."""
    ship(spark)
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)
    if spark.conf.get(name, default).removesuffix("b") == default:
        spark.conf.set(name, ARROW_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset (local tests) a temporary folder takes its place and
    is noted in the session's settings.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.quillspan.shared.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="quillspan-")
        spark.conf.set("spark.quillspan.shared.dir", found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the session has ended: the folder's owner cleans it
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    The plan after it starts from files that every executor can read, so a lost
    executor costs only its own tasks. Removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspan-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops input columns whose names an operator's own output columns take (case-insensitively)."""
    own = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in own])


#: Rows of a cell that ranks are counted in, about.
CELL = 65536


def rank_within(df: DataFrame, group: str, hashed: Column, order: list, to: str, largest: int) -> DataFrame:
    """``to``: 0, 1, 2 ... within each ``group`` by ``hashed`` (a long) and ``order``, gapless, without a task per group.

    Rows are numbered inside cells, ranges of the hash, so many that one of the
    ``largest`` group has about CELL rows; cells are laid one after another by
    running sums over their counts. The ranks do not depend on the number of cells.
    """
    bits = min(max(int(largest // CELL).bit_length(), 8), 40)
    cell = df.withColumn("__hash", hashed).withColumn("__cell", F.shiftright("__hash", 64 - bits))
    counts = cell.groupBy(group, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(group).alias("__g"), F.col("__cell").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    inside = Window.partitionBy(group, "__cell").orderBy("__hash", *order)
    numbered = cell.withColumn("__row", F.row_number().over(inside) - 1)
    same = (F.col(group).eqNullSafe(F.col("__g"))) & (F.col("__cell") == F.col("__s"))
    placed = numbered.join(starts, same, "left").withColumn(to, F.col("__row") + F.col("__start"))
    return placed.drop("__hash", "__cell", "__row", "__g", "__s", "__start")
