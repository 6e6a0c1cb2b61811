"""The shared folder, tables written there to cut lineage, and joins that hot keys do not slow."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few small columns that may be broadcast, by count.
BROADCAST_ROWS = 2_000_000
#: Parts into which a key's rows are dealt where the other side is too large for a broadcast.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a new folder where that is unset on a local master, an error on any other."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="driftmesh-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that materialize() wrote and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.startswith(shared_dir(spark)):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like `name` that no frame has, in any case of letters."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df to be broadcast if it has so few rows, else as it is, for a join by shuffle. df should be read from a table."""
    return F.broadcast(df) if df.count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as the cluster runs tasks, for narrow work that costs far more than its rows: a
    table of few files is dealt anew, one of many stays as it is, and so does what a shuffle has dealt already."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df  # to ask for its partitions would run the shuffle
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def look_up(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", most_rows: int | None = None) -> DataFrame:
    """rows joined by `key` with a table that has one row per key, whatever share of the rows one key has.

    The table is broadcast if it is small, by most_rows (a bound that is known) or by count (it should then be read from
    a written table); else it is repeated for each salt, and a key's rows are dealt over the salts by all their columns.
    """
    if (table.count() if most_rows is None else most_rows) <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, how)
    salt = fresh("salt", rows, table)
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    copies = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [key, salt], how).drop(salt)
