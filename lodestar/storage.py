"""Tables as they are read, and the folder, shared by all executors, for results that cut the lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _tasks(rows: DataFrame, cores: int) -> int:
    """Partitions of a scan that have rows: of few files no more than their row groups, as each is read whole by one task."""
    n, files = rows.rdd.getNumPartitions(), rows.inputFiles()
    if n < cores or len(files) >= cores:
        return n
    spark, groups = rows.sparkSession, 0
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for f in files:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)), conf))
        groups += reader.getFooter().getBlocks().size()
        reader.close()
    return min(n, groups)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's rows; those of few row groups, which as few tasks would read, are dealt out to all cores."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows if _tasks(rows, cores) >= cores else rows.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the folder set with setCheckpointDir; only a local session gets one of its own."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """df, written once and read back: its plan is a scan from then on."""
    place = fresh(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def remove(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
