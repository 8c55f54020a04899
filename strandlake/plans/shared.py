"""Tables in the shared folder: how plans cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).

    Only where a local session names none, as in tests, a temporary folder is set; on a cluster that is an error, as
    no folder of one machine is the others'.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        context = spark.sparkContext
        path = context.getCheckpointDir()
        if path is None:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="strandlake-"))
            path = context.getCheckpointDir()
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in this application's part of it."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/strandlake/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written to the shared folder: at its end, once no result is read any more."""
    _delete(spark, _own_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread: computed once, free of
    lineage, and readable whichever executor is lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandlake_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later step reads."""
    for df in tables:
        path = getattr(df, "_strandlake_path", None)
        if path:
            _delete(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer partitions than these (one small file, say): only then rows are shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def small(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows, found by reading no more than that."""
    return df.limit(most + 1).count() <= most


def null_safe_join(big: DataFrame, table: DataFrame, key: str, *, most: int = 10_000, salts: int = 32) -> DataFrame:
    """Left join of ``table`` (one row a key, nulls a key like others) to ``big`` on ``key``.

    ``table`` is broadcast only after a check that it has at most ``most`` rows. Beyond
    that both sides are shuffled on the key and a salt, so that a key with a third of
    the rows is dealt to ``salts`` tasks.
    """
    other = table.withColumnRenamed(key, "_join_key")
    if small(table, most):
        return big.join(F.broadcast(other), big[key].eqNullSafe(other["_join_key"]), "left").drop("_join_key")
    plain = [F.col(f"`{c}`") for c, kind in big.dtypes if not kind.startswith(("map", "variant"))]
    left = big.withColumn("_join_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    right = other.withColumn("_join_salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = left[key].eqNullSafe(right["_join_key"]) & (left["_join_salt"] == right["_join_salt_r"])
    return left.join(right, on, "left").drop("_join_key", "_join_salt", "_join_salt_r")
