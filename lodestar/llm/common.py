"""Shared plumbing: scratch tables in the shared folder, sizing, and hashed document groups."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Target size of a group of whole texts that one Python worker holds at a time.
GROUP_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only a session without other machines (tests) may leave it unset: it gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="lodestar-")
        spark.sparkContext.setCheckpointDir(found)
        found = "file://" + found
    return found


class Scratch:
    """Written tables that cut lineage. A lost executor rereads them; drop() frees those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write and reread; the shuffle files of this one execution go as soon as it has ended, since nothing rereads them."""
        conf, key = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key, "false")
        conf.set(key, "true")
        try:
            df.write.option("compression", "zstd").mode("overwrite").parquet(self.path(name))
        finally:
            conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts: one scan of one column, one row to the driver."""
    return int(docs.agg(F.sum(F.octet_length(F.col(column))).alias("b")).first()["b"] or 0)


def group_count(spark: SparkSession, total_bytes: int, group_bytes: int = GROUP_BYTES) -> int:
    """So many hashed groups that each holds about group_bytes, and several for each shuffle partition."""
    return max(4 * shuffle_partitions(spark), math.ceil(total_bytes / group_bytes))


def spread(n: int, *columns: str | Column) -> Column:
    """A group number in [0, n), even for any distribution of the columns' values."""
    return F.pmod(F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in columns]), F.lit(n)).cast("int")


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer file; LODESTAR_TOKENIZERS may name another folder."""
    folder = os.environ.get("LODESTAR_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
