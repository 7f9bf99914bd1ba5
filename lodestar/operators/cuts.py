"""Written copies that cut lineage, in the folder that all machines share, and tasks that stay as small however large the input is."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame

TASK_ROWS = 500_000


def tasks(df: DataFrame) -> int:
    """Shuffle partitions for so many rows: TASK_ROWS each, or the session's number. Rows of a table's plain columns are counted from the files' footers."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / TASK_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """A written copy of `df` in the folder that the cluster names. Only a local session may leave it unset: it gets a temporary one."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = os.path.join(tempfile.gettempdir(), "lodestar-checkpoints")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
