"""Statistics of linear probing: how far each key of a stream, in order, lands from its home slot.

Which slots end up taken does not depend on the order, so the table falls into runs of taken slots that keys never leave. Runs
come from running minima of (keys before a slot) - (slot), over counts per slot; each run is then filled in order, side by side.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 1 << 16


def table_size(keys: int, load: float = 0.75) -> int:
    if not 0 < load < 1:
        raise ValueError("the load factor must lie between 0 and 1")
    return 1 << max(0, math.ceil(math.log2(max(1, math.ceil(keys / load)))))


def _running(slots: DataFrame, size: int) -> DataFrame:
    """(slot, run): slots of keys, over two turns around the table, so that runs across its end are seen whole."""
    both = slots.unionAll(slots.select((F.col("slot") + size).alias("slot"), "n")).withColumn("wide", F.floor(F.col("slot") / WIDTH))
    sums = both.groupBy("wide").agg(F.sum("n").alias("m"))
    above = F.coalesce(F.sum("m").over(W.orderBy("wide").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row for WIDTH slots
    inside = F.coalesce(F.sum("n").over(W.partitionBy("wide").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    level = both.withColumn("in", inside).join(sums.select("wide", above.alias("above")), "wide").select("wide", "slot", (F.col("above") + F.col("in") - F.col("slot")).alias("level"))
    lows = level.groupBy("wide").agg(F.min("level").alias("low"))
    before = F.min("low").over(W.orderBy("wide").rowsBetween(W.unboundedPreceding, -1))
    low = F.min("level").over(W.partitionBy("wide").orderBy("slot").rowsBetween(W.unboundedPreceding, 0))
    joined = level.withColumn("own", low).join(lows.select("wide", before.alias("before")), "wide")
    return joined.where(F.col("slot") >= size).select((F.col("slot") - size).alias("slot"), F.least("own", "before").alias("run"))


def probe_statistics(keys: DataFrame, key: str, home: str, order: str, load: float = 0.75) -> DataFrame:
    """One row: keys, entries, duplicates, size, collisions, total_probe, max_probe. `home` is a key's hash, `order` its place in the stream."""
    total = keys.count()
    size = table_size(total, load)
    first = keys.groupBy(F.col(key).alias("k"), F.pmod(F.col(home), F.lit(size)).cast("long").alias("slot")).agg(F.min(order).alias("o"))
    taken = first.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    entries = first.count()
    if not entries:
        return keys.sparkSession.createDataFrame([(total, 0, total, size, 0, 0, 0)], COLUMNS)
    # a turn lowers the level by the free slots, so a run's level modulo their number is its name
    runs = _running(taken, size).withColumn("part", F.floor(F.pmod("run", F.lit(size - entries)) / WIDTH)).select("slot", "part")

    def filled(rows: pd.DataFrame) -> pd.DataFrame:
        used, far, moved, most = set(), 0, 0, 0
        for slot in rows.sort_values("o")["slot"].tolist():
            steps = 1
            while slot in used:
                slot, steps = (slot + 1) % size, steps + 1
            used.add(slot)
            far, moved, most = far + steps, moved + (steps > 1), max(most, steps)
        return pd.DataFrame({"collisions": [moved], "total_probe": [far], "max_probe": [most]})

    parts = first.join(runs, "slot").groupBy("part").applyInPandas(filled, "collisions long, total_probe long, max_probe long")
    out = parts.agg(F.sum("collisions").alias("collisions"), F.sum("total_probe").alias("total_probe"), F.max("max_probe").alias("max_probe"))
    literals = {"keys": total, "entries": entries, "duplicates": total - entries, "size": size}
    return out.select(*(F.lit(v).cast("long").alias(k) for k, v in literals.items()), "collisions", "total_probe", "max_probe")


COLUMNS = "keys long, entries long, duplicates long, size long, collisions long, total_probe long, max_probe long"
