"""How many tasks a small input gets."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input per core from which a scan has tasks enough by itself.
ENOUGH = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` with a task per core if it is read from fewer files than there are cores.

    Work that is much dearer than reading, such as tokenizing, would run in one
    task where a small table lies in one file. Larger inputs are left as they
    are: their scan has tasks enough, and a shuffle would only cost.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > cores * ENOUGH:
        return df
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df
