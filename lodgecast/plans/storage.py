"""Written intermediates.

A frame that is read more than once, or whose rows must keep the numbers they were given, is
written to the shared scratch folder and read back. Unlike a cached frame it outlives lost
executors, and being Parquet it keeps column pruning and true size estimates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgecast.session import scratch_path


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and return a scan of what was written."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files made inside the block go when the write or count that made them ends.

    Otherwise they stay until the driver happens to collect garbage. For blocks that read written
    intermediates and run no frame twice.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_frame(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A frame of a few rows as literals, so that no Python worker has to start for it."""
    fields = T.StructType.fromDDL(schema).fields
    records = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*records)))
